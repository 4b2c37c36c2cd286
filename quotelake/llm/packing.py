"""Packing token ids into training sequences by online sum-of-squares placement."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quotelake.llm.common import texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
MEMO_WORDS = 800_000
ROWS_OUT = 20_000
#: The pre-tokenizer's pattern as it stands in such tokenizer files; a fixed value.
SPLIT_PATTERN = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: How the tokenizer file of the packing query cuts lower-cased words of LATIN characters; a fixed value.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿā-į]+|[0-9]|[^a-zß-öø-ÿā-į0-9]+")
#: Printable ASCII and composed Latin letters, each lower-cased to one such character: no special token, nothing to
#: normalise but case.
LATIN = re.compile(r"(?:(?!<\|)[!-~À-ÖØ-öø-į])+")


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write bytes as characters: those of printable Latin-1 as they are, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Word between ASCII white space -> its ids as little-endian uint32 bytes.

    The tokenizer's pre-tokenizer never joins characters across ASCII white space, and its normalizer composes nothing
    across it, so the ids of a text are those of its words in turn. LATIN words are lower-cased, cut as the
    pre-tokenizer cuts them (`cuts`, where the file is one that does so) and handed to the tokenizer's model part by
    part, all other words to the whole tokenizer. Memory is bounded: full memos forget all.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.cuts = json.dumps(json.loads(Path(tokenizer_file).read_text())["pre_tokenizer"]).find(SPLIT_PATTERN) >= 0
        self.parts: dict[str, bytes] = {}
        self.byte_character = byte_characters()

    def whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= MEMO_WORDS:
                self.parts.clear()
            written = part if part.isascii() else "".join(map(self.byte_character.__getitem__, part.encode()))
            found = self.parts[part] = array("I", [x.id for x in self.model.tokenize(written)]).tobytes()
        return found

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        text = word.decode()
        if self.cuts and LATIN.fullmatch(text):
            ids = b"".join(map(self.part, PARTS.findall(text.lower())))
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


#: One memo for all tasks that a Python worker runs.
_ENCODERS: dict[str, WordIds] = {}


class Packer:
    """Windows of `size` ids. Full pieces fill windows of their own; each rest goes to the fill level that makes the sum
    of squared counts of partially filled windows smallest (a tie: the fullest result), tracked in an array of levels.
    At the end the fullest open windows keep their pieces and are filled up with cut pieces of the emptiest, as few as
    their gaps need; what these have left over goes into power-of-two windows: no padding."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.next = size, first_sequence
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.rows: list[tuple] = []

    def close(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def level(self, n: int) -> int:
        """The fill level to put n ids on; 0 opens a window."""
        N, size = self.levels, self.size
        change = np.empty(size - n + 1, np.int64)
        change[:] = 2 * N[n:] + 1
        change[-1] = 0  # a full window is no partially filled one
        change[1:] -= 2 * N[1 : size - n + 1] - 1
        change[1:][N[1 : size - n + 1] == 0] = np.iinfo(np.int64).max
        return size - n - int(np.argmin(change[::-1]))

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.size
        whole = len(ids) // step * step
        for a in range(0, whole, step):
            self.close([(doc, a // 4, ids[a : a + step], total)])
        n = (len(ids) - whole) // 4
        if not n:
            return
        at = self.level(n)
        window = []
        if at:
            window = self.open[at].pop()
            self.levels[at] -= 1
        window.append((doc, whole // 4, ids[whole:], total))
        if at + n == self.size:
            self.close(window)
        else:
            self.open[at + n].append(window)
            self.levels[at + n] += 1

    def finish(self) -> None:
        fill = [(at, w) for at in sorted(self.open, reverse=True) for w in self.open[at]]
        # as many windows as all their ids fill
        kept, left = divmod(sum(at for at, _ in fill), self.size)
        pieces = iter([p for _, w in reversed(fill[kept:]) for p in w])
        held: tuple = (None, 0, b"", 0)

        def take(want: int) -> list[tuple]:
            nonlocal held
            out = []
            while want:
                if not held[2]:
                    held = next(pieces)
                doc, start, ids, total = held
                part = ids[: 4 * want]
                out.append((doc, start, part, total))
                held = (doc, start + len(part) // 4, ids[len(part) :], total)
                want -= len(part) // 4
            return out

        for at, window in fill[:kept]:
            self.close(window + take(self.size - at))
        while left:
            want = min(self.size, 1 << (left.bit_length() - 1))
            left -= want
            self.close(take(want))
        self.open.clear()
        self.levels[:] = 0

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(NAMES)
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)
        self.rows = []
        return batch


def pack(documents: DataFrame, tokenizer_file: str, *, end_id: int = 2, size: int = 4096) -> DataFrame:
    """One row per piece of a document's ids (its tokens, then `end_id`): see SCHEMA.

    Each task packs the documents it reads, one by one, and numbers its sequences from its partition, so nothing is
    shuffled and memory holds one batch of documents and the open windows only. Null text counts as empty (the end id
    alone), a null doc_id is kept as null, repeated rows are packed as often as they come, other columns are ignored,
    and an empty table gives no rows. Texts of any length are cut into as many pieces as they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _ENCODERS:
            _ENCODERS[tokenizer_file] = WordIds(tokenizer_file)
        encode = _ENCODERS[tokenizer_file]
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(size, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                packer.add(doc, encode.of(text) + end)
                if len(packer.rows) >= ROWS_OUT:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
