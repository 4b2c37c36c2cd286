"""Token counts of whole texts, from batches of distinct stretches."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from quotelake.llm.common import texts
from quotelake.llm.packing import SPLIT_PATTERN

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Texts are read in parts, and the library is called on batches, of about so many bytes.
PART_BYTES, BATCH_BYTES = 1 << 20, 1 << 17
#: Counts of stretches that are remembered, and the longest of these.
MEMO, MEMO_BYTES = 500_000, 64
#: Where a text can be cut if the tokenizer drops white space and takes digits one by one: nothing is composed or joined
#: across ASCII white space or before an ASCII digit, and no special token holds either.
GAP = re.compile(rb"[\t-\r 0-9]")


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about `size` bytes that begin at a GAP; longer where it has none."""
    start = 0
    while len(text) - start > size:
        found = GAP.search(text, start + size)
        cut = found.start() if found else len(text)
        yield text[start:cut]
        start = cut
    yield text[start:]


def balanced(stretches: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Batches of about `size` bytes: the longest stretches first, each to the batch that has the fewest bytes."""
    batches: list[list[bytes]] = [[] for _ in range(max(1, -(-sum(map(len, stretches)) // size)))]
    loads = [(0, i) for i in range(len(batches))]
    for s in sorted(stretches, key=len, reverse=True):
        load, i = loads[0]
        batches[i].append(s)
        heapq.heapreplace(loads, (load + len(s), i))
    yield from filter(None, batches)


class Counter:
    """Number of tokens of texts, as the library counts them in whole texts.

    A .json file is read by tokenizers, a .model file by sentencepiece. Where the file's pre-tokenizer drops white space
    and takes digits one by one (SPLIT_PATTERN), a text's tokens are those of its words and each distinct word is encoded
    once, in batches; other tokenizers get texts whole.
    """

    def __init__(self, tokenizer_file: str):
        self.memo: dict[bytes, int] = {}
        if tokenizer_file.endswith(".json"):
            from tokenizers import Tokenizer

            self.cuts = json.dumps(json.loads(Path(tokenizer_file).read_text())["pre_tokenizer"]).find(SPLIT_PATTERN) >= 0
            tokenizer = Tokenizer.from_file(tokenizer_file)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.lengths = lambda batch: [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        else:
            import sentencepiece

            self.cuts = False
            processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file)
            self.lengths = lambda batch: [len(ids) for ids in processor.encode(batch)]

    def stretches(self, part: bytes) -> list[bytes]:
        words = part.split()
        if part and len(part) > 2 * MEMO_BYTES * len(words):  # long runs without white space
            words = [s for w in words for s in parts(w, MEMO_BYTES)]
        return words

    def learn(self, stretches: set[bytes]) -> None:
        """Have the counts of these stretches in the memo."""
        if len(self.memo) + len(stretches) > MEMO:
            self.memo.clear()
        for batch in balanced([s for s in stretches if s not in self.memo], BATCH_BYTES):
            self.memo.update(zip(batch, self.lengths([s.decode() for s in batch]), strict=True))

    def counts(self, rows: list[bytes]) -> list[int]:
        """Number of tokens of each text."""
        if not self.cuts:
            out: list[int] = []
            held: list[bytes] = []
            for i, text in enumerate(rows):
                held.append(text)
                if i + 1 == len(rows) or sum(map(len, held)) >= BATCH_BYTES:
                    out += self.lengths([t.decode() for t in held])
                    held = []
            return out
        out = [0] * len(rows)
        group: list[tuple[int, list[bytes]]] = []
        size = 0

        def count() -> None:
            stretches = set().union(*(words for _, words in group))
            self.learn(stretches)
            for i, words in group:
                out[i] += sum(map(self.memo.__getitem__, words))
            for s in stretches:
                if len(s) > MEMO_BYTES:
                    del self.memo[s]

        for i, text in enumerate(rows):
            for part in parts(text, PART_BYTES):
                group.append((i, self.stretches(part)))
                size += len(part)
                if size >= PART_BYTES:
                    count()
                    group, size = [], 0
        count()
        return out


#: One counter a tokenizer for all tasks that a Python worker runs.
_COUNTERS: dict[str, Counter] = {}


def token_counts(documents: DataFrame, tokenizer_file: str, *, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of each row of (doc_id, text).

    No begin, end or other tokens are added, strings of special tokens in a text count as the library's default has it,
    nothing is truncated or padded. A null text is empty (no tokens), a null doc_id stays null, repeated rows give as many
    rows, other columns are ignored, an empty table gives no rows. Only lengths leave the tasks and nothing is shuffled;
    memory holds one Arrow batch of texts, the words of about a megabyte, and a bounded memo. A text is longer than a part
    only where it has a run of that length with neither white space nor digits; the library gets such a run whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _COUNTERS:
            _COUNTERS[tokenizer_file] = Counter(tokenizer_file)
        counter = _COUNTERS[tokenizer_file]
        for batch in batches:
            rows = texts(batch.column(1))
            n = counter.counts(rows)
            columns = [batch.column(0).cast(pa.int64()), pa.array(map(len, rows), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
