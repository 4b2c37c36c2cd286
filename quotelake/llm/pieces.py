"""SentencePiece encoding and decoding with the tokenizers library: the model's protobuf is read here, and its
normaliser, metaspace marker, piece scores and byte fallback are rebuilt as a tokenizers pipeline."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MARK = "▁"
# The kinds of models and pieces of SentencePiece's model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: Texts are encoded in batches of about so many characters, which bounds what a worker holds.
BATCH_CHARS = 1_000_000
#: A worker remembers twice as many distinct stretches at most.
MEMO_STRETCHES = 200_000
#: Texts that every worker encodes with both libraries before it starts.
PROBES = ("", " ", "  two  spaces ", "a", "Hello, World's end.", "tab\tand\nline\r\n", "▁mark", "Ünḯcode É́ 日本語 🙂\U0010ffff", "<s> </s> <unk> <0x41>", "x" * 500, "the   " * 100, "\x00\x7f\xa0　")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed-width values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                if kind != 2:
                    raise ValueError(f"wire type {kind} in a model file")
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file holds, as far as encoding and decoding need it."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                out.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                out.kind, out.suffix_mark, out.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
            elif number == 3:
                rules = dict(_fields(value))
                out.charsmap, out.dummy_prefix, out.one_space, out.escape = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        if out.kind not in (UNIGRAM, BPE) or out.suffix_mark or not out.escape or any(k in (USER_DEFINED, UNUSED) for _, _, k in out.pieces):
            raise NotImplementedError("word and character models, suffix marks, plain white space, user-defined and unused pieces")
        return out

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that join to a piece, best piece first."""
        known = {p: (-s, i) for i, (p, s, k) in enumerate(self.pieces) if k == NORMAL}
        pairs = ((known[p], p[:i], p[i:]) for p in known for i in range(1, len(p)) if p[:i] in known and p[i:] in known)
        return [(a, b) for _, a, b in sorted(pairs)]

    def words(self) -> str:
        """A pattern of the stretches that no piece crosses the bounds of; empty where pieces cross spaces."""
        if any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k == NORMAL):
            return ""
        return f"{MARK}+[^{MARK}]*|[^{MARK}]+"

    def tokenizer(self) -> Tokenizer:
        unknown = next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)
        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unknown, byte_fallback=self.byte_fallback)
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            core = models.BPE(vocab, self.merges(), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(core)
        rules = []
        if self.charsmap:
            rules.append(normalizers.Precompiled(self.charsmap))
        if self.one_space:
            rules += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            rules.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*rules, normalizers.Replace(" ", MARK)])
        if pattern := self.words():
            out.pre_tokenizer = pre_tokenizers.Split(Regex(pattern), "isolated")
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if self.dummy_prefix else steps)
        return out


class Pieces:
    """Encodes and decodes batches; control pieces never come from a text.

    No piece crosses the bounds of the stretches of `Model.words`, so the library encodes each distinct stretch once (in
    multithreaded batches), and a bounded memo gives it to the texts. Models without such bounds encode whole
    texts. Ids decode by a table of their bytes, as the library's decoder (kept in `tokenizer`) would have them; bytes
    that are no UTF-8 become U+FFFD, control pieces nothing.
    """

    def __init__(self, data: bytes):
        model = Model.parse(data)
        self.tokenizer, self.model = model.tokenizer(), model
        self.words = re.compile(model.words()) if model.words() else None
        self.plain = not model.charsmap and not model.one_space
        self.stretches = model.tokenizer()
        self.stretches.normalizer = normalizers.Sequence([])
        self.stretches.pre_tokenizer = pre_tokenizers.Sequence([])
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = [bytes([int(p[1:-1], 16)]) if k == BYTE else {CONTROL: "", UNKNOWN: " ⁇ "}.get(k, p.replace(MARK, " ")).encode() for p, _, k in model.pieces]

    def _normal(self, text: str) -> str:
        if not self.plain:
            return self.tokenizer.normalizer.normalize_str(text)
        return (MARK if self.model.dummy_prefix and text else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.words is None:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self.words.findall(self._normal(t)) for t in texts]
        need = set().union(*parts)
        if len(self.memo) > MEMO_STRETCHES:
            # stretches that come again move to the new memo, so frequent ones are never forgotten
            self.memo, self.older = {}, self.memo
        missing = need.difference(self.memo)
        new = list(missing.difference(self.older))
        missing.difference_update(new)
        self.memo.update(zip(missing, map(self.older.__getitem__, missing), strict=True))
        for i in range(0, len(new), 2_000):
            some = new[i : i + 2_000]
            encoded = self.stretches.encode_batch_fast(some, add_special_tokens=False)
            self.memo.update(zip(some, (np.array(e.ids, np.int32).tobytes() for e in encoded), strict=True))
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, p)), np.int32) for p in parts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        out = []
        for row in ids:
            text = b"".join(map(self.bytes.__getitem__, row))
            if self.model.dummy_prefix and not text.startswith(" ⁇ ".encode()):
                text = text.removeprefix(b" ")
            out.append(text.decode(errors="replace"))
        return out


@lru_cache(maxsize=1)
def checked(model: bytes) -> Pieces:
    """The worker's coder, kept from task to task; refuses where the two libraries differ on PROBES."""
    if wrong := differences(model, list(PROBES)):
        raise ValueError(f"encoded differently: {wrong[:3]!r}")
    return Pieces(model)


def differences(model: bytes, texts: list[str]) -> list[str]:
    """The texts that this pipeline and the sentencepiece library encode or decode differently."""
    import sentencepiece

    plain, own = sentencepiece.SentencePieceProcessor(model_proto=model), Pieces(model)
    want, got = plain.encode(texts, num_threads=1), [x.tolist() for x in own.encode(texts)]
    return [t for t, w, g, d in zip(texts, want, got, own.decode(got), strict=True) if w != g or plain.decode(w) != d]


def _slices(lengths: list[int | None]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of rows of about BATCH_CHARS characters."""
    a = held = 0
    for i, n in enumerate(lengths):
        held += n or 0
        if held >= BATCH_CHARS:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(lengths):
        yield a, len(lengths)


def encode(documents: DataFrame, model: bytes) -> DataFrame:
    """documents (doc_id, text) with pieces, the ids of each whole text, in place of text.

    Null text counts as empty and has no ids; other columns are ignored; repeated rows come back as often as they came;
    an empty table gives no rows. A worker refuses to start where its pipeline and the sentencepiece library differ on
    PROBES.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = checked(shared.value)
        for batch in batches:
            for a, b in _slices(pc.utf8_length(batch.column("text")).to_pylist()):
                ids = coder.encode([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], ["doc_id", "pieces"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pieces array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, pieces with text, what the ids stand for; null pieces decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = checked(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = coder.decode([x or [] for x in part.column("pieces").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("pieces"), pa.array(text, pa.string())], ["doc_id", "pieces", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {kind}, pieces array<int>, text string")


def digest(documents: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_pieces, n_bytes (ids of byte fallback), ids_crc32 (of the ids as little-endian 32-bit numbers), and
    decoded_sha256 of what the ids decode to, for each row of documents. Cases as in `encode`."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    first = next((i for i, (_, _, k) in enumerate(Model.parse(model).pieces) if k == BYTE), -1)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = checked(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for a, b in _slices(pc.utf8_length(batch.column("text")).to_pylist()):
                ids = coder.encode([t or "" for t in batch.column("text").slice(a, b - a).to_pylist()])
                texts = coder.decode([x.tolist() for x in ids])
                for x, t in zip(ids, texts, strict=True):
                    fallback = int(((x >= first) & (x < first + 256)).sum()) if first >= 0 else 0
                    out.append((len(x), fallback, zlib.crc32(x.astype("<u4").tobytes()), hashlib.sha256(t.encode()).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, n_bytes long, ids_crc32 long, decoded_sha256 string")
