"""Substring dedup: suffix automata of reference shards find the maximal passages that smaller documents hold already."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import Powers, WordHashes, Workspace, rolling, signed, texts

WINDOW = 50
SHARD_WORDS = 65_536
PROBE_WORDS = 1_000_000
#: A window's places are split into SALTS parts where it has more than one in HEAVY_WINDOWS of all.
HEAVY_WINDOWS = 1_000
SALTS = 64
DOCUMENT = ["doc_id", "seq"]


class SuffixAutomaton:
    """All word runs of some reference passages. A passage is added from the root; `feed` gives, for each word of a
    probe, the length of the longest run that ends there and occurs in a passage (the matching statistics)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The state of the longest run through p and word: q itself, or a copy of q cut to that length."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, q, word)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p, last = last, new
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][word], word)

    def feed(self, words: list) -> Iterator[int]:
        step, link, length = self.next, self.link, self.length
        at = run = 0
        for word in words:
            to = step[at].get(word)
            while to is None and at:
                at = link[at]
                run = length[at]
                to = step[at].get(word)
            if to is not None:
                at = to
                run += 1
            yield run

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal (from, to) stretches of the words covered by matches of at least `least` words."""
        out: list[tuple[int, int]] = []
        for end, run in enumerate(self.feed(words), 1):
            if run >= least:
                if out and end - run <= out[-1][1]:
                    out[-1] = (min(out[-1][0], end - run), end)
                else:
                    out.append((end - run, end))
        return out


class Anchors:
    """Each window of `window` words is anchored at the least hash of its runs of k words, so equal windows have equal
    anchors; only about one run in twelve is an anchor."""

    def __init__(self, window: int):
        self.window, self.k = window, max(1, window // 2 - 1)
        self.hashes, self.powers = WordHashes(), Powers()

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and the anchor of each window."""
        h = self.hashes.of(words)
        least = rolling(h, self.k, self.powers) if len(words) >= self.window else h[:0]
        done, width = 1, self.window - self.k + 1
        while done < width and len(least):
            s = min(done, width - done)
            least = np.minimum(least[:-s], least[s:])
            done += s
        return h, least


def _sketch(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(window)
        for batch in batches:
            n, sha, found = [], [], []
            for text in texts(batch.column(2)):
                words = text.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                found.append(signed(np.unique(anchors(words)[1])))
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*DOCUMENT, "n_words", "sha", "anchors"])

    return rows.mapInArrow(run, "doc_id long, seq long, n_words long, sha binary, anchors array<long>")


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """hash, doc_id, seq and start of the windows whose anchor is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(window)
        for batch in batches:
            for doc, seq, text, shared in zip(batch.column(0), batch.column(1), texts(batch.column(2)), batch.column(3), strict=True):
                h, least = anchors(text.split())
                at = np.flatnonzero(np.isin(least, shared.values.to_numpy().view(np.uint64)))
                if len(at):
                    hashes = signed(rolling(h, window, anchors.powers)[at])
                    columns = [pa.array(hashes), pa.array(np.full(len(at), doc.as_py())), pa.array(np.full(len(at), seq.as_py())), pa.array(at.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["hash", *DOCUMENT, "start"])

    return candidates.mapInArrow(run, "hash long, doc_id long, seq long, start int")


def _passages(rows: DataFrame, window: int) -> DataFrame:
    """The words of a document's shared windows, merged to passages, for each shard that they are to meet."""
    names = ["owner", "shard", "is_probe", *DOCUMENT, "start", "n", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, seq, text, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3), strict=True):
                words = text.split()
                owner, shard, start = (hits.values.field(x).to_numpy() for x in ("owner", "shard", "start"))
                order = np.lexsort((start, shard, owner))
                owner, shard, start = owner[order], shard[order], start[order]
                cut = np.flatnonzero((owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1]) | (start[1:] > start[:-1] + window)) + 1
                firsts, lasts = np.r_[0, cut], np.r_[cut, len(start)] - 1
                a, b = start[firsts], start[lasts] + window
                blobs = [b" ".join(words[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                m = len(a)
                columns = [pa.array(owner[firsts]), pa.array(shard[firsts]), pa.array(owner[firsts] != doc), pa.array(np.full(m, doc)), pa.array(np.full(m, seq)), pa.array(a), pa.array(b - a), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "owner long, shard int, is_probe boolean, doc_id long, seq long, start int, n int, words binary")


def _matches(dealt: DataFrame, window: int) -> DataFrame:
    """Streams probes past the automaton of their shard; rows come sorted by shard, its passages first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = automaton = None
        for batch in batches:
            found = []
            for owner, shard, salt, is_probe, doc, seq, start, words in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if key != (owner, shard, salt):
                    key, automaton = (owner, shard, salt), SuffixAutomaton()
                if not is_probe:
                    automaton.add(words.split(b" "))
                else:
                    found += [(doc, seq, start + a, start + b) for a, b in automaton.spans(words.split(b" "), window)]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], [*DOCUMENT, "a", "b"])

    return dealt.mapInArrow(run, "doc_id long, seq long, a int, b int")


class Repeats:
    """What a corpus repeats: `sketches` (doc_id, seq, n_words, sha) has a row for each row of documents, where seq is
    a hash of the text; `spans` (doc_id, seq, spans) the stretches of words that smaller documents hold, for each
    document that has any; `copies` (doc_id, seq) the documents of which a smaller document has all words in order."""

    def __init__(self, documents: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, probe_words: int = PROBE_WORDS):
        spark = documents.sparkSession
        work = Workspace(spark, "substring")
        self.rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("seq"), "text")
        saved = work.save(_sketch(self.rows, window), "anchored")
        self.sketches = work.save(saved.drop("anchors"), "sketches")
        long_enough = (F.col("n_words") >= window) & F.col("doc_id").isNotNull()
        firsts = self.sketches.where(long_enough).groupBy("sha").agg(F.min("doc_id").alias("first"))
        self.copies = self.sketches.where(long_enough).join(firsts, "sha").where("doc_id > first").select(*DOCUMENT)
        # anchors that two documents share, and the documents that have any
        anchored = saved.where(long_enough).join(firsts, "sha").where("doc_id = first").dropDuplicates(DOCUMENT).select(*DOCUMENT, F.explode("anchors").alias("anchor"))
        shared = anchored.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
        with_shared = anchored.join(shared, "anchor").groupBy(*DOCUMENT).agg(F.collect_list("anchor").alias("anchors"))
        candidates = work.save(self.rows.join(with_shared, DOCUMENT).dropDuplicates(DOCUMENT).select(*DOCUMENT, "text", "anchors"), "candidates")
        work.drop("anchored")
        # the smallest document that has a window owns it; its window is part of a reference shard
        windows = work.save(_windows(candidates, window), "windows")
        owners = windows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"), F.min_by("start", "doc_id").alias("owner_start"))
        owners = work.save(owners.where("owner < top").drop("top"), "owners")
        # the windows that occur in more than 1 / HEAVY_WINDOWS of all places, so at most HEAVY_WINDOWS, meet their owner in
        # SALTS parts
        places = owners.agg(F.sum("n")).first()[0] or 0
        heavy = owners.where(F.col("n") * HEAVY_WINDOWS > places).select("hash", F.lit(SALTS).alias("salts"))
        part = lambda rows, salt: rows.join(F.broadcast(heavy), "hash", "left").withColumn("salt", salt).drop("salts")
        dealt_windows = part(windows, F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(*DOCUMENT, "start"), "salts")).otherwise(0).cast("int"))
        dealt_owners = part(owners.drop("n"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        hits = dealt_windows.join(dealt_owners, ["hash", "salt"]).where("owner < doc_id or start = owner_start")
        hit = F.struct("owner", F.floor(F.col("owner_start") / shard_words).cast("int").alias("shard"), "start")
        by_document = hits.select(*DOCUMENT, hit.alias("hit")).groupBy(*DOCUMENT).agg(F.collect_list("hit").alias("hits"))
        joined = candidates.join(by_document, DOCUMENT).select(*DOCUMENT, "text", "hits")
        passages = work.save(_passages(joined, window), "passages")
        work.drop("windows")
        work.drop("owners")
        # a shard that many probes meet is copied to several tasks
        salts = passages.where("is_probe").groupBy("owner", "shard").agg(F.ceil(F.sum("n") / probe_words).cast("int").alias("salts"))
        one = F.array(F.pmod(F.xxhash64(*DOCUMENT, "start"), F.col("salts")).cast("int"))
        dealt = passages.join(salts, ["owner", "shard"]).withColumn("salt", F.explode(F.when(F.col("is_probe"), one).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))))
        keys = ["owner", "shard", "salt"]
        dealt = dealt.select(*keys, "is_probe", *DOCUMENT, "start", "words").repartition(*keys).sortWithinPartitions(*keys, "is_probe")
        matches = work.save(_matches(dealt, window), "matches")
        work.drop("passages")
        self.spans = matches.groupBy(*DOCUMENT).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
        self.candidates = candidates


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The words that no span covers, and how many are covered."""
    words = text.split()
    keep = np.ones(len(words), bool)
    for a, b in spans:
        keep[a:b] = False
    return [words[i] for i in np.flatnonzero(keep)], int(len(words) - keep.sum())


def _cuts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [cut(t, [(s["a"], s["b"]) for s in spans]) for t, spans in zip(texts(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            text = [b" ".join(words).decode() for words, _ in kept]
            columns = [batch.column(0), batch.column(1), pa.array([n for _, n in kept], pa.int64()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*DOCUMENT, "n_removed", "kept_text"])

    return rows.mapInArrow(run, "doc_id long, seq long, n_removed long, kept_text string")


def removals(repeats: Repeats) -> DataFrame:
    """doc_id, seq, n_removed and kept_text (words joined by a space) of the documents that lose words."""
    part = _cuts(repeats.candidates.join(repeats.spans, DOCUMENT).select(*DOCUMENT, "text", "spans"))
    whole = repeats.sketches.join(repeats.copies.distinct(), DOCUMENT).dropDuplicates(DOCUMENT)
    return part.unionByName(whole.select(*DOCUMENT, F.col("n_words").alias("n_removed"), F.lit("").alias("kept_text")))


def digest(documents: DataFrame, *, window: int = WINDOW, **bounds: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of documents (doc_id, text).

    Words are what ASCII white space separates. A word goes if it is part of `window` consecutive words that also start
    in a document with a smaller doc_id, judged on the input. Texts that hold a smaller document's words and nothing
    else go as a whole. Window hashes only say which shard a passage is sent to; the shard's automaton decides.

    Null text has no words; a null doc_id is compared with nothing; rows of one doc_id don't shorten each other;
    repeated rows come back as often as they came; an empty table gives no rows; other columns are ignored.
    """
    repeats = Repeats(documents, window, **bounds)
    gone = removals(repeats).select(*DOCUMENT, "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("cut_sha"))
    out = repeats.sketches.join(gone, DOCUMENT, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha", F.lower(F.hex("sha"))).alias("kept_sha256"))


def remove_repeats(documents: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """documents with the columns they have; a text that loses words is its kept words joined by one space, other texts
    stay as they are, and n_chars, where there is one, follows the text."""
    gone = removals(Repeats(documents, window)).select(F.col("doc_id").alias("gone_id"), F.col("seq").alias("gone_seq"), "kept_text")
    at = (documents["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(documents["text"]) == gone["gone_seq"])
    text = F.when(gone["gone_id"].isNotNull(), gone["kept_text"]).otherwise(documents["text"])
    columns = [text.alias(c) if c == "text" else F.length(text).cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else documents[c] for c in documents.columns]
    return documents.join(gone, at, "left").select(*columns)
