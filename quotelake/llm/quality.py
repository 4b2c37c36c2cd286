"""Quality classifier: ordinal cumulative-link regression on graded ratings, with hashed-text weights shared by grades."""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm.common import WordHashes, texts

#: Ratings are fitted on at most so many labelled rows, those with the smallest hash of their doc_id.
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7)
KINDS = 64
#: A bucket is fitted when its documents' grades differ from the others' by this likelihood ratio statistic at least: of
#: the many buckets that say nothing about grades about one in 10,000 gets through.
LEAST_RATIO = 18.0
#: Documents are selected from this chance of the best grade on.
LEAST_CLEAN = 0.8
ROUNDS = 200
STEP = 0.1
#: On the mean loss, so per document: 0.001 * |w|**2 / 2. It keeps what only groups of near copies share small.
PENALTY = 0.001
#: A share s of words of a kind counts as this times sqrt(s).
KIND_SCALE = 4.0

_TAIL = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")
_HEAD = re.compile(rb"^[^0-9A-Za-z\x80-\xff]+")


class Words(dict):
    """word bytes -> (buckets as int32 bytes, kind). Buckets are hashes of the lower-cased word without marks around it
    and of its beginnings of PREFIXES characters (languages inflect at the end); the kind tells case, digits and the
    marks that follow. Forgets all when full."""

    def __init__(self):
        self.hashes = WordHashes()

    def __missing__(self, word: bytes) -> tuple[bytes, int]:
        if len(self) >= 400_000:
            self.clear()
        marks = _TAIL.search(word)
        tail = marks.group() if marks else b""
        core = _HEAD.sub(b"", word[: len(word) - len(tail)]).decode()
        case = 0 if not core else 1 if len(core) > 1 and core.isupper() else 2 if any(c.isdigit() for c in core) else 3
        mark = 0 if tail in (b"", b".", b",") else 1 + self.hashes[tail[:3]] % 15
        core = core.lower()
        keys = [core, *(f"{n} {core[:n]}" for n in PREFIXES if len(core) > n)] if core else ["\x00" + tail[:3].decode(errors="replace")]
        value = self[word] = (np.array([self.hashes[k.encode()] % BUCKETS for k in keys], np.int32).tobytes(), case * 16 + mark)
        return value


#: One memo for all tasks that a Python worker runs.
_WORDS = Words()


def features(words: list[bytes], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: 1 for each bucket that occurs, then the shares of kinds and of words that repeat the word
    before, behind the buckets."""
    n = len(words)
    counts = Counter(words)
    found = [known[w] for w in counts]
    buckets = np.unique(np.frombuffer(b"".join([b for b, _ in found]), np.int32))
    share = np.bincount(np.array([k for _, k in found], np.int64), np.fromiter(counts.values(), np.float64, len(counts)), KINDS + 1)
    share[KINDS] = sum(map(operator.eq, words[1:], words))
    kinds = np.flatnonzero(share)
    return np.r_[buckets, BUCKETS + kinds], np.r_[np.ones(len(buckets)), KIND_SCALE * np.sqrt(share[kinds] / max(n, 1))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def counted(index: np.ndarray, size: int, step: int = 1 << 20) -> np.ndarray:
    """How often each number below `size` comes, by parts: counting copies its input to wider numbers."""
    return sum((np.bincount(index[a : a + step], minlength=size) for a in range(0, len(index), step)), np.zeros(size, np.int64))


def informative(index: np.ndarray, grade_of: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
    """Which features tell grades apart (G test of presence by grade); kinds always stay."""
    some = counted(index, size)
    part = some / max(totals.sum(), 1)
    ratio = np.zeros(size)
    for g, total in enumerate(totals):
        have = counted(index[grade_of == g], size)
        for seen, chance in ((have, part), (total - have, 1 - part)):
            ratio += 2 * seen * np.log(np.where(seen > 0, seen / np.maximum(total * chance, 1e-300), 1))
    return (ratio >= LEAST_RATIO) | (np.arange(size) >= BUCKETS) & (some > 0)


class Ordinal:
    """P(grade > k) = sigmoid(x . w - thresholds[k]) with rising thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, fitted: bool = True):
        self.weights, self.thresholds, self.fitted = weights, thresholds, fitted

    def tails(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(score[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_grades: int) -> Ordinal:
        """Full-batch Adam on the mean negative log likelihood. Thresholds are a first one and logs of the steps."""
        size = BUCKETS + KINDS + 1
        if not len(grades):
            return cls(np.zeros(size), np.zeros(n_grades - 1), False)
        n, index = len(rows), np.concatenate(rows)
        row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
        del rows
        use = informative(index, grades.astype(np.int8)[row], np.bincount(grades, minlength=n_grades), size)[index]
        index, value, row = index[use], np.concatenate(values)[use].astype(np.float64), row[use]
        del values
        columns, index = np.unique(index, return_inverse=True)
        k = n_grades - 1
        share = np.array([(grades > i).sum() for i in range(k)])
        start = np.log((n - share + 0.5) / (share + 0.5))
        start = np.maximum.accumulate(start + np.arange(k) * 1e-3)
        p = np.r_[np.zeros(len(columns)), start[0], np.log(np.diff(start) + 1e-3)]
        m, v = np.zeros_like(p), np.zeros_like(p)
        d = len(columns)
        each = np.arange(n)
        for t in range(1, ROUNDS + 1):
            w, step = p[:d], np.exp(p[d + 1 :])
            theta = p[d] + np.r_[0, np.cumsum(step)]
            score = np.bincount(row, value * w[index], minlength=n)
            tail = np.c_[np.ones(n), sigmoid(score[:, None] - theta), np.zeros(n)]
            slope = tail * (1 - tail)
            chance = np.maximum(tail[each, grades] - tail[each, grades + 1], 1e-12)
            up, down = slope[each, grades] / chance, slope[each, grades + 1] / chance
            by_score = -(up - down) / n
            by_theta = np.zeros((n, k + 2))
            by_theta[each, grades] += up / n
            by_theta[each, grades + 1] -= down / n
            by_theta = by_theta[:, 1 : k + 1].sum(axis=0)
            by_step = np.cumsum(by_theta[::-1])[::-1][1:] * step
            g = np.r_[np.bincount(index, value * by_score[row], minlength=d) + PENALTY * w, by_theta.sum(), by_step]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights = np.zeros(size)
        weights[columns] = p[:d]
        return cls(weights, p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))])


def _encoded(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WORDS
        for batch in batches:
            found = [features(t.split(), known) for t in texts(batch.column(1))]
            index = pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary())
            shares = pa.array([x[i >= BUCKETS].tobytes() for i, x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), index, shares, batch.column(2)], ["grade", "index", "shares", "place"])

    ready = rows.select("grade", "text", F.xxhash64("doc_id").alias("place"))
    return ready.mapInArrow(run, "grade int, index binary, shares binary, place long")


def grade(quality: Column, toxic: Column) -> Column:
    """0 for junk, 1 for sound but toxic text, 2 for sound and clean text; null where a rating is missing."""
    return F.when(quality == 0, 0).when(quality != 0, F.when(toxic != 0, 1).when(toxic == 0, 2)).cast("int")


def _fitted(sample: DataFrame) -> DataFrame:
    """One row, the model fitted on the rows of a table of one partition. Copies count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            seen.update(zip(*(batch.column(c).to_pylist() for c in ("index", "shares", "grade")), strict=True))
        rows = sorted(seen)
        del seen
        grades = np.array([g for _, _, g in rows], np.int64)
        value = [np.r_[np.ones((len(i) // 4 - len(x) // 8), np.float32), np.frombuffer(x).astype(np.float32)] for i, x, _ in rows]
        index = [np.frombuffer(x, np.int32) for x, _, _ in rows]
        model = Ordinal.fit(index, value, grades, 3)
        at = np.flatnonzero(model.weights)
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (at, model.weights[at], model.thresholds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([model.fitted])], ["at", "weights", "thresholds", "fitted"])

    return sample.mapInArrow(run, "at binary, weights binary, thresholds binary, fitted boolean")


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fits at most `sample_rows` labelled rows in one task; the model's weights that are not 0 reach the driver. The
    sample is the rows with the smallest hash of their doc_id, and of their text where doc_ids repeat."""
    rated = labels.select(F.col("doc_id").alias("rated_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = rated.where("grade is not null and rated_id is not null")
    sample = rated.orderBy(F.xxhash64("rated_id"), "rated_id", "grade").limit(sample_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("rated_id"))
    # repeated doc_ids can't make the sample larger than stated
    bounded = _encoded(rows).orderBy("place", "grade", "index", "shares").limit(sample_rows).drop("place")
    found = _fitted(bounded.coalesce(1)).first()
    if found is None:
        return Ordinal.fit([], [], np.empty(0, np.int64), 3)
    weights = np.zeros(BUCKETS + KINDS + 1)
    weights[np.frombuffer(found.at, np.int64)] = np.frombuffer(found.weights)
    return Ordinal(weights, np.frombuffer(found.thresholds), found.fitted)


SCORES = "expected_grade double, p_sound double, p_clean double, selected boolean"
SCORE_NAMES = [x.split()[0] for x in SCORES.split(", ")]


def classify(documents: DataFrame, labels: DataFrame, *, least: float = LEAST_CLEAN, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents with expected_grade (0 to 2), p_sound = P(grade >= 1), p_clean = P(grade = 2) and selected, which is
    p_clean >= `least`.

    The model is fitted on a bounded sample of rated documents (train) and scores all whole texts. Without any usable
    rating all probabilities are null and every document is selected. Null text counts as empty, and an empty text has
    the thresholds' base chance; null doc_ids are scored; repeated rows get equal scores and an empty table gives no
    rows. Documents keep their columns; one that is named like a score column is replaced.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(train(documents, labels, sample_rows))
    names = SCORE_NAMES
    columns = [c for c in documents.columns if c not in names]
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fitted = _WORDS, model.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, text in enumerate(texts(batch.column(place))):
                index, value = features(text.split(), known)
                score[i] = fitted.weights[index] @ value
            tails = fitted.tails(score)
            none = None if fitted.fitted else np.ones(len(score), bool)
            added = [*(pa.array(x, mask=none) for x in (tails.sum(axis=1), tails[:, 0], tails[:, 1])), pa.array((tails[:, 1] >= least) | (not fitted.fitted))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*columns, *names])

    kept = documents.select(*columns)
    schema = T.StructType(list(kept.schema.fields))
    for name, kind in (x.split() for x in SCORES.split(", ")):
        schema = schema.add(name, kind)
    return kept.mapInArrow(run, schema)
