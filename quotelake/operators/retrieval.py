"""Retrieval over postings, n-gram keys and vectors."""

from __future__ import annotations

from itertools import batched, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotelake.functions.text import bound, fragment, ngrams, tokens, unit
from quotelake.operators.vectors import in_blocks, top_k


def postings(documents: DataFrame) -> DataFrame:
    """word, doc_id, once for each word of a document."""
    return documents.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))


def weights(posts: DataFrame, n_documents: DataFrame) -> DataFrame:
    """df of each word, idf = ln((N + 1) / (df + 1)) and the weight 1 + sqrt(max(0, idf)). n_documents is one row, n."""
    df = posts.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1))
    return df.crossJoin(F.broadcast(n_documents)).select("word", "df", F.round(idf, 6).alias("idf"), F.round(1 + F.sqrt(F.greatest(F.lit(0.0), idf)), 6).alias("weight"))


def rarest_words(items: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """The k rarest known words of each item, ties in order of words."""
    words = items.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    known = posts.join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    order = Window.partitionBy("item_id").orderBy("df", "word")
    return words.join(known, "word").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "word", "df")


def intersection(items: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """Documents that have all of an item's k rarest words."""
    rare = rarest_words(items, posts, k)
    need = rare.groupBy("item_id").agg(F.count("*").alias("need"))
    hits = posts.join(rare, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    return hits.join(need, "item_id").where("hits = need").select("item_id", "doc_id", "hits")


def union_ranked(items: DataFrame, posts: DataFrame, k: int, most: int) -> DataFrame:
    """Documents by how many of the k rarest words they have, the best `most` of each item."""
    hits = posts.join(rarest_words(items, posts, k), "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def gram_hits_of(items: DataFrame, documents: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """item_id, doc_id, n, hits, coverage: distinct n-grams of the given sizes that an item and a document share, and their
    share of the item's. Documents are read and cut into words once; their n-grams are rows of the join at once, not
    arrays, and only those that an item has go on and are counted once for each document row."""

    def rows(df: DataFrame, *keys: str) -> DataFrame:
        words = df.select(*keys, F.explode(F.array(F.struct(tokens(F.col("text")).alias("w")))).alias("x")).select(*keys, F.col("x.w").alias("w"))
        words = words.where(F.size("w") >= min(sizes))
        at = words.select(*keys, "w", F.explode(F.sequence(F.lit(1), F.size("w") - (min(sizes) - 1))).alias("at"))
        gram = lambda n: F.when(F.col("at") + (n - 1) <= F.size("w"), F.array_join(F.slice("w", F.col("at"), n), " "))
        found = at.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("n"), gram(n).alias("gram")) for n in sizes))).alias("x"))
        return found.select(*keys, "x.n", "x.gram").where("gram is not null")

    def grams(df: DataFrame) -> DataFrame:
        found = lambda w: F.array(*(F.struct(F.lit(n).alias("n"), F.array_distinct(ngrams(w, n)).alias("g")) for n in sizes))
        own = df.select("item_id", F.monotonically_increasing_id().alias("item_row"), F.explode(bound(tokens(F.col("text")), found)).alias("x"))
        return own.select("item_id", "item_row", "x.n", F.size("x.g").alias("size"), F.posexplode("x.g").alias("no", "gram"))

    shared = rows(documents.select("doc_id", F.monotonically_increasing_id().alias("doc_row"), "text"), "doc_id", "doc_row").join(grams(items), ["n", "gram"])
    hits = shared.drop("gram").distinct().groupBy("item_id", "doc_id", "n", "size").agg(F.count("*").alias("hits"))
    return hits.select("item_id", "doc_id", "n", "hits", F.round(F.col("hits") / F.col("size"), 6).alias("coverage"))


def gram_hits(items: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """The hits of one size."""
    return gram_hits_of(items, documents, (n,)).drop("n")


#: Characters or stems of texts and items of a block, and counts that are held at once.
BLOCK_CHARS, BLOCK_STEMS, BLOCK_ITEMS = 1 << 22, 1 << 20, 1 << 16
COUNTS = 1 << 22


def most_grams(items: DataFrame, documents: DataFrame, n: int, k: int) -> DataFrame:
    """item_id, doc_id, hits, coverage as in `gram_hits`, of the k documents (doc_id, scope, words) that share most distinct
    n-grams with each item (item_id, scope, words) of their scope, the smaller doc_id on ties; those that share any. Words
    are fragments of texts; ids come once in a scope.

    What is shuffled are texts in blocks, and of each block k documents for each item: n-grams, and what items and documents
    share of them, stay in the task where a block of documents meets a block of items."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = _most_shared(a, b, n, k) if a.num_rows and b.num_rows else [[]] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("item_id", "doc_id", "hits", "size"), parts, strict=True)})

    rows = documents.select("scope", F.col("doc_id").alias("id"), "words")
    queries = items.select("scope", F.col("item_id").alias("query_id"), "words")
    cells = in_blocks(rows, queries, F.sum(F.length("words") + 1) / BLOCK_CHARS, F.count("*") / BLOCK_ITEMS)
    found = cells.applyInArrow(best, "item_id long, doc_id long, hits long, size long")
    order = Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id")
    kept = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return kept.select("item_id", "doc_id", "hits", F.round(F.col("hits") / F.col("size"), 6).alias("coverage"))


def _rows_of(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def _expanded(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after another."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _shared_grams(documents: pa.Array, items: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct n-grams of each item and of each document, those that an item has: (document, gram) and (item, gram) in
    order, and how many grams there are. Grams grow word by word; a document's that no item begins with are left out."""
    sides = [pc.split_pattern(c, " ") for c in (items, documents)]
    encoded = sides[0].flatten().dictionary_encode()
    known = encoded.dictionary
    codes = [encoded.indices.to_numpy().astype(np.int64), pc.fill_null(pc.index_in(sides[1].flatten(), value_set=known), -1).to_numpy().astype(np.int64)]
    rows = [_rows_of(np.diff(s.offsets.to_numpy())) for s in sides]
    at = [np.flatnonzero(c >= 0) for c in codes]
    grams, count = [c[p] for c, p in zip(codes, at, strict=True)], len(known)
    for j in range(1, n):
        for side in (0, 1):
            place, row, code = at[side], rows[side], codes[side]
            end = np.minimum(place + j, max(0, len(row) - 1))
            on = (place + j < len(row)) & (row[end] == row[place]) & (code[end] >= 0)
            at[side] = place[on]
            grams[side] = grams[side][on] * len(known) + code[end[on]]
        found, grams[0] = np.unique(grams[0], return_inverse=True)
        count = len(found)
        where = np.minimum(np.searchsorted(found, grams[1]), max(0, count - 1))
        on = found[where] == grams[1] if count else np.zeros(len(where), bool)
        at[1], grams[1] = at[1][on], where[on]
    (item, gram), (document, own) = (np.divmod(np.unique(r[p] * max(1, count) + g), max(1, count)) for r, p, g in zip(rows, at, grams, strict=True))
    return document, own, item, gram, count


def _most_shared(a: pa.Table, b: pa.Table, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """item, document, hits and the item's number of n-grams, of the k best documents (id, words) of each item (query_id,
    words). Documents come in order of ids, so of two with as many hits the first is kept."""
    a = a.sort_by("id")
    ids, asked = a.column("id").to_numpy(), b.column("query_id").to_numpy()
    document, own, item, gram, count = _shared_grams(*(t.column("words").combine_chunks() for t in (a, b)), n)
    size = np.bincount(item, minlength=len(asked))
    order = np.argsort(gram, kind="stable")
    items_of, starts = item[order], np.searchsorted(gram[order], np.arange(count + 1))
    more = starts[own + 1] - starts[own]
    done = np.r_[0, np.cumsum(more)]
    least, held, waiting = np.zeros(len(asked), np.int64), [np.empty((3, 0), np.int64)], 0

    def best() -> list[np.ndarray]:
        i, d, h = np.concatenate(held, axis=1)
        at = np.lexsort((d, -h, i))
        i, d, h = i[at], d[at], h[at]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        least[i[place == k - 1]] = h[place == k - 1]
        return [np.stack([x[place < k] for x in (i, d, h)])]

    step = max(1, COUNTS // len(asked))
    for first in range(0, len(ids), step):
        low, high = np.searchsorted(document, (first, first + step)).tolist()
        counts = np.zeros(min(step, len(ids) - first) * len(asked), np.int64)
        while low < high:
            to = min(high, max(low + 1, int(np.searchsorted(done, done[low] + COUNTS, "right")) - 1))
            with_items = items_of[_expanded(starts[own[low:to]], more[low:to])]
            counts += np.bincount(np.repeat((document[low:to] - first) * len(asked), more[low:to]) + with_items, minlength=len(counts))
            low = to
        cells = np.flatnonzero(counts)
        d, i = np.divmod(cells, len(asked))
        on = counts[cells] > least[i]
        held.append(np.stack([i[on], d[on] + first, counts[cells[on]]]))
        waiting += int(on.sum())
        if waiting > COUNTS:
            held, waiting = best(), 0
    i, d, h = best()[0]
    return asked[i], ids[d], h, size[i]


def most_stems(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """pairs (item_id, doc_id, stems, ...) with how many stems the item has in place of them, and with `shared`, how many of
    them one of the texts of its document (doc_id, stems: a list for each text) has, the most that any has. Stems are
    distinct in their lists; pairs whose document has no row are left out. Documents meet pairs in blocks, so that no task
    holds more than a block of both."""
    rows = documents.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    n_pairs, n_items = pairs.agg(F.count("*"), F.approx_count_distinct("item_id")).first()
    n_stems = rows.agg(F.coalesce(F.sum(F.size(F.flatten("stems"))), F.lit(0))).first()[0]
    blocks = max(1, -(-n_pairs // BLOCK_ITEMS), -(-n_stems // BLOCK_STEMS)), max(1, -(-n_items // BLOCK_ITEMS))
    keys = ["doc_block", "item_block"]
    doc_block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks[0])).cast("int").alias("doc_block")
    left = rows.select(doc_block, F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))).alias("item_block"), "doc_id", "stems")
    right = pairs.select(doc_block, F.pmod(F.xxhash64("item_id"), F.lit(blocks[1])).cast("int").alias("item_block"), *pairs.columns)
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    rest = [c for c in pairs.columns if c != "stems"]

    def shared(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("doc_id")
        most = _stems_shared(a, b) if a.num_rows and b.num_rows else np.zeros(b.num_rows, np.int64)
        counted = b.select(rest).append_column("stems", pc.list_value_length(b.column("stems")).cast(pa.int64())).append_column("shared", pa.array(most))
        return counted.filter(pc.is_in(b.column("doc_id"), value_set=a.column("doc_id")))

    schema = pairs.select(*rest, F.lit(0).cast("long").alias("stems"), F.lit(0).cast("long").alias("shared")).schema
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(shared, schema)


def _stems_shared(a: pa.Table, b: pa.Table) -> np.ndarray:
    """The most shared stems of each pair (doc_id, stems), pairs in order of doc_id, with documents (doc_id, stems)."""
    ids, wanted = a.column("doc_id").to_numpy(), b.column("doc_id").to_numpy()
    texts, said = a.column("stems").combine_chunks(), b.column("stems").combine_chunks()
    encoded = said.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    lists = texts.flatten()
    own = pc.fill_null(pc.index_in(lists.flatten(), value_set=encoded.dictionary), -1).to_numpy().astype(np.int64)
    ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
    first = np.r_[0, np.cumsum(pc.list_value_length(texts).to_numpy())]
    said_ends = np.r_[0, np.cumsum(pc.list_value_length(said).to_numpy())]
    most, place = np.zeros(len(wanted), np.int64), np.full(len(encoded.dictionary), -1)
    for at, doc in enumerate(ids.tolist()):
        low, high = np.searchsorted(wanted, (doc, doc + 1)).tolist()
        text_ends = ends[first[at] : first[at + 1] + 1]
        stems, text = own[text_ends[0] : text_ends[-1]], _rows_of(np.diff(text_ends))
        stems, text = stems[stems >= 0], text[stems >= 0]
        there, column = np.unique(stems, return_inverse=True)
        if low == high or not len(there):
            continue
        place[there] = np.arange(len(there))
        has = np.zeros((len(there), len(text_ends) - 1), np.int32)
        has[column, text] = 1
        step = max(1, COUNTS // (32 * has.shape[1]))
        asked = place[codes[said_ends[low] : said_ends[high]]]
        place[there] = -1
        pair = _rows_of(np.diff(said_ends[low : high + 1]))[asked >= 0]
        asked = asked[asked >= 0]
        for i in range(0, high - low, step):
            x, y = np.searchsorted(pair, (i, i + step)).tolist()
            if x < y:
                begins = np.flatnonzero(np.r_[True, pair[x + 1 : y] != pair[x : y - 1]])
                sums = np.add.reduceat(has[asked[x:y]], begins, axis=0)
                most[low + pair[x:y][begins]] = sums.max(axis=1)
    return most


def word_overlap(pairs: DataFrame, items: DataFrame, documents: DataFrame) -> DataFrame:
    """pairs (item_id, doc_id) with overlap, the share of the item's distinct words that the document has, and stems, how
    many they are. Only documents of pairs are cut into words."""
    words = lambda df, key, name: df.select(F.col(key), F.array_distinct(tokens(F.col("text"))).alias(name))
    chosen = documents.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = pairs.join(words(items, "item_id", "a"), "item_id").join(words(chosen, "doc_id", "b"), "doc_id")
    shared = F.size(F.array_intersect("a", "b"))
    return rows.withColumns({"overlap": F.when(F.size("a") > 0, F.round(shared / F.size("a"), 6)).otherwise(0.0), "stems": shared.cast("long")}).drop("a", "b")


def quotations(items: DataFrame, documents: DataFrame, n: int = 5, least: float = 0.55) -> DataFrame:
    """The best item of each document by covered n-grams, with its method: the whole item, or a part of it."""
    hits = gram_hits(items, documents, n).where(F.col("coverage") >= least)
    best = hits.groupBy("doc_id").agg(F.max(F.struct("coverage", "hits", (-F.col("item_id")).alias("no"))).alias("b"))
    return best.select("doc_id", (-F.col("b.no")).alias("item_id"), "b.hits", "b.coverage", F.when(F.col("b.coverage") >= 1, "exact").otherwise("partial").alias("method"))


def similar_words(words: DataFrame, vocabulary: DataFrame, least: float, best: int) -> DataFrame:
    """Vocabulary words for words that it lacks: the same first three letters and an edit similarity of at least `least`,
    the best few. The vocabulary is dealt by beginning and length, and each word goes where its length allows the
    similarity, so most pairs never meet; those that do are compared by columns of letters."""
    share = 1 - least + 1e-6
    size = F.length("word").cast("long")
    unknown = words.where(size >= 4).join(vocabulary, "word", "left_anti").withColumn("prefix", F.substring("word", 1, 3))
    known = vocabulary.where(size >= 3).select(F.substring("word", 1, 3).alias("prefix"), size.alias("length"), "word")
    lengths = known.select("prefix", "length").distinct()
    asked = unknown.join(lengths, "prefix").where(F.abs(size - F.col("length")) <= F.greatest(size, "length") * share).select("prefix", "length", "word")

    def compared(a: pa.Table, b: pa.Table) -> pa.Table:
        sides: list[dict] = [{}, {}]
        for side, t in zip(sides, (a, b), strict=True):
            for prefix, length, word in zip(*(t.column(c).to_pylist() for c in ("prefix", "length", "word")), strict=True):
                side.setdefault((prefix, length), []).append(word)
        out: list[tuple] = []
        for key in sides[0].keys() & sides[1].keys():
            theirs = sides[1][key]
            # the first three letters are equal
            rest = np.stack([_codes(w[3:]) for w in theirs]).T
            step = max(1, PAIRS // len(theirs))
            for n, own in groupby(sorted(sides[0][key], key=len), len):
                longest = max(n, len(theirs[0]))
                for some in batched(own, step):
                    left = np.stack([_codes(w[3:]) for w in some]).T
                    i, j = np.repeat(np.arange(len(some)), len(theirs)), np.tile(np.arange(len(theirs)), len(some))
                    at, edits = close(left[:, i], rest[:, j], int(longest * share))
                    out += [(some[i[p]], theirs[j[p]], int(e), longest) for p, e in zip(at, edits, strict=True)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("word", "match", "edits", "longest"), columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)})

    # few bytes and much work: several groups for each of as many tasks as are set, of many beginnings each
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("prefix", "length"), F.lit(4 * tasks)).cast("int")
    dealt = lambda df: df.withColumn("bucket", bucket).repartition(tasks, "bucket").groupBy("bucket")
    # one side is made of the other: columns of their own
    known = known.select(*(F.col(c).alias(c) for c in known.columns))
    pairs = dealt(asked).cogroup(dealt(known)).applyInArrow(compared, "word string, match string, edits int, longest int")
    rows = pairs.withColumn("score", F.round(1 - F.col("edits") / F.col("longest"), 6)).where(F.col("score") >= least)
    order = Window.partitionBy("word").orderBy(F.desc("score"), "match")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best).select("word", "match", "score", "rank")


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-16-le" if max(word, default="") <= "\uffff" else "utf-32-le"), np.uint16 if max(word, default="") <= "\uffff" else np.uint32)


#: Pairs of words whose tables are filled at once.
PAIRS = 1 << 15


def close(words: np.ndarray, others: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of words are at most `most` edits apart, and how many: a column each of both arrays, all of one length on
    a side. The tables of edit distances are filled for all pairs at once, where they are within `most` of the diagonal;
    pairs that can't come back under it go on the way."""
    size, n = others.shape
    at, small = np.arange(n), np.int16 if max(size, len(words)) < 30_000 else np.int32
    row = {i: np.full(n, i, small) for i in range(min(size, most) + 1)}
    for j in range(1, len(words) + 1):
        last, row = row, {}
        for i in range(max(0, j - most), min(size, j + most) + 1):
            if i == 0:
                row[0] = np.full(len(at), j, small)
                continue
            x = last[i - 1] + (others[i - 1] != words[j - 1])
            if i in last:
                x = np.minimum(x, last[i] + 1)
            row[i] = np.minimum(x, row[i - 1] + 1) if i - 1 in row else x
        there = np.minimum.reduce(list(row.values())) <= most if row else np.zeros(len(at), bool)
        if 2 * there.sum() < len(at):
            at, words, others, row = at[there], words[:, there], others[:, there], {i: x[there] for i, x in row.items()}
        if not len(at):
            break
    if size not in row:
        return at[:0], at[:0]
    there = row[size] <= most
    return at[there], row[size][there]


def with_unknown(weighted: DataFrame, n_documents: DataFrame, words: DataFrame) -> DataFrame:
    """word and weight of any words; a word that no document has weighs as if its idf were 0.6 ln(N + 1)."""
    rows = words.join(weighted.select("word", "weight"), "word", "left").crossJoin(F.broadcast(n_documents))
    return rows.select("word", F.coalesce("weight", F.round(1 + F.sqrt(0.6 * F.log(F.col("n") + 1)), 6)).alias("weight"))


def _unit_rows(vectors: DataFrame, every: int, scoped: bool) -> tuple[DataFrame, DataFrame]:
    """Rows and queries of `top_k`. Vectors that are null or hold nulls, and rows without an id, meet nothing; vectors meet
    those of their length."""
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    scope = F.struct((F.col("label") if scoped else F.lit(0)).alias("label"), F.size("embedding").alias("length"))
    rows = whole.where(F.col("label").isNotNull()) if scoped else whole
    rows = rows.select(F.col("vec_id").alias("id"), scope.alias("scope"), unit(F.col("embedding")).alias("v"))
    return rows, rows.where(F.col("id") % every == 0).withColumnRenamed("id", "query_id")


def nearest(vectors: DataFrame, k: int, every: int = 100, scoped: bool = False) -> DataFrame:
    """The k nearest vectors of each vector whose id is divisible by `every`, all or those of its label."""
    return top_k(*_unit_rows(vectors, every, scoped), k).withColumnRenamed("id", "vec_id")


def gap_and_lag(vectors: DataFrame, every: int = 100) -> DataFrame:
    """Of each query the best score in its label, its lead over the second there, and how far it is behind the best of
    all."""
    inside, top = nearest(vectors, 2, every, scoped=True), nearest(vectors, 1, every)
    two = inside.groupBy("query_id").agg(F.max("score").alias("best"), F.min(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    rows = two.join(top.select("query_id", F.col("score").alias("top")), "query_id")
    return rows.select("query_id", "best", F.round(F.col("best") - F.col("second"), 5).alias("gap"), F.round(F.col("top") - F.col("best"), 5).alias("behind"))


def contained(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that have an item's words, five or more, in a row: n-gram keys propose, the text decides."""
    spaced = lambda c: F.concat(F.lit(" "), fragment(F.col(c)), F.lit(" "))
    hits = gram_hits(items, documents, 5).where("coverage >= 1").select("item_id", "doc_id")
    texts = documents.select("doc_id", spaced("text").alias("whole"))
    return hits.join(texts, "doc_id").join(items.select("item_id", spaced("text").alias("part")), "item_id").where(F.col("whole").contains(F.col("part"))).select("item_id", "doc_id")
