import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quotelake.llm.merkle import folded, manifest, row_hash, tampered_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row[0], row[1], row[2], row[3] if row[3] is None else row[3] + more, row[4]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root and each leaf's path of (side, sibling)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            if (i ^ 1) < len(level):
                path.append(("L" if i & 1 else "R", level[i ^ 1]))
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        for i, x in enumerate(at):
            at[i] = x >> 1
    return level[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256) of each row, in order."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for lang in langs]
    trees = [tree([leaf_of(r) for r in g]) for g in groups]
    root, above = tree([t[0] for t in trees])
    return [(r[0], leaf_of(r), subroot, root, sha(*(h for _, h in [*path, *up]))) for g, (subroot, paths), up in zip(groups, trees, above, strict=True) for r, path in zip(g, paths, strict=True)]


def corpus(seed, n, langs):
    rng = random.Random(seed)
    ids = rng.sample(range(10**6), n)
    return [(i, rng.choice(["web", None, "é"]), rng.choice(langs), rng.choice([None, 5, 9, 2**63 - 1]), rng.choice(["", None, "text é 𝒳", f"words {i}"]), "x", "y") for i in ids]


@pytest.mark.parametrize("seed,n,langs,block,window,partitions", [(1, 300, ["en"] * 6 + ["de", None, "", "é", "𝒳", "~"], 2, 1, 7), (2, 257, ["en"], 3, 2, 5), (4, 40, [f"l{i}" for i in range(60)], 1, 2, 9), (5, 1, ["en"], 2, 2, 4)])
def test_against_whole_trees(spark, seed, n, langs, block, window, partitions):
    rows = corpus(seed, n, langs)
    rows += [(None, "s", langs[0], 3, "no id", "x", "y"), (None, None, langs[-1], None, None, "x", "y"), *rows[: n // 5], *([rows[0]] * 40 if n > 100 else [])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = tampered_manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), block_levels=block, window_levels=window).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(rows)
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    tampered = {leaf_of(r) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}
    assert all(r.verified == (r.leaf not in tampered) == (r.folded_root == r.root) for r in got)
    assert not tampered or any(not r.verified for r in got)


def test_carried_columns_and_proofs_of_any_table(spark):
    rows = spark.range(50).select(F.col("id").alias("key"), (F.col("id") % 3).cast("string").alias("part"), F.lit(1.5).alias("proof_of"), row_hash([F.col("id")]).alias("h"))
    found = manifest(rows, order="key", group="part", leaf="h", carry=["proof_of"], block_levels=1, window_levels=1)
    assert found.columns == ["key", "proof_of", "leaf", "subroot", "root", "proof"]
    assert found.where((folded(F.col("leaf"), F.col("proof")) == F.col("root")) & (F.col("proof_of") == 1.5)).count() == 50
    assert found.select("root").distinct().count() == 1 and found.select("subroot").distinct().count() == 3


def test_empty_table(spark):
    assert tampered_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
