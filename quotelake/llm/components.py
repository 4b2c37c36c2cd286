"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import Workspace

#: Up to so many links of the thinned forest are finished in one task (16 bytes each); beyond it, star rounds run.
ONE_TASK_LINKS = 400_000


class Forest(dict):
    """Union-find whose roots are the smallest members."""

    def root(self, x):
        path = []
        while (up := self.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self[p] = x
        return x

    def link(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.setdefault(a, a)
        self[b] = a
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            forest.link(a, b)
    members = [x for x in forest if forest.root(x) != x]
    for i in range(0, len(members), 50_000):
        part = members[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.root(x) for x in part], pa.int64())], ["a", "b"])


def _star_round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step; links (a, b) come and go with a > b."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return large.join(low, "a").select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct()


def components(spark: SparkSession, links: DataFrame, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, component) for each node of links (a, b); component is the smallest node reachable.

    Nulls in a or b are ignored, repeated links and self links change nothing, no links give no rows. Each task first
    thins its links to a forest; a small rest is finished in one task, a large one by alternating star rounds whose
    tables are written to the shared folder.
    """
    work = Workspace(spark, "components")
    clean = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    schema = "a long, b long"
    thin = work.save(clean.mapInArrow(_forest, schema), "thin")
    count = thin.count()
    if count <= one_task_links:
        stars = work.save(thin.repartition(1).mapInArrow(_forest, schema), "stars")
    else:
        stars, seen, k = thin, None, 0
        while True:
            stars = work.save(_star_round(stars), f"round{k}")
            now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if k:
                work.drop(f"round{k - 1}")
            if now == seen:
                break
            seen, k = now, k + 1
    work.drop("thin")
    members = stars.groupBy("a").agg(F.min("b").alias("b"))
    return members.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
