"""Every query of the library proper over tables without rows, and over tables with nulls, a very long text and repeated
rows: none fails, none loses its columns."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quotelake import registry

FOLDER = "/root/testdata/sf0.001"
LONG = "un très long texte, jean 3:16 et la suite. " * 2_000


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    for file in sorted(os.listdir(FOLDER)):
        table = spark.read.parquet(f"{FOLDER}/{file}")
        table.limit(0).coalesce(1).write.parquet(f"{root}/empty/{file}")
        few = table.orderBy(table.columns[0]).limit(6)
        key = table.columns[0]
        blank = [few.withColumn(c, F.lit(None).cast(table.schema[c].dataType)) for c in table.columns if c != key]
        rows = few.unionByName(few.limit(2))
        for b in [*blank, few.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema))]:
            rows = rows.unionByName(b.limit(1))
        if "text" in table.columns:
            rows = rows.unionByName(few.limit(1).withColumn("text", F.lit(LONG))).unionByName(few.limit(1).withColumn("text", F.lit("")))
        rows.coalesce(1).write.parquet(f"{root}/odd/{file}")
    # few rows: compiling plans would take longer than running them
    plain = {"spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    yield root
    for k, v in before.items():
        spark.conf.set(k, v)


def fault(spark, name: str, folder: str, most: float) -> str | None:
    try:
        got = registry.QUERIES[name](spark, folder)
        if not got.columns or len(set(got.columns)) < len(got.columns):
            return f"{name}: columns {got.columns}"
        rows = got.collect()
        return f"{name}: {len(rows)} rows" if len(rows) > most else None
    except Exception as e:  # noqa: BLE001
        return f"{name}: {type(e).__name__} {str(e)[:300]}"


@pytest.mark.parametrize("kind, most", [("empty", 1), ("odd", float("inf"))])
def test_queries(spark, folders, kind, most):
    """Aggregates of everything have a row where there is nothing; all other queries have none."""
    with ThreadPoolExecutor(6) as pool:
        found = pool.map(lambda name: fault(spark, name, f"{folders}/{kind}", most), sorted(registry.QUERIES))
        assert [f for f in found if f] == []
