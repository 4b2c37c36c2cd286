"""Files that are read as one value each."""

from quotelake.plans import corpora as Q
from quotelake.sources import corpora as C


def test_a_file_of_several_lines_is_one_content(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "semeur.json").write_text("[\nold\n]\n")
    (tmp_path / "b" / "semeur.json").write_text("[\nz\n]\n")
    (tmp_path / "b" / "kjf.json").write_text("x\ny")
    (tmp_path / "b" / "note.meta.json").write_text("{}")
    got = {r["name"]: r["content"] for r in C.read_files(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()}
    assert got == {"SEM": "[\nz\n]\n", "KJF": "x\ny"}


def test_version_files_with_items_of_several_lines(spark, tmp_path):
    import hashlib

    texts = {i: f"item {i}\nz second line\n" if i % 2 else f"item {i}\n\na last one" for i in range(8)}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["name"]: r["md5"] for r in Q.QUERIES["version_files"](spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.md5(texts[i].encode()).hexdigest() for n, i in (("SEM", 4), ("TOB", 5), ("KJF", 2))}
