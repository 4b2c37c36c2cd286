import pandas as pd

from quotelake.sources import corpora as C


def test_verses_of_many_xml_files_come_in_one_frame():
    good = "<bible><book><c><v>one</v><v>two</v></c></book></bible>"
    files = pd.DataFrame({"name": [f"V{i}" for i in range(50)], "content": [good, None, "<open>", good, ""] * 10})
    frames = list(C._xml_frames(iter([files, files])))
    assert [len(f) for f in frames] == [80]


def test_marked_text_looks_for_titles_before_lines_are_apart(spark):
    content = "\\h Short\n\\toc2  Long name \n\\c 3\n\\p\n\\v 1-2 one \u2003 two\xa0\\f + \\ft note\\f*\n\\q1 more\t text\n rest \n\\v 4 four"
    rows = C.from_marked_text(spark.createDataFrame([("V", content), ("W", None), ("X", "\\c 1\n\\v 1 x")], "name string, content string"))
    assert sorted(map(tuple, rows.collect())) == [("V", "Long name", 3, 1, "one two more text rest"), ("V", "Long name", 3, 4, "four"), ("X", "X", 1, 1, "x")]
    above = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "content#" not in above
