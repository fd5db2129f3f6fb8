import pytest
from pyspark.sql import functions as F

from siftwell.operators import scans as N
from siftwell.operators.passages import match_pattern

LISTED = "path string, reason string, listed_at timestamp"


def test_delete_modes(spark):
    docs = spark.createDataFrame([(1, "/a"), (2, "/b")], "doc_id long, path string")
    none = spark.createDataFrame([], LISTED)
    paths = spark.createDataFrame([("/a",), ("/a",), ("/absent",)], "path string")
    got = {}
    for mode in N.MODES:
        rest, blacklist, doomed = N.delete_paths(docs, none, paths, mode)
        assert [r.path for r in rest.collect()] == ["/b"]
        got[mode] = ([r.path for r in blacklist.collect()], [r.path for r in doomed.collect()])
    assert got == {"db_only": ([], []), "blacklist": (["/a"], []), "delete_file": ([], ["/a"])}
    with pytest.raises(ValueError, match="no such mode"):
        N.delete_paths(docs, none, paths, "all")


def test_blacklist_keeps_reason_until_read(spark):
    held = spark.createDataFrame([("/a", "old"), ("/b", "old"), ("/c", "old")], "path string, reason string").withColumn("listed_at", F.current_timestamp())
    again = spark.createDataFrame([("/x", "new"), ("/a", "new")], "path string, reason string")
    assert {r.path: r.reason for r in N.add_listed(held, N.listed(again)).collect()} == {"/a": "old", "/b": "old", "/c": "old", "/x": "new"}
    records = spark.createDataFrame([("/a", True, None), ("/b", False, "damaged"), ("/d", None, None)], "path string, success boolean, error string")
    assert {r.path: r.reason for r in N.after_rescan(held, records).collect()} == {"/b": "damaged", "/c": "old", "/d": "extraction failed"}


def test_labels_and_keep(spark):
    sizes = spark.createDataFrame([(None,), (0,), (1023,), (1024,), (1536,), (2560,), (1310720,), (3 << 29,)], "n long")
    assert [r[0] for r in sizes.select(N.size_label(F.col("n"))).collect()] == ["?", "0B", "1023B", "1KB", "2KB", "2KB", "1.2MB", "1.5GB"]
    docs = spark.createDataFrame([(1, "", "n.txt", 5), (2, "t", "m", 5), (3, "x" * 56, "q", None), (4, "y", "r", 1)], "doc_id long, title string, name string, size long")
    groups = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4)], "group_id long, doc_id long")
    assert {r.label for r in N.group_labels(groups, docs).collect()} == {'"n.txt"  [5B × 2 copies]', '"' + "x" * 52 + '…"  [? × 2 copies]'}
    assert N.group_labels(groups.where("group_id = 1").withColumn("similarity", F.lit(0.97123)), docs).first().label == '"n.txt"  [similarity 97.1%  × 2 docs]'
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(N.keep_one(docs, groups)) == [1, 3]
    keep = spark.createDataFrame([(1, 2), (3, 1)], "group_id long, doc_id long")
    assert ids(N.keep_one(docs, groups, keep)) == [2, 3, 4]


def test_auto_tags_of_odd_rows(spark):
    rows = [(1, "Reports/ab/x.PDF", "PDF", "Annual Report", None), (2, None, None, None, None), (3, "x.py", "py", "Long title words", "word word word")]
    files = spark.createDataFrame(rows, "doc_id long, rel string, ext string, title string, text string")
    got: dict = {}
    for r in N.auto_tags(files).collect():
        got.setdefault(r.doc_id, set()).add(r.tag)
    assert got == {1: {"pdf", "reports", "annual", "report"}, 3: {"py", "code"}}


def test_auto_tags_of_long_texts(spark):
    text = " ".join(f"{w}{x}" for x in "abcdefghij" * 4 for w in ("word", "term", "name", "same") * 10)
    files = spark.createDataFrame([(1, "x.pdf", "pdf", None, text)], "doc_id long, rel string, ext string, title string, text string")
    tags = N.auto_tags(files)
    # words are taken once, not in a filter below the explode as well, where they would be taken again for each word
    assert tags._jdf.queryExecution().optimizedPlan().toString().count("{3,20}") == 1
    assert sorted(r.tag for r in tags.collect()) == ["namea", "pdf", "samea", "terma", "worda", "wordb"]


def test_pattern_of_scripts():
    assert match_pattern("한국인 Data") == r"(?iU)(?:\b(?:data)\b|한국|국인)"
    assert match_pattern("...") is None
