import os
from email.utils import getaddresses

import pytest
from pyspark.sql import functions as F

from siftwell import library as L
from siftwell.functions import text as T


embedder = lambda texts: [[float(t.lower().count("apple")), float(t.lower().count("pear")), 0.1] for t in texts]  # noqa: E731 - sent to the executors by value


def write(folder, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", "/").replace("_", ".")
        os.makedirs(path.parent, exist_ok=True)
        path.write_text(text)


def test_library(spark, tmp_path):
    docs, uri = tmp_path / "docs", str(tmp_path / "library")
    write(docs, a_txt="apple apple pie", b_md="pear tree", skip__c_txt="apple", fruit__d_txt="apple apple pie", bad_docx="no archive")
    L.create(spark, uri, 4)
    ignored = spark.createDataFrame([(f"{docs}/skip/",)], "path string")
    log = L.scan(spark, uri, [str(docs)], ignored=ignored).first()
    assert (log.docs_found, log.docs_added, log.docs_updated, log.docs_failed) == (4, 3, 0, 1)
    names = {r.name: r.doc_id for r in L.table(spark, uri, "documents").collect()}
    assert set(names) == {"a.txt", "b.md", "d.txt"} and len(set(names.values())) == 3
    assert [r.path.rpartition("/")[2] for r in L.table(spark, uri, "blacklist").collect()] == ["bad.docx"]
    assert {(r.doc_id, r.tag) for r in L.table(spark, uri, "tags").collect()} == {(names["a.txt"], "txt"), (names["b.md"], "md"), (names["d.txt"], "txt"), (names["d.txt"], "fruit")}
    # nothing is new, and what failed is not tried again; an edited file keeps its id
    assert L.scan(spark, uri, [str(docs)], ignored=ignored).first().docs_found == 0
    write(docs, b_md="pear and plum")
    os.utime(docs / "b.md", (2_000_000_000, 2_000_000_000))
    log = L.scan(spark, uri, [str(docs)], ignored=ignored).first()
    assert (log.docs_found, log.docs_updated) == (1, 1)
    assert {r.name: r.doc_id for r in L.table(spark, uri, "documents").collect()} == names

    assert L.embed(spark, uri, embedder, "m") == 3 and L.embed(spark, uri, embedder, "m") == 0
    search = lambda q, **k: sorted(r["name"] for r in L.search(spark, uri, q, **k).page.collect())
    assert search("plum", mode="keyword") == ["b.md"] and search("tree", mode="keyword") == []
    assert search("the apple", mode="semantic", embedder=embedder, model="m") == ["a.txt", "d.txt"]
    assert search("apple", mode="semantic", embedder=embedder, model="other") == [] and search("") == ["a.txt", "b.md", "d.txt"]
    groups = L.duplicates(spark, uri).collect()
    assert sorted(r.path.rpartition("/")[2] for r in groups) == ["a.txt", "d.txt"] and "2 copies" in groups[0].label
    assert {r.doc_id for r in L.duplicates(spark, uri, 0.97, "m").collect()} == {names["a.txt"], names["d.txt"]}
    got = L.passages(spark, uri, names["b.md"], "plum").first()
    assert (got.location, got.score, got.sample) == ("line 1", 1, "pear and plum")
    assert L.passages(spark, uri, names["b.md"], "pear", "semantic", embedder).count() == 1

    # a file that was listed is read again on demand, and leaves the list
    (docs / "bad.docx").unlink()
    write(docs, bad_docx="still none", e_txt="quince")
    L.rescan(spark, uri, [str(docs)], spark.createDataFrame([(f"{docs}/bad.docx",), (f"{docs}/e.txt",), (None,)], "path string"))
    assert search("quince", mode="keyword") == ["e.txt"] and L.table(spark, uri, "blacklist").count() == 1
    gone = spark.createDataFrame([(f"{docs}/a.txt",), (f"{docs}/none.txt",), (None,)], "path string")
    assert L.remove(spark, uri, gone, "blacklist").count() == 0
    assert search("apple", mode="keyword") == ["d.txt"] and L.table(spark, uri, "blacklist").count() == 2 and L.table(spark, uri, "embeddings").count() == 2
    assert L.scan(spark, uri, [str(docs)], ignored=ignored, again=True).first().docs_found == 3
    assert L.table(spark, uri, "scans").count() == 5
    assert L.remove(spark, uri, spark.createDataFrame([(f"{docs}/fruit/d.txt",)], "path string"), "delete_file").count() == 1


def test_empty_library(spark, tmp_path):
    uri = str(tmp_path / "library")
    L.create(spark, uri, 2)
    assert L.table(spark, uri, "documents").count() == 0 and L.embed(spark, uri, embedder, "m") == 0
    assert L.remove(spark, uri, spark.createDataFrame([], "path string")).count() == 0 and L.duplicates(spark, uri).count() == 0
    with pytest.raises(ValueError):
        L.remove(spark, uri, spark.createDataFrame([], "path string"), "other")


def test_titles(spark):
    cases = {
        "Microsoft Word - Report.docx": "Report", "report.PDF": "report.PDF", ".docx": ".docx", "  a.doc  ": "a", "Microsoft Word - ": "Microsoft Word -", "x/y.rtf": "y", "v1.2.odt": "v1.2", "": "", " ": "",
        "Microsoft Excel - Microsoft Word - a.xls": "Microsoft Word - a", "a.docx b": "a.docx b", None: None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.clean_title(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases


def test_addresses_like_the_standard_library(spark):
    fields = ["Bob <bob@x.org>", '"Last, First" <a@b.c>, d@e.f', "a@b.c (Ann)", "<x@y.z>", "", "Ann B <a@b.c>,  <c@d.e> , f@g.h", '"A \\"q\\" B" <q@r.s>']
    rows = spark.createDataFrame([(f,) for f in fields], "f string").select("f", T.addresses(F.col("f")).alias("a"), T.first_sender(F.col("f")).alias("s")).collect()
    for r in rows:
        want = [x for x in getaddresses([r.f]) if any(x)]
        assert [tuple(x) for x in r.a] == want, r.f
        assert r.s == ((want[0][0] or want[0][1]) if want else None)
    assert spark.createDataFrame([(None,)], "f string").select(T.format_addresses(F.col("f"))).first()[0] == ""


def test_a_bucket_upsert_shuffles_each_side_once(spark, tmp_path):
    """Stored and new rows are dealt by bucket, joined and written: one exchange for each, in all that is written."""
    import re

    from siftwell.sources import buckets

    rows = spark.createDataFrame([(f"/p{i}", i, "old") for i in range(40)], "path string, doc_id long, title string")
    buckets.create(rows.where("doc_id < 30"), str(tmp_path / "b"), 4)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def executions():
        bus.waitUntilEmpty(30_000)
        found = store.executionsList()
        return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}

    before = executions()
    buckets.upsert(spark, str(tmp_path / "b"), rows.where("doc_id >= 20").withColumn("title", F.lit("new")).withColumn("doc_id", F.col("doc_id") + 100))
    writes = [p for i, p in executions().items() if i not in before and "InsertIntoHadoopFsRelationCommand" in p]
    assert writes and sum(len(re.findall(r"\bExchange \(", p.partition("== Initial Plan ==")[0])) for p in writes) == 2
    got = {r["path"]: (r["doc_id"], r["title"]) for r in buckets.read(spark, str(tmp_path / "b")).collect()}
    assert got == {f"/p{i}": (i if i < 30 else i + 100, "old" if i < 20 else "new") for i in range(40)}
