from datetime import datetime

import pytest

from siftwell.operators import models as M
from siftwell.sources import snapshots
from siftwell.streaming import landing as L


def test_landing(spark, tmp_path):
    folder, store, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    (folder / "deep").mkdir(parents=True)
    (folder / "a.txt").write_text("first words")
    (folder / "x.exe").write_bytes(b"\x7fELF")
    assert L.ingest_available(L.landing(spark, str(folder)), store, check) == 1
    (folder / "deep" / "b.txt").write_text("second words")
    L.ingest_available(L.landing(spark, str(folder)), store, check)
    L.ingest_available(L.landing(spark, str(folder)), store, check)
    got = sorted((r["name"], r["text"]) for r in L.stored(spark, store).collect())
    assert got == [("a.txt", "first words"), ("b.txt", "second words")]


def test_snapshots(spark, tmp_path):
    uri = f"file://{tmp_path}/snaps"
    with pytest.raises(ValueError):
        snapshots.load(spark, uri)
    df = spark.range(1)
    for n in range(1, 5):
        assert snapshots.save(spark, uri, {"documents": df, "tags": spark.range(0)}) == n
        df = snapshots.load(spark, uri)["documents"].union(spark.range(n, n + 1))
    (tmp_path / "snaps" / "v9").mkdir()  # one that was never completed
    assert snapshots.versions(spark, uri) == [2, 3, 4]
    assert snapshots.load(spark, uri)["documents"].count() == 4
    assert snapshots.load(spark, uri, 2)["documents"].count() == 2 and snapshots.load(spark, uri)["tags"].count() == 0
    for bad in ({}, {"../up": df}):
        with pytest.raises(ValueError):
            snapshots.save(spark, uri, bad)


def test_models(spark):
    old, new = datetime(2024, 1, 1), datetime(2024, 2, 1)
    schema = "doc_id long, name string, title string, description string, content_snippet string, synopsis string, updated_at timestamp"
    docs = spark.createDataFrame([(1, "n1", "T", "d", "s", "kept", new), (2, "n2", "", None, "w " * 9000, None, old), (3, "n3", None, None, None, "", old)], schema)
    have = spark.createDataFrame([(1, [0.0], "m", old), (2, [7.0], "m", new)], "doc_id long, embedding array<float>, model string, updated_at timestamp")
    made = M.embed_stale(docs, have, lambda texts: [[float(len(t))] for t in texts], "m")
    assert {r[0]: r[1] for r in M.merge_embeddings(have, made).select("doc_id", "embedding").collect()} == {1: [5.0], 2: [7.0], 3: [2.0]}
    assert {r[0]: r[1] for r in M.synopses(docs, lambda texts: [str(len(t)) for t in texts]).collect()} == {1: "kept", 2: "4000", 3: None}


def test_landing_tells_of_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "MOST_BYTES", 4)
    folder, store = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_text("abc")
    (folder / "b.txt").write_text("abcdef")
    L.ingest_available(L.landing(spark, str(folder)), store, str(tmp_path / "check"))
    got = {r["name"]: (r["success"], r["error"]) for r in L.stored(spark, store).collect()}
    assert got == {"a.txt": (True, None), "b.txt": (False, "not readable or too large")}
