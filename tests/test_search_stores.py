"""Stored indexes, vectors, folder tables, buckets, walks and rescans against plain versions."""

import os
import random
from pathlib import Path

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from siftwell.operators import dedup as D
from siftwell.operators import folders as O
from siftwell.operators import passages as P
from siftwell.operators import pii_scan as I
from siftwell.operators import search as S
from siftwell.operators import segments, trigrams
from siftwell.operators import vectors as V
from siftwell.plans import queries as plans
from siftwell.plans import stores
from siftwell.sources import buckets, walk
from siftwell.store import files_key
from siftwell.streaming import rescans


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


CATALOG = "doc_id long, name string, title string, content string, tags array<string>, path string, extra int"


def catalog_of(spark, texts):
    return spark.createDataFrame([(i, f"n{i}", None, t, ["t"], f"/p/{i}", 1) for i, t in texts], CATALOG)


def scored(source, query="alpha beta"):
    return {r[0]: round(r[1], 9) for r in S.keyword_scores(source, query).collect()}


def test_segments_equal_a_fresh_build(spark, tmp_path):
    rng, uri = random.Random(0), f"file://{tmp_path}/ix"
    words = ["alpha", "beta", "gamma", "alphabet", "delta"]
    state, text = {}, lambda: " ".join(rng.choices(words, k=rng.randrange(12)))
    for step in range(3):
        came = {rng.randrange(20): text() for _ in range(8)}
        gone = rng.sample(range(40), 4)
        version = segments.commit(spark, uri, catalog_of(spark, list(came.items())), spark.createDataFrame([(i,) for i in gone], "doc_id long"), f"state {step}")
        state = {i: t for i, t in state.items() if i not in gone} | came
        if step == 1:
            version = segments.compact(spark, uri)
        assert segments.source_of(spark, uri) == f"state {step}" and version
        assert scored(segments.read(spark, uri)) == scored(catalog_of(spark, list(state.items())))
    segments.commit(spark, uri, catalog_of(spark, []))
    assert scored(segments.read(spark, uri)) == scored(catalog_of(spark, list(state.items())))
    segments.compact(spark, uri)
    for _ in range(2):
        segments.commit(spark, uri, catalog_of(spark, []))
    assert segments.vacuum(spark, uri) == [1, 2, 3, 4, 5]
    assert scored(segments.read(spark, uri)) == scored(catalog_of(spark, list(state.items())))
    everything = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    segments.commit(spark, uri, catalog_of(spark, []), everything)
    assert scored(segments.read(spark, uri)) == {}


def test_heads_prune_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "heads_for", lambda catalog: 7)
    c = catalog_of(spark, [(i, "alpha beta a b " + "gamma " * i) for i in range(20)])
    index = S.write_index(c, f"file://{tmp_path}/ix")
    for query in ("alpha", '"alpha beta"', "a", "g gamma"):
        assert scored(index, query) == scored(c, query)
    plan = S.keyword_scores(index, '"alpha beta"')._jdf.queryExecution().optimizedPlan().toString()
    assert "head" in plan


def test_stored_index_notices_new_data(spark, tmp_path):
    own = f"{tmp_path}/t"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.orderBy("doc_id").limit(50).write.parquet(f"{own}/documents.parquet")
    before, few = files_key(spark, f"{own}/documents.parquet"), plans.bm25("tion")(spark, own).count()
    assert files_key(spark, f"{own}/documents.parquet") == before
    docs.write.mode("overwrite").parquet(f"{own}/documents.parquet")
    assert files_key(spark, f"{own}/documents.parquet") != before
    assert few < plans.bm25("tion")(spark, own).count() == plans.bm25("tion")(spark, SF).count()


def vectors_of(spark, m, schema="doc_id long, embedding array<double>"):
    return spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in enumerate(m)], schema)


def test_packed_vectors(spark):
    m = [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0], None, [1.0, 2.0], [-1.5, 1e-3, 7.0]]
    given = V.packed(vectors_of(spark, m))
    assert [r[0] for r in rows(given.select("doc_id"))] == [0, 1, 4]
    back = {r[0]: r[1] for r in given.select("doc_id", V.unpack(F.col("vec"), 3)).collect()}
    assert back == {i: [float(np.float32(v)) for v in m[i]] for i in (0, 1, 4)}
    assert given.select(V.unpack(F.col("vec"), 2)).distinct().collect() == [(None,)]
    hole = spark.createDataFrame([(1, [1.0, None])], "doc_id long, embedding array<double>").select(V.pack(F.col("embedding")))
    assert hole.first()[0] is None
    query = [0.3, -0.2, 0.9]
    want = {r[0]: r[1] for r in S.semantic_scores(vectors_of(spark, [x for x in m if x and len(x) == 3]), query).collect()}
    got = [r[1] for r in rows(V.scores(given, query))]
    assert np.allclose(sorted(got), sorted(want.values()), atol=1e-6)
    assert V.packed(vectors_of(spark, [])).count() == 0 and V.scores(V.packed(vectors_of(spark, [])), query).count() == 0


def plain_topk(m, asked, k):
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = np.round(u[asked] @ u.T, V.PLACES)
    return {(q, d) for q, row in zip(asked, cos, strict=True) for d in sorted(range(len(m)), key=lambda d: (-row[d], d))[:k]}


def test_vector_index(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 16))[rng.integers(0, 40, 1500)] + rng.normal(scale=0.5, size=(1500, 16))
    m[700:760] = m[3]  # copies
    asked = list(range(0, 1500, 20))
    given = V.packed(vectors_of(spark, m))
    queries = given.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec")
    want = plain_topk(m, asked, 10)
    for size in (20_000, 130):  # the second deals both sides into slices
        monkeypatch.setattr(V, "SLICE", size)
        exact = V.exact_topk(given, queries, 10)
        assert {(r["qid"], r["doc_id"]) for r in exact.collect()} == want
        index = V.write_vector_index(given, f"file://{tmp_path}/ix{size}")
        assert index.rows.count() == 1500
        told = V.recall(V.topk(index, queries, 10), exact).first()
        assert told["queries"] == 75 and told["wanted"] == 750 and told["recall"] >= 0.9
        every = V.topk(index, queries, 10, probes=len(index.centres), again=150)
        assert {(r["qid"], r["doc_id"]) for r in every.collect()} == want
    empty = V.write_vector_index(given.limit(0), f"file://{tmp_path}/none")
    assert V.topk(empty, queries, 10).count() == 0 and V.exact_topk(given.limit(0), queries).count() == 0


def test_recall_of_the_registered_query(spark):
    assert stores.vector_index_recall(spark, SF).first()["recall"] >= 0.9


def test_classes_of_copies_are_linear(spark):
    n = 20_000
    copies = spark.range(n).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    others = spark.createDataFrame([(n, [1.0, 2.01]), (n + 1, [-1.0, 0.0]), (n + 2, [0.0, 0.0]), (n + 3, [0.0, 0.0]), (n + 4, None)], "id long, embedding array<double>")
    found = D.near_duplicate_classes(copies.unionByName(others), 0.97)
    assert rows(found.groupBy("class_id", "links").count()) == sorted([(0, n, n + 1), (n + 1, 0, 1), (n + 2, 0, 1), (n + 3, 0, 1)], key=repr)
    assert rows(D.near_duplicate_groups(copies.unionByName(others), 0.97).groupBy("group_id").agg(F.count("*"), F.min("similarity"))) == [(0, n + 1, 1.0)]
    assert D.near_duplicate_classes(copies.limit(0), 0.97).count() == 0


def test_containing_folders(spark):
    paths = ["/a/b/c", "/a/b", "/ab/c", "/a/bc/d/", "", None, "/x", "/a/b/c"]
    folders = ["/a/", "/a/b", "/a/b", "/a/bc/d", None]
    p, f = (spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "path string, root int").drop("root") for xs in (paths, folders))
    assert rows(O.containing(p, f)) == sorted([("/a/b/c", "/a/b"), ("/a/b", "/a/b"), ("/ab/c", None), ("/a/bc/d/", "/a/bc/d"), ("", None), (None, None), ("/x", None), ("/a/b/c", "/a/b")], key=repr)
    assert rows(O.outside(p, f)) == sorted([("/ab/c",), ("",), (None,), ("/x",)], key=repr) and O.inside(p, f).count() == 4
    assert O.outside(p, f.limit(0)).count() == len(paths)
    everything = spark.createDataFrame([("/",)], "path string")
    assert O.inside(p.where("path like '/%'"), everything).count() == 6
    dotted = spark.createDataFrame([("/a/.b/c",), ("/.home/x",), ("/.home/.git/x",), ("/z/.x",), ("/z/y",)], "path string")
    roots = spark.createDataFrame([("/.home",), ("/a/",)], "path string")
    assert {r[0]: r[1] for r in O.hidden(dotted, roots).collect()} == {"/a/.b/c": True, "/.home/x": False, "/.home/.git/x": True, "/z/.x": True, "/z/y": False}


def test_buckets_keep_what_they_do_not_touch(spark, tmp_path):
    uri = f"file://{tmp_path}/t"
    first = spark.createDataFrame([(f"/f/{i}", i, "old") for i in range(200)], "path string, doc_id long, title string")
    buckets.create(first, uri, 32)

    def files():
        return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in Path(tmp_path, "t").glob("bucket=*/*.parquet")}

    before = files()
    touched = buckets.upsert(spark, uri, spark.createDataFrame([("/f/3", 900, "new"), ("/g", 901, "more"), (None, 1, "none")], "path string, doc_id long, title string"))
    after = files()
    assert len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == {f"bucket={b}" for b in touched}
    assert rows(buckets.read(spark, uri).where("title != 'old'")) == [("/f/3", 3, "new"), ("/g", 901, "more")]
    own = first.where("doc_id = 7")
    touched = buckets.delete(spark, uri, own)
    assert len(touched) == 1 and buckets.read(spark, uri).count() == 200
    buckets.delete(spark, uri, buckets.read(spark, uri).select("path"))
    assert buckets.delete(spark, uri, own.limit(0)) == [] and not files()


def test_walk_equals_a_plain_walk(spark, tmp_path):
    for p in ("a.txt", "d/b.txt", "d/e/f/c.txt", ".hid/x", "d/.y", "skip/z", "é ü/ü.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    os.symlink(tmp_path, tmp_path / "d" / "loop")
    roots = spark.createDataFrame([(str(tmp_path),), (f"{tmp_path}/d/",), (f"{tmp_path}/none",), (None,)], "path string")
    files, errors = walk.walk(roots, ignored=spark.createDataFrame([(f"{tmp_path}/skip",)], "path string"))
    want = [str(tmp_path / p) for p in ("a.txt", "d/b.txt", "d/e/f/c.txt", "é ü/ü.md")]
    assert sorted(r["path"] for r in files.collect()) == sorted(want)
    assert {r["path"]: r["size"] for r in files.collect()}[want[0]] == 5
    assert [r["path"] for r in errors.collect()] == [f"{tmp_path}/none"]
    every = walk.walk(roots, hidden=True)[0]
    assert sorted(r["path"] for r in every.collect()) == sorted(os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs)
    assert walk.walk(roots.limit(0))[0].count() == 0


def test_rescans_follow_listings(spark, tmp_path):
    schema, folder, out = "path string, mtime long, seen long", tmp_path / "in", str(tmp_path / "out")
    batches = [
        [("/a", 10, 1), ("/b", 20, 1), ("/a", 10, 1), (None, 1, 1), ("/c", 5, None)],
        [("/a", 12, 3), ("/b", 20, 3), ("/c", 7, 3)],
        [("/a", 11, 2), ("/b", None, 4), ("/b", None, 5), ("/c", 6, 4)],  # an old listing of /a comes late
        [("/b", 21, 6), ("/b", 21, 6), ("/c", None, 3), ("/d", 2**62 + 1, 7)],
    ]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))
        query = rescans.changes(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).orderBy("seen", "path").collect()]
    assert got == [("/a", "insert", 10, 1), ("/b", "insert", 20, 1), ("/a", "update", 12, 3), ("/c", "insert", 7, 3), ("/b", "delete", None, 4), ("/b", "insert", 21, 6), ("/d", "insert", 2**62 + 1, 7)]


def test_trigrams_find_substrings(spark, tmp_path):
    texts = ["Alpha beta", "alphabet", None, "", "al", "漢字かな", "a.b*c\nd", "ALPHA BETA twice alpha beta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = trigrams.write_trigrams(docs, f"file://{tmp_path}/ix")
    for query in ("alpha", "ha be", "bet", "al", "字かな", "b*c\nd", "nothing here", "A.B"):
        want = [i for i, t in enumerate(texts) if t is not None and query.lower() in t.lower()]
        assert sorted(r["doc_id"] for r in trigrams.containing(index, docs, query).collect()) == want


def test_semantic_passages(spark):
    units = spark.createDataFrame([(1, i, f"section {i}", "Some words of the unit here", [1.0, i / 1000]) for i in range(400)] + [(2, i, "s", " nothing  to mark\there ", [1.0, 0.0]) for i in range(250)] + [(3, 1, "s", "The", [0.0, 1.0])], "doc_id long, unit_no int, location string, text string, embedding array<double>")
    got = P.semantic_passages(units, [1.0, 0.0], "the")
    told = {(r["doc_id"], r["truncated"]): r["n"] for r in got.groupBy("doc_id", "truncated").agg(F.count("*").alias("n")).collect()}
    assert told == {(1, True): 200, (2, True): 200}
    assert got.where("doc_id = 1 and rank = 1").select("unit_no", "match_start", "match_end", "sample").first() == (0, 14, 17, "Some words of the unit here")
    assert got.where("doc_id = 2 and rank = 1").select("match_start", "match_end", "sample").first() == (0, 0, "nothing to mark here")
    few = P.semantic_passages(units.where("unit_no < 300"), [1.0, 0.0], "the", most=300)
    assert few.where("truncated").count() == 0

    def embed(texts):
        return [[1.0, float("mark" in t)] for t in texts]

    found = P.passages(units.drop("embedding"), "the mark", "semantic", embed)
    assert found.where("doc_id = 2").first()["score"] == pytest.approx(1.0) and found.where("doc_id = 3").count() == 1
    assert P.passages(units, "the", "keyword").where("doc_id = 3").count() == 1
    with pytest.raises(ValueError):
        P.passages(units, "the", "semantic")


def test_purge_with_a_blacklist(spark):
    schema = "doc_id long, path string, description string, content_snippet string"
    docs = spark.createDataFrame([(1, "/a", "born 1/2/1990", None), (2, "/b", "born", "1/2/1990"), (3, "/c", None, None), (4, "/d", "fine", "fine"), (5, None, "ssn 123-45-6789", ""), (6, "/a", "fine", "")], schema)
    listed = spark.createDataFrame([("/d", "by hand"), ("/z", "old")], "path string, reason string")
    left, after = I.purge_listed(docs, listed)
    assert [r["doc_id"] for r in left.collect()] == [3, 6]
    assert rows(after) == [("/a", "Date of Birth"), ("/b", "Date of Birth"), ("/d", "by hand"), ("/z", "old")]
    again, same = I.purge_listed(left, after)
    assert [r["doc_id"] for r in again.collect()] == [3] and rows(same) == rows(after)


def test_a_query_goes_to_shards_not_to_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 100)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(900, 8))
    m[:250] = m[0]  # a cell of more than two shards
    given = V.packed(vectors_of(spark, m))
    index = V.write_vector_index(given, f"file://{tmp_path}/ix")
    placed, shards = V._shards(index.rows.select("cell", "doc_id", F.col("code").alias("data")))
    assert placed.count() == 900 and len(shards) == index.rows.select("cell").distinct().count() > 20
    cells, n = len(index.centres), len({x for found in shards.values() for x in found})
    assert 9 <= n < len(shards) and max(len(x) for x in shards.values()) == 3
    asked = given.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec")
    met = V._meet(index.rows.select("cell", "doc_id", F.col("vec").alias("data")), asked, 8, lambda q: np.tile(np.arange(cells), (len(q), 1)), lambda _, vecs: V._units(V._matrix(vecs, 8)), 5)
    assert met.count() <= 45 * n * 5 < 45 * len(shards) * 3  # ten vectors in most cells: rows of each cell would be more
    row, at = V._first(np.array([[1.0, 3, 3, 2, 3], [-np.inf, 0, -np.inf, 0, 1]]), 2)
    assert row.tolist() == [0, 0, 1, 1] and at.tolist() == [1, 2, 4, 1]


def test_postings_are_packed_and_counted_once(spark, tmp_path, monkeypatch):
    """A row for each term of a block, not for each token; a search without an index passes over the texts once; compaction drops tokens, not blocks."""
    monkeypatch.setattr(S, "BLOCK_TOKENS", 500)
    texts = [(i, "alpha beta " * (i % 7) + "gamma " * 30 + "beta") for i in range(200)]
    c, uri = catalog_of(spark, texts).coalesce(1), f"file://{tmp_path}/ix"
    index = S.write_index(c, uri)
    stored = spark.read.parquet(f"{uri}/postings")
    blocks = stored.where("term is null").count()
    assert 5 < blocks < 50 and stored.where("term = 'gamma'").count() == blocks
    assert stored.where("term = 'gamma'").agg(F.sum(F.size("at"))).first()[0] == 6000
    for query in ("alpha beta", '"gamma beta"', '"alpha beta alpha" gam', "zeta"):
        assert scored(index, query) == scored(c, query)
    plan = S.keyword_scores(c, '"alpha beta" gam be')._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate" not in plan
    uri, dead = f"file://{tmp_path}/segments", [i for i in range(200) if i % 3 == 0]
    segments.commit(spark, uri, c)
    segments.commit(spark, uri, c.limit(0), spark.createDataFrame([(i,) for i in dead], "doc_id long"))
    segments.compact(spark, uri)
    left = catalog_of(spark, [t for t in texts if t[0] not in dead])
    at = spark.read.parquet(f"{uri}/postings/seq=3")
    assert at.where("term = 'gamma'").agg(F.sum(F.size("at"))).first()[0] == 30 * (200 - len(dead))
    assert scored(segments.read(spark, uri)) == scored(left) and segments.read(spark, uri).docs.count() == 200 - len(dead)
