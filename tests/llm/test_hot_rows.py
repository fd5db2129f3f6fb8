"""Rows of one id, targets that nothing meets, and large groups of near copies."""

import collections
import warnings
import zlib

import numpy as np
import pytest
from test_new_operators import docs_of, families, plain_components, rows

from siftwell.llm import mixing, nearcopies, queries, records
from siftwell.llm.common import scratch


def test_records_deal_rows_of_one_id(spark):
    """Rows without an id, also equal ones, go to all shards, and ids ascend over them."""
    given = [(None, f"text {i % 3}" if i < 400 else "same", "s") for i in range(800)] + [(i, f"own {i}", "s") for i in range(20)]
    uri = scratch(spark, "t")
    manifest = records.write_records(docs_of(spark, given), uri, queries.tokenizer_path(), 2, shards=8)
    assert len(manifest) >= 6 and max(m["records"] for m in manifest) <= 300
    got = records.read_records(spark, uri, manifest).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(got) == len(given)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got][:-1]]).tolist()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter((i, zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t, _ in given)
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want


@pytest.mark.parametrize("p", [[[1 / 3] * 3] * 4, [[0.5, 0.25, 0.25]] * 3 + [[0.2, 0.4, 0.4]], [[0.5, 0.3, 0.2], [0.4999999, 0.3000001, 0.2], [0.1, 0.1, 0.8]]])
def test_mixing_without_feasible_targets_is_least_squares(spark, p):
    soft = spark.createDataFrame([(i, 1000, x) for i, x in enumerate(p)], "doc_id long, n_tokens long, p array<double>")
    goal, m = np.array(list(mixing.TARGETS.values())), np.array(p)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        rate = mixing.rates(m, mixing.fit_rates(soft, goal.tolist()))
    assert any("least squares" in str(w.message) for w in told)
    plain = np.ones(len(p))  # projected gradient, one step at a time
    for _ in range(20_000):
        plain = np.maximum(0, plain - m @ (plain @ m / len(p) - goal))
    height = lambda r: float(((r @ m / len(p) - goal) ** 2).sum())
    assert height(rate) <= height(plain) + 1e-7


def test_near_copies_in_many_blocks(spark):
    """One row of each group stays, whatever the blocks."""
    given = families(seed=6, kinds=2, copies=30)
    want = {c for _, _, c in plain_components(given, 4, 5, 5)}
    for block in (500, 9):
        got = nearcopies.distinct_documents(docs_of(spark, given), block=block)
        assert {r["doc_id"] for r in got.collect()} == want
    assert rows(nearcopies.distinct_documents(docs_of(spark, []), block=9)) == []


def test_rounds_of_components_leave_one_folder(spark, tmp_path):
    from pathlib import Path

    from siftwell.llm.common import shared_root
    from siftwell.llm.simhash import components

    root = Path(shared_root(spark).removeprefix("file://")) / "siftwell"
    before = {p.name for p in root.glob("*")}
    kept = []
    chain = components(spark.range(200).selectExpr("id as a", "id + 1 as b"), kept)
    assert chain.select("root").distinct().count() == 1 and chain.count() == 201
    assert len(kept) == 1 and {p.name for p in root.glob("*")} - before == {kept[0].rpartition("/")[2]}


def test_small_tables_are_few_files(spark):
    """However many partitions a shuffle has, what is written of a small table is a few files for each core."""
    from siftwell.llm.simhash import components

    settings = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, kept = {k: spark.conf.get(k) for k in settings}, []
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.range(2000).selectExpr("id - id % 10 as a", "id as b"), kept)
        assert 0 < len(found.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found.count() == 2000 and found.select("root").distinct().count() == 200
