"""Bottom-k near-duplicates, fill-in-middle and Merkle manifests against plain versions and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from oracle import SF, same
from pyspark.sql import functions as F

from siftwell.llm import bottomk, fim, grouping, merkle, queries

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row long, grp string, i long, n long, digest string, proof string, root string, set_id string, node long"


def docs_of(spark, rows):
    """rows: (doc_id, text, source); the other columns have names that operators use too."""
    return spark.createDataFrame([(i, t, None if s == "b" else "en", s, None if t is None else len(t), 1, "g", 2, 3, "d", "p", "r", "s", 4) for i, t, s in rows], EXTRA)


ODD = [(1, None, "a"), (2, "", "a"), (3, "one", "b"), (4, "One two three four", None), (5, "one two three four", ""), (None, "no id at all", "a"), (4, "One two three four", None), (7, "x " * 30_000, "b"), (8, " \t\n", "é"), (-9, "é <P> ok ok", "z"), (10, "one", "b")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_components(given, p, q, size):
    sets = []
    for _, t, *_ in given:
        ws = (t or "").encode().lower().split()
        sets.append({b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    root = list(range(len(given)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(given)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both * q >= p * (len(sets[a]) + len(sets[b]) - both):
            root[find(b)] = find(a)
    out = []
    for k, (i, *_) in enumerate(given):
        ids = [given[j][0] for j in range(len(given)) if find(j) == find(k) and given[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=repr)


def families(seed=3, kinds=6, copies=25, size=150):
    """Texts with copies at many distances, also copies of copies, and a passage that all share."""
    rng, out = random.Random(seed), []
    passage = [f"common{i}" for i in range(40)]
    for k in range(kinds):
        base = [f"w{k}_{rng.randrange(400)}" for _ in range(size)]
        made = [base]
        for _ in range(copies):
            ws = list(rng.choice(made))
            for _ in range(rng.randrange(8)):
                ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
            made.append(ws)
        out += [" ".join(passage + ws) for ws in made]
    out += [" ".join(passage), " ".join(passage[:38]), *(f"short text {i % 3}" for i in range(9))]
    rng.shuffle(out)
    return [(i, t, "s") for i, t in enumerate(out)]


def test_bottomk_matches_all_pairs(spark):
    given = families() + [(900, None, "s"), (901, "", "s"), (902, " ", "s")]
    assert rows(bottomk.near_duplicates(docs_of(spark, given), 3, (4, 5))) == plain_components(given, 4, 5, 3)


def test_bottomk_in_small_blocks(spark, monkeypatch):
    """Groups of many blocks give what one block gives."""
    monkeypatch.setattr(bottomk, "SKETCHES", 12)
    monkeypatch.setattr(bottomk, "SHINGLES", 2000)
    given = families(seed=4, kinds=2, copies=24)
    assert rows(bottomk.near_duplicates(docs_of(spark, given), 3, (17, 20))) == plain_components(given, 17, 20, 3)


def test_bottomk_odd_rows(spark):
    got = rows(bottomk.near_duplicates(docs_of(spark, ODD), 3, (17, 20)))
    assert got == plain_components(ODD, 17, 20, 3)
    assert bottomk.near_duplicates(docs_of(spark, []), 3, (17, 20)).count() == 0
    with pytest.raises(ValueError):
        bottomk.near_duplicates(docs_of(spark, []), 3, (3, 4))


def test_estimate_is_that_of_the_union_sketch():
    rng = np.random.default_rng(5)
    similar = bottomk.estimated(17, 20)
    for _ in range(300):
        n, m, both = rng.integers(1, 120, 3).tolist()
        pool = rng.choice(10**6, n + m + both, replace=False).astype(np.uint64)
        a, b = np.sort(pool[: n + both]), np.sort(pool[n:])
        sa, sb = bottomk.sketch(a), bottomk.sketch(b)
        union = np.union1d(sa, sb)[: bottomk.K]
        met = int(np.isin(union, np.intersect1d(sa, sb)).sum())
        whole = len(a) < bottomk.K and len(b) < bottomk.K and len(np.union1d(a, b)) <= bottomk.K
        want = met * 20 >= 17 * len(union) if whole else met * bottomk.K >= bottomk.LEAST * len(union)
        assert bool(grouping.Sets([sa, sb], similar).links()) == want


def plain_cut(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def plain_fim(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = plain_cut(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    form = "spm" if h[3] % 100 < spm else "psm"
    return (doc_id, len(units), form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")


def mixed_texts(n=300):
    rng = random.Random(1)
    parts = ["a", "été", "漢字", "😀", " ", "\t\n", "<P", "<", ">", "S>", "\x0b ", " ", " x"]
    return ["".join(rng.choices(parts, k=rng.choice((0, 1, 2, 5, 40, 900)))) for _ in range(n)]


def test_fim_matches_plain_version(spark):
    given = [(i, t, "s") for i, t in enumerate(mixed_texts())] + ODD
    for rate, spm in ((50, 80), (100, 30)):
        made = fim.fill_in_middle(docs_of(spark, given), rate=rate, spm=spm)
        assert rows(made) == sorted([plain_fim(i, t, 42, rate, spm) for i, t, _ in given], key=repr)
        back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")))
        assert rows(back) == sorted([(i, t or "") for i, t, _ in given], key=repr)
    assert fim.fill_in_middle(docs_of(spark, [])).count() == 0


def test_checkpoints_find_every_cut():
    for text in mixed_texts(60):
        units, data = plain_cut(text), text.encode()
        for step in (1, 3, 256):
            index = fim.Checkpoints(data, step)
            assert index.n == len(units) and len(index.units) == len(units) // step + 1
            for u in range(len(units) + 1):
                head = "".join(units[:u])
                assert index.cut(u) == (len(head.encode()), len(head))


def test_fim_of_a_very_long_text():
    data = "wörter 漢 ".encode() * 300_000
    n, form, pre, mid, out = fim.transform(5, data, 42, 100, 100)
    assert n == 600_001 and form == "spm" and len(out) == len(data) + 9 and pre + mid <= len(data.decode())


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """The root, and of each leaf the runs above it with its place in each."""
    paths, level, own = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [range(a, min(a + 16, len(level))) for a in range(0, len(level), 16)]
        for run in runs:
            for j in run:
                for i in own[j]:
                    paths[i].append(([level[x] for x in run], j - run[0]))
        own = [[i for j in run for i in own[j]] for run in runs]
        level = [h(*(level[j] for j in run)) for run in runs]
    return level[0], paths


def plain_merkle(given):
    """given: (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in given}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted([r for r in given if r[1] == s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in sources}
    trees = {s: plain_tree([plain_leaf(r) for r in own[s]]) for s in sources}
    root, above = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for r, path in zip(own[s], trees[s][1], strict=True):
            low = r[4] and "".join(c.lower() if c.isascii() else c for c in r[4])
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, proof = plain_leaf((*r[:4], low) if tampered else r), ""
            for run, j in path + up:
                proof += "".join(run[:j] + run[j + 1 :])
                node = h(*run[:j], node, *run[j + 1 :])
            out.append((r[0], plain_leaf(r), trees[s][0], root, h(proof), node, node == root))
    return sorted(out, key=repr)


def digests(found):
    text = lambda c: F.lower(F.hex(c))
    return rows(found.select("doc_id", text("leaf"), text("subroot"), text("root"), F.sha2(text("proof"), 256), text("folded_root"), "verified"))


def given_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_merkle_matches_plain_version(spark):
    rng = random.Random(2)
    sources = ["big"] * 300 + ["mid"] * 16 + ["seventeen"] * 17 + ["one"] + [f"s{i}" for i in range(40)]
    given = [(i, rng.choice(("Ab", "ab", "É x", None, "")), s) for i, s in enumerate(sources)] + ODD
    docs = docs_of(spark, given)
    assert digests(merkle.dataset_proofs(docs)) == plain_merkle(given_rows(docs))
    assert merkle.dataset_proofs(docs_of(spark, [])).count() == 0
    one = docs_of(spark, [(1, "Text", None)])
    assert digests(merkle.dataset_proofs(one)) == plain_merkle(given_rows(one))


def test_merkle_of_many_blocks(spark):
    """Blocks of one level, so that the leaves take three traversals, and those of the sources two."""
    given = [(i, f"Text {i}", "big" if i % 2 else f"s{i % 34}") for i in range(1200)]
    docs = docs_of(spark, given)
    assert digests(merkle.dataset_proofs(docs, levels=1)) == plain_merkle(given_rows(docs))


def test_merkle_finds_a_change(spark):
    """What is verified is the text: a proof holds for its own leaf alone."""
    found = merkle.dataset_proofs(docs_of(spark, [(i, "A" if i % 2 else "a", "s") for i in range(100)])).collect()
    for r in found:
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] % 2 == 1
        assert r["verified"] == (not tampered)
    assert {r["verified"] for r in found} == {True, False}


@pytest.mark.parametrize("name", ["op11_minhash_neardup", "op12_fill_in_middle", "op13_merkle_manifest"])
def test_new_queries_match_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])
