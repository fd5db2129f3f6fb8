"""The registered query of each operator, with production parameters, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import automaton, bottomk, decontam, fim, licenses, merkle, mixing, pii, quality, records, rules, simhash, warc
from siftwell.llm.common import scratch


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "records")
    manifest = records.write_records(table(spark, sf_dir, "documents"), uri, tokenizer_path(), end_id=2)
    return records.read_records(spark, uri, manifest).drop("ids")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_tokens", *[F.col("posterior")[n].alias(f"p_{n}") for n in mixing.TARGETS], "rate", "copies")


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The registered query's key; a real run takes its own.
PII_KEY = b"registered-query"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PII_KEY)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.lm_scores(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.apply_rules(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("passed")).alias("kept"))


def _rule_sql(r: rules.Rule) -> str:
    tests = [f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None)
    return f"coalesce({' OR '.join(tests)}, false)"


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in rules.STOP_WORDS.values() for w in ws}))

OP7_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM l WHERE len(ws) >= 3)),
d AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, k) AS n FROM g),
r AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM d WHERE n > 1) GROUP BY rn),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters,
    len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop
  FROM l LEFT JOIN r USING (rn)),
q AS (
  SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio,
    n_stop / nullif(n_words, 0) AS stop_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
    n_repeat_words / nullif(n_words, 0) AS repeat_ratio, n_upper / nullif(n_letters, 0) AS upper_ratio,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(_rule_sql(r) for r in rules.RULES)}) AS kept
FROM q
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP8_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS rn FROM documents),
d AS (SELECT doc_id, rn, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rn, i, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT rn, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hits AS (SELECT rn, i, k, item_id FROM dw JOIN bw USING (k, w)),
n AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rn, i, k FROM hits)) GROUP BY rn),
it AS (SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rn, item_id::VARCHAR AS item_id FROM hits) GROUP BY rn)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rn) LEFT JOIN it USING (rn)
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "warc")
    archives = warc.write_pages(table(spark, sf_dir, "pages"), uri)
    return warc.read_pages(spark, uri, archives)


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""

def op11_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bottomk.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=(17, 20))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT rn, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS k FROM t),
n AS (SELECT rn, count(*) AS n FROM s GROUP BY rn),
c AS (SELECT a.rn AS x, b.rn AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.rn <> b.rn GROUP BY a.rn, b.rn),
p AS (SELECT x, y FROM c JOIN n a ON a.rn = x JOIN n b ON b.rn = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT rn AS x, rn AS y FROM t UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
m AS (SELECT x, min(t.doc_id) AS component_id FROM r JOIN t ON t.rn = r.y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM t JOIN m ON x = t.rn LEFT JOIN n ON n.rn = t.rn
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)
    sha = lambda c: F.sha2(c, 256)
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
  list_transform([1, 9, 17, 25], lambda i: ('0x' || h[i:i + 7])::BIGINT) AS d FROM t),
f AS (SELECT *, len(us) AS n, least(d[1] % (len(us) + 1), d[2] % (len(us) + 1)) AS a, greatest(d[1] % (len(us) + 1), d[2] % (len(us) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
c AS (SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS pre, coalesce(array_to_string(us[a + 1:b], ''), '') AS mid, coalesce(array_to_string(us[b + 1:], ''), '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.dataset_proofs(table(spark, sf_dir, "documents"))
    text = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", *[text(c).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), "verified")


def _op13_sql(leaf_levels: int = 5, source_levels: int = 3) -> str:
    """For up to 16 to the power of leaf_levels leaves of a source, and as many sources by source_levels."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bit = "list_transform({}, lambda x: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crcs = "range(0, 256)"
    for _ in range(8):
        crcs = bit.format(crcs)

    def tree(nodes: str, levels: int) -> str:
        out = ""
        for k in range(1, levels + 1):
            out += f"""
{nodes}r{k} AS (SELECT grp, i // 16 AS g, list(h ORDER BY i) AS hs, max(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM {nodes}{k - 1}) GROUP BY grp, i // 16),
{nodes}{k} AS (SELECT grp, g AS i, CASE WHEN c = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {nodes}r{k}),"""
        return out

    def fold(nodes: str, levels: int, at: str, grp: str, first: int) -> str:
        out = ""
        for k in range(1, levels + 1):
            p = f"{at} // {16 ** (k - 1)} % 16"
            out += f"""
f{first + k} AS (SELECT f.* REPLACE (CASE WHEN c = 1 THEN cur ELSE sha256(array_to_string(list_concat(list_append(hs[1:{p}], cur), hs[{p} + 2:]), '')) END AS cur,
    proof || CASE WHEN c = 1 THEN '' ELSE coalesce(array_to_string(list_concat(hs[1:{p}], hs[{p} + 2:]), ''), '') END AS proof)
  FROM f{first + k - 1} f JOIN {nodes}r{k} r ON r.grp = {grp} AND r.g = {at} // {16**k}),"""
        return out

    return f"""
WITH crcs AS (SELECT {crcs} AS crc),
d AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf("text")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: xor(s >> 8, crc[xor(s, b) % 256 + 1])), 4294967295) % 5 = 0 THEN {leaf(low)} END AS tampered
  FROM documents, crcs),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
a0 AS (SELECT grp, i, leaf AS h FROM l),{tree("a", leaf_levels)}
b0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, h, grp AS name FROM a{leaf_levels}),{tree("b", source_levels)}
f0 AS (SELECT l.*, b0.i AS s, b0.h AS subroot, z.h AS root, coalesce(tampered, leaf) AS cur, '' AS proof FROM l JOIN b0 ON b0.name = l.grp, b{source_levels} z),{fold("a", leaf_levels, "f.i", "f.grp", 0)}{fold("b", source_levels, "f.s", "''", leaf_levels)}
z AS (SELECT * FROM f{leaf_levels + source_levels})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM z
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_records, op2_mixing, op3_simhash_neardup, op4_quality_classifier, op5_pseudonyms, op6_lm_scores, op7_quality_rules, op8_decontamination, op9_license_scan, op10_warc, op11_minhash_neardup, op12_fill_in_middle, op13_merkle_manifest)
}

ORACLE_SQL: dict[str, str] = {"op7_quality_rules": OP7_SQL, "op8_decontamination": OP8_SQL, "op10_warc": OP10_SQL, "op11_minhash_neardup": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_merkle_manifest": _op13_sql()}
