"""Quality rules as one Spark projection (native: no Python on the executors).

A table of thresholds is compiled into boolean columns over length, symbol, stop-word, repetition and line
measures. Every measure is a built-in expression over the text of its own row, so the plan has no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "was", "by", "be", "at", "are", "this", "from", "or"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "est", "pour", "par", "dans", "sur", "au", "avec"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "ist", "mit", "des", "auf", "für", "ein", "eine", "dem", "nicht", "sich", "auch"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "es", "del", "se", "no", "al", "su"],
}


@dataclass(frozen=True)
class Rule:
    """A document fails if measure is below low or above high."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are columns of measured(); ratios are per word, line or letter as named.
RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.01),
    Rule("duplicate_lines", "dup_line_ratio", high=0.3),
    Rule("repeated_words", "repeat_ratio", high=0.5),
    Rule("capitals", "upper_ratio", high=0.5),
)

WORD = r"[^\x20\x09-\x0D]+"

_SAME = "coalesce(x.h = get(win, {0}).h and x.a = get(win, {0}).a and x.b = get(win, {0}).b and x.c = get(win, {0}).c, false)"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts and the ratios.

    Null and empty texts have no words: their counts are 0 and their ratios null. Repeated rows are measured
    each on its own, an empty table gives no rows, other columns are not read, and texts of any length are
    measured whole.
    """
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("ws", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    df = df.select(
        "doc_id",
        "ws",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("ls"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.size(F.filter("ws", lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop"),
        F.expr("transform(slice(ws, 1, greatest(size(ws) - 2, 0)), (w, i) -> xxhash64(w, ws[i + 1], ws[i + 2]))").alias("hs"),
    )
    # Windows are sorted only in texts where some hash occurs twice; equal ones become neighbours, and there the words decide.
    df = df.withColumn(
        "win",
        F.expr("if(size(array_distinct(hs)) < size(hs), sort_array(transform(hs, (h, i) -> struct(h as h, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c, i as p))), null)"),
    )
    df = df.withColumn("at", F.expr(f"sort_array(transform(filter(win, (x, i) -> {_SAME.format('i - 1')} or {_SAME.format('i + 1')}), x -> x.p))"))
    df = df.withColumn("n_repeat_words", F.expr("if(coalesce(size(at), 0) <= 0, 0, 3 + aggregate(transform(slice(at, 2, size(at) - 1), (p, i) -> least(3, p - at[i])), 0, (s, x) -> s + x))").cast("long"))
    df = df.select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"), "n_repeat_words", F.size("ls").cast("long").alias("n_lines"), "n_upper", "n_letters", "n_stop")
    return df.withColumns(
        {
            "mean_word_chars": _over("word_chars", "n_words"),
            "symbol_ratio": _over("n_symbols", "n_words"),
            "stop_ratio": _over("n_stop", "n_words"),
            "dup_line_ratio": _over("n_dup_lines", "n_lines"),
            "repeat_ratio": _over("n_repeat_words", "n_words"),
            "upper_ratio": _over("n_upper", "n_letters"),
        }
    )


def _over(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def failed(rule: Rule) -> Column:
    """True if the rule rejects; a null ratio rejects nothing."""
    x, tests = F.col(rule.measure), []
    if rule.low is not None:
        tests.append(x < F.lit(rule.low))
    if rule.high is not None:
        tests.append(x > F.lit(rule.high))
    test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return F.coalesce(test, F.lit(False))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measured() with failed_rules (names, in table order) and passed; nothing is dropped here."""
    df = measured(docs, id_col, text_col)
    names = F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return df.withColumn("failed_rules", names).withColumn("passed", F.size("failed_rules") == 0)
