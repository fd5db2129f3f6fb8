"""Passages inside documents: units with locations, keyword and semantic ranking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions.text import BLOCK_END, CJK, SPACES, segment_text, unescape
from siftwell.operators.search import cosine, query_vector
from siftwell.sources.extractors import units

# Formats whose text is not prose, and the most passages of a document.
NON_PROSE = ("xlsx", "ods", "ots", "csv", "tsv", "pptx", "odp", "otp", "vsdx", "vsdm", "vsd", "vss", "vst", "vdx", "drawio", "dio", "svg")
MOST_PASSAGES, SEMANTIC_UNITS, SEMANTIC_FLOOR, RADIUS, FIRST_WORDS = 200, 300, 0.5, 5, 12


def line_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit_no, location, text): non-blank lines; numbers count blank ones."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("p", "text"))
    return _units(rows.select("doc_id", (F.col("p") + 1).alias("unit_no"), F.trim("text").alias("text")), "line ")


def markup_units(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(doc_id, unit_no, location, text): blocks of markup without scripts, styles and tags, numbered without blank ones."""
    bare = F.regexp_replace(F.regexp_replace(text_col, r"(?is)<(script|style)\b[^>]*>.*?</\1>", ""), BLOCK_END, "\n")
    bare = unescape(F.regexp_replace(bare, r"(?s)<[^>]+>", ""))
    blocks = F.filter(F.transform(F.split(bare, "\n", -1), lambda x: F.trim(F.regexp_replace(x, SPACES, " "))), lambda x: x != "")
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(blocks).alias("p", "text"))
    return _units(rows.select("doc_id", (F.col("p") + 1).alias("unit_no"), "text"), "section ")


def file_units(files: DataFrame) -> DataFrame:
    """(doc_id, unit_no, location, text) of files (doc_id, ext, content) of prose: lines, sections, chapters or pages, by their type.

    Types that are not prose or have no reader, no type, null and damaged content have no passages.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.content is not None and (found := units(r.ext.lower(), bytes(r.content))):
                    made = pd.DataFrame(found, columns=["unit_no", "location", "text"])
                    made.insert(0, "doc_id", r.doc_id)
                    yield made

    chosen = files.where(is_prose(F.col("ext"))).select("doc_id", "ext", "content")
    return _telling(chosen.mapInPandas(run, "doc_id long, unit_no int, location string, text string"))


def _units(rows: DataFrame, label: str) -> DataFrame:
    return _telling(rows.select("doc_id", "unit_no", F.concat(F.lit(label), F.col("unit_no").cast("string")).alias("location"), "text"))


def _telling(rows: DataFrame) -> DataFrame:
    """Units with two letters or more."""
    return rows.where(F.regexp_count("text", F.lit(r"\p{L}")) >= 2)


def match_pattern(query: str) -> str | None:
    """Latin words whole, case ignored, and the bigrams of CJK runs anywhere: any of them."""
    words = list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z0-9]+", query)))
    pairs = list(dict.fromkeys(b for run in re.findall(f"[{CJK}]+", query) for b in segment_text(run).split()))
    found = [r"\b(?:" + "|".join(words) + r")\b"] * bool(words) + pairs
    return "(?iU)(?:" + "|".join(found) + ")" if found else None


def _mark(found: DataFrame, query: str) -> DataFrame:
    """found with score, the query's matches in text, and the first one's hit, match_start and match_end (null without one)."""
    pattern = F.lit(match_pattern(query) or "(?!)")
    start, hit = F.regexp_instr("text", pattern), F.regexp_substr("text", pattern)
    marked = found.withColumns({"score": F.regexp_count("text", pattern), "hit": hit, "match_start": F.when(start > 0, start - 1)})
    return marked.withColumn("match_end", F.col("match_start") + F.length("hit"))


def _sample() -> Column:
    """Words around hit in text."""
    words = lambda c: F.filter(F.split(c, " +"), lambda x: x != "")
    before, after = words(F.substring("text", F.lit(1), F.col("match_start"))), words(F.substring("text", F.col("match_end") + 1, F.length("text")))
    return F.array_join(F.concat(F.slice(before, F.greatest(F.size(before) - RADIUS + 1, F.lit(1)), F.lit(RADIUS)), F.array("hit"), F.slice(after, 1, RADIUS)), " ")


def keyword_passages(units: DataFrame, query: str, most: int = MOST_PASSAGES) -> DataFrame:
    """(doc_id, unit_no, location, score, match_start, match_end, sample, rank, truncated): matches by count, then in document order; truncated tells that a document has more than most."""
    found = _mark(units, query).where("score > 0").withColumn("sample", _sample())
    return _ranked(found, most).select("doc_id", "unit_no", "location", "score", "match_start", "match_end", "sample", "rank", "truncated")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    each = W.partitionBy("doc_id")
    ranked = found.withColumns({"rank": F.row_number().over(each.orderBy(F.desc("score"), "unit_no")), "truncated": F.count("*").over(each) > most})
    return ranked.where(F.col("rank") <= most)


def first_units(units: DataFrame, most: int = SEMANTIC_UNITS) -> DataFrame:
    """The first units of each document, which alone are embedded, with more: whether the document has others."""
    each = W.partitionBy("doc_id")
    numbered = units.withColumns({"_n": F.row_number().over(each.orderBy("unit_no")), "more": F.count("*").over(each) > most})
    return numbered.where(F.col("_n") <= most).drop("_n")


def embed_units(units: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """units (doc_id, unit_no, location, text, and more from first_units()) with embedding, by embed for lists of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                yield part.assign(embedding=embed(part["text"].tolist()))

    return units.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in units.dtypes) + ", embedding array<double>")


def semantic_passages(units: DataFrame, query: list[float], words: str = "", most: int = MOST_PASSAGES, floor: float = SEMANTIC_FLOOR) -> DataFrame:
    """(doc_id, unit_no, location, score, match_start, match_end, sample, rank, truncated) of units (doc_id, unit_no, location, text, embedding): the first 300 of a document by cosine with query, from floor up.

    The mark is that of the first match of words, with words around it as sample; without a match it is empty (0, 0) and the sample is the first words. truncated tells
    that a document has over 300 units or over most results. Units that first_units() has cut tell by more whether there were others.
    """
    first = units if "more" in units.columns else first_units(units)
    scored = first.withColumn("_score", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))).where(F.col("_score") >= floor)
    head = F.array_join(F.slice(F.filter(F.split("text", SPACES), lambda x: x != ""), 1, FIRST_WORDS), " ")
    told = _mark(scored, words).withColumn("score", F.col("_score")).withColumn("sample", F.when(F.col("match_start").isNull(), head).otherwise(_sample()))
    told = told.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("match_start", "match_end")})
    return _ranked(told, most).withColumn("truncated", F.col("truncated") | F.col("more")).select("doc_id", "unit_no", "location", "score", "match_start", "match_end", "sample", "rank", "truncated")


def passages(units: DataFrame, query: str, mode: str = "keyword", embed: Callable[[list[str]], list[list[float]]] | None = None, most: int = MOST_PASSAGES) -> DataFrame:
    """Passages of units (see line_units() and others) in a mode, keyword or semantic; the latter embeds the query without stop words, and the first units, by embed."""
    if mode == "keyword":
        return keyword_passages(units, query, most)
    if mode != "semantic" or embed is None:
        raise ValueError("mode is keyword, or semantic with an embedder")
    vector = query_vector(query, embed) or []
    return semantic_passages(embed_units(first_units(units.select("doc_id", "unit_no", "location", "text")), embed), vector, query, most)


def is_prose(ext: Column) -> Column:
    return ~F.lower(ext).isin(*NON_PROSE)
