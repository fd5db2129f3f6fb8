"""Text expressions: tokens, folding, CJK bigrams, index letters, markup, keywords, personal data. All JVM-side."""

from __future__ import annotations

import functools
import html.entities
import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
CJK = "\\u3040-\\u30ff\\u3400-\\u9fff\\uf900-\\ufaff\\uac00-\\ud7a3"

#: White space of any script, for Java's and RE2's patterns.
SPACES = r"[\x{9}-\x{d} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ENTITY = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"

# Tags of HTML, DocBook, RSS and Atom that end a passage; the numbers of sections depend on each of them.
BLOCK_END = r"(?i)</(?:p|div|h[1-6]|li|tr|section|article|header|footer|blockquote|pre|td|th|figcaption|dd|dt|para|item|entry|description|abstract|note|sect\d|chapter|listitem|term|outline)>|<br\s*/?>"

# The default English stop words of queries, and those of keyword extraction.
EN_STOPWORDS = ("a", "an", "the", "and", "or", "but", "nor", "for", "so", "yet")
KEYWORD_STOPWORDS = ("the", "and", "for", "that", "with", "from", "this")

# Leading consonants of Hangul syllables, in code point order; index letters of titles, where tense ones count as their base.
HANGUL_LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
TENSE = {"ㄲ": "ㄱ", "ㄸ": "ㄷ", "ㅃ": "ㅂ", "ㅆ": "ㅅ", "ㅉ": "ㅈ"}


@functools.cache
def fold_pairs() -> tuple[str, str]:
    """Lower-case letters with marks, of any script but Hangul, and the bare letter of each, from Unicode decompositions."""
    marked, bare = [], []
    for c in map(chr, range(0xC0, 0x2C00)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and c.lower() == c and parts[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            marked.append(c)
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


def fold(text: Column) -> Column:
    """Lower case without diacritics, written as letters of their own or as combining marks; ASCII texts are only lower-cased."""
    low = F.lower(text)
    marked, bare = fold_pairs()
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), marked, bare)).otherwise(low)


def fold_text(text: str) -> str:
    low = "".join(c for c in text.lower() if unicodedata.category(c) != "Mn")
    return low.translate(str.maketrans(*fold_pairs()))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, CJK runs as bigrams; null has none."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.rlike(f"[{CJK}]"), cjk_segment(text)).otherwise(text)
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def segment_text(text: str) -> str:
    """cjk_segment() of a query."""
    return re.sub(f"[{CJK}]+", lambda m: " " + " ".join(m[0][i : i + 2] for i in range(max(1, len(m[0]) - 1))) + " ", text).strip()


def cjk_segment(text: Column) -> Column:
    """Runs of CJK characters as overlapping bigrams between spaces; a lone character and other text stay."""
    spaced = F.regexp_replace(text, f"([{CJK}]+)", " $1 ")
    pairs = F.regexp_replace(spaced, f"([{CJK}])(?=([{CJK}]))|(?<=[{CJK}])[{CJK}](?![{CJK}])", "$1$2 ")
    return F.trim(F.regexp_replace(pairs, " +", " "))


def index_letter(title: Column) -> Column:
    """A-Z by the first character's ASCII upper case, else "0"; empty and null titles have none."""
    first = F.upper(F.substring(title, 1, 1))
    return F.when(F.length(title) > 0, F.when(first.rlike("^[A-Z]$"), first).otherwise("0"))


def korean_letter(title: Column) -> Column:
    """The leading consonant of a first Hangul syllable, a tense one as its base, else null."""
    first = F.substring(title, 1, 1)
    out = F.lit(None).cast("string")
    for i, lead in reversed(list(enumerate(HANGUL_LEADS))):
        lo, hi = chr(0xAC00 + 588 * i), chr(0xAC00 + 588 * i + 587)
        out = F.when(first.between(lo, hi), TENSE.get(lead, lead)).otherwise(out)
    return out


def strip_markup(text: Column) -> Column:
    """Text of XML-like markup: declarations, comments, scripts, styles and tags become spaces; common entities are decoded."""
    for pattern, put in (
        (r"(?is)<!DOCTYPE[^>]*>", " "),
        (r"(?s)<\?.*?\?>", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"),
        (r"(?is)<script\b[^>]*>.*?</script>", " "),
        (r"(?is)<style\b[^>]*>.*?</style>", " "),
        (r"(?s)<[^>]+>", " "),
    ):
        text = F.regexp_replace(text, pattern, put)
    return F.trim(F.regexp_replace(unescape(text), SPACES, " "))


@functools.cache
def entity_names() -> dict[str, str]:
    """What each name of HTML 5 that ends in a semicolon stands for."""
    return {name[:-1]: char for name, char in html.entities.html5.items() if name.endswith(";")}


def western_pairs() -> tuple[str, str]:
    """Control characters that pages use for those of Windows-1252 at the same numbers, and these."""
    both = [(chr(n), bytes([n]).decode("cp1252", "ignore")) for n in range(128, 160)]
    return "".join(a for a, b in both if b), "".join(b for _, b in both)


def _referred(mark: Column) -> Column:
    """The characters that &...; stands for; null for an unknown name. Numbers of no character give U+FFFD."""
    number = F.when(mark.rlike("^&#[xX]"), F.conv(F.regexp_extract(mark, "^&#.([0-9a-fA-F]+)", 1), 16, 10)).when(mark.startswith("&#"), F.regexp_extract(mark, "^&#([0-9]+)", 1)).cast("int")
    valid = (number > 0) & ~number.between(0xD800, 0xDFFF) & (number <= 0x10FFFF)
    char = F.translate(F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32"), *western_pairs())
    names = F.from_json(F.lit(json.dumps(entity_names())), "map<string,string>")
    return F.when(number.isNotNull(), char).otherwise(F.element_at(names, F.regexp_extract(mark, "^&(.*);", 1)))


def unescape(text: Column) -> Column:
    """Character references by number and by name decoded in one pass; unknown names, and references without a semicolon, stay."""

    def decoded(t: Column) -> Column:
        parts, marks = F.split(t, ENTITY, -1), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))
        return F.when(t.contains("&"), F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, F.coalesce(_referred(m), m, F.lit("")))), "")).otherwise(t)

    return F.get(F.transform(F.array(text), decoded), F.lit(0))  # an array of one, so that text is evaluated once


def markup_title(text: Column) -> Column:
    """The first title, dc:title or h1 element's text, at most 200 characters; none: null."""
    inner = F.regexp_extract(text, r"(?is)<(?:title|dc:title|h1)\b[^>]*>(.*?)</(?:title|dc:title|h1)>", 1)
    return F.nullif(F.substring(strip_markup(inner), 1, 200), F.lit(""))


def with_keywords(df: DataFrame, text: str, title: str, most: int = 10, out: str = "keywords") -> DataFrame:
    """df with sorted keywords: title words over 3 characters, then body words of frequency 3 or more until there are most.

    Body words are bare of brackets and marks, 3 to 20 letters, by frequency and then first place. One is
    added even if the title alone has as many as allowed. Equal words are counted as neighbours of a sorted array.
    """
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda x: x != "")
    df = df.withColumn("_head", F.array_distinct(F.transform(F.filter(split(title), lambda w: F.length(w) > 3), lambda w: F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", ""))))
    body = F.filter(F.transform(split(text), lambda w: F.regexp_replace(w, r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")), lambda w: w.rlike(r"^\p{L}{3,20}$"))
    df = df.withColumn("_s", F.sort_array(F.transform(body, lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    df = df.withColumn("_at", F.expr("filter(sequence(0, size(_s)), k -> k < size(_s) and not coalesce(get(_s, k - 1).w = get(_s, k).w, false))"))
    df = df.withColumn("_runs", F.expr("sort_array(transform(_at, (k, j) -> struct(k - coalesce(get(_at, j + 1), size(_s)) as n, _s[k].i as i, _s[k].w as w)))"))
    df = df.withColumn("_often", F.transform(F.filter("_runs", lambda x: (x["n"] <= -3) & ~x["w"].isin(*KEYWORD_STOPWORDS)), lambda x: x["w"]))
    fresh, head = F.array_except("_often", "_head"), F.col("_head")
    taken = F.when(F.size(head) < most, F.slice(fresh, F.lit(1), F.lit(most) - F.size(head))).when(F.array_contains(head, F.coalesce(F.get("_often", F.lit(0)), F.lit(""))), F.slice(fresh, 1, 0)).otherwise(F.slice(fresh, 1, 1))
    return df.withColumn(out, F.sort_array(F.array_union(head, taken))).drop("_head", "_s", "_at", "_runs", "_often")


# What office programs put before titles, and the endings of their files.
OFFICE_PREFIXES = ("Microsoft Word - ", "Microsoft Excel - ", "Microsoft PowerPoint - ", "Microsoft Office Word - ", "Microsoft Office Excel - ", "Microsoft Office PowerPoint - ")
OFFICE_ENDINGS = ("docx", "doc", "xlsx", "xls", "pptx", "ppt", "odt", "ods", "odp", "rtf")


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def clean_title(title: Column) -> Column:
    """A title without the program's name before it, and of a file's name without folders and the ending; what would become empty stays."""
    whole = strip_spaces(title)
    bare = strip_spaces(F.regexp_replace(whole, "^(?:" + "|".join(OFFICE_PREFIXES) + ")", ""))
    stem = F.regexp_extract(bare, r"(?is)^(?:.*/)?([^/]*[^./][^/]*)\.(?:" + "|".join(OFFICE_ENDINGS) + r")/*$", 1)
    return F.coalesce(F.nullif(strip_spaces(F.when(stem == "", bare).otherwise(stem)), F.lit("")), whole)


def addresses(field: Column) -> Column:
    """array<struct<name, address>> of a mail's From or To: names may be quoted, or follow in brackets; commas inside quotes do not part. Null has none."""
    parts = F.regexp_extract_all(F.coalesce(field, F.lit("")), F.lit(r'(?:"(?:[^"\\]|\\.)*"|<[^>]*>|\([^)]*\)|[^,"<(])+'), F.lit(0))

    def one(part: Column) -> Column:
        part = strip_spaces(part)
        angle, after = F.regexp_extract(part, "<([^>]*)>", 1), F.regexp_extract(part, r"^([^(<]*)\(([^)]*)\)$", 2)
        quoted = strip_spaces(F.regexp_replace(part, "(?s)<[^>]*>.*$", ""))
        name = F.regexp_replace(F.regexp_replace(quoted, r'(?s)^"(.*)"$', "$1"), r"\\(.)", "$1")
        return F.when(part.contains("<"), F.struct(name.alias("name"), strip_spaces(angle).alias("address"))).otherwise(
            F.struct(strip_spaces(after).alias("name"), strip_spaces(F.regexp_replace(part, r"\([^)]*\)$", "")).alias("address"))
        )

    return F.filter(F.transform(parts, one), lambda x: (x["name"] != "") | (x["address"] != ""))


def format_addresses(field: Column) -> Column:
    """Name <address>, or the one there is, with a comma between two."""
    return F.array_join(F.transform(addresses(field), lambda x: F.when((x["name"] != "") & (x["address"] != ""), F.concat(x["name"], F.lit(" <"), x["address"], F.lit(">"))).otherwise(F.concat(x["name"], x["address"]))), ", ")


def first_sender(field: Column) -> Column:
    """The name of the first address, or the address without one; null if there is none."""
    first = F.get(addresses(field), F.lit(0))
    return F.coalesce(F.nullif(first["name"], F.lit("")), F.nullif(first["address"], F.lit("")))
