"""Personal data in text: the first accepted match of each pattern, as an array of (name, match). JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names and patterns whose matches are reported.
PATTERNS = (
    ("SSN", r"(?<![0-9\-])\d{3}[-\s]\d{2}[-\s]\d{4}(?![0-9\-])", "ssn"),
    ("SSN", r"(?i)(?:ssn|social\s+security(?:\s*(?:no|number|#))?)[:#\s]+(?<!\d)\d{9}(?!\d)", "ssn"),
    ("Credit Card", r"(?<![0-9\-])(?:\d[ \-]?){12,18}\d(?![0-9\-])", "card"),
    ("Passport Number", r"(?i)\b(?:passport|pass\s*(?:no|number|#))[:\s]+[A-Z]{1,2}\d{7,9}\b", None),
    ("Date of Birth", r"(?i)\b(?:dob|date\s+of\s+birth|born)[:\s]+\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", None),
    ("Medical Record Number", r"(?i)\b(?:mrn|medical\s+record(?:\s+number)?|patient\s+id)[:\s#]+\d{4,12}\b", None),
    ("Driver License", r"(?i)\b(?:driver'?s?\s+licen[sc]e|dl\s+#?|license\s+#?)[:\s]+[A-Z0-9]{5,15}\b", None),
    ("Bank Routing Number", r"(?i)\b(?:routing(?:\s+(?:transit\s+)?number)?|rtn|aba)[:\s#]+(?<!\d)\d{9}(?!\d)", "aba"),
    ("Bank Routing Number", r"(?<![0-9\-])\d{9}(?![0-9\-])", "aba"),
    ("Bank Account Number", r"(?i)\b(?:(?:bank\s+)?account|acct)(?:\s+(?:no|number|#))?[:\s#]+(?<!\d)\d{4,17}(?!\d)", None),
)


def valid_ssn(d: Column) -> Column:
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~d.rlike(r"^(\d)\1{8}$") & ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def valid_card(d: Column) -> Column:
    return F.length(d).isin(13, 14, 15, 16, 19) & F.substring(d, 1, 1).between("2", "6") & F.call_function("luhn_check", d)


def valid_aba(d: Column) -> Column:
    n = F.substring(d, 1, 2).cast("int")
    total = sum((F.substring(d, i + 1, 1).cast("int") * (3, 7, 1)[i % 3] for i in range(9)), F.lit(0))
    prefix = n.between(1, 12) | n.between(21, 32) | n.between(61, 72) | (n == 80)
    return F.when(F.length(d) == 9, ~d.rlike(r"^(\d)\1{8}$") & prefix & (total % 10 == 0)).otherwise(False)


VALID = {"ssn": valid_ssn, "card": valid_card, "aba": valid_aba}


def _accepts(check: str) -> Callable[[Column], Column]:
    return lambda m: VALID[check](F.regexp_replace(m, r"\D", ""))


def pii_hits(text: Column) -> Column:
    """array<struct<name, match>>; a name may occur twice, as it has two patterns. Null text has none."""
    found = []
    for name, pattern, check in PATTERNS:
        all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if check:
            all_ = F.filter(all_, _accepts(check))
        found.append(F.struct(F.lit(name).alias("name"), F.get(all_, F.lit(0)).alias("match")))
    return F.filter(F.array(*found), lambda x: x["match"].isNotNull())


def scan_pii(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, hits) of documents with personal data: the purge's dry run."""
    return documents.select("doc_id", pii_hits(F.col(text_col)).alias("hits")).where(F.size("hits") > 0)


def purge_pii(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents without those that have personal data."""
    return documents.where(F.coalesce(F.size(pii_hits(F.col(text_col))), F.lit(0)) <= 0)


def purge_listed(documents: DataFrame, blacklist: DataFrame, columns: tuple[str, ...] = ("description", "content_snippet")) -> tuple[DataFrame, DataFrame]:
    """What a purge leaves of documents (path and others), and the blacklist (path, reason) after it.

    The columns' texts are joined by a space and scanned, null ones left out. Documents with personal data go, and so do those whose path the blacklist has already: it
    is permanent. A path comes on it once, with the names of the patterns, repeated as often as they were found; rows without a path go but are not listed.
    """
    hits = pii_hits(F.concat_ws(" ", *columns))
    known = blacklist.select("path").distinct()
    named = documents.withColumn("_names", F.array_join(F.transform(hits, lambda x: x["name"]), ", "))
    left = named.where("_names = ''").drop("_names").join(known, "path", "left_anti")
    fresh = named.where("_names != '' and path is not null").groupBy("path").agg(F.min("_names").alias("reason")).join(known, "path", "left_anti")
    return left, blacklist.select("path", "reason").unionByName(fresh.select("path", "reason"))
