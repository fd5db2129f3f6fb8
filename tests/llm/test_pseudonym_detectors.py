"""Finders of personal data written apart from the operator: no pattern of it, only splits and character tests."""

import collections

from oracle import SF

from siftwell.llm import queries

DIGITS = set("0123456789")
WORD = DIGITS | set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


def emails(text):
    """Spans of local@domain around each @."""
    out = []
    for at in (i for i, c in enumerate(text) if c == "@"):
        a, b = at, at + 1
        while a and (text[a - 1] in WORD or text[a - 1] in ".+-"):
            a -= 1
        while b < len(text) and (text[b] in WORD - {"_"} or text[b] in ".-"):
            b += 1
        labels = text[at + 1 : b].rstrip(".-").split(".")
        if a < at and text[a] in WORD - {"_"} and len(labels) > 1 and all(labels) and len(labels[-1]) > 1 and labels[-1].isalpha():
            out.append((a, at + 1 + len(".".join(labels))))
    return out


def shaped(text, shape):
    """Spans that look like shape, in which 0 is any digit and every other character itself, apart from other words and numbers."""
    out = []
    for a in range(len(text) - len(shape) + 1):
        b = a + len(shape)
        if all((c in DIGITS) if s == "0" else c == s for c, s in zip(text[a:b], shape, strict=True)):
            if (a == 0 or text[a - 1] not in WORD | set(".-")) and (b == len(text) or text[b] not in WORD | {"-"}):
                out.append((a, b))
    return out


def found(text):
    counts, spans = collections.Counter(), emails(text)
    counts["email"] = len(spans)
    for a, b in spans:
        text = text[:a] + "@" * (b - a) + text[b:]
    phones = {s for lead in ("", "+1 ", "+1-", "+1.") for sep in " .-" for body in (f"000{sep}000{sep}0000", f"(000) 000{sep}0000", f"(000)000{sep}0000") for s in shaped(text, lead.replace("1", "0") + body)}
    for a, b in phones:
        if any(x < a and y == b for x, y in phones):
            continue  # the longer one, with its lead, counts
        d = "".join(c for c in text[a:b] if c in DIGITS)[-10:]
        counts["phone"] += d[0] in "23456789" and d[3] in "23456789"
    for a, b in shaped(text, "000-00-0000"):
        area, group, serial = text[a:b].split("-")
        counts["ssn"] += 0 < int(area) < 900 and area != "666" and int(group) > 0 and int(serial) > 0
    return {k: n for k, n in counts.items() if n}


def test_counts_equal_those_of_other_finders(spark):
    """E-mail addresses, telephone and social security numbers of the registered query, at the whole of sf0.001."""
    given = {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    total = collections.Counter()
    for r in queries.op5_pseudonyms(spark, SF).collect():
        want = found(given[r["doc_id"]])
        assert {k: r[f"n_{k}"] for k in ("email", "phone", "ssn") if r[f"n_{k}"]} == want, (r["doc_id"], want)
        total.update(want)
    assert total["email"] and total["phone"]
