"""Rescans as a stream: listings of files become inserts, updates and deletes by what is known of each path.

A row of a listing tells that a path had a modification time, or none (it was gone), at a moment. Rows may be repeated and come late: one
that is not newer than what is known of its path changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "path string, change string, mtime long, seen long"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # mtime and seen as text, so that none becomes a float beside a null
    known, mtime = state.get if state.exists else (None, None)
    rows = sorted({(int(s), None if m is None else int(m)) for f in frames for s, m in zip(f["seen"], f["mtime"], strict=True)}, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    out = []
    for seen, found in rows:
        if known is not None and seen < known or (known == seen and not (found is not None and (mtime is None or found > mtime))):
            continue
        if found is None:
            change = "delete" if mtime is not None else None
        else:
            change = "insert" if mtime is None else "update" if found > mtime else None
        if change:
            out.append((key[0], change, found, seen))
        known, mtime = seen, found if found is None or mtime is None else max(found, mtime)
    if rows:
        state.update((known, mtime))
    made = pd.DataFrame(out, columns=["path", "change", "mtime", "seen"])
    yield made.astype({"mtime": "Int64", "seen": "Int64"})


def changes(listings: DataFrame) -> DataFrame:
    """(path, change, mtime, seen) of a stream of listings (path, mtime long or null if gone, seen long): insert, update or delete.

    Of rows with one path and moment the newest modification time counts. Rows without a path or moment are left out. What is held
    is two numbers for each path ever seen.
    """
    rows = listings.where("path is not null and seen is not null").selectExpr("path", "cast(mtime as string) as mtime", "cast(seen as string) as seen")
    return rows.groupBy("path").applyInPandasWithState(_follow, CHANGE, "known long, mtime long", "append", GroupStateTimeout.NoTimeout)
