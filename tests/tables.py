"""Altered copies of the tables: empty ones, and ones with nulls in any column."""

from __future__ import annotations

import glob
import os

import duckdb

#: Columns that identify a row; the SQL to compare with takes them as given.
IDS = {"reading_id", "_row", "doc_id", "vec_id", "image_id", "event_id"}
FIXED = {"split_shares", "pack_capacity", "region", "nation"}


def copy(source: str, target: str, empty: bool = False, ids: bool = False) -> str:
    """Tables of `source` in `target`: without rows, or with every seventh value or so null, in
    identifiers too if `ids`, and a column more that clashes with inner names."""
    os.makedirs(target, exist_ok=True)
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{source}/*.parquet")):
        name = os.path.basename(path)[:-8]
        columns = [r[0] for r in con.execute(f"describe select * from '{path}'").fetchall()]
        if empty and name not in FIXED:
            what = "select *"
        elif name in FIXED or name == "locations":
            what = "select *"
        else:
            keep = lambda c, k: f'"{c}"' if c in IDS and not ids else f'case when hash(rid, {k}) % 7 = 0 then null else "{c}" end as "{c}"'
            what = "select " + ", ".join(keep(c, k) for k, c in enumerate(columns)) + ", 1 as source, 'x' as look, 'y' as place"
        rows = "limit 0" if empty and name not in FIXED else ""
        con.execute(f"copy ({what} from (select *, row_number() over () as rid from '{path}') {rows}) to '{target}/{name}.parquet' (format parquet)".replace("select * from (select *, row_number() over () as rid from", "select * exclude (rid) from (select *, row_number() over () as rid from"))
    return target
