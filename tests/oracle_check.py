"""Compare every registered query with its SQL: same columns, same rows in any order.

Run as ``python tests/oracle_check.py <data folder> [query …]``.
"""

from __future__ import annotations

import sys
import time
import traceback
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SAME_TYPE = {"int": "integer", "string": "varchar", "bigint": "bigint"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def compare(con, spark, sf_dir: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    mine = Counter(
        tuple(plain(row[c]) for c in names) for row in frame.collect()
    )
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    if sorted(theirs_names) != names:
        return f"columns {names} / {sorted(theirs_names)}"
    order = [theirs_names.index(c) for c in names]
    types = {c: str(result.description[theirs_names.index(c)][1]).lower() for c in names}
    for c, t in frame.dtypes:
        if SAME_TYPE.get(t, t) != types[c]:
            print(f"  note: {c} is {t} here, {types[c]} in SQL")
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    if mine == theirs:
        return ""
    only_mine, only_theirs = list((mine - theirs).items()), list((theirs - mine).items())
    return (
        f"{sum(mine.values())} / {sum(theirs.values())} rows; "
        f"{len(only_mine)} only here, {len(only_theirs)} only in SQL\n"
        f"  {names}\n  here {only_mine[:3]}\n  SQL  {only_theirs[:3]}"
    )


def main() -> int:
    import __spark_entry__ as entry

    from pricelens.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con, failed = local_session(), connect(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(con, spark, sf_dir, query, sqls[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            if wanted:
                traceback.print_exc()
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("missing SQL:", sorted(set(entry.queries()) - set(sqls)), "failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
