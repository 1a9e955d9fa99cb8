"""Runs queries in Spark and their SQL in DuckDB over the same tables and compares rows (and names of columns).

python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def difference(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    theirs = Counter(tuple(plain(row[names.index(c)]) for c in order) for row in got.fetchall())
    ours = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    if ours == theirs:
        return None
    more, less = list((ours - theirs).items()), list((theirs - ours).items())
    return f"{order}: {sum(ours.values())} rows against {sum(theirs.values())}; {len(more)} only here, e.g. {more[:3]}; {len(less)} only there, e.g. {less[:3]}"


def main(sf_dir: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry

    spark = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    db, sql, bad = database(sf_dir), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if wanted and name not in wanted or not wanted and name not in sql:
            continue
        began = time.time()
        try:
            df = f(spark, sf_dir)
            said = difference(df, db, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception:
            said = "\n".join(x for x in traceback.format_exc().splitlines()[-12:] if not x.lstrip().startswith("at "))[-900:]
        bad += said is not None and not said.startswith("rows only")
        print(f"{'ok  ' if said is None else 'BAD '} {name} {time.time() - began:.1f}s" + (f" {said[:1500]}" if said else ""), flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(min(1, main(args[0] if args else "/root/testdata/sf0.01", args[1:])))
