"""Compare registered queries with their SQL on DuckDB: python tests/oracle.py [folder] [name ...]"""

import glob
import os
import sys
import time

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if isinstance(v, float):
            return repr(v)
        return str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def compare(spark, con, query, folder):
    """None if the query agrees with its SQL, else a short description of the difference."""
    df = query.run(spark, folder)
    mine = df.collect()
    if query.sql is None:
        return None if mine else "no rows"
    cursor = con.execute(query.sql)
    columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {df.columns} != {columns}"
    a, b = canonical(mine, df.columns), canonical(theirs, columns)
    if a == b:
        return None if a else "no rows on either side"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, e.g. {sorted(columns)} {wrong[0][0]} != {wrong[0][1]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from gridprobe.catalog import QUERIES
    from gridprobe.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(folder)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, con, QUERIES[name], folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:300]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - started:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
