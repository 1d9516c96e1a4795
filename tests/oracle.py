"""Run queries beside their SQL: python tests/oracle.py SF_DIR [NAME...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    fixed = lambda x: round(float(x), 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted((tuple(fixed(x) for x in r) for r in frame[cols].itertuples(index=False)), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    got = query(spark, sf_dir).toPandas()
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (name, list(got.columns), list(want.columns))
    a, b = rows(got), rows(want)
    assert a == b, (name, len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    return len(a)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sys.argv[1])
    for name, sql in entry.oracle_sql().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            print(name, "same", compare(spark, con, sys.argv[1], name, entry.queries()[name], sql), round(time.time() - began, 1), flush=True)
        except Exception as e:
            print(name, "DIFFERS", str(e)[:900], flush=True)
