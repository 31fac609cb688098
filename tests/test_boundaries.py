"""Values on the boundaries of a query's steps, against its SQL, and texts that break a careless pattern."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.plans.registry import ORACLES, QUERIES


def _both(spark, folder, name, **tables):
    duck = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = duck.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    got = QUERIES[name](spark, str(folder)).toPandas()
    return sorted(got[columns].astype(str).values.tolist()), sorted(want[columns].astype(str).values.tolist())


def test_a_name_of_many_words_and_a_long_run_of_white_space(spark):
    long = "featuring " + "Word " * 100_000
    rows = [(1, long), (2, "featuring\nGuest DJ " + "Word " * 100_000), (3, " " * 100_000 + "a" + "\n " * 100_000 + "b \n\t ")]
    df = spark.createDataFrame(rows, "k int, s string").select("k", text.names_performer(F.lit(""), F.col("s")).alias("named"), text.strip(F.col("s")).alias("bare"))
    got = {r.k: r for r in df.collect()}
    assert [got[k].named for k in (1, 2, 3)] == [True, True, False]
    assert got[3].bare == rows[2][1].strip() and got[1].bare == long.strip()


def test_events_just_before_a_page_begins(spark, tmp_path):
    at = [datetime(2024, 1, 4, 23, 59, 59, us) for us in (400_000, 500_000, 600_000)] + [datetime(2024, 1, 5), datetime(2024, 1, 1, 0, 0, 1, 500_000)]
    rows = [(k, ts, k % 2) for k, ts in enumerate(at)]
    got, want = _both(spark, tmp_path, "api_paged_scan", events=(rows, "event_id long, ts timestamp_ntz, user_id long"))
    assert got == want and len(got) == 5


def test_prices_of_half_a_unit(spark, tmp_path):
    rows = [(k, k, price, datetime(1998, 6, 3)) for k, price in enumerate((9000.5, 9000.5, 1999.5, 2000.5, 5999.5, 18000.5, 1.5), 1)]
    got, want = _both(spark, tmp_path, "sellout_risk", orders=(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"))
    assert got == want
