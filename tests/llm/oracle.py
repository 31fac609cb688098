"""Results of a query against those of its SQL on the same tables."""

import duckdb
import pandas as pd

from marquee.llm.queries import ORACLES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def assert_same(got: pd.DataFrame, name: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda frame: sorted((tuple(None if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
