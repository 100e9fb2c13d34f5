"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loomfield import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_queries_without_sql_are_held_against_numpy():
    """By test_integrity.py and test_arrays.py, over all rows."""
    assert set(plans.queries()) - set(ORACLES) == {
        "consensus_vectors", "covariance_spectrum", "luma_near_pairs", "luma_near_members", "texture_patterns", "verified_matches", "principal_coordinates",
    }
