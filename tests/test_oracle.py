"""A sample of every family against its SQL at the smallest scale; tools/check.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "orders lineitem events documents embeddings labels".split()
SAMPLE = ["leaderboard", "k08_roc_auc", "k18_auc_vs_reference", "t02_prior_shift", "f03_bag_topk", "b05_paired_bootstrap", "d10_pair_evidence",
          "c11_opposite_neighbour", "l04_running_best", "l11_resource_summary", "n08_robust_filter", "x06_residual_auc", "w04_stream_best"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = entry.queries()[name](spark, folder).toPandas(), con.sql(entry.oracle_sql()[name]).df()

    def tidy(df):
        df = df[sorted(df.columns)].round(5)
        return sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))

    assert sorted(got.columns) == sorted(want.columns) and tidy(got) == tidy(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
