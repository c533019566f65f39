"""The driver contract: every query runs; a sample agrees with its SQL."""

import duckdb
import pytest

import __spark_entry__ as E
from tonemill.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "n", "share"] and df.count() == 3


def test_every_query_has_oracle_or_reason():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


@pytest.mark.parametrize("name", ["label_rules", "report_reviews", "label_ensemble", "valence_compound_join",
                                  "skip_bad_lines", "row_at", "label_with_scorer", "export_tiers"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)

    def canon(names, rows):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows),
                      key=repr)

    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, res.fetchall())
