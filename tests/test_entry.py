import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
QUICK = ("top_skills", "skill_share", "criteria_search", "posted_date_parse", "harvest_cards", "page_rule",
         "quota_by_ranges", "knn_batch", "transcript_checks")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(str([r[names.index(c)] for c in df.columns]) for r in cursor.fetchall())
    assert sorted(str(list(r)) for r in df.collect()) == want
