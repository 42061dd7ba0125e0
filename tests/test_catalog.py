"""Every registered query against its SQL on the smallest data set."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from sentrymill.catalog.oracle_queries import ORACLE
from sentrymill.catalog.queries import QUERIES

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_upsert_extracts_every_article_once(spark, monkeypatch):
    """c8_upsert reads the older articles for its links and the newer ones for the upsert, not the newer ones twice."""
    from sentrymill.catalog import queries as Q
    t, seen = Q.tables(spark, f"/root/testdata/{SF}"), []
    old = Q.c("published_at") < Q.F.lit("1998-06-01").cast("timestamp_ntz")
    fresh = Q.Tables(spark, t.sf_dir)
    assert sorted(map(str, fresh.extracted_where(old).collect())) == sorted(map(str, t.extracted.filter(old).collect()))
    for module in (Q.pipeline, Q.INC):
        real = module.process_and_extract
        monkeypatch.setattr(module, "process_and_extract", lambda a, *x, real=real: seen.append(a.count()) or real(a, *x))
    assert Q.c8_upsert(fresh).count() == seen[1] and sum(seen) == t.articles.count() and min(seen) > 0
    assert not {"decided", "extracted"} & set(fresh.__dict__)
