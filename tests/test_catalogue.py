"""Every query with SQL against DuckDB over the same files."""

import duckdb
import pytest

from tristage.plans import catalogue, catalogue_compare, catalogue_elements, catalogue_extract, catalogue_findings, catalogue_judgement, catalogue_labels, catalogue_layers, catalogue_materials, catalogue_places, catalogue_relations, catalogue_review, catalogue_revisions, catalogue_sheets, catalogue_text  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None):
        out.append(tuple(round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else None if x is None else str(x) for x in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql(spark):
    """A page has one partner at most, and partners ascend on both sides."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"aligned_pages", "placed_pages"}
    pairs = sorted(map(tuple, catalogue.QUERIES["aligned_pages"](spark, DATA).collect()))
    assert pairs and all(a[0] < b[0] or a[1] < b[1] and a[2] < b[2] for a, b in zip(pairs, pairs[1:], strict=False))
