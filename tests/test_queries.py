"""Every registered query with SQL gives the rows of its SQL; every other one runs."""

import os

import duckdb
import pytest

from corvina.plans import registry, search


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return str(round(value, 6) + 0.0)
    return str(value)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(rows, df.columns) == normal(want.fetchall(), columns)


def test_names_of_sql_are_registered():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_every_title_is_a_case(spark, data, duck):
    """The registered SQL leaves out titles of up to 12 characters and those with 1 or more than 50 chunks."""
    whole = f"""WITH {search._TERMS}, {search._weighted('terms', 'v')}, titled AS (SELECT DISTINCT section_title AS query_id, chunk_id, document_id FROM cur WHERE regexp_matches(section_title, '\\S')),
cases AS (SELECT query_id, count(DISTINCT chunk_id) AS relevant, count(DISTINCT document_id) AS documents FROM titled GROUP BY 1), {search._query('SELECT query_id, query_id AS query_text FROM cases')},
top AS (SELECT query_id, id AS chunk_id, document_id FROM sparse JOIN cur ON chunk_id = id WHERE rank <= 5),
h AS (SELECT query_id, count(*) AS hits FROM top JOIN titled USING (query_id, chunk_id) GROUP BY 1), c AS (SELECT query_id, count(DISTINCT document_id) AS covered FROM top JOIN titled USING (query_id, document_id) GROUP BY 1)
SELECT count(*), round(avg(coalesce(hits, 0) / 5e0), 4), round(avg(coalesce(hits, 0) / relevant), 4), round(avg(coalesce(covered, 0) / documents), 4) FROM cases LEFT JOIN h USING (query_id) LEFT JOIN c USING (query_id)"""
    got = search.retrieval_eval(spark, data).first()
    assert tuple(got) == pytest.approx(duck.execute(whole).fetchone())
    titles = duck.execute("SELECT count(DISTINCT section_title) FROM chunks WHERE regexp_matches(section_title, '\\S')").fetchone()[0]
    assert got.cases == titles
