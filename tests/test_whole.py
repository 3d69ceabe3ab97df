"""Queries that must give the whole job: against SQL of their own, without filters by id and cuts."""

import duckdb
import pytest

from postflow.queries import QUERIES
from postflow.sources import bindings

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents labels conversations".split()
WHOLE = {
    "a14_run_status": "SELECT provider, ['ok','degraded','failed'][max(errors) + 1] AS status FROM boards GROUP BY 1",
    "j20_contacts_of_job": "SELECT job_id, token, provider FROM listings JOIN boards USING (board_id)",
    "j16_verdicts_batch": "SELECT l.doc_id, quality, d.source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id",
    "l07_contact_ranking": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY contains(lower(text), 'the') DESC, role = 'user' DESC, turn) AS rank FROM conversations",
    "l08_suggestions": "SELECT title, count(*) AS n FROM titles GROUP BY 1",
    "o07_concatenation": "SELECT id, 'active' AS budget FROM jobs WHERE is_active UNION ALL SELECT id, 'market F' FROM jobs WHERE market = 'F'",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(f"WITH {bindings.SQL.strip()} {WHOLE[name]}")
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, result.fetchall()))
