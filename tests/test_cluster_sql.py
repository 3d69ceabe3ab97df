"""The SQL of clusters settles chains of any length."""

import duckdb

from postflow.queries.posting import STATES_SQL


def test_a_chain_of_records_is_settled_to_its_end():
    edges = ", ".join(f"({k}, {k + 1})" for k in range(1, 20))
    got = duckdb.execute(f"WITH r AS (SELECT unnest(range(1, 21)) AS doc_id), edges AS (SELECT * FROM (VALUES {edges}) e(u, v)), {STATES_SQL} SELECT k, h FROM states ORDER BY k").fetchall()
    assert got == [(k, k % 2 == 1) for k in range(1, 21)]
