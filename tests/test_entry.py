"""The registry: names, and the flagship query."""

import __spark_entry__


def test_registry(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 45
    rows = {r.code: r.runs for r in __spark_entry__.entry(spark).collect()}
    assert [rows[c] for c in sorted(rows)] == [8, 2, 2, 13, 11, 5]
