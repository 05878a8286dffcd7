"""The queries with checking SQL against it, over the smallest data."""

import duckdb
import pytest

from marginalia.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("duplicate_pairs", "extract_results", "mentions", "episodes"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(round(float(v), 5) if isinstance(v, float) else v for v in (r[k] for k in columns))) for r in df.collect())
    result = c.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(tuple(round(float(v), 5) if isinstance(v, float) else v for v in (row[names.index(k)] for k in columns))) for row in result.fetchall())
    assert got == want


@pytest.mark.parametrize(("name", "columns"), [
    ("p1_found", ["group_id", "name_a", "name_b"]), ("p5_found", ["group_id", "uuid"]), ("p6_found", ["group_id", "uuid", "kind", "start_pos", "end_pos"]), ("p9_found", ["doc_id", "seg_start", "lang"]),
])
def test_columns(spark, data, name, columns):
    assert QUERIES[name](spark, data).columns == columns
