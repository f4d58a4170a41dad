"""Every registered query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from spanglass.plans import catalogue, further, imaging, instruments, observing  # noqa: F401 (add their queries to the register)

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def comparable(row):
    return tuple((0, "") if v is None else (1, round(v, 6) if math.isfinite(v) else str(v)) if isinstance(v, float) else (1, float(v)) if isinstance(v, int) and not isinstance(v, bool) else (2, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(comparable(r) for r in df.select(*sorted(df.columns)).collect())
    rel = con.sql(catalogue.ORACLE[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(comparable(r) for r in con.sql(f"SELECT {', '.join(sorted(rel.columns))} FROM ({catalogue.ORACLE[name]})").fetchall())
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (a[0] == b[0] == 1 and math.isclose(a[1], b[1], rel_tol=1e-7, abs_tol=2e-4)) for a, b in zip(g, w, strict=True)), (g, w)
