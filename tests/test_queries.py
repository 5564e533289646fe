"""Every query against its SQL in another engine, over the smallest tables."""

import math
import os

import duckdb
import pytest

from quern.queries import ORACLES, QUERIES

FOLDER = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(row):
    return tuple(float(x) if hasattr(x, "as_tuple") else x for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other, name):
    df = QUERIES[name](spark, FOLDER)
    got = sorted((plain(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    result = other.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((plain([r[k] for k in order]) for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


def test_sums_follow_the_rows_of_the_files(spark, tmp_path):
    """(0.09 + 0.05) + 0.04 and 0.09 + (0.05 + 0.04) lie on two sides of three times 0.06; the second file is the larger one, which Spark reads first."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"COPY (SELECT k AS l_orderkey, 0.09::DOUBLE AS l_discount, 0.05::DOUBLE AS l_tax FROM range(50) r(k)) TO '{folder}/a.parquet'")
    later = "SELECT k AS l_orderkey, CASE WHEN n = 0 THEN 0.05 ELSE 0.04 END::DOUBLE AS l_discount, 0.05::DOUBLE AS l_tax FROM range(2) s(n), range(50) r(k)"
    con.execute(f"COPY ({later} UNION ALL SELECT 1000 + k % 700, CASE WHEN k % 700 > 0 THEN k * 7 % 11 / 100 END, k * 5 % 9 / 100 FROM range(5000) r(k)) TO '{folder}/b.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    want = dict(con.execute(ORACLES["scale_steps"]).fetchall())
    got = {r.l_orderkey: r.step for r in QUERIES["scale_steps"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 750
