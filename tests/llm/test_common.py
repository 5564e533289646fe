import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import common


def test_memo_is_bounded_and_given_up():
    calls = []
    memo = common.Memo("one", lambda k: calls.append(k) or len(k), limit=3, longest=4)
    assert [memo[k] for k in ("a", "bb", "a", "longer", "longer")] == [1, 2, 1, 6, 6]
    assert calls == ["a", "bb", "longer", "longer"] and set(memo) == {"a", "bb"}
    memo["c"], memo["d"]
    assert len(memo) <= 3
    common.take_over("one")
    assert memo
    common.take_over("two")
    assert not memo


def test_free_memory_goes_back():
    """A worker that takes over doesn't carry what is free, even below memory in use."""

    def held() -> float:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Anonymous:\s+(\d+)", f.read())[1]) / 1024

    blocks = [bytes(1000) for _ in range(200_000)]
    full, last = held(), blocks[-1]
    del blocks
    common.take_over("three")
    assert len(last) == 1000 and held() < full - 100


def test_prefix_sums(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice("aaab"), rng.randrange(5), rng.randrange(10)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, bucket long, v long")
    got = {r.id: r.before for r in common.prefix_sums(df, "g", "bucket", ["id"], F.col("v"), "before").collect()}
    sums: dict[str, int] = {}
    for k, g, _, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        assert got[k] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v


def test_checked_joins(spark):
    left, right = spark.range(50).withColumnRenamed("id", "k"), spark.range(0, 50, 2).withColumnRenamed("id", "k")
    assert common.small(right, 25) and not common.small(right, 24)
    for rows in (10, 100):
        plan = common.join_checked(left, right, "k", "left_semi", rows)
        assert plan.count() == 25
        assert ("broadcast" in plan._jdf.queryExecution().analyzed().toString().lower()) == (rows == 100)


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.range(20).select("id", F.array_repeat(F.lit(1), 100).alias("a"), F.repeat(F.lit("x"), 50).alias("s"))
    assert common.small(df, 20, 20 * (8 + 808 + 58)) and not common.small(df, 20, 20 * (8 + 808 + 58) - 1)
    assert common.small(df.limit(0), 0)


def test_session_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.newSession()
    assert common.tuned(own).conf.get(key) == str(common.ARROW_ROWS)
    own.conf.set(key, "10000")
    assert common.tuned(own).conf.get(key) == "10000"


def test_cluster_without_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError):
        common.shared_folder(Session)
