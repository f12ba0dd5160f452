import pytest
from pyspark.sql import functions as F

from tidewheel.plans.pipeline import InvalidPipeline, Pipeline


def _rows(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v long")


def test_a_pipeline_runs_in_order_and_fans_out(spark):
    p = Pipeline("demo")
    source = p.source("rows", _rows(spark))
    odd = source.filter("odd", F.col("v") % 2 == 1)
    sums = source.key_by("k").process("sums", lambda df: df.groupBy("k").agg(F.sum("v").alias("v"))).parallelism(2)
    both = odd.union("both", sums)
    both.sink("out", lambda df: sorted((r.k, r.v) for r in df.collect()))
    sums.key_by("k").sink("count", lambda df: df.count())
    plan = p.build()
    assert plan.order() == ["rows", "odd", "sums", "both", "out", "count"]
    assert plan.downstream("rows") == ["odd", "sums"] and plan.sources() == ["rows"] and plan.sinks() == ["out", "count"]
    assert plan.run() == {"out": [("a", 1), ("a", 3), ("a", 4), ("b", 2)], "count": 2}


@pytest.mark.parametrize(
    ("make", "message"),
    [
        (lambda p, df: None, "no steps"),
        (lambda p, df: (p.source("x", df), p.source("x", df)), "two steps are called 'x'"),
        (lambda p, df: p.source("", df), "no id"),
        (lambda p, df: p.source("x", df).parallelism(0), "x: parallelism"),
        (lambda p, df: p.source("x", df).parallelism(129), "x: parallelism"),
        (lambda p, df: p.source("x", df).sink("s", print).process("y", lambda d: d), "nothing comes out"),
    ],
)
def test_what_is_wrong_is_said_by_step(spark, make, message):
    p = Pipeline("wrong")
    make(p, _rows(spark))
    with pytest.raises(InvalidPipeline, match=message):
        p.build()


def test_unions_and_event_time_are_checked_at_once(spark):
    df, p, q = _rows(spark), Pipeline("p"), Pipeline("q")
    a, b = p.source("a", df), q.source("b", df)
    for other in (a, b):
        with pytest.raises(InvalidPipeline):
            a.union("u", other)
    with pytest.raises(InvalidPipeline, match="belongs to a source"):
        a.filter("f", "v > 1").with_event_time(lambda d: d)
    with pytest.raises(InvalidPipeline):
        a.key_by()
    with pytest.raises(InvalidPipeline, match="greatest parallelism"):
        p.most = 500
        p.build()
