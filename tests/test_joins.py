from collections import Counter

import pytest

from conftest import plan_of
from pyspark.sql import functions as F

from checks import queries
from registryloom.operators import joins

S = "NO NCT CODE"
CASES = {
    "plain": (["a", "b", "b", S, S, None], ["a", "a", "b", "c", "c"]),
    "marker on both sides": (["a", S, S, S, None, "d"], [S, S, "a", "e"]),
    "null on both sides": ([None, None, "x"], [None, "x", "x", "y"]),
    "both markers": ([None, S, "q"], [None, None, S, ""]),
    "hot right key": (["a", "b"], [""] * 50 + ["b"]),
    "empty right": (["a", S, None], []),
    "empty left": ([], ["a", S, None]),
}


def frames(spark, left, right):
    a = spark.createDataFrame([(i, k) for i, k in enumerate(left)], "lid int, nct_id string")
    b = spark.createDataFrame(
        [(k, i, "z") for i, k in enumerate(right)], "nct_id string, rid int, more string"
    )
    return a, b


@pytest.mark.parametrize("case", CASES)
def test_split_is_the_full_outer_join(spark, case):
    left, right = CASES[case]
    a, b = frames(spark, left, right)
    split = joins.split_join(a, b, "nct_id", right_columns=["rid", "absent"])
    want = [(i, k, j) for i, k in enumerate(left) for j, r in enumerate(right) if k == r]
    assert split.both.columns == ["lid", "nct_id", "rid_CT"]
    assert Counter(map(tuple, split.both.collect())) == Counter(want)
    assert Counter(map(tuple, split.left_only.collect())) == Counter(
        (i, k) for i, k in enumerate(left) if k not in right
    )
    assert Counter(map(tuple, split.right_only.collect())) == Counter(
        (k, j) for j, k in enumerate(right) if k not in left
    )
    counts = {r.bucket: r.n_rows for r in joins.bucket_counts(a, b, "nct_id").collect()}
    assert counts == {name: df.count() for name, df in split._asdict().items()}


def test_right_side_options(spark):
    a, b = frames(spark, ["a"], ["a", "b"])
    split = joins.split_join(a, b, "nct_id", suffix="_R", drop_right_key=True)
    assert split.both.columns == ["lid", "nct_id"], "no columns asked for: key only"
    wide = joins.split_join(
        a, b, "nct_id", right_columns=["more", "rid"], suffix="_R", drop_right_key=True
    )
    assert wide.both.columns == ["lid", "nct_id", "more_R", "rid_R"]
    assert [tuple(r) for r in wide.right_only.collect()] == [("z", 1)]


def test_union_keeps_copies_and_fills_gaps(spark):
    a, b = frames(spark, ["a", "a"], ["a"])
    out = joins.stack(a.drop("lid"), b)
    assert out.columns == ["nct_id", "rid", "more"]
    assert Counter(map(tuple, out.collect())) == Counter(
        {("a", None, None): 2, ("a", 0, "z"): 1}
    )


@pytest.fixture
def skewed(spark, tmp_path):
    """A third of the left rows under the marker and a third under one real key."""
    spark.range(60000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "HOT")
        .when(F.col("id") % 3 == 1, S)
        .otherwise(F.concat(F.lit("K"), F.col("id").cast("string")))
        .alias("nct_id"),
        F.concat(*[F.sha2(F.concat("id", F.lit(i)), 512) for i in range(4)]).alias("payload"),
    ).repartition(8).write.parquet(str(tmp_path / "left"))
    keys = F.when(F.col("id") < 1, "HOT").otherwise(F.concat(F.lit("K"), F.col("id") * 4))
    spark.range(20000).select(keys.alias("nct_id"), F.col("id").alias("rid")).write.parquet(
        str(tmp_path / "right")
    )
    tight = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in tight}
    for k, v in tight.items():
        spark.conf.set(k, v)
    yield [spark.read.parquet(str(tmp_path / side)) for side in ("left", "right")]
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("part, rows", [("both", 25000), ("left_only", 35000)])
def test_hot_keys_are_split_or_kept_out_of_the_shuffle(skewed, part, rows):
    split = joins.split_join(*skewed, "nct_id", right_columns=["rid"])
    df = getattr(split, part)
    done = df.groupBy().agg(F.count("*").alias("n"), F.max("payload"))
    assert done.collect()[0].n == rows
    final = plan_of(done).split("== Initial Plan ==")[0]
    assert "SortMergeJoin(skew=true)" in final
    assert "Cartesian" not in final and "NestedLoop" not in final


def test_marker_rows_do_not_shuffle(skewed):
    left, right = skewed
    rows = joins.unmatched_hot(left, right, "nct_id")
    assert rows.count() == 20000
    rows.collect()
    final = plan_of(rows).split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final


def test_marker_rows_spread_when_the_right_side_has_the_marker(spark, skewed):
    left, right = skewed
    marked = right.union(spark.createDataFrame([(S, -1), (S, -2)], right.schema))
    both = joins.matched(left, marked, "nct_id", salts=4)
    assert both.filter(F.col("nct_id") == S).count() == 40000
    assert both.filter("rid < 0").select("id", "rid").distinct().count() == 40000


def test_keys_hot_on_both_sides_form_no_pairs(spark, tmp_path, monkeypatch):
    rows = spark.range(6000).selectExpr(
        "id AS o_orderkey", "id % 9 AS o_custkey", "'O' AS o_orderstatus", "timestamp'1995-01-02' AS o_orderdate",
        "concat('P', id % 7) AS o_orderpriority",
    )
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    buyers = spark.range(9).selectExpr("id AS c_custkey", "'BUILDING' AS c_mktsegment", "id % 5 AS c_nationkey")
    buyers.write.parquet(f"{tmp_path}/customer.parquet")
    splits, split_join = [], joins.split_join

    def kept(*args, **options):
        splits.append(split_join(*args, **options))
        return splits[-1]

    monkeypatch.setattr(joins, "split_join", kept)
    out = {r.trial_id: r.n_rows for r in queries.join_hot_keys(spark, str(tmp_path)).collect()}
    hot = {n for i, n in out.items() if i % 3 == 0}
    assert len(hot) == 1 and hot.pop() > 1
    assert splits[0].both.count() <= 6000
    assert splits[0].both.count() == len(out) < sum(out.values())


def test_totals_per_key_keep_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 2), (None, None)], "k string, v int")
    out = joins.per_key(df, "k", n=F.count(F.lit(1)), top=F.max("v")).collect()
    assert sorted(out, key=str) == sorted([("a", 2, 3), (None, 2, 2)], key=str)
