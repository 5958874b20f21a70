from collections import Counter

import pytest

from conftest import plan_of
from pyspark.sql import functions as F

from registryloom.names import Names
from registryloom.operators import lookups


@pytest.fixture(scope="module")
def sponsors(spark):
    names = ["Acme & Co", "acme co", " Beta  Inc.", "Gamma", "", None]
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, lead_sponsor string")


@pytest.fixture(scope="module")
def sponsor_map(spark):
    return spark.createDataFrame(
        [("ACME & CO", "Acme"), ("beta inc", "std beta"), ("Beta Inc", "Beta 2"), ("x", None)],
        "lead_sponsor string, standard_name string",
    )


def appended(df):
    return Counter((r.id, r.standard_name) for r in df.collect())


def test_compat_keys_miss_where_idempotent_keys_meet(sponsors, sponsor_map):
    clean = lookups.clean_lookup(sponsor_map)
    assert {r.standard_name for r in clean.collect()} == {"Acme", "Std Beta", "Beta 2", ""}
    compat = lookups.lookup_append(sponsors, clean, left_key="lead_sponsor")
    beta = {(2, "Std Beta"): 1, (2, "Beta 2"): 1}
    rest = {(3, None): 1, (4, None): 1, (5, None): 1}
    assert appended(compat) == Counter({(0, None): 1, (1, "Acme"): 1, **beta, **rest})
    again = lookups.lookup_append(sponsors, clean, left_key="lead_sponsor", mode="idempotent")
    assert appended(again) == Counter({(0, "Acme"): 1, (1, "Acme"): 1, **beta, **rest})


def test_raw_lookup_and_null_keys(spark, sponsors):
    raw = spark.createDataFrame(
        [("Acme & Co", "A"), (None, "N"), ("", "E")], "k string, standard_name string"
    )
    out = lookups.lookup_append(sponsors, raw, left_key="lead_sponsor", right_key="k")
    got = {r.id: r.standard_name for r in out.collect()}
    assert got == {0: "A", 1: None, 2: None, 3: None, 4: "E", 5: "N"}
    assert out.columns == ["id", "lead_sponsor", "standard_name"]


def test_missing_key_column_is_an_error(spark, sponsors, sponsor_map):
    raw = spark.createDataFrame([("", "E"), ("x", "X")], "k string, v string")
    with pytest.raises(ValueError, match="absent"):
        lookups.lookup_append(sponsors, raw, left_key="absent", right_key="k")
    with pytest.raises(ValueError, match="lead_sponsor"):
        lookups.lookup_append(sponsors, raw, left_key="lead_sponsor")
    with pytest.raises(ValueError, match="'standard_name'"):
        lookups.lookup_chain(sponsors, sponsor_map, raw, raw, us_add=["v"], ww_add=["v"])


def test_keys_lose_punctuation_whatever_the_cleaning(spark):
    df = spark.createDataFrame([("Acme, Inc.",)], "lead_sponsor string")
    m = spark.createDataFrame([("ACME INC", "A. B")], "lead_sponsor string, standard_name string")
    us = spark.createDataFrame([("a b", "x-1")], "standard_name string, us_segment string")
    ww = us.withColumnRenamed("us_segment", "ww_segment")
    out = lookups.lookup_chain(df, m, us, ww, punct=False)
    assert [tuple(r) for r in out.collect()] == [("Acme, Inc.", "A. B", "X-1", "X-1")]


def test_each_table_may_have_its_own_key(spark):
    df = spark.createDataFrame([("acme",), ("none",)], "who string")
    m = spark.createDataFrame([("ACME", "std")], "k1 string, standard_name string")
    us = spark.createDataFrame([("Std", "u")], "k2 string, us_segment string")
    ww = spark.createDataFrame([("STD", "w")], "k3 string, ww_segment string")
    keys = {"map_left_key": "who", "map_right_key": "k1", "us_key": "k2", "ww_key": "k3"}
    for cleanse, found in ((True, ("acme", "Std", "U", "W")), (False, ("acme", "std", "u", "w"))):
        out = lookups.lookup_chain(df, m, us, ww, cleanse=cleanse, **keys)
        assert {tuple(r) for r in out.collect()} == {found, ("none", None, "Others", "Others")}


def test_number_columns_are_spared(spark):
    raw = spark.createDataFrame([("a.", "12.5"), ("b", "-0.75"), ("c", None)], "k string, n string")
    clean = lookups.clean_lookup(raw, numbers=["n"])
    assert {tuple(r) for r in clean.collect()} == {("A", 12.5), ("B", -0.75), ("C", 0.0)}


def test_trials_move_once_for_three_shuffled_lookups(spark, sponsors, sponsor_map):
    us = spark.createDataFrame([("ACME", "x")], "standard_name string, us_segment string")
    ww = us.withColumnRenamed("us_segment", "ww_segment")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        plan = plan_of(lookups.lookup_chain(sponsors, sponsor_map, us, ww))
        utils = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
        out = lookups.lookup_chain(sponsors, sponsor_map, us, ww)
        text = utils.explainString(out._jdf.queryExecution(), "formatted")
    finally:
        for k in keys:
            spark.conf.unset(k)
    moved = [part for part in text.split("\n\n") if "Exchange\n" in part and "[id#" in part]
    assert len(moved) == 1 and plan.count("SortMergeJoin") == 3


def test_name_clash_is_an_error(sponsors):
    with pytest.raises(ValueError, match="id"):
        lookups.lookup_append(sponsors, sponsors, left_key="lead_sponsor")


def test_default_fill(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("a",)], "s string")
    assert [r.s for r in lookups.fill_default(df, "s").collect()] == ["Others", "Others", " ", "a"]


def test_chain(spark, sponsors, sponsor_map):
    us = spark.createDataFrame(
        [("ACME", "global pharma"), ("Std-Beta", None)], "standard_name string, us_segment string"
    )
    ww = spark.createDataFrame(
        [("acme", "SMID"), ("acme", "Big")], "standard_name string, ww_segment string"
    )
    out = lookups.lookup_chain(sponsors, sponsor_map, us, ww)
    assert out.columns == [*sponsors.columns, "standard_name", "us_segment", "ww_segment"]
    got = Counter((r.id, r.standard_name, r.us_segment, r.ww_segment) for r in out.collect())
    none = {(i, None, "Others", "Others"): 1 for i in (0, 3, 4, 5)}
    assert got == Counter({
        **none,
        (1, "Acme", "Global Pharma", "Smid"): 1,
        (1, "Acme", "Global Pharma", "Big"): 1,
        (2, "Std Beta", "Others", "Others"): 1,
        (2, "Beta 2", "Others", "Others"): 1,
    })


def test_chain_without_cleaning_matches_null_with_null(spark, sponsors, sponsor_map):
    seg = spark.createDataFrame([(None, "none")], "standard_name string, us_segment string")
    ww = seg.withColumnRenamed("us_segment", "ww_segment")
    out = lookups.lookup_chain(sponsors, sponsor_map, seg, ww, cleanse=False)
    assert {(r.standard_name, r.us_segment) for r in out.collect()} == {
        (None, "none"), ("std beta", "Others"), ("Beta 2", "Others"), ("Acme", "Others")}


def test_chain_equals_three_single_lookups(spark, sponsors, sponsor_map):
    seg = spark.createDataFrame([("a-cme", "x")], "standard_name string, us_segment string")
    ww = seg.withColumnRenamed("us_segment", "ww_segment")
    chain = lookups.lookup_chain(sponsors, sponsor_map, seg, ww)
    out = lookups.lookup_append(sponsors, lookups.clean_lookup(sponsor_map), left_key="lead_sponsor")
    for table, value in ((seg, "us_segment"), (ww, "ww_segment")):
        out = lookups.lookup_append(out, lookups.clean_lookup(table), left_key="standard_name")
        out = lookups.fill_default(out, value)
    assert Counter(map(tuple, chain.collect())) == Counter(map(tuple, out.collect()))


def test_broadcast_only_below_the_size_limit(spark, sponsors, sponsor_map):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        small, empty = lookups.broadcast_small(sponsor_map, sponsor_map.filter("standard_name = 'none'"))
        (large,) = lookups.broadcast_small(sponsor_map, max_bytes=10)
        for table, broadcast in ((small, True), (empty, True), (large, False)):
            out = lookups.lookup_append(
                sponsors, lookups.clean_lookup(table), left_key="lead_sponsor"
            )
            assert ("BroadcastHashJoin" in plan_of(out)) == broadcast
        assert "CartesianProduct" not in plan_of(out)
        rows = lookups.lookup_append(sponsors, large, left_key="lead_sponsor")
        assert rows.count() == 7, "the shuffled join gives the same rows"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_large_lookups_join_by_shuffle_and_split_the_hot_sponsor(spark, tmp_path):
    trials = spark.range(60000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "Hot Co")
        .otherwise(F.concat(F.lit("co "), F.col("id").cast("string")))
        .alias("lead_sponsor"),
        F.concat(*[F.sha2(F.concat("id", F.lit(i)), 512) for i in range(4)]).alias("payload"),
    )
    trials.repartition(8).write.parquet(str(tmp_path / "trials"))
    names = spark.range(20000).select(
        F.when(F.col("id") == 0, "hot co")
        .otherwise(F.concat(F.lit("CO "), F.col("id").cast("string")))
        .alias("lead_sponsor"),
        F.concat(F.lit("std "), F.col("id").cast("string")).alias("standard_name"),
    )
    tight = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for k, v in tight.items():
        spark.conf.set(k, v)
    try:
        (table,) = lookups.broadcast_small(names, max_bytes=1000)
        out = lookups.lookup_append(
            spark.read.parquet(str(tmp_path / "trials")), table, left_key="lead_sponsor"
        )
        done = out.agg(
            F.count("*").alias("n"), F.count("standard_name").alias("hits"), F.max("payload")
        )
        row = done.collect()[0]
        assert (row.n, row.hits) == (60000, 20000 + 13333)
        final = plan_of(done).split("== Initial Plan ==")[0]
        assert "SortMergeJoin(skew=true)" in final
    finally:
        for k in tight:
            spark.conf.unset(k)


def test_names_are_parameters(spark):
    names = Names(lead_sponsor="Lead", standard_name="Std", us_segment="US", ww_segment="WW")
    df = spark.createDataFrame([("a",)], "Lead string")
    m = spark.createDataFrame([("A", "b")], "Lead string, Std string")
    us = spark.createDataFrame([("B", "u")], "Std string, US string")
    ww = spark.createDataFrame([("c", "w")], "Std string, WW string")
    out = lookups.lookup_chain(df, m, us, ww, names=names)
    assert [tuple(r) for r in out.collect()] == [("a", "B", "U", "Others")]
