"""The windowed and the sliced way of ordered computation give the same rows."""

import random

from pyspark.sql import functions as F

from sceneframe.operators.ordered import scan, with_totals


def _frame(spark, rows=600):
    rng = random.Random(7)
    data = []
    for i in range(rows):
        key = 1 if i % 3 == 0 else rng.randrange(40)  # one key holds a third of the rows
        data.append((key, rng.randrange(10), i, None if i % 7 == 0 else rng.randrange(100)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k long, o long, id long, v long").repartition(5)


def _scan(df):
    out = scan(df, ["k"], ["o", "id"], number="n", sums={"s": "v"}, maxes={"m": "v"}, previous={"p": "v"}, following={"f": "v"})
    return sorted(map(tuple, out.collect()), key=repr)


def _brute(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"], []).append(r)
    out = []
    for rows in groups.values():
        rows.sort(key=lambda r: (r["o"], r["id"]))
        total = top = None
        for i, r in enumerate(rows):
            if r["v"] is not None:
                total, top = (total or 0) + r["v"], max(top if top is not None else r["v"], r["v"])
            before = rows[i - 1]["v"] if i else None
            after = rows[i + 1]["v"] if i + 1 < len(rows) else None
            out.append((r["k"], r["o"], r["id"], r["v"], total, top, before, after, i + 1))
    return sorted(out, key=repr)


def test_windowed_scan_matches_brute_force(spark):
    df = _frame(spark)
    names = scan(df, ["k"], ["o", "id"], number="n", sums={"s": "v"}, maxes={"m": "v"}, previous={"p": "v"}, following={"f": "v"}).columns
    assert names == ["k", "o", "id", "v", "s", "m", "p", "f", "n"]
    assert _scan(df) == _brute(df)


def test_sliced_scan_matches_brute_force(spark, hot):
    df = _frame(spark)
    assert _scan(df) == _brute(df)


def test_sliced_plan_spreads_a_hot_key(spark, hot):
    df = _frame(spark)
    plan = scan(df, ["k"], ["o", "id"], number="n")._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan


def test_small_inputs_stay_on_one_window(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = scan(df, ["l_orderkey"], ["l_linenumber"], number="n")._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" not in plan


def test_totals_agree_both_ways(spark):
    df = _frame(spark)
    totals = {"c": F.count(F.lit(1)), "t": F.sum("v")}
    plain = sorted(map(tuple, with_totals(df, ["k"], totals).collect()), key=repr)
    spark.conf.set("sceneframe.skew.taskBytes", "0")
    try:
        assert sorted(map(tuple, with_totals(df, ["k"], totals).select("k", "o", "id", "v", "c", "t").collect()), key=repr) == plain
    finally:
        spark.conf.unset("sceneframe.skew.taskBytes")


def test_totals_of_a_null_key_and_the_column_order_agree_both_ways(spark, hot):
    df = spark.createDataFrame([(5, None), (6, None), (7, 1), (8, 1), (9, 1)], "id long, k long")
    out = with_totals(df, ["k"], {"c": F.count(F.lit(1))})
    assert out.columns == ["id", "k", "c"]
    assert sorted(map(tuple, out.collect())) == [(5, None, 2), (6, None, 2), (7, 1, 3), (8, 1, 3), (9, 1, 3)]


def test_building_a_plan_runs_no_job(spark, hot):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    spark.sparkContext.setJobGroup("building", "")
    out = scan(df, ["l_orderkey"], ["l_linenumber"], number="n", previous={"p": "l_quantity"})
    with_totals(out, ["l_orderkey"], {"c": F.count(F.lit(1))})
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")


def test_one_key_spans_slices_and_null_keys_are_a_key(spark, hot):
    for keys in ([None] * 300, [7] * 290 + [None] * 10, [None, 1, 2] * 20):
        df = spark.createDataFrame([(k, 0, i, i) for i, k in enumerate(keys)], "k long, o long, id long, v long")
        assert _scan(df) == _brute(df)
    assert _scan(df.limit(0)) == []


def test_types_agree_both_ways(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("d", F.col("l_quantity").cast("decimal(12,2)"))
    made = lambda: scan(df, ["l_orderkey"], ["l_linenumber"], number="n", sums={"s": "d"}, maxes={"m": "d"})
    plain = made()
    spark.conf.set("sceneframe.skew.taskBytes", "0")
    try:
        assert made().dtypes == plain.dtypes and made().exceptAll(plain).count() == 0
    finally:
        spark.conf.unset("sceneframe.skew.taskBytes")


def test_large_inputs_stay_on_one_window_by_default(spark):
    df = spark.range(2**28).selectExpr("id % 1000 AS k", "id AS o")  # two GB by its statistics
    out = with_totals(scan(df, ["k"], ["o"], number="n"), ["k"], {"c": F.count(F.lit(1))})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_slice" not in plan and plan.count("Exchange ") == 1
