"""Small literal cases."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions import encode, sequence, sizing
from rankloom.operators import batching, expand, metrics, profile
from rankloom.operators.spec import Layout, Sequence

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def values(spark, column, kind, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_prehashed(spark):
    rows = [None, -1, -8, LOW, 1, HIGH]
    assert values(spark, lambda v: encode.prehashed_bucket(v, 8), "long", rows) == [0, 8, 1, 1, 2, 8]
    assert values(spark, lambda v: encode.prehashed_bucket(v, 8, False), "long", [0]) == [1]
    with pytest.raises(Exception, match="zero is not"):
        values(spark, lambda v: encode.prehashed_bucket(v, 8), "long", [0])


def test_identity(spark):
    assert values(spark, lambda v: encode.identity_id(v, 8, "padding"), "long", [-1, 2, 9, None]) == [0, 2, 0, 0]
    with pytest.raises(Exception, match="not within"):
        values(spark, lambda v: encode.identity_id(v, 8), "long", [9])


def python_mix(v):
    m = (1 << 64) - 1
    v &= m
    v ^= v >> 30
    v = v * 0xBF58476D1CE4E5B9 & m
    v ^= v >> 27
    v = v * 0x94D049BB133111EB & m
    v ^= v >> 31
    return v - (1 << 64) if v >> 63 else v


def test_mix64(spark):
    rows = [0, 1, -1, LOW, HIGH, 123456789, -987654321, 1 << 62]
    assert values(spark, encode.mix64, "long", rows) == [python_mix(v) for v in rows]


def test_bags(spark):
    rows = [[1, None, -1, 4], None, [-8]]
    head = lambda v: encode.encode(sequence.head(sequence.or_empty(v, "array<long>"), 3), "prehashed", 8, 1)
    assert values(spark, head, "array<long>", rows) == [[2, 0, 8], [], [1]]
    tail = lambda v: encode.encode(sequence.tail(v, 3), "prehashed", 8, 1)
    assert values(spark, tail, "array<long>", [[1, None, -1, 4], [7], [-8, 3, 5, 9]]) == [[0, 8, 5], [8], [4, 6, 2]]


def test_singletons(spark):
    assert values(spark, sequence.singleton, "array<long>", [None, [], [5]]) == [None, None, 5]
    with pytest.raises(Exception, match="more than one"):
        values(spark, sequence.singleton, "array<long>", [[1, 2]])


def test_scene_and_buckets(spark):
    scene = lambda v: encode.coarse_scene(v, [2, 21, 23, 1137])
    assert [tuple(x) for x in values(spark, scene, "long", [2, 21, 1137, 0, 7])] == [(0, 1)] * 3 + [(1, 2)] * 2
    assert values(spark, lambda v: sequence.length_bucket(v, [128, 256, 512]), "long", [0, 128, 129, 1000]) == [0, 0, 1, 3]


def test_truncate_then_compact(spark):
    df = spark.range(1).select(F.expr("array(named_struct('g', 1, 'p', 0), named_struct('g', cast(null as int), 'p', 1), named_struct('g', 3, 'p', 2), named_struct('g', 4, 'p', 3))").alias("e"))
    for keep, want in (("head", [0, 2]), ("tail", [2, 3])):
        r = df.select(sequence.truncate_then_compact(F.col("e"), 3, "g", keep).alias("x")).first()["x"]
        assert ([e["p"] for e in r["events"]], r["bucket_length"]) == (want, 3)


def test_recent_window(spark):
    df = spark.range(1).select(F.expr("transform(array(4900, 4800, 4700), t -> named_struct('time', t))").alias("a"), F.expr("transform(array(1000, cast(null as int)), t -> named_struct('time', t))").alias("b"))
    got = df.select(sequence.recent({"a": F.col("a"), "b": F.col("b")}, 2).alias("x")).first()["x"]
    assert [(x["time"], x["stream"]) for x in got] == [(4800, 0), (4900, 0)]


def test_time_delta_errors(spark):
    df = spark.createDataFrame([(5000, [4900, 3000])], "r long, t array<long>")
    assert df.select(sequence.time_deltas(F.col("r"), F.col("t"))).first()[0] == [100.0, 2000.0]
    for times in ([5001], [10, 20]):
        with pytest.raises(Exception, match="event after request|newest first"):
            spark.createDataFrame([(5000, times)], "r long, t array<long>").select(sequence.time_deltas(F.col("r"), F.col("t"))).collect()


def scored(spark, rows):
    return spark.createDataFrame(rows, "logit double, label int, g string")


def test_auc(spark):
    labels, s = [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]
    for scores, want in ((s, 1.0), (s[::-1], 0.0), ([0.5] * 4, 0.5)):
        df = scored(spark, [(x, y, "a") for x, y in zip(scores, labels, strict=True)])
        assert metrics.exact_auc(df, parts=3).first()["auc"] == want
    groups = [(0.1, 0, "a"), (0.9, 1, "a"), (0.9, 0, "b"), (0.1, 1, "b"), (0.5, 1, "c")]
    df = scored(spark, groups).withColumn("task", F.lit("t"))
    assert tuple(metrics.group_auc(df, ["task"], "g").first())[1:] == (0.5, 2)


def test_auc_against_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(round(rng.gauss(0, 1), 1), rng.randint(0, 1), "a") for _ in range(300)]
    pos, neg = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.exact_auc(scored(spark, rows), parts=7).first()["auc"] - want) < 1e-8


def test_faulty_scores(spark):
    for bad in ((float("nan"), 1, "a"), (0.1, 2, "a"), (float("inf"), 0, "a")):
        with pytest.raises(Exception, match="not finite or label"):
            metrics.checked(scored(spark, [bad])).collect()


def test_pooling(spark):
    table = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "id long, vector array<double>")
    bags = spark.createDataFrame([(1, [2, 0, 8]), (2, [])], "k long, ids array<long>")
    for padding, want in ((False, 5.0), (True, 10 / 3)):
        got = {r["k"]: r["pooled"] for r in metrics.pooled(bags, table, "k", "ids", 1, padding).collect()}
        assert abs(got[1][0] - want) < 1e-9 and got[2] == [0.0]


def test_packing(spark):
    groups = spark.createDataFrame([(0, 0, "A", 5), (0, 1, "B", 2)], "shard int, i int, g string, n int")
    got = [(r["g"], r["batch"], r["rows"]) for r in batching.packed(groups, ["shard"], ["i"], "n", 2).orderBy("batch", "i").collect()]
    assert got == [("A", 0, 2), ("A", 1, 2), ("A", 2, 1), ("B", 3, 2)]


def test_scenarios(spark):
    df = spark.createDataFrame([([17, 9],), ([17],), ([3],)], "s array<long>")
    assert [tuple(r) for r in profile.scenarios(df, "s").collect()] == [(3, 0), (9, 1), (17, 2)]
    with pytest.raises(Exception, match="without scenario"):
        profile.scenarios(spark.createDataFrame([([],)], "s array<long>"), "s").collect()


def test_nested_profile(spark):
    df = spark.createDataFrame([(None,), ([[None, LOW], [], [1, -1, 0]],)], "c array<array<long>>")
    got = {r["depth"]: (r["nulls"], r["empties"]) for r in profile.field_profile(df, "c").collect()}
    assert got == {0: (1, 0), 1: (0, 1), 2: (1, 0)}
    leaf = profile.leaf_statistics(df, "c").first()
    assert (leaf["negative"], leaf["positive"], leaf["zero"]) == (2, 1, 1)


def test_growth_and_recommendation(spark):
    got = sizing.growth(spark.createDataFrame([(10, 100)], "a long, b long"), "a", "b", 10, 100, 500, 1000).first()
    assert (round(got["alpha"], 2), got["tier"], got["projected"]) == (0.95, "climbing", 462)
    fields = spark.createDataFrame([("f", 100_000)], "field string, distinct long")
    rates = spark.createDataFrame([("f", 1 << 18, 0.0), ("f", 1 << 23, 0.0)], "field string, buckets long, sample_rate double")
    assert sizing.bucket_recommendation(fields, rates, 0.01).first()["recommended"] == 1 << 23


LAYOUT = Layout(
    request_scalars=("ctx_scalar",), request_bags=("ctx_bag",), request_meta=("scene_id", "search_id", "impr_time"), candidate_scalars=("item_scalar",), candidate_bags=("sku_a", "sku_b"),
    candidate_meta=("example_ids",), labels=("label_a",), sequences=(Sequence("impr", {"id": "impr_id", "time": "impr_time_list"}, "time", "impr_indices"),), request_time="impr_time",
)
SCHEMA = (
    "k int, context_indices array<long>, target_indices array<long>, ctx_scalar array<array<long>>, ctx_bag array<array<long>>, item_scalar array<array<long>>, sku_a array<array<long>>, sku_b array<array<long>>, "
    "impr_id array<long>, impr_time_list array<long>, impr_indices array<array<long>>, scene_id array<long>, search_id array<string>, impr_time array<long>, label_a array<long>, example_ids array<string>"
)
ROW = (1, [0, 1], [0, 1, 1], [[101], [102]], [[1, 2], None], [[201], [202], [203]], [[11, 12], [13], [14, 15]], [[21, None], [22], [23, 24]], [-1, -2, -3], [4900, 4500, 3000], [[0, 1], [1], [0]], [7, 8], ["r0", "r1"], [5000, 6000], [0, 1, 0], ["e0", "e1", "e2"])


def test_agg_literal(spark):
    flat = expand.expand_agg(spark.createDataFrame([ROW], SCHEMA), LAYOUT, ("k",)).orderBy("example_ids").collect()
    got = [(r["search_id"], r["candidate_position"], r["ctx_scalar"], r["ctx_bag"], r["item_scalar"], [e["id"] for e in r["impr"]], r["scene_id"], r["label_a"]) for r in flat]
    assert got == [("r0", 0, 101, [1, 2], 201, [-1, -3], 7, 0), ("r1", 0, 102, [], 202, [-1, -2], 8, 1), ("r1", 1, 102, [], 203, [-1, -2], 8, 0)]
    deltas = [[r["impr_time"] - e["time"] for e in r["impr"]] for r in flat]
    assert deltas == [[100, 2000], [1100, 1500], [1100, 1500]]


@pytest.mark.parametrize("place, value, message", [(2, [0, 1, 5], "dangling"), (1, [0, 0], "duplicate"), (13, [5000], "length"), (10, [[0, 1], [], [0]], "orphan")])
def test_agg_faults(spark, place, value, message):
    row = [*ROW[:place], value, *ROW[place + 1 :]]
    with pytest.raises(Exception, match=message):
        expand.expand_agg(spark.createDataFrame([tuple(row)], SCHEMA), LAYOUT, ("k",)).collect()


def test_one_index_column(spark):
    with pytest.raises(ValueError, match="only one"):
        LAYOUT.kind(spark.createDataFrame([ROW], SCHEMA).drop("target_indices").schema)


def test_alias_cycle(spark):
    of = lambda rows: {r["name"]: (r["root"], r["cyclic"]) for r in profile.resolved_aliases(spark.createDataFrame(rows, "name string, alias string")).collect()}
    assert of([("a", "b"), ("b", "b")]) == {"a": ("b", False), "b": ("b", False)}
    assert of([("a", "b"), ("b", "a"), ("c", "a"), ("d", None), ("e", "x")]) == {"a": (None, True), "b": (None, True), "c": (None, True), "d": ("d", False), "e": ("x", False)}
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)] + [("n100", "n100")] + [(f"m{i}", f"m{(i + 1) % 7}") for i in range(7)]
    assert of(chain) == {n: (None, True) if n[0] == "m" else ("n100", False) for n, _ in chain}
    assert of([]) == {}
