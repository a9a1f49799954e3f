"""Behaviour that no query shows: errors, modes, plans, packing against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import encode, sequence, sizing
from rankloom.operators import batching, contract, expand, metrics, profile
from rankloom.operators.spec import Layout, Sequence
from rankloom.plans import fixtures, registry, scoring
from rankloom.sources import readers
from rankloom.sources.shared import shared_folder


def plain_packing(groups, batch):
    """Next-fit, one group after the other."""
    at, used, out = 0, 0, []
    for g, n in groups:
        if used and used + n > batch:
            at, used = at + 1, 0
        for k in range(0, n, batch):
            rows = min(batch, n - k) if n > batch else n
            out.append((g, at, k, rows))
            used += rows
            if used >= batch:
                at, used = at + 1, 0
    return out


@pytest.mark.parametrize("batch,parts", [(1, 5), (2, 3), (7, 16), (100, 4)])
def test_packing_equals_a_plain_fold(spark, batch, parts):
    rng = random.Random(batch)
    rows = [(shard, i, rng.choice([0, 1, 1, 2, 3, 5, 8, 40, 250])) for shard in range(3) for i in range(80)]
    df = spark.createDataFrame(rows, "shard int, g int, n int").repartition(4)
    got = batching.packed(df, ["shard"], ["g"], "n", batch, parts=parts)
    want = [(s, *x) for s in range(3) for x in plain_packing([(g, n) for t, g, n in rows if t == s], batch)]
    assert sorted((r["shard"], r["g"], r["batch"], r["offset"], r["rows"]) for r in got.collect()) == sorted(want)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_packing_literal_and_empty(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 2)], "shard int, g int, n int")
    assert [r["rows"] for r in batching.packed(df, ["shard"], ["g"], "n", 2).orderBy("g", "batch").collect()] == [2, 2, 1, 2]
    assert batching.packed(df.limit(0), ["shard"], ["g"], "n", 2).count() == 0
    with pytest.raises(Exception, match="a batch has 1 to"):
        batching.packed(df, ["shard"], ["g"], "n", 0).collect()


def plain_buffers(groups, limit):
    """Buffers of whole groups in order: one that doesn't fit opens the next, an oversize one has its own."""
    out, at, used = [], 0, 0
    for g, n in groups:
        if used and used + n > limit:
            at, used = at + 1, 0
        out.append((g, at))
        used += n
        if used >= limit:
            at, used = at + 1, 0
    return out


@pytest.mark.parametrize("buffer,parts", [(1, 4), (6, 3), (40, 9)])
def test_buffers_equal_a_plain_fold(spark, buffer, parts):
    rng = random.Random(buffer)
    groups = [(g, rng.choice([1, 1, 2, 3, 5, 8, 50])) for g in range(70)]
    rows = [(g, 1000 * g + i) for g, n in groups for i in range(n)]
    df = spark.createDataFrame(rows, "g long, position long").repartition(parts)
    got = {(r["g"], r["shuffle_block"]) for r in batching.shuffled(df, ["g"], "position", 5, buffer).collect()}
    assert got == set(plain_buffers(groups, buffer))


def test_fill_maps_equal_each_fill_by_itself():
    rng = random.Random(8)
    for whole in (False, True):
        sizes = [rng.choice([0, 1, 2, 3, 7, 30]) for _ in range(rng.randint(1, 90))]
        fills = batching.FillMap(20, whole)
        for n in sizes:
            fills.put(n, 20)
        begins, used, closed = fills.steps_of()
        for fill in range(20):
            one = batching.NextFit(batching.np.array([fill]), whole)
            for n in sizes:
                one.put(n, 20)
            k = int(batching.np.searchsorted(begins, fill, "right")) - 1
            assert (used[k], closed[k]) == (one.used[0], one.closed[0])
        assert len(begins) <= 20


@pytest.mark.parametrize("batch", [1, 4, 9])
def test_every_candidate_in_one_batch(spark, batch, tmp_path):
    rng = random.Random(batch)
    groups = [(g % 2 if g else None, g if g != 5 else None, rng.choice([0, 1, 3, 5, 60])) for g in range(40)]
    rows = [(g, i, f"{g}-{i}", 7) for _, g, n in groups for i in range(n)]
    sizes = spark.createDataFrame(groups, "shard int, g long, n long").repartition(3)
    parts = batching.packed(sizes, ["shard"], ["g"], "n", batch, parts=5)
    found = batching.batch_rows(parts, spark.createDataFrame(rows, "g long, i long, item string, n int").repartition(4), ["g"], "i")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.columns == ["g", "i", "item", "n", "shard", "batch", "slot"]
    got = [tuple(r) for r in found.collect()]
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] is not None) == sorted(r[:3] for r in rows if r[0] is not None)
    assert sorted(r[2] for r in got) == sorted(r[2] for r in rows)
    by_batch = {}
    for r in got:
        by_batch.setdefault((r[4], r[5]), []).append((r[6], -1 if r[0] is None else r[0], r[1]))
    for own in by_batch.values():
        assert sorted(x[0] for x in own) == list(range(len(own))) and len(own) <= batch
        assert [x[1:] for x in sorted(own)] == sorted(x[1:] for x in own)
    batching.write_batches(found, f"file://{tmp_path}/batches", ["shard", "batch"])
    files = spark.read.parquet(f"file://{tmp_path}/batches").withColumn("file", F.input_file_name())
    assert files.count() == len(rows) and files.groupBy("shard", "batch").agg(F.countDistinct("file").alias("n")).where("n > 1").isEmpty()


def test_slices_equal_row_numbers(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 2), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(3)
    got = {r["i"]: r["slice"] for r in batching.slices(df, ["k"], ["i"], 7, 5).collect()}
    for k in range(3):
        assert all(got[i] == p // 7 for p, i in enumerate(sorted(i for x, i in rows if x == k)))


def test_shuffle_buffer(spark):
    df = spark.createDataFrame([(i % 10, i) for i in range(60)], "user long, position long").repartition(3)
    order = lambda b: [r["user"] for r in batching.shuffled(df, ["user"], "position", 3, b).collect()]
    assert order(0) == [u for u in range(10) for _ in range(6)]
    whole, some = order(None), order(27)  # rows: four users
    assert whole != order(0) and {*some[:24]} == {0, 1, 2, 3} and {*some[24:48]} == {4, 5, 6, 7} and some[:24] != order(0)[:24]


def test_expansion_without_checks_keeps_candidates(spark):
    layout = Layout(request_meta=("m",), candidate_scalars=("c",))
    df = spark.createDataFrame([([1, 2], [1, 9, 2, None, 1], ["a", "b"], [10, 11, 12, 13, 14])], "context_indices array<long>, target_indices array<long>, m array<string>, c array<long>")
    got = sorted(map(tuple, expand.expand_agg(df, layout, validate="off").collect()), key=str)
    assert got == sorted([(1, 0, "a", 10), (1, 1, "a", 14), (2, 0, "b", 12), (9, 0, None, 11), (None, 0, None, 13)], key=str)
    with pytest.raises(Exception, match="null index"):
        expand.expand_agg(df, layout).collect()
    assert expand.expand_agg(df.select("context_indices", F.array().cast("array<long>").alias("target_indices"), "m", F.array().cast("array<long>").alias("c")), layout, validate="off").count() == 0


def test_evaluation_multiplies_no_rows(spark, sf_dir):
    plan = registry.QUERIES["held_out_evaluation"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    plan = registry.QUERIES["log_loss_reductions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan


def test_hour_window_prunes_folders(spark):
    from datetime import datetime

    path = shared_folder(spark, "pruned")
    spark.range(48).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") / 24 + 1).cast("int")).alias("pt"), F.format_string("%02d", F.col("id") % 24).alias("hr")).write.partitionBy("pt", "hr").parquet(path)
    found = readers.hour_window(spark.read.parquet(path), datetime(2024, 1, 1, 20), datetime(2024, 1, 2, 3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan and "PushedFilters: []" in plan
    assert sorted(r["id"] for r in found.collect()) == list(range(20, 27))


def test_coarse_scene_policies(spark):
    df = spark.createDataFrame([("2",), ("7",), (None,)], "s string")
    got = [r[0] for r in df.select(encode.coarse_scene(F.col("s"), [2, 21])).collect()]
    assert [x and tuple(x) for x in got] == [(0, 1), (1, 2), None]
    for text, policy, match in (("7", "error", "unlisted scene 7"), ("2.5", "recommend", "not an integer"), ("-1", "recommend", "negative scene")):
        with pytest.raises(Exception, match=match):
            spark.createDataFrame([(text,)], "s string").select(encode.coarse_scene(F.col("s"), [2], policy)).collect()


def test_merging_clocks(spark):
    df = spark.createDataFrame([([(5.0,), (9.0,)], [(7.0,)])], "a array<struct<time:double>>, b array<struct<time:double>>")
    streams = {"a": F.col("a"), "b": F.col("b")}
    times = lambda clocks: [x["time"] for x in df.select(sequence.merged_by_time(streams, clocks=clocks)).first()[0]]
    assert times(None) == [5, 7, 9] and times({"a": "age", "b": "age"}) == [-9, -7, -5]
    with pytest.raises(ValueError, match="different clocks"):
        sequence.merged_by_time(streams, clocks={"a": "age"})


def test_nested_tokens_and_bags(spark):
    df = spark.createDataFrame([([[1], [], None, [4]], [[1, 2]])], "tokens array<array<long>>, bag array<array<long>>")
    assert tuple(df.select(sequence.flatten_singletons(F.col("tokens")), sequence.flatten_bag(F.col("bag"))).first()) == ([1, None, None, 4], [1, 2])
    several = spark.createDataFrame([([[1], [2]], [[1, 2], [3]])], "a array<array<long>>, b array<array<long>>")
    assert several.select(sequence.flatten_bag(F.col("a"))).first()[0] == [1, 2]
    with pytest.raises(Exception, match="several lists"):
        several.select(sequence.flatten_bag(F.col("b"))).collect()
    with pytest.raises(Exception, match="differ in length"):
        df.select(sequence.aligned(F.col("tokens"), F.col("bag"))).collect()


def test_labels_and_scores_are_checked(spark):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 1, 0.5)], "g string, k int, x double")
    with pytest.raises(Exception, match="not unique"):
        metrics.scored_output(df, "g", ["k"], {"t": F.col("x")}).collect()
    with pytest.raises(Exception, match="null or not"):
        metrics.scored_output(df.limit(1).withColumn("k", F.lit(None).cast("int")), "g", ["k"], {"t": F.col("x")}).collect()
    with pytest.raises(ValueError, match="repeat"):
        metrics.scored_output(df, "g", ["g"], {"t": F.col("x")})
    with pytest.raises(Exception, match="label is not 0 or 1"):
        spark.createDataFrame([(2,)], "y int").select(expand.complete_label(F.col("y"))).collect()


def test_scenario_modes(spark):
    raw = spark.createDataFrame([("b",), ("a",)], "s string")
    index = spark.createDataFrame([([0, 1],), ([1],)], "s array<int>")
    pairs = lambda df, names, mode: [tuple(r) for r in expand.scenario_values(df, "s", names, mode).orderBy("index").collect()]
    assert pairs(raw, ["a", "b"], "auto") == pairs(raw, ["b", "a"], "raw") == [("a", 0, "a"), ("b", 1, "b")]
    assert pairs(index, ["home", "cart"], "auto") == pairs(index, ["home", "cart"], "index") == [("0", 0, "home"), ("1", 1, "cart")]
    for df, names, mode in ((index, ["home", "cart"], "raw"), (raw, ["x", "y"], "auto"), (raw, ["a", "global"], "raw")):
        with pytest.raises(ValueError, match="scenario"):
            expand.scenario_values(df, "s", names, mode)


def test_long_scenario_lists_aren_t_cut(spark):
    known = spark.range(400).select(F.col("id").alias("scenario"), F.col("id").alias("index"))
    assert expand.scenario_index(spark.range(400).withColumnRenamed("id", "s"), "s", known).where("s <> index").count() == 0


def test_crosses_stay(spark):
    df = spark.createDataFrame([(1, 2, 3)], "scene int, item int, scene_x_item int")
    assert expand.drop_columns(df, ["scene", "scene_x_item"], crosses={"scene_x_item": ["scene", "item"]}).columns == ["item", "scene_x_item"]


def test_profiles_must_have_the_same_fields(spark):
    a, b = (spark.createDataFrame([(f, 1) for f in fields], "field string, distinct long") for fields in ("xy", "xz"))
    assert sizing.joined_profiles(a, a).count() == 2
    with pytest.raises(Exception, match="field in one profile only"):
        sizing.joined_profiles(a, b).collect()


def test_gates_raise(spark):
    labels = spark.createDataFrame([("t", 5, 1, 0, 2), ("u", 5, 0, 0, 0)], "task string, total long, nulls long, minus_one long, other long")
    found = contract.gate(labels, contract.LABEL_RULES, "task")
    assert sorted(map(tuple, found.collect())) == [("t", "labels that aren't 0 or 1", 2), ("t", "null labels", 1)]
    contract.require(found.limit(0))
    with pytest.raises(ValueError, match="null labels"):
        contract.require(found.withColumnRenamed("task", "field"))
    depths = spark.createDataFrame([("f", 0, 0, 2), ("g", 1, 3, 0)], "field string, depth int, nulls long, empties long")
    assert sorted(r["rule"] for r in contract.gate(depths, contract.DEPTH_RULES).collect()) == ["empty outer lists", "nulls inside a history"]


def test_layout_check(spark, sf_dir):
    nested = fixtures.nested(spark, sf_dir)
    assert fixtures.LAYOUT.check(nested.schema) == [] and fixtures.LAYOUT.check(nested.drop("click_time").schema) == ["click_time"]


def test_vocabulary_strategy(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "k int, v string")
    vocab = profile.vocabulary(df.where("v <> 'z'"), "v")
    assert sorted(map(tuple, profile.encoded(df, "v", "vocabulary", vocab=vocab).select("k", "v_id").collect())) == [(1, 1), (2, 2), (3, 0), (4, 0)]
    assert sorted(map(tuple, profile.encoded(spark.createDataFrame([(1, 9), (2, 3)], "k int, v long"), "v", "identity", 5, on_error="padding").select("k", "v_id").collect())) == [(1, 0), (2, 3)]


def test_sampled_overlap_lists_pairs_that_share_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 9)], "field string, leaf long")
    assert sorted(map(tuple, profile.sample_overlap(df).collect())) == [("a", "b", 1, 0.5), ("a", "c", 0, 0.0), ("b", "c", 0, 0.0)]


def test_longest_work(spark):
    assert spark.range(1).select(sequence.sequence_work([F.lit(3), F.lit(50)], [10, 20], "max")).first()[0] == 20


def test_pooled_nulls_and_unknown_ids(spark):
    bags = spark.createDataFrame([(1, [1, 2, 0]), (2, []), (3, None), (4, [9]), (5, [1, None])], "k int, ids array<long>")
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (0, [50.0, 50.0])], "id long, vector array<double>")
    got = {r["k"]: r["pooled"] for r in metrics.pooled(bags, table, "k", "ids", 2).collect()}
    assert got == {1: [2.0, 3.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [1.0, 2.0]}
    assert {r["k"]: r["pooled"] for r in metrics.pooled(bags, table, "k", "ids", 2, True).collect()}[5] == [0.5, 1.0]


def test_scoring_has_no_filtered_bags():
    assert "% 3" not in registry.SQL["bag_mean_pool"] and scoring._BAGS in registry.SQL["bag_mean_pool"]


def test_req_rows_are_checked(spark):
    layout = Layout(request_scalars=("s",), request_bags=("b",), candidate_scalars=("c",), labels=("y",), sequences=(Sequence("h", {"id": "h_id", "time": "h_time"}, "time", "h_members"),))
    shape = "s array<array<long>>, b array<array<long>>, c array<array<long>>, y array<long>, h_id array<array<long>>, h_time array<long>"
    good = ([[101]], [[1], [2]], [[201], [202]], [0, 1], [[-1], [-2]], [5, 4])

    def flat(**changes):
        row = dict(zip(("s", "b", "c", "y", "h_id", "h_time"), good, strict=True)) | changes
        return [tuple(r) for r in expand.expand_req(spark.createDataFrame([tuple(row.values())], shape), layout, complete=True).collect()]

    events = [(-1, 5), (-2, 4)]
    assert flat() == [(101, [1, 2], events, 0, 201, 0), (101, [1, 2], events, 1, 202, 1)]
    assert flat(s=None, b=None, h_id=None, h_time=None)[0] == (None, None, [], 0, 201, 0)
    for changes, match in (({"y": [0]}, "length of y"), ({"y": None}, "missing y"), ({"h_time": [5]}, "length of h_time"), ({"y": [0, 2]}, "label is not 0 or 1"), ({"y": [0, None]}, "label is not 0 or 1"), ({"b": [[1, 2], [3]]}, "several lists"), ({"s": [[1, 2]]}, "more than one value"), ({"h_id": [[1, 2], [3]]}, "more than one value")):
        with pytest.raises(Exception, match=match):
            flat(**changes)


def test_expansion_of_hot_rows_is_linear(spark):
    """Ten times the requests and candidates of one row cost far less than a hundred times the work."""
    layout = Layout(request_meta=("m",), candidate_scalars=("c",))

    def plan_of(requests):
        n = 3 * requests
        df = spark.range(1).select(F.sequence(F.lit(0), F.lit(requests - 1)).alias("context_indices"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * 7 % requests).alias("target_indices"), F.sequence(F.lit(0), F.lit(requests - 1)).alias("m"), F.sequence(F.lit(0), F.lit(n - 1)).alias("c"))
        return expand.expand_agg(df, layout)

    got = plan_of(500)
    rows = got.collect()
    want = {}
    for i in range(1500):
        want.setdefault(i * 7 % 500, []).append(i)
    assert sorted(map(tuple, rows)) == sorted((r, k, r, c) for r, own in want.items() for k, c in enumerate(own))


def test_a_hot_group_is_spread(spark):
    """A group of nine tenths of the rows: the same value, and no task with most of its counts."""
    rng = random.Random(31)
    rows = [("hot" if rng.random() < 0.9 else f"g{rng.randint(0, 20)}", round(rng.uniform(-3, 3), 3), rng.randint(0, 1)) for _ in range(3000)] + [(None, 0.5, 1), (None, 0.1, 0)]
    df = spark.createDataFrame(rows, "g string, logit double, label int").repartition(3)
    got = {r["g"]: r["auc"] for r in metrics.auc_by_group(df, [], "g", parts=8).collect()}
    for g in {r[0] for r in rows}:
        pos, neg = ([batching.np.float32(s) for k, s, y in rows if k == g and y == v] for v in (1, 0))
        if pos and neg:
            assert abs(got[g] - sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)) < 1e-8
    parts = metrics.histogram(df, ["g"], F.col("logit").cast("float")).repartitionByRange(8, "g", "bin").where("g = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 5


def test_evaluation_equals_its_parts(spark):
    """A large mean with a small spread keeps its deviation; nulls among keys and groups stay."""
    rng = random.Random(32)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), 1e8 + rng.random() / 8 if rng.random() < 0.5 else 1e8, rng.randint(0, 1), f"f{rng.randint(0, 3)}") for _ in range(400)]
    df = spark.createDataFrame(rows, "task string, g int, logit double, label int, file string")
    for r in metrics.evaluation(df, ["task"], "g", "file").collect():
        own = [x for x in rows if x[0] == r["task"]]
        xs = batching.np.array([x[2] for x in own])
        assert (r["examples"], r["files"], r["positives"]) == (len(own), len({x[4] for x in own}), sum(x[3] for x in own))
        assert abs(r["logit_std"] - xs.std()) < 1e-6 and abs(r["logit_mean"] - xs.mean()) < 1e-5
    assert {r["task"] for r in metrics.evaluation(df, ["task"], "g").collect()} == {"a", "b", None}
    assert metrics.evaluation(df, [], "g").count() == 1


def test_paths_of_differences(spark):
    shape = "k long, a struct<x:int,b:array<struct<y:array<int>,z:string>>>, c string"
    base = [(i, {"x": i, "b": [{"y": [1, 2, i], "z": "q"}, {"y": None, "z": None}]}, "c") for i in range(50)] + [(None, None, None)]
    left = spark.createDataFrame(base, shape)
    other = [[k, a and {"x": a["x"], "b": [dict(e) for e in a["b"]]}, c] for k, a, c in base]
    other[3][1]["b"][0]["y"] = [1, 5, 3]
    other[4][1]["b"][1]["z"] = "new"
    other[5][1]["b"].pop()
    other[6][1]["b"][1]["y"] = []
    other[7][2] = None
    other[8][1]["x"] = None
    del other[9]
    right = spark.createDataFrame([tuple(r) for r in other] + [(99, None, "d")], shape)
    got = {r["k"]: r["difference"] for r in batching.differences(left, right.select("c", "k", "a"), ["k"]).collect()}
    assert got == {3: "a.b[0].y[1]", 4: "a.b[1].z", 5: "a.b.length", 6: "a.b[1].y", 7: "c", 8: "a.x", 9: "only_left", 99: "only_right"}
    assert batching.differing_parts(left, left.repartition(7), ["k"]).isEmpty() and batching.differences(left, left.repartition(7), ["k"]).count() == 0
    assert 1 <= batching.differing_parts(left, right, ["k"]).count() <= 8


def test_union_checks_schemas(spark):
    a, b = spark.createDataFrame([(1, "x")], "i long, s string"), spark.createDataFrame([("y", 2)], "s string, i long")
    assert sorted(map(tuple, batching.union_of({"a": a, "b": b}).collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="c and a differ in i, t"):
        batching.union_of({"a": a, "b": b, "c": a.select(F.col("i").cast("int"), "s", F.lit(1).alias("t"))})
    keys = spark.createDataFrame([(1,), (None,), (3,), (3,)], "i long")
    assert sorted(map(tuple, batching.keys_apart(keys, a, ["i"]).collect()), key=str) == [(3,), (None,)]
    assert [tuple(r) for r in batching.keys_apart(keys, a, ["i"], shared=True).collect()] == [(1,)]


@pytest.mark.parametrize("room", [1, 4, 1 << 16])
def test_top_values_with_little_room(spark, room):
    rng = random.Random(41)
    values = [int(rng.paretovariate(0.6)) for _ in range(3000)] + list(range(-500, 0)) + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(4)
    want = sorted(((-sum(x == v for x in values), v) for v in {x for x in values if x is not None}))[:7]
    assert [(r["leaf"], r["count"]) for r in profile.top_values(df, "v", 7, room).collect()] == [(v, -n) for n, v in want]
    assert profile.top_values(df.limit(0), "v", 3).collect() == []
    assert [(r["leaf"], r["count"]) for r in profile.top_values(df.selectExpr("cast(v % 3 AS string) AS v").where("v >= '0'"), "v", 1).collect()][0][1] > 500


def test_bottom_samples_merge(spark):
    rows = [(i % 3 if i % 7 else None, i % 400) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long")
    key = lambda r: (str(r["k"]), r["leaf"])
    got = sorted(map(key, profile.bottom_sample(df.repartition(6), "v", 9, ("k",)).collect()))
    every = profile.bottom_sample(df, "v", 1000, ("k",)).collect()
    want = sorted(key(r) for k in {r["k"] for r in every} for r in sorted((x for x in every if x["k"] == k), key=lambda r: r["priority"])[:9])
    assert got == want and len(got) == 36
    parts = [profile.bottom_sample(df.where(f"v % 2 = {b}"), "v", 20) for b in (0, 1)]
    merged = parts[0].unionByName(parts[1]).orderBy("priority").limit(20)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, profile.bottom_sample(df, "v", 20).collect()))


def test_production_gate_rules(spark):
    scenes = spark.createDataFrame([(1, 5, 0), (2, 1, 3), (3, 9, 9)], "scene int, requests long, candidates long")
    depths = spark.createDataFrame([("f", 0, 10, 0, 2), ("g", 1, 10, 3, 0), ("h", 0, 4, 1, 0)], "field string, depth int, cells long, nulls long, empties long")
    none = spark.createDataFrame([(0,)], "rows long")
    got = sorted(map(tuple, contract.production_gate(rows=none, depths=depths, scenes=scenes, least_requests=2).collect()))
    assert got == [("f", "empty outer lists", 2), ("g", "nulls inside a history", 3), ("rows", "nothing was scanned", 0), ("scene 1", "a scene without candidates", 5), ("scene 2", "too few requests of a scene", 1)]
    with pytest.raises(ValueError, match="nothing was scanned"):
        contract.require(contract.production_gate(rows=none))
    contract.require(contract.production_gate(rows=spark.createDataFrame([(3,)], "rows long")))
    with pytest.raises(ValueError, match="nothing to judge"):
        contract.production_gate()


def test_pooling_in_a_row_equals_the_join_and_shuffles_nothing(spark):
    rows = [(k, [(k * 7 + i * i) % 13 - 1 for i in range(k * 9 % 40)]) for k in range(50)] + [(50, None), (51, []), (52, [None, 0, 2]), (53, [5, 3] * 30_000)]
    bags = spark.createDataFrame(rows, "k int, ids array<int>")
    table = spark.createDataFrame([(i, [float(i), None if i == 4 else -i / 4]) for i in (-1, 0, 2, 3, 4, 5, 5, 9)], "id long, vector array<double>")
    vectors = {-1: (-1.0, 0.25), 2: (2.0, -0.5), 3: (3.0, -0.75), 4: (4.0, 0.0), 5: (10.0, -2.5), 9: (9.0, -2.25)}
    for padding in (False, True):
        want = {}
        for k, ids in rows:
            ids = [i or 0 for i in ids or []]
            n = max(1, len(ids) if padding else sum(i != 0 for i in ids))
            want[k] = [round(sum(vectors.get(i, (0.0, 0.0))[d] for i in ids) / n, 9) for d in (0, 1)]
        for limit in (metrics.POOLED_TABLE_BYTES, 0):
            found = metrics.pooled(bags, table, "k", "ids", 2, padding, limit)
            assert {r["k"]: [round(x, 9) for x in r["pooled"]] for r in found.collect()} == want
            if limit:
                assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["pooled"] for r in metrics.pooled(bags.where("k > 50"), table.where("id = 0"), "k", "ids", 2).collect()] == [[0.0, 0.0]] * 3
