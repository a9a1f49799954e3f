import glob
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankloom.operators import contract, expand, metrics, profile
from rankloom.operators.spec import Layout, Sequence
from rankloom.sources import generate, readers
from rankloom.sources.shared import shared_folder
from rankloom.streaming import incremental

LAYOUT = Layout(request_meta=("impr_time", "scene_id"), candidate_scalars=("item_id",), candidate_bags=("item_parts",), labels=("label",), sequences=(Sequence("click", {"id": "click_id", "time": "click_time"}, "time", "click_members"),), request_time="impr_time")


@pytest.fixture(scope="module")
def folder(spark):
    path = shared_folder(spark, "generated")
    generate.agg_rows(spark, 20, 3, 4, 6).repartition(4).write.parquet(path)
    return path


def test_generator(spark, folder):
    df = spark.read.parquet(folder)
    flat = expand.expand_agg(df, LAYOUT, ("row",))
    assert flat.count() == 20 * 12
    assert sorted(map(tuple, generate.agg_rows(spark, 2, 3, 4, 6).select("row", "item_id").collect())) == sorted(map(tuple, df.where("row < 2").select("row", "item_id").collect()))
    assert contract.index_faults(df, LAYOUT).first().asDict() == {"invalid": 0, "duplicate_rows": 0, "dangling": 0}
    assert tuple(contract.order_faults(df, LAYOUT, LAYOUT.sequences[0]).first()) == (0, 0)
    assert contract.label_distribution(flat, ["label"]).first()["ones"] == 120
    assert generate.multiplied(df, 3, "copy", ["impr_time"]).count() == 60


def test_footers(spark, folder):
    found = readers.footers(spark, folder)
    assert found.select("file").distinct().count() == 4 and readers.schema_report(found).count() == 1
    assert readers.projected_bytes(found, ["item_id"]).agg(F.min("bytes")).first()[0] > 0
    files = readers.with_file(spark.read.parquet(folder))
    assert readers.first_files(files, 2).select("input_file").distinct().count() == 2
    assert tuple(readers.split_statistics(files, "target_indices").first()) == (4, 20, 240)


def test_manifest(spark, folder):
    files = readers.with_file(spark.read.parquet(folder))
    path = shared_folder(spark, "manifest")
    readers.freeze_manifest(files, "input_file", 2, path)
    manifest = spark.read.parquet(path)
    names = sorted(r[0] for r in files.select("input_file").distinct().collect())
    assert sorted(r[0] for r in manifest.collect()) == [names[0], names[-1]]
    assert readers.held_out(files, "input_file", manifest).count() > 0
    with pytest.raises(ValueError, match="overlap"):
        readers.check_disjoint(files, files, ["input_file"])
    with pytest.raises(ValueError, match="empty"):
        readers.freeze_manifest(files.limit(0), "input_file", 2, shared_folder(spark, "none"))


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def damage(path, content):
    """Another content for a file that Spark has written, without its checksum."""
    with open(path, "wb") as f:
        f.write(content)
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def test_budget(spark, folder):
    path = shared_folder(spark, "broken")
    schema = spark.read.parquet(folder).schema
    spark.read.parquet(folder).repartition(3).write.parquet(path)
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(path)  # a sound file without rows
    assert readers.read_with_budget(spark, path, schema, 0).count() == 20
    victim = next(f for f in sorted(glob.glob(local(path) + "/*.parquet")) if pq.read_metadata(f).num_rows)
    damage(victim, b"not parquet at all")
    assert 0 < readers.read_with_budget(spark, path, schema, 1).count() < 20
    with pytest.raises(ValueError, match="1 files can't be read; the budget is 0"):
        readers.read_with_budget(spark, path, schema, 0)
    found = readers.read_losses(spark, path, schema)
    assert found.count() == 4 and found.where("error IS NOT NULL").count() == 1 and found.where("lost_rows > 0").count() == 0 and found.where("rows IS NULL AND lost_rows IS NULL").count() == 1


def broken_middle(folder, name="a.parquet", groups=3):
    """A file of 1,000 rows a group whose second group's data is damaged."""
    path = str(folder / name)
    pq.write_table(pa.table({"x": pa.array(range(1000 * groups), pa.int64()), "y": pa.array([[i, i] for i in range(1000 * groups)])}), path, row_group_size=1000, compression="none", use_dictionary=False)
    start = pq.read_metadata(path).row_group(1).column(0).data_page_offset
    content = bytearray(open(path, "rb").read())
    content[start : start + 40] = b"\xff" * 40
    open(path, "wb").write(bytes(content))


def test_a_broken_group_loses_no_other(spark, tmp_path):
    broken_middle(tmp_path)
    pq.write_table(pa.table({"x": pa.array([9000], pa.int32()), "z": ["more"]}), str(tmp_path / "b.parquet"))
    (tmp_path / "c.parquet").write_bytes(b"not parquet at all")
    rows, losses = readers.read_groups(spark, str(tmp_path), "x long, y array<long>", most_files=2, most_rows=1000, most_groups=2)
    got = rows.collect()
    assert sorted(r["x"] for r in got) == [*range(1000), *range(2000, 3000), 9000]
    assert all(r["y"] == ([r["x"]] * 2 if r["x"] < 9000 else None) for r in got)
    assert losses.found() == {"files": 2, "rows": 1000, "groups": 2}
    losses.check()
    for budget in ({"most_files": 1}, {"most_rows": 999}, {"most_groups": 1}):
        name = next(iter(budget)).removeprefix("most_")
        with pytest.raises(ValueError, match=f"{name} can't be read; the budget is"):
            readers.read_with_budget(spark, str(tmp_path), "x long", **({"most_files": 5} | budget))
    assert readers.read_with_budget(spark, str(tmp_path), "x long", 2).count() == 2001
    assert readers.read_groups(spark, str(tmp_path), "y array<long>, z string")[0].count() == 3001  # the broken column isn't read
    with pytest.raises(Exception, match="can't be read"):
        readers.read_groups(spark, str(tmp_path), "x long", on_failure="fail")[0].collect()


def test_each_group_is_read_once(spark, tmp_path):
    """One job over (file, group), and no other scan of the contents."""
    broken_middle(tmp_path, groups=9)
    rows, _ = readers.read_groups(spark, str(tmp_path), "x long")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Format: Parquet" not in plan and "FileScan parquet" not in plan
    assert rows.count() == 8000 and rows.select("x").distinct().count() == 8000


def test_losses_by_file(spark, tmp_path):
    broken_middle(tmp_path)
    r = readers.read_losses(spark, str(tmp_path), "x long").first()
    assert (r["rows"], r["lost_rows"], r["lost_groups"]) == (3000, 1000, 1) and r["error"] is not None


def test_opening_is_tried_again(tmp_path, monkeypatch):
    pq.write_table(pa.table({"x": pa.array([1, 2], pa.int64())}), str(tmp_path / "a.parquet"))
    store, tries = readers._store, []

    def failing(address):
        tries.append(address)
        if len(tries) < 3:
            raise OSError("not yet")
        return store(address)

    monkeypatch.setattr(readers, "_store", failing)
    schema = pa.schema([("x", pa.int64()), ("__fault", pa.struct([("file", pa.string()), ("group", pa.int32()), ("rows", pa.int64()), ("error", pa.string())]))])
    told = pa.RecordBatch.from_pylist([{"file": f"file://{tmp_path}/a.parquet", "group": 0, "rows": 2, "error": None}])
    found = list(readers._read_groups(schema, "skip", None, None, 2, 0.0)(iter([told])))
    assert [r["x"] for b in found for r in b.to_pylist()] == [1, 2] and len(tries) == 3
    tries.clear()
    found = list(readers._read_groups(schema, "skip", None, None, 1, 0.0)(iter([told])))
    assert [r["__fault"]["error"] for b in found for r in b.to_pylist()] == ["OSError"]


def test_nested_report(spark):
    a = spark.createDataFrame([("f", 1), ("g", 2), ("f", 3)], "field string, n long")
    b = spark.createDataFrame([(7,)], "total long")
    assert json.loads(readers.nested_report({"fields": a, "sums": b}).first()[0]) == {"fields": {"f": [{"n": 1}, {"n": 3}], "g": [{"n": 2}]}, "sums": [{"total": 7}]}


def test_multiplied_rows_differ(spark, folder):
    df = spark.read.parquet(folder)
    out = generate.multiplied(df, 3, "copy", ["impr_time"], values=("item_id",), labels=("label",), members=("click_members",), ids=("row",))
    assert out.count() == 60 and out.select("row").distinct().count() == 60
    r = {x["copy"]: x for x in out.where("row = '0' OR row LIKE '0-%'").collect()}
    assert r[0]["item_id"] != r[1]["item_id"] != r[2]["item_id"] and len(r[1]["item_id"]) == 12
    assert [[1 - y for y in x] for x in r[0]["label"]] == r[1]["label"] and r[0]["label"] == r[2]["label"]
    assert all(set(m) == set(n) or [(x + 1) % 3 for x in m] == n for m, n in zip(r[0]["click_members"], r[1]["click_members"], strict=True))
    assert contract.index_faults(out, LAYOUT).first().asDict() == {"invalid": 0, "duplicate_rows": 0, "dangling": 0}


def test_rewritten_inputs_are_rescanned(spark):
    top = shared_folder(spark, "rescan")
    one = spark.range(5).coalesce(1)
    one.write.parquet(f"{top}/in")
    run = lambda: incremental.rescanned(spark, f"{top}/in", "id long", f"{top}/out", f"{top}/c", f"{top}/seen")
    assert not run() and not run()
    spark.range(5, 7).coalesce(1).write.mode("append").parquet(f"{top}/in")
    assert not run() and spark.read.parquet(f"{top}/out/run=0").count() == 7
    victim = sorted(glob.glob(local(f"{top}/in") + "/*.parquet"))[0]
    other = pa.BufferOutputStream()
    pq.write_table(pa.table({"id": pa.array([100], pa.int64())}), other)
    n = pq.read_metadata(victim).num_rows
    damage(victim, other.getvalue().to_pybytes())
    os.utime(victim, (2_000_000_000, 2_000_000_000))
    assert run() and spark.read.parquet(f"{top}/out/run=1").count() == 7 - n + 1


def test_running_monitor_equals_the_whole(spark):
    top = shared_folder(spark, "monitor")
    rows = spark.range(200).select((F.col("id") % 3).alias("task"), (F.col("id") / 40 - 2).alias("logit"), (F.col("id") % 2).cast("int").alias("label"))
    rows.repartition(5).write.parquet(f"{top}/in")
    for _ in range(2):
        incremental.running_monitor(incremental.stream_files(spark, f"{top}/in", rows.schema, 1), ["task"], f"{top}/c")
    assert sorted(map(tuple, incremental.monitored(spark, ["task"], f"{top}/c").collect())) == sorted(map(tuple, metrics.monitor(rows, ["task"]).collect()))


def test_a_failed_batch_is_counted_once(spark, tmp_path):
    """A stream that fails in its third batch and runs again has the counts of the whole, and a row of state for each key."""
    top = shared_folder(spark, "restart")
    rows = spark.range(120).select((F.col("id") % 3).alias("task"), (F.col("id") / 40 - 1).alias("logit"), (F.col("id") % 2).cast("int").alias("label"), "id")
    for k in range(6):
        rows.where(f"id % 6 = {k}").coalesce(1).write.mode("append").parquet(f"{top}/in")
    mark = str(tmp_path / "broken")
    open(mark, "w").close()

    @F.udf("int")
    def fails(i):
        if i == 62 and os.path.exists(mark):
            raise RuntimeError("lost")
        return 1

    stream = lambda: incremental.stream_files(spark, f"{top}/in", rows.schema, 1)
    for run in (lambda s: incremental.running_histogram(s, ["task"], f"{top}/c1"), lambda s: incremental.running_counters(s, ["task"], {"n": F.lit(1), "sum": F.col("id")}, f"{top}/c2")):
        open(mark, "w").close()
        with pytest.raises(Exception):  # noqa: B017
            run(stream().where(fails("id") == 1))
        os.remove(mark)
        run(stream().where(fails("id") == 1))
    want = metrics.histogram_auc(metrics.histogram(rows, ["task"], metrics.probability_bin(F.col("logit"))), ["task"])
    assert sorted(map(tuple, incremental.running_auc(spark, ["task"], f"{top}/c1").collect())) == sorted(map(tuple, want.collect()))
    counted = incremental.running_counters(stream().where(fails("id") == 1), ["task"], {"n": F.lit(1), "sum": F.col("id")}, f"{top}/c2")
    assert sorted(map(tuple, counted.collect())) == [(k, 40, sum(range(k, 120, 3))) for k in range(3)]
    assert incremental.stream_state(spark, f"{top}/c2").count() == 6


def test_sampled_schema_check(spark, folder):
    found = readers.footers(spark, folder, sample=2)
    assert found.select("file").distinct().count() == 2 and readers.schema_report(found).count() == 1


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(ValueError, match="ambiguous"):
        readers.renamed(df, {"x": ["a", "b"]})


def test_vocabulary_round_trip_and_reports(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "v string")
    path = shared_folder(spark, "vocab")
    profile.vocabulary(df, "v", parts=3).write.parquet(path)
    vocab = spark.read.parquet(path)
    assert sorted(map(tuple, vocab.collect())) == [("a", 2, 1), ("b", 1, 2), ("c", 3, 1)]
    assert sorted(map(tuple, profile.vocabulary(df, "v", max_size=2).collect())) == [("a", 2, 1), ("b", 1, 2)]
    with pytest.raises(Exception, match="unknown value"):
        profile.vocabulary_ids(spark.createDataFrame([("z",)], "v string"), "v", vocab, "error").collect()
    out = shared_folder(spark, "report")
    readers.write_report(vocab, out)
    assert spark.read.json(out).count() == 3


def test_json_rows(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1, "b": [2]}, {"a": 3, "b": []}]')
    assert readers.json_rows(spark, str(tmp_path / "x.json")).count() == 2


def test_streams(spark, folder):
    top = shared_folder(spark, "stream")
    schema = spark.read.parquet(folder).schema
    read = lambda: incremental.stream_files(spark, folder, schema, 1)
    flat = lambda df: expand.expand_agg(df, LAYOUT, ("row",)).select("row", "request_id", "item_id")
    for _ in range(2):  # the second run finds nothing new
        incremental.ingest(read(), f"{top}/out", f"{top}/c1", flat)
    got = spark.read.parquet(f"{top}/out").drop("batch")
    assert got.exceptAll(flat(spark.read.parquet(folder))).count() == 0 and got.count() == 240
    counters = incremental.running_counters(read(), ["row"], {"n": F.size("target_indices")}, f"{top}/c2")
    assert counters.agg(F.sum("n")).first()[0] == 240
    times = incremental.file_times(spark.read.parquet(folder))
    assert incremental.changed_files(times, times).count() == 0
