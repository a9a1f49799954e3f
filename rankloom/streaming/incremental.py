"""Incremental runs on Structured Streaming: new files are read once, and counts are kept in state stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.metrics import bce, histogram_auc, probability_bin, sigmoid
from rankloom.sources.shared import written


def stream_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append what is new, once; each batch has a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (file, modified) seen before whose modification time differs: they ask for a full rescan."""
    return now.join(before.withColumnRenamed("modified", "was"), "file").where("modified <> was").select("file")


def file_times(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def rescanned(spark: SparkSession, path: str, schema, out: str, checkpoint: str, seen: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Ingest what is new below ``path``; if a file seen before was rewritten, start again with another
    output and checkpoint, so no row of its former content stays. ``seen`` holds the files' times and
    the number of the run; returns whether it was a rescan. The output is below ``out``/run=number."""
    now = written(file_times(spark.read.schema(schema).parquet(path)), "file-times")
    marks = spark._jvm.org.apache.hadoop.fs.Path(seen)
    known = marks.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marks)
    before = written(spark.read.parquet(seen), "file-times") if known else now.withColumn("run", F.lit(0))
    again = known and not changed_files(now, before.drop("run")).isEmpty()
    run = (before.agg(F.max("run")).first()[0] or 0) + int(again)
    ingest(stream_files(spark, path, schema), f"{out}/run={run}", f"{checkpoint}/{run}", transform)
    now.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(seen)
    return again


def kept_by_stream(aggregate: DataFrame, checkpoint: str) -> None:
    """Runs a streaming aggregate over what is new. Its state store holds a row for each key, whatever the
    number of batches, and a batch that failed is counted once when the stream runs again."""
    aggregate.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keys and buffers that the stream of this checkpoint holds."""
    return spark.read.format("statestore").load(checkpoint).select("key.*", "value.*")


def _named_values(stream: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """A row for each named value, so that one aggregate has them all."""
    return stream.select(*keys, F.inline(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()))))


def running_monitor(stream: DataFrame, keys: list[str], checkpoint: str) -> None:
    """Keeps count, mean and squared deviations of loss, probability and logit by key in the stream's state."""
    x, y = F.col("logit").cast("double"), F.col("label")
    rows = _named_values(stream, keys, {"loss": bce(x, y), "prob": sigmoid(x), "logit": x})
    kept_by_stream(rows.groupBy(*keys, "name").agg(F.stddev_pop("value").alias("spread")), checkpoint)


def monitored(spark: SparkSession, keys: list[str], checkpoint: str) -> DataFrame:
    """The monitor over all batches: examples, loss, prob_mean, logit_mean, logit_std."""
    of = lambda name, c: F.max(F.when(F.col("name") == name, c))
    n, mean, spread = F.col("n"), F.col("avg"), F.sqrt(F.col("m2") / F.col("n"))
    out = [of("logit", n).cast("long").alias("examples"), F.round(of("loss", mean), 6).alias("loss"), F.round(of("prob", mean), 6).alias("prob_mean"), F.round(of("logit", mean), 6).alias("logit_mean"), F.round(of("logit", spread), 6).alias("logit_std")]
    return stream_state(spark, checkpoint).groupBy(*keys).agg(*out)


def running_histogram(stream: DataFrame, keys: list[str], checkpoint: str) -> None:
    """Keeps counts by key, bin and label in the stream's state."""
    rows = stream.select(*keys, probability_bin(F.col("logit")).alias("bin"), (F.col("label") == 1).alias("positive"))
    kept_by_stream(rows.groupBy(*keys, "bin", "positive").count(), checkpoint)


def running_auc(spark: SparkSession, keys: list[str], checkpoint: str) -> DataFrame:
    counts = stream_state(spark, checkpoint).groupBy(*keys, "bin")
    of = lambda own: F.coalesce(F.sum(F.when(own, F.col("count"))), F.lit(0))
    return histogram_auc(counts.agg(of(F.col("positive")).alias("pos"), of(~F.col("positive")).alias("neg")), keys)


def running_counters(stream: DataFrame, keys: list[str], counters: dict[str, Column], checkpoint: str) -> DataFrame:
    """Sums of whole-number values by key, kept in the stream's state: keys and a column for each counter."""
    rows = _named_values(stream, keys, {n: F.coalesce(c.cast("long"), F.lit(0).cast("long")) for n, c in counters.items()})
    kept_by_stream(rows.groupBy(*keys, "name").agg(F.sum("value").alias("total")), checkpoint)
    held = stream_state(stream.sparkSession, checkpoint)
    return held.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("sum"))).alias(n) for n in counters))
