"""WARC archives, written and read back with boundary-chain verification.

A record is a row of text that Spark's text writer ends with the record separator, so archives
are ordinary WARC files in any store that Spark reaches. Payloads of MIN_PAYLOAD bytes or more
that are equal by SHA-1 and length are stored once; the others become revisit records.

Reading splits the files at the magic line, wherever it stands. Each task follows, within its
byte range, where every candidate record says that its successor starts, and emits candidate and
exit. Pointer jumping over the exits from each file's start finds where the true chain enters
each range; only records on that chain are kept, so a magic line inside a payload is rejected.
Payloads that hold one are put together again from their parts.

Defined results: a null payload is empty; a null address is left out. Small payloads are always
responses. Rows that repeat both id and payload get a record each, all of them responses if
theirs is the largest id. A null id is smaller than any other. A file whose chain doesn't end at
the file's end is an error. An archive without files gives no records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import broadcast_if_small, written

MAGIC, END, GAP = "WARC/1.1\r\n", "\r\n\r\n", "\r\n\r\n"
MIN_PAYLOAD, DATE, BROADCAST_BYTES = 1000, "2000-01-01T00:00:00Z", 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> DataFrame:
    """One WARC record per page, as text without the separator that follows it.

    The groups of equal payloads are found on digests alone. Only groups of two or more are kept
    for the join, which broadcasts them if their file is small and else shuffles by digest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("id", "url", "payload", F.octet_length("payload").alias("size"), F.sha1(F.col("payload").cast("binary")).alias("sha"))
    groups = rows.where(F.col("size") >= MIN_PAYLOAD).groupBy("sha", "size").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(broadcast_if_small(written(groups.select("sha", "size", "first"), "payload-groups"), BROADCAST_BYTES), ["sha", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha")),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("first"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return rows.select(F.concat(header, block).alias("value"))


def write_archives(pages: DataFrame, path: str, **names: str) -> None:
    """Write the pages' records to WARC files below ``path``, a file for each task."""
    records(pages, **names).write.option("lineSep", GAP).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines, in the files' order within each byte range."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("file_size"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole byte ranges of files, each as one table; a task reads one range after the other."""
    held: list[pa.RecordBatch] = []
    own = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("file").to_pylist(), batch.column("range").to_pylist(), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if own is not None and keys[s] != own:
                yield pa.Table.from_batches(held)
                held = []
            own = keys[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds rel (where a part starts in its range), next (where its record's successor starts) and
    leaves (the first start on its chain that isn't a candidate of the range)."""
    for part in _ranges(batches):
        sizes = part.column("len").to_numpy() + len(MAGIC)
        rel = np.cumsum(sizes) - sizes - len(MAGIC)
        length = part.column("content_length").to_pylist()
        first = part.column("range")[0].as_py() == 0
        after = [None if n is None or (first and i == 0) else int(r) + len(MAGIC) + h + len(END) + n + len(GAP) for i, (r, h, n) in enumerate(zip(rel, part.column("head_len").to_pylist(), length, strict=True))]
        leaves: dict[int, int] = {}
        for r, n in zip(rel[::-1].tolist(), after[::-1], strict=True):
            if n is not None:
                leaves[r] = leaves.get(n, n)
        part = part.append_column("rel", pa.array(rel, pa.int64())).append_column("next", pa.array(after, pa.int64())).append_column("leaves", pa.array([leaves.get(r) for r in rel.tolist()], pa.int64()))
        yield from part.to_batches()


def _field(head: Column, name: str, value: str = "[^\r\n]*") -> Column:
    return F.regexp_extract(head, rf"(?m)^{name}: *({value})\r?$", 1)


_PARTS = "file string, range long, file_size long, len int, head_len int, content_length long, pay_len long, whole boolean, sha string, type string, record string, address string, digest string, told_len long, refers string"


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each part between magic lines: header fields, payload digest and chain, no payload."""
    lines = _lines(spark, path).withColumn("head", F.substring_index("value", END, 1)).withColumn("head_len", F.octet_length("head"))
    data = F.col("value").cast("binary")
    lines = lines.withColumn("http_len", F.octet_length(F.substring_index(F.substr(data, F.col("head_len") + 5).cast("string"), END, 1)))
    number = lambda name: F.nullif(_field(F.col("head"), name, "[0-9]{1,18}"), F.lit("")).cast("long")
    lines = lines.withColumn("content_length", F.when(F.col("head_len") < F.octet_length("value"), number("Content-Length")))
    lines = lines.withColumn("pay_len", F.greatest(F.lit(0), F.col("content_length") - F.col("http_len") - len(END)))
    lines = lines.withColumn("pay", F.substr(data, F.col("head_len") + F.col("http_len") + 2 * len(END) + 1, F.col("pay_len").cast("int")))
    text = lambda name: F.nullif(_field(F.col("head"), name), F.lit(""))
    rows = lines.select(
        "file", "range", "file_size", F.octet_length("value").alias("len"), "head_len", "content_length", "pay_len",
        (F.octet_length("pay") == F.col("pay_len")).alias("whole"), F.sha1("pay").alias("sha"), text("WARC-Type").alias("type"), text("WARC-Record-ID").alias("record"),
        text("WARC-Target-URI").alias("address"), F.regexp_replace(text("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), number("WARC-Payload-Length").alias("told_len"), text("WARC-Refers-To").alias("refers"),
    )
    return written(rows.mapInArrow(_chained, _PARTS + ", rel long, next long, leaves long"), "parts")


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The records of one byte range that the chain from its entry reaches."""
    after = dict(zip(rows["rel"], rows["next"], strict=True))
    at, out = rows["entry"].iloc[0], []
    while at in after:
        out.append(at)
        at = after[at]
    return pd.DataFrame({"file": rows["file"].iloc[0], "range": rows["range"].iloc[0], "rel": pd.array(out, dtype="int64")})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records: file, start, record_type, record_id, address, payload_bytes,
    payload_digest (computed for responses, told by revisits), refers_to, intact."""
    parts = _parts(spark, path)
    spans = parts.groupBy("file", "range").agg(F.sum(F.col("len") + len(MAGIC)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    spans = written(spans.select("file", "range", F.coalesce(before, F.lit(0)).alias("base")), "ranges")
    placed = parts.join(broadcast_if_small(spans, BROADCAST_BYTES), ["file", "range"]).withColumn("start", F.col("base") + F.col("rel"))
    jumps = written(placed.where("leaves IS NOT NULL").select("file", "start", (F.col("base") + F.col("leaves")).alias("to")), "jumps")
    reached = written(parts.select("file", F.lit(0).cast("long").alias("start")).distinct(), "reached")
    most = spans.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most + 1)) if most else 0):
        reached = written(reached.unionByName(reached.join(jumps, ["file", "start"]).select("file", F.col("to").alias("start"))).distinct(), "reached")
        further = jumps.select("file", F.col("start").alias("to"), F.col("to").alias("beyond"))
        jumps = written(jumps.join(further, ["file", "to"], "left").select("file", "start", F.coalesce("beyond", "to").alias("to")), "jumps")
    ends = parts.select("file", "file_size").distinct()
    broken = ends.join(reached, (ends["file"] == reached["file"]) & (ends["file_size"] == reached["start"]), "left_anti").count()
    if broken:
        raise ValueError(f"in {broken} files the records' chain doesn't end with the file")
    entries = placed.where("next IS NOT NULL").join(reached, ["file", "start"], "left_semi").select("file", "range", F.col("rel").alias("entry"))
    chain = parts.where("next IS NOT NULL").select("file", "range", "rel", "next").join(entries, ["file", "range"])
    true = written(chain.groupBy("file", "range").applyInPandas(_walk, "file string, range long, rel long"), "true-records")
    kept = placed.join(true, ["file", "range", "rel"], "left_semi")
    parted = kept.where("NOT whole")
    if parted.limit(1).count():
        kept = kept.join(_reassembled(spark, path, placed, true), ["file", "start"], "left").withColumns({"sha": F.coalesce("whole_sha", "sha")})
    answer = F.col("type") == "response"
    return kept.select(
        "file", "start", F.col("type").alias("record_type"), F.col("record").alias("record_id"), "address",
        F.when(answer, F.col("pay_len")).otherwise(F.col("told_len")).alias("payload_bytes"), F.when(answer, F.col("sha")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("refers").alias("refers_to"), (~answer | (F.col("sha") == F.col("digest"))).alias("intact"),
    )


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds rel to the parts; ranges are long, so only the running place is kept."""
    own, at = None, 0
    for batch in batches:
        rel = []
        for file, start, value in zip(batch.column("file").to_pylist(), batch.column("range").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if (file, start) != own:
                own, at = (file, start), -len(MAGIC)
            rel.append(at)
            at += len(value) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("range"), pa.array(rel, pa.int64()), batch.column("value")], ["file", "range", "rel", "value"])


def _reassembled(spark: SparkSession, path: str, placed: DataFrame, true: DataFrame) -> DataFrame:
    """(file, start, whole_sha) of the records whose payload holds magic lines."""
    marked = placed.join(true.withColumn("is_record", F.lit(True)), ["file", "range", "rel"], "left")
    record = F.when(F.col("is_record"), F.struct("start", "whole", "head_len", "pay_len", "content_length"))
    owner = F.last(record, ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    pieces = marked.select("file", "range", "rel", F.col("start").alias("at"), owner.alias("o")).where("NOT o.whole")
    values = _lines(spark, path).select("file", "range", F.col("value").cast("binary").alias("value")).mapInArrow(_values, "file string, range long, rel long, value binary")
    joined = pieces.join(values, ["file", "range", "rel"]).groupBy("file", "o").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    text = F.array_join(F.transform("v", lambda x: x["value"].cast("string")), MAGIC).cast("binary")
    skip = F.col("o.head_len") + len(END) + F.col("o.content_length") - F.col("o.pay_len")
    return joined.select("file", F.col("o.start").alias("start"), F.sha1(F.substr(text, (skip + 1).cast("int"), F.col("o.pay_len").cast("int"))).alias("whole_sha"))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record of archives from ``write_archives``: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    rows = read_records(spark, path)
    sound = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload doesn't have its record's digest")))
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", sound.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
