"""Queries on request groups: order, packing, padding, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import sequence
from rankloom.operators import batching, expand
from rankloom.plans import fixtures
from rankloom.plans.fixtures import KEYS, LAYOUT
from rankloom.plans.registry import FLAT, REQ, SEEN, joined, mixed, query
from rankloom.sources.shared import written

REQUEST = ["user_id", "request_id"]
_GROUPS = f"{FLAT}, {SEEN}, w AS (SELECT user_id, request_id, count(*) AS work FROM seen GROUP BY ALL), g AS (SELECT user_id, request_id, user_id % 4 AS shard, count(*) AS n, coalesce(any_value(work), 0) AS work FROM flat LEFT JOIN w USING (user_id, request_id) GROUP BY ALL)"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested rows as a table, which each of a query's passes reads instead of joining them anew."""
    return written(fixtures.nested(spark, sf_dir), "nested")


def _groups(nested: DataFrame) -> DataFrame:
    """Request groups: shard, candidates and sequence work."""
    sizes = expand.candidates(nested, LAYOUT, KEYS).groupBy(*REQUEST).agg(F.count("*").alias("n"))
    lengths = [expand.sequence_lengths(nested, s, LAYOUT, KEYS).withColumnRenamed("n", s.name) for s in LAYOUT.sequences]
    for x in lengths:
        sizes = sizes.join(x, REQUEST)
    work = sequence.sequence_work([F.col(s.name) for s in LAYOUT.sequences], [1 << 30] * 3)
    return sizes.select(*REQUEST, (F.col("user_id") % 4).cast("int").alias("shard"), "n", work.cast("long").alias("work"))


def _packed_sql(groups: str, keys: str, size: str) -> str:
    """Next-fit as a recursion over the groups of each key in order: parts with batch, offset, rows."""
    return f"""ord AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY user_id, request_id) AS i, {size} AS b FROM {groups}),
        o AS (SELECT *, CASE WHEN n > b THEN CAST(ceil(n / CAST(b AS DOUBLE)) AS BIGINT) ELSE 1 END AS pieces, CASE WHEN n > b THEN (CASE WHEN n % b > 0 THEN n % b ELSE b END) END AS rest FROM ord),
        f AS (SELECT {keys}, i, CAST(0 AS BIGINT) AS opened, pieces, n, b, user_id, request_id, CASE WHEN coalesce(rest, n) >= b THEN pieces ELSE pieces - 1 END AS next_batch, CASE WHEN coalesce(rest, n) >= b THEN 0 ELSE coalesce(rest, n) END AS used FROM o WHERE i = 1
            UNION ALL SELECT {", ".join("o." + k for k in keys.split(", "))}, o.i, s.at, o.pieces, o.n, o.b, o.user_id, o.request_id,
                CASE WHEN s.last >= o.b THEN s.at + o.pieces ELSE s.at + o.pieces - 1 END, CASE WHEN s.last >= o.b THEN 0 ELSE s.last END
            FROM f JOIN o ON o.i = f.i + 1 AND {" AND ".join(f"o.{k} = f.{k}" for k in keys.split(", "))},
                LATERAL (SELECT f.next_batch + CASE WHEN f.used > 0 AND f.used + o.n > o.b THEN 1 ELSE 0 END AS at, coalesce(o.rest, CASE WHEN f.used + o.n > o.b THEN o.n ELSE f.used + o.n END) AS last) s)
        SELECT {keys}, user_id, request_id, opened + k AS batch, CAST(k * b AS BIGINT) AS "offset", CAST(least(n - k * b, b) AS BIGINT) AS rows FROM (SELECT *, unnest(range(pieces)) AS k FROM f)"""


@query(f"WITH RECURSIVE {_GROUPS}, {_packed_sql('g', 'shard', '100')}")
def pack_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _nested(spark, sf_dir)
    found = batching.packed(_groups(nested), ["shard"], REQUEST, "n", 100)
    return found.select("shard", *REQUEST, "batch", "offset", "rows")


@query(f"WITH RECURSIVE {_GROUPS}, gb AS (SELECT *, CAST(work > 8 AS INT) + CAST(work > 16 AS INT) AS bucket FROM g), {_packed_sql('gb', 'shard, bucket', 'CASE bucket WHEN 0 THEN 200 WHEN 1 THEN 100 ELSE 40 END')}")
def pack_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _nested(spark, sf_dir)
    found = batching.packed_by_length(_groups(nested), ["shard"], REQUEST, "n", "work", [8, 16], [200, 100, 40])
    return found.select("shard", "bucket", *REQUEST, "batch", "offset", "rows")


def _batches(parts: DataFrame, nested: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates in their batches with the padded width of their clicks."""
    rows = expand.expand_agg(nested, LAYOUT, KEYS).select(*REQUEST, F.col("candidate_position").cast("long").alias("candidate_position"), "item_id", F.col("click.id").alias("ids"))
    found = batching.batch_rows(parts.select(*REQUEST, *keys, "batch", "offset", "rows", "slot"), rows, REQUEST, "candidate_position")
    padded = batching.padded_batches(found, [*keys, "batch"], "ids")
    return padded.select(*keys, "batch", "slot", *REQUEST, "candidate_position", "item_id", F.col("length").cast("long").alias("length"), F.size("ids").cast("long").alias("width"))


def _batches_sql(groups: str, keys: str, size: str) -> str:
    """Each candidate's batch from the parts; slots are numbered in order."""
    return f"""parts AS (WITH RECURSIVE {_packed_sql(groups, keys, size)}),
        clicks AS (SELECT user_id, request_id, count(*) AS k FROM seen WHERE stream = 'click' GROUP BY ALL),
        o2 AS (SELECT p.*, f.candidate_position, f.item_id, coalesce(c.k, 0) AS length FROM flat f JOIN parts p ON p.user_id = f.user_id AND p.request_id = f.request_id AND f.candidate_position >= p."offset" AND f.candidate_position < p."offset" + p.rows LEFT JOIN clicks c ON c.user_id = f.user_id AND c.request_id = f.request_id)
        SELECT {keys}, batch, row_number() OVER (PARTITION BY {keys}, batch ORDER BY user_id, request_id, candidate_position) - 1 AS slot, user_id, request_id, candidate_position, item_id, length, max(length) OVER (PARTITION BY {keys}, batch) AS width FROM o2"""


@query(f"WITH RECURSIVE {_GROUPS}, {_batches_sql('g', 'shard', '100')}")
def batches_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in its batch, with its slot and the width that its clicks are padded to."""
    nested = _nested(spark, sf_dir)
    parts = batching.packed(_groups(nested), ["shard"], REQUEST, "n", 100)
    return _batches(parts, nested, ["shard"])


@query(f"WITH RECURSIVE {_GROUPS}, gb AS (SELECT *, CAST(work > 8 AS INT) + CAST(work > 16 AS INT) AS bucket FROM g), {_batches_sql('gb', 'shard, bucket', 'CASE bucket WHEN 0 THEN 200 WHEN 1 THEN 100 ELSE 40 END')}")
def batches_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by buckets of length, each with its own batch size."""
    nested = _nested(spark, sf_dir)
    parts = batching.packed_by_length(_groups(nested), ["shard"], REQUEST, "n", "work", [8, 16], [200, 100, 40])
    return _batches(parts, nested, ["shard", "bucket"])


@query(f"WITH {_GROUPS}, b AS (SELECT *, CAST(work > 8 AS INT) + CAST(work > 16 AS INT) AS bucket FROM g), r AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY user_id, request_id) - 1) // 32 AS slice FROM b) SELECT bucket, slice, count(*) AS requests, CAST(sum(n) AS BIGINT) AS candidates FROM r GROUP BY ALL")
def bucket_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _nested(spark, sf_dir)
    rows = batching.slices(batching.bucketed(_groups(nested), "work", [8, 16]), ["bucket"], REQUEST, 32)
    return rows.groupBy("bucket", "slice").agg(F.count("*").alias("requests"), F.sum("n").alias("candidates"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS k FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM r WHERE k = 1")
def first_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "lineitem")
    return batching.first_per_request(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS first_position, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events")
def interleaved_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batching.grouped_order(fixtures.events(spark, sf_dir), ["user_id"], "event_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.select("event_id", "first_position", place.cast("long").alias("place"))


@query("SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS representative FROM events")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.representative(fixtures.events(spark, sf_dir), ["user_id", "event_type"], "event_id").select("event_id", "representative")


@query(f"WITH o AS (SELECT user_id, CAST(h % 1000003 AS BIGINT) AS h FROM {mixed('y', '(SELECT DISTINCT user_id, xor(user_id, 7) AS y FROM events)', 'user_id')}) SELECT event_id, e.user_id, h AS key_mod, CAST(0 AS BIGINT) AS block FROM events e JOIN o ON o.user_id = e.user_id")
def shuffled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their request's shuffle key, modulo a prime; the tests check that groups stay whole and in order."""
    rows = batching.shuffled(fixtures.events(spark, sf_dir).select("event_id", "user_id"), ["user_id"], "event_id", 7)
    unsigned = F.col("shuffle_key").cast("decimal(20,0)") + F.when(F.col("shuffle_key") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    return rows.select("event_id", "user_id", (unsigned % 1000003).cast("long").alias("key_mod"), F.col("shuffle_block").alias("block"))


_PADDED = f"{REQ}, {SEEN}, c AS (SELECT user_id, request_id, count(*) FILTER (stream = 'click') AS n, count(*) FILTER (stream = 'click' AND id = 0) AS z FROM seen GROUP BY ALL), r AS (SELECT r.user_id, r.request_id, coalesce(n, 0) AS n, z FROM req r LEFT JOIN c USING (user_id, request_id) WHERE r.user_id IN (SELECT o_custkey FROM orders))"


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = fixtures.nested(spark, sf_dir)
    wide = nested.withColumn("h", expand.history(nested, LAYOUT.sequences[0])).select("user_id", F.explode("context_indices").alias("request_id"), "h")
    return wide.select(*REQUEST, sequence.visible(F.col("h"), F.col("request_id"))["id"].alias("ids"))


@query(f"WITH {_PADDED} SELECT user_id, request_id, n AS length, max(n) OVER (PARTITION BY user_id) AS width, n > 0 AS has_sequence, max(n) OVER (PARTITION BY user_id) - n + coalesce(z, 0) AS zeros FROM r")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batching.padded_batches(_clicks(spark, sf_dir), ["user_id"], "ids")
    width = F.size("ids").cast("long")
    return rows.select(*REQUEST, F.col("length").cast("long").alias("length"), width.alias("width"), "has_sequence", (width - F.size(F.filter("ids", lambda x: x != 0))).alias("zeros"))


@query(f"WITH {_PADDED} SELECT user_id, count(*) AS rows, CAST(sum(n) AS BIGINT) AS tokens, max(n) * count(*) AS cells, round(CASE WHEN max(n) > 0 THEN 1 - sum(n) / (max(n) * count(*)) ELSE 0.0 END, 9) AS padding FROM r GROUP BY user_id")
def padding_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.padding_ratio(_clicks(spark, sf_dir).withColumn("n", F.size("ids")), ["user_id"], "n")


@query(f"WITH {FLAT} SELECT user_id, request_id, item_id, 'label' AS difference FROM flat WHERE item_id % 97 = 0 AND request_id <> 3 UNION ALL SELECT user_id, request_id, item_id, 'only_left' FROM flat WHERE request_id = 3")
def compare_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two forms of expansion, one with planted faults."""
    nested = _nested(spark, sf_dir)
    local = expand.expand_agg(nested, LAYOUT, KEYS).select(*REQUEST, "item_id", "scene_id", "label")
    other = expand.candidates_with_requests(nested, LAYOUT, KEYS).select(*REQUEST, F.col("item_id")[0].alias("item_id"), "scene_id", F.col("label")[0].alias("label"))
    planted = other.where("request_id <> 3").withColumn("label", F.when(F.col("item_id") % 97 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    return batching.differences(local, planted, [*REQUEST, "item_id"])


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def union_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", "event_type")
    return batching.union_of({t: rows.where(F.col("event_type") == t) for t in ("click", "view")})


@query("SELECT DISTINCT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    orders = fixtures.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return batching.keys_apart(customers, orders, ["id"])


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS values, count(*) AS length FROM lineitem GROUP BY 1")
def flattened_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags as values and lengths, without padding."""
    rows = fixtures.orders(spark, sf_dir).where(F.size("parts") > 0)
    return rows.select(F.col("item_id").alias("l_orderkey"), joined("parts").alias("values"), F.size("parts").cast("long").alias("length"))


@query(f"SELECT event_id, CAST(row_number() OVER (ORDER BY h) - 1 AS BIGINT) AS place FROM {mixed('y', '(SELECT event_id, xor(event_id, 12345) AS y FROM events)', 'event_id')}")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of a mix of their number and a seed."""
    return batching.shuffled_rows(fixtures.table(spark, sf_dir, "events").select("event_id"), "event_id", 12345).select("event_id", "place")


@query("""WITH RECURSIVE g AS (SELECT user_id, min(event_id) AS f, count(*) AS n FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY f, user_id) AS i FROM g),
    b AS (SELECT i, user_id, CAST(0 AS BIGINT) AS block, CASE WHEN n >= 150 THEN 1 ELSE 0 END AS next_block, CASE WHEN n >= 150 THEN 0 ELSE n END AS used FROM o WHERE i = 1
        UNION ALL SELECT o.i, o.user_id, s.at, s.at + CASE WHEN s.now >= 150 THEN 1 ELSE 0 END, CASE WHEN s.now >= 150 THEN 0 ELSE s.now END
        FROM b JOIN o ON o.i = b.i + 1, LATERAL (SELECT b.next_block + CASE WHEN b.used > 0 AND b.used + o.n > 150 THEN 1 ELSE 0 END AS at, CASE WHEN b.used > 0 AND b.used + o.n <= 150 THEN b.used + o.n ELSE o.n END AS now) s)
    SELECT event_id, block FROM events e JOIN b ON b.user_id = e.user_id""")
def shuffle_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded form of the shuffle: which buffer of 150 rows, filled by whole users in the order in
    which they first appear, a row is dealt among. A user of more rows has one alone."""
    rows = batching.shuffled(fixtures.events(spark, sf_dir).select("event_id", "user_id"), ["user_id"], "event_id", 7, 150)
    return rows.select("event_id", F.col("shuffle_block").alias("block"))


@query(f"WITH {FLAT} SELECT 'flat' AS input, count(*) AS rows, CAST(sum(label) AS BIGINT) AS total FROM flat UNION ALL SELECT 'requests', count(*), CAST(sum(scene_id) AS BIGINT) FROM req WHERE user_id IN (SELECT o_custkey FROM orders)")
def user_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own function from a nested table and a context to several flat ones."""

    def adapt(table: DataFrame, context: dict) -> dict[str, DataFrame]:
        return {"flat": expand.expand_agg(table, context["layout"], context["keys"]), "requests": expand.requests(table, context["layout"], context["keys"])}

    found = expand.adapted(fixtures.nested(spark, sf_dir), adapt, {"layout": LAYOUT, "keys": KEYS})
    total = lambda name, c: found[name].agg(F.count("*").alias("rows"), F.sum(c).cast("long").alias("total")).select(F.lit(name).alias("input"), "rows", "total")
    return total("flat", "label").unionByName(total("requests", "scene_id"))


@query(f"WITH {FLAT}, {SEEN}, v AS (SELECT user_id, request_id, id, row_number() OVER (PARTITION BY user_id, request_id ORDER BY t DESC, id) - 1 AS place FROM seen WHERE stream = 'view'), p AS (SELECT user_id, request_id, min(place) AS place FROM v WHERE id % 5 = 0 GROUP BY ALL) SELECT f.user_id, f.request_id, f.item_id, 'view[' || p.place || '].id' AS difference FROM flat f JOIN p USING (user_id, request_id)")
def differences_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults planted deep in a history, named by their path."""
    flat = expand.expand_agg(_nested(spark, sf_dir), LAYOUT, KEYS).select(*REQUEST, "item_id", "scene_id", "click", "view")
    planted = F.transform("view", lambda e: F.struct(F.when(e["id"] % 5 == 0, -e["id"] - 1).otherwise(e["id"]).alias("id"), e["time"].alias("time")))
    return batching.differences(flat, flat.withColumn("view", planted), [*REQUEST, "item_id"])
