"""Sizing of hash tables: collisions, widths, growth and recommendations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bound of distinct values and the width up to it.
PROFILE_WIDTHS = ((16, 8), (256, 16), (4096, 24), (65_536, 32), (1_000_000, 48), (10_000_000, 64), (100_000_000, 96))
TABLE_WIDTHS = ((16, 8), (256, 16), (4096, 24), (65_536, 32), (1_000_000, 48))
#: Observed maximum and the cap up to it; beyond it 512.
BAG_CAPS = ((512, 128), (2048, 256))
MAX_ALPHA, HIGH_CARDINALITY, HIGH_CARDINALITY_WIDTH = 0.95, 1_000_000, 32
IDEAL_LOAD, PRODUCTION_LOAD, MIN_BUCKETS, MAX_BUCKETS, SMALL_TABLE, SMALL_COLLISION = 0.5, 1.75, 1 << 8, 1 << 30, 1000, 0.02
IDENTITY_MAX, VOCABULARY_MAX, HEAD_TAIL_MIN = 8192, 50_000, 1_000_000


def expected_collision(distinct: Column, buckets: Column) -> Column:
    """Share of distinct values expected to lose a bucket of their own under uniform hashing."""
    occupied = buckets * -F.expm1(distinct * F.log1p(F.lit(-1.0) / buckets))
    uniform = F.greatest(F.lit(0.0), F.lit(1.0) - occupied / distinct)
    return F.when(distinct <= 1, 0.0).when(buckets <= 1, F.lit(1.0) - F.lit(1.0) / distinct).otherwise(uniform)


def _tiered(value: Column, tiers: tuple, beyond: int) -> Column:
    out = F.lit(beyond)
    for bound, width in reversed(tiers):
        out = F.when(value <= bound, width).otherwise(out)
    return out


def profile_width(distinct: Column) -> Column:
    return _tiered(distinct, PROFILE_WIDTHS, 128)


def table_width(distinct: Column, production: bool = False) -> Column:
    width = _tiered(distinct, TABLE_WIDTHS, 64)
    return F.when(distinct > HIGH_CARDINALITY, F.least(width, F.lit(HIGH_CARDINALITY_WIDTH))).otherwise(width) if production else width


def bag_cap(largest: Column) -> Column:
    """Cap of a bag's length from the longest seen."""
    return F.when(largest <= 128, largest).otherwise(_tiered(largest, BAG_CAPS, 512))


def power_of_two(value: Column, minimum: int = MIN_BUCKETS) -> Column:
    """Smallest power of two that is neither below the value nor the minimum."""
    bits = F.when(value > 1, F.length(F.bin((value - 1).cast("long")))).otherwise(0)
    return F.greatest(F.lit(minimum).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), bits))


def sequence_cap(quantile: Column, *caps: Column) -> Column:
    return F.least(quantile, *caps)


def joined_profiles(small: DataFrame, large: DataFrame, value: str = "distinct") -> DataFrame:
    """(field, small, large): a small and a large profile by field. Both must have the same fields;
    one that either lacks is an error when the rows are read."""
    both = small.select("field", F.col(value).alias("small")).join(large.select("field", F.col(value).alias("large")), "field", "full_outer")
    fault = F.concat(F.lit("field in one profile only: "), F.coalesce(F.col("field").cast("string"), F.lit("null")))
    checked = F.when(F.col("small").isNotNull() & F.col("large").isNotNull(), F.col("field")).otherwise(F.raise_error(fault))
    return both.select(checked.alias("field"), "small", "large")


def growth(profiles: DataFrame, small: str, large: str, small_files: int, large_files: int, target_files: int, stress_files: int, top_share: str | None = None) -> DataFrame:
    """Adds raw_alpha, alpha, tier, projected and stress: distinct values expected at more files."""
    a, b = F.col(small).cast("double"), F.col(large).cast("double")
    share = F.col(top_share) if top_share else F.lit(0.0)
    raw = F.when((a <= 0) | (b <= a), 0.0).otherwise(F.ln(b / F.when(a > 0, a)) / F.ln(F.lit(large_files / small_files)))
    out = profiles.withColumn("raw_alpha", raw).withColumn("alpha", F.least(F.lit(MAX_ALPHA), F.greatest(F.lit(0.0), F.col("raw_alpha"))))
    alpha = F.col("alpha")
    tier = (
        F.when(b <= 1, "dead").when((b <= 4) & (share >= 0.5), "near_const").when((b <= 512) & (alpha < 0.35), "saturated").when(alpha < 0.15, "slow")
        .when(alpha < 0.35, "mild").when(alpha < 0.7, "sublinear").otherwise("climbing")
    )
    out = out.withColumn("tier", tier)

    def at(files: int) -> Column:
        power = F.when(b <= 0, 0).otherwise(F.ceil(b * F.pow(F.lit(max(1.0, files / large_files)), alpha)))
        margin = F.when(F.col("tier") == "saturated", F.ceil(b * 1.25)).when(F.col("tier") == "slow", F.ceil(b * 1.5)).otherwise(0)
        return F.when(F.col("tier").isin("dead", "near_const"), b).otherwise(F.greatest(power, margin)).cast("long")

    return out.withColumn("projected", at(target_files)).withColumn("stress", at(stress_files))


def bucket_recommendation(fields: DataFrame, rates: DataFrame, target: float, headroom: float = 1.0) -> DataFrame:
    """Smallest bucket count that holds the field's distinct values at the collision target.

    ``fields``: field, distinct; ``rates``: field, buckets, sample_rate. Null if none does."""
    joined = fields.join(rates, "field").withColumn("projected_rate", expected_collision(F.col("distinct").cast("double"), F.col("buckets").cast("double")))
    fits = (F.col("buckets") >= F.ceil(F.col("distinct") * headroom)) & (F.col("sample_rate") <= target) & (F.col("projected_rate") <= target)
    return joined.groupBy("field").agg(F.min(F.when(fits, F.col("buckets"))).alias("recommended"), F.min("projected_rate").alias("best_projected_rate"))


def _bounded_buckets(distinct: Column, most: float) -> Column:
    """Smallest power of two from MIN_BUCKETS whose expected collision is at most ``most``."""
    sizes = F.transform(F.sequence(F.lit(MIN_BUCKETS.bit_length() - 1), F.lit(MAX_BUCKETS.bit_length() - 1)), lambda b: F.pow(F.lit(2.0), b))
    fit = F.filter(sizes, lambda n: (n >= MAX_BUCKETS) | (expected_collision(distinct.cast("double"), n) <= most))
    return F.get(fit, F.lit(0)).cast("long")


def table_shapes(fields: DataFrame, projected: str = "projected", retained: str = "retained", tier: str = "tier", widest: int | None = None) -> DataFrame:
    """Adds ideal_buckets, buckets, ideal_width, width, collision, weight_bytes and action to
    fields with distinct values projected to the target and to the retention period. ``widest`` is
    the width beyond which the tiers don't go."""
    d = F.col(projected)
    within = lambda w: F.least(w, F.lit(widest)) if widest else w
    small = F.when(d <= SMALL_TABLE, _bounded_buckets(d, SMALL_COLLISION)).otherwise(F.lit(MIN_BUCKETS).cast("long"))
    ideal = F.greatest(power_of_two(F.ceil(d / IDEAL_LOAD)), small)
    needed = F.greatest(power_of_two(F.ceil(F.col(retained) / IDEAL_LOAD)), power_of_two(F.ceil(d / PRODUCTION_LOAD)), small)
    live = F.col(tier) != "dead"
    out = fields.withColumns({"ideal_buckets": F.when(live, ideal), "needed": F.when(live, needed), "ideal_width": F.when(live, within(table_width(d))), "width": F.when(live, within(table_width(d, production=True)))})
    out = out.withColumn("buckets", F.least("needed", F.lit(MAX_BUCKETS).cast("long")))
    action = (
        F.when(~live, "exclude_constant").when(F.col(tier) == "near_const", "weak_optional").when(F.col("buckets") < F.col("needed"), "use_hard_capped")
        .when((F.col("buckets") < F.col("ideal_buckets")) | (F.col("width") < F.col("ideal_width")), "use_budgeted").otherwise("use")
    )
    out = out.withColumn("action", action).withColumn("collision", F.when(live, expected_collision(d.cast("double"), F.col("buckets").cast("double"))))
    return out.withColumn("weight_bytes", F.coalesce(weight_bytes(F.col("buckets"), F.col("width"), 2), F.lit(0).cast("long"))).drop("needed")


def weight_bytes(buckets: Column, width: Column, size: int = 4, row_state: bool = False) -> Column:
    """Bytes of a table with a padding row, and of one state value a row if asked for."""
    rows = buckets.cast("long") + F.lit(1).cast("long")
    own = rows * width.cast("long") * F.lit(size).cast("long")
    return own + rows * F.lit(size).cast("long") if row_state else own


def largest_tables(fields: DataFrame, n: int = 20) -> DataFrame:
    """The n tables with most weight bytes, ties by field."""
    return fields.orderBy(F.desc("weight_bytes"), "field").limit(n)


def encoding_strategy(profile: DataFrame) -> DataFrame:
    """Adds strategy, confidence, reason and suggested_width to field profiles with columns leaf_count,
    distinct, minimum, maximum, span (share of the unsigned range), high16 (distinct prefixes),
    buckets (current, may be null), remix_gain and inputs."""
    d, width = F.col("distinct"), F.col("maximum").cast("decimal(38,0)") - F.col("minimum").cast("decimal(38,0)") + 1
    code = (F.col("minimum") >= 0) & (width <= IDENTITY_MAX) & (d <= width) & (d >= F.greatest(F.lit(2), F.floor(width / 4)))
    tight = F.coalesce(code & (F.col("maximum") < IDENTITY_MAX) & (F.col("high16") <= 2) & (F.coalesce("span", F.lit(0.0)) < 1e-12), F.lit(False))
    over = F.coalesce(d > F.col("buckets"), F.lit(False))
    narrow = (d <= VOCABULARY_MAX) & (F.col("high16") <= 8) & (F.coalesce("span", F.lit(0.0)) < 0.01) & ~F.coalesce(code, F.lit(False))
    heavy = (d >= HEAD_TAIL_MIN) | F.coalesce(F.col("buckets") >= 1 << 24, F.lit(False))
    hashed = (F.col("remix_gain") >= 0.02) | F.coalesce((F.col("span") > 0.1) & (F.col("high16") >= 16), F.lit(False))
    rules = [(F.col("leaf_count") == 0, "insufficient_data"), (tight, "identity"), (over, "enlarge_pre_hashed"), (narrow, "vocab_candidate"), (heavy, "head_tail"), (hashed, "remixed_pre_hashed")]
    strategy = F.lit("keep_pre_hashed")
    for rule, name in reversed(rules):
        strategy = F.when(rule, name).otherwise(strategy)
    reasons = {
        "insufficient_data": F.lit("no values"), "identity": F.concat(F.lit("a code of width "), width.cast("string")), "enlarge_pre_hashed": F.concat(d.cast("string"), F.lit(" values in "), F.col("buckets").cast("string"), F.lit(" buckets")),
        "vocab_candidate": F.concat(d.cast("string"), F.lit(" values in a narrow range")), "head_tail": F.concat(d.cast("string"), F.lit(" values or a very large table")), "remixed_pre_hashed": F.concat(F.lit("remixing gains "), F.round("remix_gain", 4).cast("string")),
    }
    reason = F.lit("already hashed well")
    for name, text in reasons.items():
        reason = F.when(F.col("strategy") == name, text).otherwise(reason)
    many = F.col("inputs")
    sure = (
        F.when(F.col("strategy") == "enlarge_pre_hashed", "high").when((F.col("strategy") == "remixed_pre_hashed") | (F.col("strategy") == "identity") & (many >= 2) | (F.col("strategy") == "head_tail") & (many >= 3), "medium").otherwise("low")
    )
    return profile.withColumn("strategy", strategy).withColumn("confidence", sure).withColumn("reason", reason).withColumn("suggested_width", table_width(d))
