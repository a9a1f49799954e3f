"""Encoding of categorical ids, as column expressions. Ids start at 1; 0 stands for a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of the 64-bit finaliser.
MIX_FIRST, MIX_SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def prehashed_bucket(value: Column, buckets: int, reject_zero: bool = True) -> Column:
    """Low bits of an already hashed value, plus 1; null gives 0. Zero is an error, or bucket 1."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    bucket = value.bitwiseAND(F.lit(buckets - 1).cast("long")) + F.lit(1).cast("long")
    if reject_zero:
        bucket = F.when(value == 0, F.raise_error(F.lit("zero is not a hashed value")).cast("long")).otherwise(bucket)
    return F.when(value.isNull(), F.lit(0).cast("long")).otherwise(bucket)


def sha_bucket(value: Column, buckets: int, salt: str = "") -> Column:
    """First eight bytes of SHA-256 of ``salt:value``, little-endian, modulo ``buckets``, plus 1."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), value.cast("string")), 256)
    little = F.concat(*(F.substring(digest, 2 * k + 1, 2) for k in range(7, -1, -1)))
    number = F.conv(little, 16, 10).cast("decimal(20,0)")
    return F.when(value.isNull(), F.lit(0).cast("long")).otherwise((number % F.lit(buckets).cast("decimal(20,0)")).cast("long") + F.lit(1).cast("long"))


def identity_id(value: Column, size: int, on_error: str = "error") -> Column:
    """The value itself if within 1 to ``size``; else an error, or 0 with ``padding``."""
    other = F.lit(0).cast("long") if on_error == "padding" else F.raise_error(F.lit(f"id is not within 1 and {size}")).cast("long")
    return F.when(value.isNull(), F.lit(0).cast("long")).when(value.between(1, size), value.cast("long")).otherwise(other)


def encode(value: Column, strategy: str, size: int, depth: int = 0, **options) -> Column:
    """Encode a scalar (depth 0), list (1) or nested list (2) by ``prehashed``, ``sha`` or ``identity``."""
    if depth:
        return F.transform(value, lambda x: encode(x, strategy, size, depth - 1, **options))
    chosen = {"prehashed": prehashed_bucket, "sha": sha_bucket, "identity": identity_id}[strategy]
    return chosen(value, size, **options)


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wrapping_multiply(value: Column, factor: int) -> Column:
    """Product modulo 2**64 on the bit pattern, by 16-bit limbs; a plain product would overflow
    under ANSI rules. ``value`` should be a bound name, as it occurs many times."""
    part = lambda v, shift, mask: F.shiftrightunsigned(v, shift).bitwiseAND(F.lit(mask).cast("long"))
    own, other = [part(value, 16 * k, 0xFFFF) for k in range(4)], [factor >> (16 * k) & 0xFFFF for k in range(4)]
    sums = []
    for k in range(4):
        total = own[0] * F.lit(other[k]).cast("long")
        for i in range(1, k + 1):
            total = total + own[i] * F.lit(other[k - i]).cast("long")
        sums.append(total)

    def assembled(c: Column) -> Column:
        low = c[0] + F.shiftleft(c[1], 16) + F.shiftleft(c[2].bitwiseAND(F.lit(0xFFFF).cast("long")), 32)
        top = F.shiftrightunsigned(low, 48) + F.shiftrightunsigned(c[2], 16) + c[3]
        return low.bitwiseAND(F.lit((1 << 48) - 1).cast("long")).bitwiseOR(F.shiftleft(top, 48))

    return bind(F.array(*sums), assembled)


def mix64(value: Column) -> Column:
    """Finaliser that spreads all 64 bits."""
    fold = lambda shift: lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift))
    value = bind(bind(value, fold(30)), lambda v: wrapping_multiply(v, MIX_FIRST))
    value = bind(bind(value, fold(27)), lambda v: wrapping_multiply(v, MIX_SECOND))
    return bind(value, fold(31))


def low_bits(value: Column, buckets: int, remix: bool = False, seed: int = 0) -> Column:
    """Bucket from 0 by the low bits, of the value itself or of its mix with a seed."""
    if remix:
        seed = seed - (1 << 64) if seed >= 1 << 63 else seed
        value = mix64(value.bitwiseXOR(F.lit(seed).cast("long")))
    return value.bitwiseAND(F.lit(buckets - 1).cast("long"))


def unsigned_order(value: Column) -> Column:
    """Orders signed 64-bit patterns as unsigned numbers; applied twice it gives the value back."""
    return value.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def dense(value: Column) -> tuple[Column, Column]:
    """Dense value with null as 0, and its presence bit."""
    return F.coalesce(value.cast("float"), F.lit(0.0).cast("float")), value.isNotNull().cast("float")


def fixed_vector(value: Column, width: int) -> Column:
    """The vector, or an error if its width differs; null stays null."""
    return F.when(value.isNull() | (F.size(value) == width), value).otherwise(F.raise_error(F.lit(f"vector width is not {width}")))


def value_map(value: Column, mapping: dict) -> Column:
    """Mapped value; an unmapped one is an error, null stays null."""
    out = F.raise_error(F.concat(F.lit("unmapped value "), value.cast("string")))
    out = out.cast("long") if all(isinstance(v, int) for v in mapping.values()) else out.cast("string")
    for k, v in mapping.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return F.when(value.isNotNull(), out)


def coarse_scene(scene: Column, allowed: list[int], unlisted: str = "recommend") -> Column:
    """struct(index, prior): (0, 1) for listed scenes; others give (1, 2), or are an error with
    ``unlisted="error"``. A negative or not whole scene is an error, null stays null."""
    pair = lambda i, p: F.struct(F.lit(i).cast("long").alias("index"), F.lit(p).cast("long").alias("prior"))
    fault = lambda text: F.raise_error(F.concat(F.lit(text), scene.cast("string"))).cast("struct<index:bigint,prior:bigint>")
    number = scene.cast("double")
    other = pair(1, 2) if unlisted == "recommend" else fault("unlisted scene ")
    out = F.when(number.isNull() & scene.isNotNull() | (number != F.floor(number)), fault("scene is not an integer: "))
    return F.when(scene.isNotNull(), out.when(number < 0, fault("negative scene ")).when(number.isin([float(x) for x in allowed]), pair(0, 1)).otherwise(other))
