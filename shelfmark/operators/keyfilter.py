"""A Bloom filter over keys, built and asked with built-in functions.

The filter drops rows of a wide table (raw responses) before anything costly is
done with them, and without moving them. It is blocked: a key's hash names one
of the filter's buckets (a bitmap of 4 KB), and other bits of a hash name the
key's ``HASHES`` bits in it, so a row looks at one bucket. A key that is in is
never dropped; of the others about one in a hundred stays, so the exact join
stays behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a bucket (the size of the built-in bitmaps), bits of the filter for each key, bits that a key sets.
BUCKET_BITS = 32_768
BITS_PER_KEY = 12
HASHES = 4
# The filter is broadcast (1.5 bytes a key, so at most 30 MB): for more keys there is none.
MAX_KEYS = 20_000_000


def _buckets(n: int) -> int:
    return max(1, -(-n * BITS_PER_KEY // BUCKET_BITS))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _bits(key: Column) -> list[Column]:
    """The places of a key's bits in its bucket: 15 bits of a second hash for each."""
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BUCKET_BITS - 1)) for i in range(HASHES)]


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(F.lit(1 << i)) != 0 for i in range(8)]), at.bitwiseAND(F.lit(7)).cast("int"))


def key_filter(keys: DataFrame, n: int, key: str = "isbn") -> DataFrame | None:
    """``(_bucket, _bits)`` of the distinct ``keys``, ``n`` or fewer of them; None where they are too many for a filter."""
    if n > MAX_KEYS:
        return None
    buckets, k = _buckets(n), F.col(key)
    bits = keys.select(_bucket(k, buckets).alias("_bucket"), F.explode(F.array(*_bits(k))).alias("_at"))
    # bitmap_construct_agg counts places from 0; a bucket no key falls into has no row and lets nothing through.
    return bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def only_keys(df: DataFrame, filter_: DataFrame | None, n: int, key: str = "isbn") -> DataFrame:
    """``df`` without most rows whose key is not in a ``key_filter`` made for ``n`` keys (all rows if there is none)."""
    if filter_ is None:
        return df
    buckets, k = _buckets(n), F.col(key)
    asked = df.withColumn("_bucket", _bucket(k, buckets)).join(F.broadcast(filter_), "_bucket")
    hit = None
    for at in _bits(k):
        one = _is_set(F.col("_bits"), at)
        hit = one if hit is None else hit & one
    return asked.where(hit).select(*df.columns)
