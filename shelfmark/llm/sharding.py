"""Shards by jump consistent hashing.

A row's shard follows from its id and the number of shards alone: the id's
64-bit hash seeds a linear congruential sequence, and the sequence says to
which higher shard number the row would jump next. The last jump below the
number of shards is the row's shard. There is no ring and no table to keep, and
with one shard more the next jump either leads to that shard or beyond it, so
rows move into the new shard only, and no more of them than it needs.

``write_shards`` puts rows into one folder for each shard, in the order of id,
checksum and size. They are dealt by ranges of (shard, id, checksum, size) and
last of all a row's own number, so an id (or a missing one) that holds a third
of all rows is spread over several tasks and files. A slot is a row's place in
its shard: the rows in the files before its own, and its place in its file.
Files are counted, rows never gather anywhere.

Defined cases: rows without an id count as rows with an empty one (all in one
shard, before the others); null text has size 1 and the checksum of no bytes;
texts of any length are taken whole; rows equal in id, checksum and size have
neighbouring slots in any order; an empty table gives no files and an empty
result; columns of the table named like the operator's own (``shard``,
``slot``) are not written, other columns are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import stored

#: Fixed values of the method's sequence: multiplier (as two halves) and the span of its upper 31 bits.
MULTIPLIER = 2862933555777941757
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
SPAN = float(1 << 31)
#: Jumps made at first; more than this are hardly ever needed, and then made too.
JUMPS = 64
#: Rows of a file that are numbered together.
BLOCK = 1_000_000
LAW = "key"


def _half(key: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), at, 8), 16, 10).cast("bigint")


def _and(c: Column, bits: int) -> Column:
    return c.bitwiseAND(F.lit(bits))


def _next(s: Column) -> Column:
    """State (b, j, hi, lo) after one jump; hi and lo are the halves of a 64-bit number, which wraps."""
    hi, lo = s["hi"], s["lo"]
    p = _and(lo, 0xFFFF) * F.lit(LOW) + 1
    q = F.shiftright(lo, 16) * F.lit(LOW) + F.shiftright(p, 16)
    new_lo = _and(p, 0xFFFF).bitwiseOR(F.shiftleft(_and(q, 0xFFFF), 16))
    top = _and(hi, 0xFFFF) * F.lit(LOW) + F.shiftleft(_and(F.shiftright(hi, 16) * F.lit(LOW), 0xFFFF), 16)
    new_hi = _and(top + lo * F.lit(HIGH) + F.shiftright(q, 16), 0xFFFFFFFF)
    share = F.lit(SPAN) / (F.shiftright(new_hi, 1) + 1).cast("double")
    return F.struct(s["j"].alias("b"), F.floor((s["j"] + 1).cast("double") * share).cast("bigint").alias("j"), new_hi.alias("hi"), new_lo.alias("lo"))


def _jumps(state: Column, shards: int, most: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, lambda s, _: F.when(s["j"] < shards, _next(s)).otherwise(s))


def _free(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def with_shard(df: DataFrame, shards: int, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """``df`` with the shard (0 to shards - 1) of every row's key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    k, zero = F.col(f"`{key}`"), F.lit(0).cast("bigint")
    # Shard -1 jumps to 0 before the first draw, as every sequence begins.
    start = F.struct(F.lit(-1).cast("bigint").alias("b"), zero.alias("j"), _half(k, 1).alias("hi"), _half(k, 9).alias("lo"))
    first, last = _free(df, "first_jumps"), _free(df, "last_jump")
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    df = df.select("*", F.explode(F.array(_jumps(start, shards, min(shards, JUMPS)))).alias(first))
    state = F.col(first)
    more = F.when(state["j"] < shards, _jumps(state, shards, shards)).otherwise(state) if shards > JUMPS else state
    df = df.select("*", F.explode(F.array(more)).alias(last))
    return df.select(*own, F.col(last)["b"].cast("int").alias(name))


def moves(df: DataFrame, shards: int, more: int, key: str = "doc_id") -> DataFrame:
    """The rows that go elsewhere when ``shards`` become ``more``, with ``shard`` and ``grown_shard`` (always a new one)."""
    both = with_shard(with_shard(df, shards, key), more, key, "grown_shard")
    return both.filter(F.col("shard") != F.col("grown_shard"))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_crc(text: Column) -> Column:
    """Unsigned crc32 of the text's UTF-8 bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> T.StructType:
    """Write ``docs`` below ``path`` as ``shard=<number>`` folders, and return the schema to read them with."""
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")])
    text = F.col(f"`{text_col}`")
    order = [F.col("shard"), F.col(f"`{id_col}`"), text_crc(text), text_size(text)]
    placed = with_shard(own, shards, id_col)
    dealt = placed.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    dealt.write.partitionBy("shard").parquet(path)
    return placed.schema


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All written columns, ``shard`` and ``slot`` (its place in the shard, from 0 without a gap)."""
    rows = spark.read.schema(schema).parquet(path)
    file, at, block, base = (_free(rows, c) for c in ("file", "at", "block", "base"))
    rows = rows.select(*[F.col(f"`{c}`") for c in schema.names], F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(at))
    rows = rows.withColumn(block, F.floor(F.col(at) / F.lit(BLOCK)))
    key = ["shard", file, block]
    # One row a file (and block): the place of a file is that of the task that wrote it.
    part, piece = (F.regexp_extract(file, p, 1).cast("bigint") for p in (r"^part-(\d+)", r"\.?c(\d+)\."))
    ahead = Window.partitionBy("shard").orderBy(part, piece, block).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key).agg(F.count("*").alias(base))
    bases = stored(counts.select(*key, F.coalesce(F.sum(base).over(ahead), F.lit(0)).alias(base)), "shard-files")
    slot = F.col(base) + F.col(at) - F.col(block) * BLOCK
    return rows.join(bases, key).select(*[F.col(f"`{c}`") for c in schema.names], slot.cast("bigint").alias("slot"))


def manifest(shards: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows and bytes of every shard that has rows."""
    return shards.groupBy("shard").agg(F.count("*").alias("rows"), F.sum(text_size(F.col(f"`{text_col}`"))).alias("bytes"))


def sql(shards: int) -> str:
    """DuckDB SQL of the contract's columns: 128-bit integers where Spark works with halves, checksums byte by byte."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        table.append(str(byte))
    return f"""
WITH RECURSIVE t AS (SELECT [{", ".join(table)}] AS crc),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (
  SELECT rid, doc_id, strlen(text) + 1 AS size,
    ('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT AS seed,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda acc, b: xor(acc >> 8, t.crc[(xor(acc, b) & 255) + 1]::BIGINT))) AS text_crc32
  FROM d, t),
s AS (
  SELECT rid, -1::BIGINT AS b, 0::BIGINT AS j, seed AS k FROM x
  UNION ALL
  SELECT rid, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((n >> 33) + 1)::DOUBLE))::BIGINT, n
  FROM (SELECT rid, j, (k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS n FROM s WHERE j <= {shards})),
g AS (SELECT rid, max(b) FILTER (WHERE b < {shards}) AS shard, max(b) FILTER (WHERE b <= {shards}) AS grown FROM s GROUP BY rid)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, '{LAW}' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard
FROM x JOIN g USING (rid)
"""
