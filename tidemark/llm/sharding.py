"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone: a generator seeded by the key jumps from shard to shard, and the last one below the number of shards
is the key's. There is no table of ring positions, and one more shard takes from each of the others its share of keys only. Keys are hashed by MD5, so that any engine finds the same shard.

Within a shard, rows are numbered without gaps by key, then by checksum and size of the text. A range partitioning spreads them, a shard over as many tasks as it needs; what
is known at once is one count for each task and shard.

Defined results: a null key hashes as the empty text, so all rows without a key are in one shard, over many tasks. Repeated rows share a shard and have numbers side by side. Null and
empty texts have size 1 and checksum 0. An empty table gives an empty table. Further columns aren't read by ``numbered``; ``placed`` keeps them, but one with the name of a column that it adds is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, crc32_sql, discard, extended, map_arrow, staged, with_columns

#: Fixed value: the multiplier of the published generator (Lamping and Veach 2014).
STEP = 2862933555777941757
#: The number of shards of the query.
SHARDS = 8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, from 0."""
    state, last, ahead = keys.astype("uint64"), np.zeros(len(keys), "int64"), np.zeros(len(keys), "int64")
    open_ = np.arange(len(keys))
    while len(open_):
        last[open_] = ahead[open_]
        state[open_] = state[open_] * np.uint64(STEP) + np.uint64(1)
        far = (last[open_] + 1) * (float(1 << 31) / ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype("float64"))
        ahead[open_] = far.astype("int64")
        open_ = open_[ahead[open_] < shards]
    return last


def hashed(key: Column) -> Column:
    """The first eight bytes of the MD5 of a key as text."""
    return F.unhex(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 16))


def placed(docs: DataFrame, shards: int, key: str = "doc_id", shard: str = "shard", grown: str | None = None) -> DataFrame:
    """``docs`` with the shard of each row, and with ``grown`` also the one that it has among one shard more. Nothing is shuffled."""
    if shards < 1:
        raise ValueError("there must be a shard")
    names = {shard: shards} | ({grown: shards + 1} if grown else {})
    taken = {n.lower() for n in names}
    given = docs.select(hashed(docs[f"`{key}`"]).alias("hash"), *(docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(as_bytes(batch.column(0))), ">u8")
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:])
            yield with_columns(rest, {name: pa.array(jump(keys, n), pa.int32()) for name, n in names.items()})

    schema = type(given.schema)(given.schema.fields[1:])
    return map_arrow(given, run, extended(schema, ", ".join(f"`{n}` int" for n in names)))


def numbered(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard of each row.

    Only these travel, not the texts. Equal rows are told apart by where they were read, so that not even one key with a third of all rows is one task.
    """
    raw = F.coalesce(docs[f"`{text}`"].cast("binary"), F.lit(b""))
    slim = docs.select(docs[f"`{key}`"].alias("key"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    slim = staged(placed(slim, shards, "key", grown="grown_shard").withColumn("tie", F.monotonically_increasing_id()), "shard-rows")
    order = ["shard", F.col("key").asc_nulls_first(), "text_crc32", "size", "tie"]
    # The number of a row within its task is in the low bits of its id, the task in the high ones.
    ordered = staged(slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("row", F.monotonically_increasing_id()), "shard-order")
    task = F.shiftright("row", 33)
    parts = ordered.groupBy("shard", task.alias("task")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    # A row for each task and one more for each shard: as many as the shuffle has partitions, whatever the table.
    starts = parts.select("shard", "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    out = ordered.withColumn("task", task).join(F.broadcast(starts), ["shard", "task"])
    discard(slim)
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("row") + F.col("shift")).alias("slot"), "grown_shard")


def op13(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and place of each document by the law of the key."""
    found = numbered(docs.select("doc_id", "text"), shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle(shards: int = SHARDS) -> str:
    """DuckDB SQL for ``op13``: the generator's states by recursion, until every key has jumped past the last shard."""
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT DISTINCT doc_id, CAST(CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:16] AS UBIGINT) AS HUGEINT) AS state FROM documents
), jumps(doc_id, last, state, ahead) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), state, CAST(0 AS BIGINT) FROM keyed
  UNION ALL
  SELECT doc_id, ahead, next, CAST(floor((ahead + 1) * (CAST(2147483648 AS DOUBLE) / CAST((next >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, ahead, (state * {STEP} + 1) % CAST(18446744073709551616 AS HUGEINT) AS next FROM jumps WHERE ahead < {shards + 1})
), homes AS (
  SELECT doc_id, max(last) FILTER (last < {shards}) AS shard, max(last) FILTER (last < {shards + 1}) AS grown_shard FROM jumps GROUP BY doc_id
), sized AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents
)
SELECT s.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM sized s JOIN homes h ON s.doc_id IS NOT DISTINCT FROM h.doc_id
"""
