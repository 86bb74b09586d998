"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text. A text is cut before the bytes where the hash is the largest among its
neighbours, so that a cut depends on nothing but some dozens of bytes around it and an insertion moves no cut further off. Chunks
that occur more than once, by a 128-bit digest, count where they stand in a run of such chunks that follow each other over ``least`` bytes or more. With 0 every repeated chunk counts;
``LEAST`` leaves phrases alone which texts merely have in common, and these are reported still. Of a chunk's places in such runs the first one (smallest doc_id, then hash of the text, then
position) is kept, and the chunk is removed elsewhere.

Cuts fall between characters only. Defined results: null and empty texts have no chunks; a text shorter than the
neighbourhood is one chunk. Where a text repeats itself within fewer bytes than the neighbourhood, no place differs from the others, so it is cut every
``LONGEST`` bytes from the last cut on: an insertion moves these cuts up to the next one that the text sets, and no others. A
repeated row counts as the same text at the same place, so it keeps what its twin keeps; a null doc_id comes first. Extra columns are kept, but one with the
name of one that is added is replaced. An empty table gives an empty table. Texts are used whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, boxed, cut, discard, map_arrow, row_hash, staged, unboxed, with_spans

#: Bytes that the rolling hash covers, and bytes on each side among which a cut has the largest hash.
ROLL = 16
REACH = 32
#: A chunk without a cut for so long (a text that repeats itself) is cut all the same.
LONGEST = 1024
#: Bytes that repeated chunks in a row cover at least, unless a caller says otherwise.
LEAST = 128
#: Fixed by a seed: one random number for each byte value.
GEAR = np.random.default_rng(20_240_601).integers(0, 1 << 32, 256, dtype="uint32")


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """Gear hash of the last ``ROLL`` bytes at every place, by doubling the covered length."""
    h, n = GEAR[raw], 1
    while n < ROLL:
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(n)
        h, n = longer, 2 * n
    return h


def largest_before(h: np.ndarray, reach: int) -> np.ndarray:
    """Largest of the ``reach`` (a power of two) values before each place; 0 where there are none."""
    top, n = h.copy(), 1
    while n < reach:
        wider = top.copy()
        np.maximum(wider[n:], top[:-n], out=wider[n:])
        top, n = wider, 2 * n
    return np.concatenate((np.zeros(1, h.dtype), top[:-1]))


def cut_points(raw: bytes) -> list[int]:
    """Where chunks end, the last of them at the end of the text."""
    n = len(raw)
    if n <= 2 * REACH:
        return [n] if n else []
    b = np.frombuffer(raw, "uint8")
    h = gear_hashes(b)
    before, after = largest_before(h, REACH), largest_before(h[::-1], REACH)[::-1]
    best = (h > before) & (h >= after) & ((b & 0xC0) != 0x80)
    best[:REACH] = False
    best[n - REACH :] = False
    ends, last = [], 0
    for end in [*np.flatnonzero(best).tolist(), n]:
        while end - last > LONGEST:
            last += LONGEST
            while last < end and (raw[last] & 0xC0) == 0x80:
                last += 1
            if last < end:
                ends.append(last)
        if end > last:
            ends.append(end)
            last = end
    return ends


def chunk_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each chunk: row_id, row_hash, start, end and a 128-bit digest as two integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, digests = [], [], [], []
            for i, raw in enumerate(as_bytes(batch.column(2))):
                last = 0
                for end in cut_points(raw or b""):
                    rows.append(i)
                    starts.append(last)
                    ends.append(end)
                    digests.append(xxhash.xxh3_128_digest(raw[last:end]))
                    last = end
            two = np.frombuffer(b"".join(digests), "int64").reshape(-1, 2)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1])],
                ["row_id", "row_hash", "start", "end", "d0", "d1"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", row_hash(F.col(text)), text), run, f"row_id {kind}, row_hash long, start int, end int, d0 long, d1 long")


def repeated_chunks(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Repeated chunks: row_id, row_hash, start, end and whether the place is the first; null where the run is shorter than ``least`` bytes."""
    rows = docs.select("doc_id", text)
    chunks = chunk_rows(rows, text)
    # Two places differ in their hash; a row that stands several times has the same places each time.
    at = F.xxhash64("row_id", "row_hash", "start")
    counts = chunks.groupBy("d0", "d1").agg(F.min(at).alias("one"), F.max(at).alias("other"))
    shared = staged(counts.filter("one <> other").select("d0", "d1"), "shared-chunks", release=True)
    # Written as joined, so that Spark may split a digest with many places.
    places = staged(chunks.join(shared, ["d0", "d1"]), "repeated-chunks", release=True)
    discard(shared)
    along = W.partitionBy("row_id", "row_hash").orderBy("start")
    run = F.sum((F.coalesce(F.lag("end").over(along), F.lit(-1)) != F.col("start")).cast("int")).over(along)
    covered = F.sum(F.col("end") - F.col("start")).over(W.partitionBy("row_id", "row_hash", "run"))
    # A repeated row is one place, not two: its chunks are told apart from other texts' only.
    runs = staged(places.distinct().withColumn("run", run).withColumn("long", covered >= least).drop("run"), "chunk-runs", release=True)
    discard(places)
    place = F.struct("row_id", "row_hash", "start")
    long = runs.filter("long")
    first = long.groupBy("d0", "d1").agg(F.min(place).alias("first"))
    told = long.join(first, ["d0", "d1"]).select("row_id", "row_hash", "start", "end", place.eqNullSafe(F.col("first")).alias("is_first"))
    return told.unionByName(runs.filter("not long").select("row_id", "row_hash", "start", "end", F.lit(None).cast("boolean").alias("is_first")))


def deduplicate(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with kept (bytes), n_removed, n_spans, spans, n_shared (bytes in runs, of ``least`` bytes or more, of chunks that occur elsewhere too) and n_repeated (the same, without ``least``)."""
    added = ("kept", "n_removed", "n_spans", "spans", "n_shared", "n_repeated")
    size = F.col("end") - F.col("start")
    marks = repeated_chunks(docs, text, least).groupBy("row_id", "row_hash").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_first"), F.struct("start", "end")))).alias("spans"),
        F.coalesce(F.sum(F.when(F.col("is_first").isNotNull(), size)), F.lit(0)).alias("n_shared"), F.sum(size).alias("n_repeated"),
    )
    out = cut(with_spans(boxed(docs, text, *added), staged(marks, "chunk-marks", release=True)))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_shared", "n_repeated")}
    return out.withColumns(zero).select(*unboxed(docs.columns, text, *added), *added)


def op1(docs: DataFrame) -> DataFrame:
    """Bytes shared and removed, and the digest of what is kept, of each document."""
    out = deduplicate(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_shared", "n_repeated", "n_removed", "n_spans", "spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
