"""Helpers that the operators share: table access, staging in the shared folder, Arrow mapping."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Target size of one Arrow slice handled at once inside a Python worker.
SLICE_BYTES = 2 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session without one gets a fresh folder of its own; a cluster must name one that it shares."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    import tempfile

    made = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def staged(df: DataFrame, what: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors.

    ``discard`` deletes the files when nothing reads them any more; others stay until the cluster clears its checkpoint folder. After a large shuffle ``release``
    lets Spark's cleaner delete the shuffle's files, which it does when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*done: DataFrame) -> None:
    """Delete the files of ``staged`` frames that nothing reads any more; other frames are passed over."""
    for df in done:
        if path := getattr(df, "staged_path", None):
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over slices of at most about ``SLICE_BYTES`` of data each, so that memory stays bounded."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            step = max(1, n * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, n, step):
                yield batch.slice(at, step)

    conf = df.sparkSession.conf
    # Rows of an Arrow batch, unless the session asks for another number: ten thousand texts at once take more memory than they are worth.
    if conf.get(BATCH_ROWS) == "10000":
        conf.set(BATCH_ROWS, "2000")
    return df.mapInArrow(lambda batches: fn(sliced(batches)), schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Values of a string or binary Arrow column as bytes."""
    return column.cast(pa.binary()).to_pylist()


def text_key(text: Column) -> Column:
    """128-bit digest of a text (null counts as empty), which tells apart rows that share an id."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with further columns, which are given as DDL and take the place of columns of the same name."""
    more = StructType.fromDDL(ddl).fields
    return StructType([*(f for f in schema.fields if f.name.lower() not in {m.name.lower() for m in more}), *more])


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with further columns, in place of those of the same name (as ``extended`` has them)."""
    taken = {name.lower() for name in columns}
    kept = [k for k, name in enumerate(batch.schema.names) if name.lower() not in taken]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns.values()], [*(batch.schema.names[k] for k in kept), *columns])


def boxed(docs: DataFrame, text: str, *replaced: str) -> DataFrame:
    """``docs`` as two columns: ``box``, a struct of all others but those to be ``replaced``, and ``text``. So no name of a caller's can clash with one used on the way."""
    gone = {text.lower(), *(r.lower() for r in replaced)}
    others = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in gone]
    return docs.select(F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("box"), docs[f"`{text}`"].alias("text"))


def unboxed(columns: list[str], text: str, *replaced: str) -> list[Column]:
    """The columns of a frame that ``boxed`` made of one with ``columns``, in their order and without those ``replaced``."""
    gone = {r.lower() for r in replaced}
    return [F.col("text").alias(c) if c.lower() == text.lower() else F.col("box").getField(c).alias(c) for c in columns if c.lower() not in gone]


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def summed_blocks(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of vectors of ``width`` int64 that arrive as (block int, counts binary), a block of 1024 at a time.

    Every task sums what it reads, so that no block is gathered; only the sums reach the driver, and ``width`` bounds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(raw, "int64")
                sums[block] = sums[block] + counts if block in sums else counts
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    total = np.zeros(width, "int64")
    for block, raw in parts.repartition("block").mapInArrow(run, "block int, counts binary").collect():
        total[block * 1024 : block * 1024 + 1024] += np.frombuffer(raw, "int64")
    return total


def cut(docs: DataFrame, text: str = "text", spans: str = "spans", kept: str = "kept", removed: str = "n_removed", runs: str = "n_spans") -> DataFrame:
    """``docs`` with the UTF-8 bytes of ``text`` outside ``spans`` (array of start and end in bytes, null: none), the bytes removed and their runs."""
    at_text, at_spans = docs.columns.index(text), docs.columns.index(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, gone, times = [], [], []
            for raw, found in zip(as_bytes(batch.column(at_text)), batch.column(at_spans).to_pylist()):
                raw, parts, end, n, k = raw or b"", [], 0, 0, 0
                for a, b in sorted((s["start"], s["end"]) for s in found or []):
                    if a > end or not k:
                        parts.append(raw[end:a])
                        k += 1
                        n += b - a
                        end = b
                    elif b > end:
                        n += b - end
                        end = b
                parts.append(raw[end:])
                out.append(b"".join(parts))
                gone.append(n)
                times.append(k)
            yield with_columns(batch, {kept: pa.array(out, pa.binary()), removed: pa.array(gone, pa.int64()), runs: pa.array(times, pa.int64())})

    return map_arrow(docs, run, extended(docs.schema, f"`{kept}` binary, `{removed}` long, `{runs}` long"))


def with_spans(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``boxed`` documents with the columns of ``marks`` (row_id, row_hash and others); rows that share id and text share their marks."""
    same = docs["box"].getField("doc_id").eqNullSafe(marks["row_id"]) & (row_hash(docs["text"]) == marks["row_hash"])
    return docs.join(marks, same, "left").drop("row_id", "row_hash")


def row_hash(text: Column) -> Column:
    """64-bit hash that tells apart texts under one doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Slots of the bitmap that tells which rows may be wanted: 4 MB at most, whatever the corpus.
SLOTS = 1 << 25


def with_maybe(docs: DataFrame, wanted: DataFrame, key: Column, maybe: str) -> DataFrame:
    """``docs`` with a boolean: false where no row of ``wanted`` (one column) has the ``key``. So only few rows have to be shuffled for an exact join.

    The keys are marked in a bitmap, which is broadcast; of a crowded one everything is true.
    """
    slot = lambda h: F.pmod(F.xxhash64(h), F.lit(SLOTS)) + 1
    marks = wanted.select(slot(F.col(wanted.columns[0])).alias("slot"))
    marks = staged(marks.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits")), "marks")
    place = F.bitmap_bit_position(slot(key))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1, F.lit(False))
    found = docs.withColumn("_at", F.bitmap_bucket_number(slot(key))).join(F.broadcast(marks), F.col("_at") == F.col("_bucket"), "left")
    return found.withColumn(maybe, bit).drop("_at", "_bucket", "_bits")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of the UTF-8 bytes of a text expression: the lookup table is linear, so that the entries of its eight powers of two are enough."""
    entries = []
    for k in range(8):
        c = 1 << k
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        entries.append(c)
    looked_up = "0"
    for k, entry in enumerate(entries):
        looked_up = f"xor({looked_up}, ((xor(c, b) >> {k}) & 1) * {entry})"
    listed = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({listed}, lambda c, b: xor(c >> 8, {looked_up}), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
