"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of ten words (a shorter item is one window). A window and a document are compared as
sets of three-word shingles (of all its words, if the window has fewer). Since a window must be contained whole, a
prefix of one shingle is enough: shingles are ordered by how rare they are in the documents, and only the rarest of each
window is joined. A candidate must leave room for the window before and behind the shingle (positional and length
bounds) and is then verified word by word over a window of the item's size.

Documents reach that join only with runs of words long enough for the shortest window, all of whose shingles may be
benchmark shingles by a bitmap of fixed size; the bitmap has false positives and no false negatives, so it costs work and never rows.

Defined results: null and empty texts have no words and no hits; an item without words has no window; hits of an item
with a null id count, but the id isn't listed. Repeated rows get the same result each; rows that share an id and differ in text are
told apart by a digest of the text. Without documents or items there are no hits, and an empty table gives an empty table. Shingles that are equally rare are taken
in the order of their hashes. Texts are used whole, whatever their length. ``clean`` keeps extra columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, boxed, map_arrow, staged, text_key, unboxed, with_maybe

WINDOW = 10
SHINGLE = 3
#: Slots of the bitmap of benchmark shingles.
SLOTS = 1 << 22
#: What is no word byte becomes a blank, and A-Z becomes a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def folded_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text: runs of digits, letters a-z and non-ASCII characters."""
    return (raw or b"").translate(FOLD).split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hashes of the runs of ``width`` words, as signed integers."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, "int64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    return mixed(h, width)


def mixed(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    x = np.full(n, width, "uint64")
    for k in range(width):
        x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x.view("int64")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of ``items`` (item_id, text): item_id, words, n_words, and the hashes of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes = [], [], []
            for item, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = folded_words(raw)
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    part = words[at : at + window]
                    ids.append(item)
                    texts.append([w.decode() for w in part])
                    hashes.append(shingle_hashes(part, min(SHINGLE, len(part))).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "words", "shingles"])

    made = map_arrow(items.select(F.col("item_id").cast("string"), "text"), run, "item_id string, words array<string>, shingles array<long>")
    return made.distinct().withColumn("n_words", F.size("words"))


def long_runs(hits: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Starts and ends of the runs of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hits.view("int8"), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def document_runs(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each document with n_words and its runs of words whose shingles may all be benchmark shingles."""
    sizes = [r[0] for r in windows.groupBy("n_words").agg(F.lit(1)).select("n_words").collect()]
    slots: dict[int, np.ndarray] = {}
    least: dict[int, int] = {}
    for width in sorted({min(SHINGLE, n) for n in sizes}):
        least[width] = min(n for n in sizes if min(SHINGLE, n) == width) - width + 1
        of = windows.filter(F.least("n_words", F.lit(SHINGLE)) == width)
        taken = of.select(F.explode("shingles").alias("h")).select(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()
        slots[width] = np.zeros(SLOTS, bool)
        slots[width][taken["slot"].to_numpy()] = True
    shipped = docs.sparkSession.sparkContext.broadcast((slots, least))
    kind = pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, least = shipped.value
        for batch in batches:
            sizes, found = [], []
            for raw in as_bytes(batch.column(1)):
                words = folded_words(raw)
                sizes.append(len(words))
                mine = []
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
                for width, need in least.items():
                    if len(words) < width + need - 1:
                        continue
                    x = mixed(h, width)
                    hits = slots[width][x & (SLOTS - 1)]
                    if np.count_nonzero(hits) >= need:
                        for a, b in long_runs(hits, need):
                            mine.append({"start": a, "words": [w.decode() for w in words[a : b + width - 1]], "shingles": x[a:b].tolist()})
                found.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(kind))], ["doc_id", "text_key", "n_words", "runs"])

    kept = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(kept, run, f"doc_id {doc_type}, text_key string, n_words long, runs array<struct<start: int, words: array<string>, shingles: array<long>>>")


def occurrences(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Verified places of windows in documents: doc_id, text_key, start, n_words (of the window), item_id."""
    each = runs.select("doc_id", "text_key", F.explode("runs").alias("run")).select("doc_id", "text_key", "run.start", "run.words", F.posexplode("run.shingles").alias("i", "shingle"))
    rarity = each.groupBy("shingle").agg(F.count("*").alias("times"))
    rank = W.partitionBy("item_id", "words").orderBy("times", "shingle", "offset")
    prefix = (
        windows.select("item_id", "words", F.posexplode("shingles").alias("offset", "shingle"))
        .join(rarity, "shingle")
        .withColumn("rank", F.row_number().over(rank))
        .filter("rank = 1")
        .select("shingle", "item_id", F.col("words").alias("window"), "offset")
    )
    # What stands around a shingle is enough to verify any window that holds it.
    before = F.least("i", F.lit(WINDOW - 1))
    near = each.select(
        "doc_id", "text_key", "shingle", (F.col("start") + F.col("i") - before).alias("from"), before.alias("before"),
        F.slice("words", F.col("i") - before + 1, before + WINDOW + SHINGLE).alias("words"),
    )
    at = F.col("before") - F.col("offset")
    size = F.size("window")
    fits = (at >= 0) & (at + size <= F.size("words"))
    return (
        near.join(prefix, "shingle")
        .filter(fits)
        .filter(F.slice("words", F.greatest(at, F.lit(0)) + 1, size) == F.col("window"))
        .select("doc_id", "text_key", (F.col("from") + at).alias("start"), size.alias("n_words"), "item_id")
    )


def covered(spans: Column) -> Column:
    """How many positions the (start, n_words) spans of an array cover."""
    each = F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["n_words"] - 1))
    return F.size(F.array_distinct(F.flatten(each))).cast("long")


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, spans (array of start and n_words of the window), items (sorted ids)."""
    windows = staged(item_windows(items), "windows")
    runs = staged(document_runs(docs, windows), "runs")
    hits = (
        occurrences(runs, windows)
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "n_words"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "spans", "items")
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    return runs.select("doc_id", "text_key", "n_words").join(hits, same, "left").drop("hit_id", "hit_key")


def op5(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Hit words and items of each document."""
    found = find(docs.select("doc_id", "text"), items)
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; columns and repeated rows stay."""
    hit = find(docs.select("doc_id", "text"), items).filter("spans is not null")
    hit = staged(hit.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")), "contaminated")
    # Most rows have no hit; only those that may have one are shuffled to find out.
    told = with_maybe(boxed(docs, "text"), hit.select("hit_key"), text_key(F.col("text")), "maybe")
    same = F.col("box").getField("doc_id").eqNullSafe(F.col("hit_id")) & (text_key(F.col("text")) == F.col("hit_key"))
    columns = unboxed(docs.columns, "text")
    return told.filter(~F.col("maybe")).select(*columns).unionByName(told.filter("maybe").join(hit, same, "left_anti").select(*columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM bw),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
dw AS (SELECT doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') AS g FROM dp, sizes WHERE p + m - 1 <= len(w)),
hit AS (SELECT doc_id, p, dw.m AS m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
