"""Quality rules: word and line counts, and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Text that compresses too well is
repetitive, text that hardly compresses is noise; both limits depend on the length, since short inputs give the
compressor less to work with.

Defined results: null and empty texts have no words, ratio 1 and fail the base rules; texts are used whole, whatever their length; a ratio at
a limit is within it; repeated rows and extra columns are kept as they are, but a column with the name of one that is added is replaced; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, extended, map_arrow, with_columns

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio of plain to compressed size.

    ``whole`` and ``chunk`` hold (bytes from which the limits hold, least ratio, largest ratio); a chunk of ``chunk_bytes``
    is judged if it is whole or the text's only one, and ``bad_share`` of the chunks may lie outside their limits.
    """

    whole: tuple[tuple[int, float, float], ...] = ((0, 0.0, 8.0), (256, 1.05, 6.0), (1024, 1.25, 6.5), (4096, 1.5, 9.0), (32768, 1.6, 14.0))
    chunk: tuple[tuple[int, float, float], ...] = ((0, 0.0, 8.0), (256, 1.05, 6.0), (1024, 1.25, 8.0))
    chunk_bytes: int = 2048
    bad_share: float = 0.5
    level: int = 3


def limits(of: tuple[tuple[int, float, float], ...], n: int) -> tuple[float, float]:
    """Least and largest ratio for ``n`` bytes."""
    return max(row for row in of if row[0] <= n)[1:]


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that stand in the text twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "int64", n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dense = raw.translate(None, SPACE)
    points = int(np.count_nonzero((np.frombuffer(dense, "uint8") & 0xC0) != 0x80))
    return len(words), points, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def compression(raw: bytes, squeeze, bands: Bands) -> tuple[float, float, float, float, bool]:
    """Ratio of the whole text, least and largest ratio of its chunks, share of chunks outside, and whether all is in band."""
    if not raw:
        return 1.0, 1.0, 1.0, 0.0, True
    whole = len(raw) / len(squeeze(raw))
    step = bands.chunk_bytes
    chunks = [raw[i : i + step] for i in range(0, len(raw), step)]
    judged = [c for c in chunks if len(c) == step] or chunks
    ratios = [(len(c), len(c) / len(squeeze(c))) for c in judged] if len(chunks) > 1 else [(len(raw), whole)]
    outside = sum(not low <= r <= high for n, r in ratios for low, high in [limits(bands.chunk, n)]) / len(ratios)
    low, high = limits(bands.whole, len(raw))
    return whole, min(r for _, r in ratios), max(r for _, r in ratios), outside, low <= whole <= high and outside <= bands.bad_share


def measure(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """``docs`` with the base counts, the ratios and ``in_band``; one row per input row."""
    at = docs.columns.index(text)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "chunk_ratio_min", "chunk_ratio_max", "bad_chunk_share", "in_band"]
    kinds = [pa.int64()] * 5 + [pa.float64()] * 4 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            rows = [base_counts(raw or b"") + compression(raw or b"", squeeze, bands) for raw in as_bytes(batch.column(at))]
            yield with_columns(batch, {name: pa.array(values, kind) for name, values, kind in zip(names, zip(*rows), kinds)})

    ddl = ", ".join(f"{name} {kind}" for name, kind in zip(names, ["long"] * 5 + ["double"] * 4 + ["boolean"]))
    return map_arrow(docs, run, extended(docs.schema, ddl))


def op7(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Base counts and verdicts: one row per document."""
    out = measure(docs.select("doc_id", "text"), bands).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("in_band")).drop("in_band")
