"""Removal of repeated 200-byte strings by suffix arrays that are built by induced sorting.

Any string of 200 bytes contains anchors: of its substrings of ``ANCHOR`` bytes, the one with the least hash (the leftmost of
equals). Neighbouring strings that share their anchor form a run. Equal strings have equal anchors, so only
runs whose anchor occurs twice can matter. Of these, runs whose bytes are equal as a whole are repeated in full, and the
other runs of an anchor are compared in shards: a shard's runs are laid one after another, its suffix array is
induced, and neighbours in it whose common prefix reaches 200 bytes start with the same string. An anchor with very many different
runs is not gathered into one shard; the strings of its runs are counted by a 128-bit hash instead.

Defined results: null and empty texts, and texts under 200 bytes, lose nothing. A repeated row is another document with the
same text, so all of it is repeated. Texts are used whole, whatever their length, and what is removed is judged on the input. Extra columns are kept, but one with
the name of one that is added is replaced. An empty table gives an empty table. Equal strings are all removed: none counts as the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, boxed, cut, discard, map_arrow, row_hash, staged, unboxed, with_spans

LENGTH = 200
ANCHOR = 100
#: Bytes of text that a worker hashes at once; longer texts are taken in overlapping parts.
PART = 1 << 20
#: Bytes of one shard, and different runs of one anchor up to which they may share a shard.
SHARD = 1 << 20
CROWD = 2000


def rolling_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from every place on, by joining hashes of powers of two."""
    h = (raw.astype("uint64") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    total, covered, size = None, 0, 1
    while True:
        if length & size:
            part = h[covered:]
            total = part if total is None else joined(total[: len(part)], part[: len(total)])
            covered += size
        if covered == length:
            return total[: len(raw) - length + 1]
        h = joined(h[:-size], h[size:])
        size *= 2


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b + np.uint64(0xD1B54A32D192ED03))) * np.uint64(0xFF51AFD7ED558CCD) + (a << np.uint64(31))
    return x ^ (x >> np.uint64(32))


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    low, size = h, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(h) - width + 1], low[width - size :])


def anchor_runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, first and last start of the runs of 200-byte strings of a text."""
    found = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), PART):
        part = np.frombuffer(raw, "uint8")[at : at + PART + LENGTH - 1]
        h = rolling_hashes(part, ANCHOR)
        low = sliding_minimum(h, LENGTH - ANCHOR + 1)
        # A new run begins where the anchor has left the string or a lesser one has come in.
        new = np.concatenate(([True], (h[: len(low) - 1] == low[:-1]) | (low[1:] < low[:-1])))
        first = np.flatnonzero(new)
        found.append((low[first].view("int64"), first + at, np.append(first[1:], len(low)) - 1 + at))
    if not found:
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64")
    return tuple(np.concatenate(x) for x in zip(*found))


def run_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each run: row_id, row_hash, anchor, digest, first, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, anchors, firsts, lasts, digests = [], [], [], [], []
            for i, raw in enumerate(as_bytes(batch.column(2))):
                if raw is None or len(raw) < LENGTH:
                    continue
                anchor, first, last = anchor_runs(raw)
                rows.append(np.full(len(first), i, "int32"))
                anchors.append(anchor)
                firsts.append(first)
                lasts.append(last)
                digests += [xxhash.xxh3_64_intdigest(raw[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())]
            if not rows:
                continue
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(anchors)), pa.array(np.array(digests, "uint64").view("int64")), pa.array(np.concatenate(firsts).astype("int32")), pa.array(np.concatenate(lasts).astype("int32"))],
                ["row_id", "row_hash", "anchor", "digest", "first", "last"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", row_hash(F.col(text)), text), run, f"row_id {kind}, row_hash long, anchor long, digest long, first int, last int")


# Induced sorting.


def induced(s: np.ndarray, lms: np.ndarray, is_s: np.ndarray, width: int) -> np.ndarray:
    """Suffix array induced from leftmost-smaller suffixes in the order given.

    ``s`` ends with a sentinel 0 that occurs nowhere else and belongs to ``lms``. Buckets are taken in the order of their
    symbol, and in whole waves: a bucket induces into itself until a wave brings no more, and then into the others.
    """
    n = len(s)
    size = np.bincount(s, minlength=width)
    end = np.cumsum(size)
    start = end - size
    symbols = np.flatnonzero(size).tolist()
    sa = np.full(n, -1, "int64")
    many = np.bincount(s[lms], minlength=width)

    def place(found: np.ndarray, at: np.ndarray, edge: np.ndarray, step: int) -> None:
        """Append suffixes to their buckets in the order given, from the front (1) or from the back (-1)."""
        order = np.argsort(at, kind="stable")
        ranked = at[order]
        fresh = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        times = np.diff(np.append(fresh, len(ranked)))
        within = np.arange(len(ranked)) - np.repeat(fresh, times)
        sa[edge[ranked] + within if step > 0 else edge[ranked] - 1 - within] = found[order]
        edge[ranked[fresh]] += step * times

    def sources(suffixes: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes one symbol longer that are of the wanted kind, and their symbols."""
        longer = suffixes[suffixes > 0] - 1
        longer = longer[is_s[longer] == small]
        return longer, s[longer]

    place(lms[::-1], s[lms[::-1]], end.copy(), -1)
    head = start.copy()
    for c in symbols:
        low = start[c]
        while low < head[c]:
            wave, at = sources(sa[low : head[c]], False)
            low = head[c]
            same = at == c
            if same.any():
                place(wave[same], at[same], head, 1)
        wave, at = sources(np.concatenate((sa[start[c] : head[c]], sa[end[c] - many[c] : end[c]])), False)
        other = at != c
        if other.any():
            place(wave[other], at[other], head, 1)
    tail = end.copy()
    for c in symbols[::-1]:
        high = end[c]
        while high > tail[c]:
            wave, at = sources(sa[tail[c] : high][::-1], True)
            high = tail[c]
            same = at == c
            if same.any():
                place(wave[same], at[same], tail, -1)
        wave, at = sources(np.concatenate((sa[start[c] : head[c]], sa[tail[c] : end[c]]))[::-1], True)
        other = at != c
        if other.any():
            place(wave[other], at[other], tail, -1)
    sa[0] = n - 1
    return sa


def kinds(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than their successor, and the leftmost ones of these."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    following = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)]
    is_s = np.append(s[following] < s[following + 1], True)
    return is_s, np.flatnonzero(is_s & np.concatenate(([False], ~is_s[:-1])))


def named(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings, in the order of the text, and how many differ."""
    size = np.diff(np.append(lms, len(s) - 1)) + 1
    at = np.searchsorted(lms, order)
    a, b = at[:-1], at[1:]
    equal = size[a] == size[b]
    live, d = np.flatnonzero(equal), 0
    while len(live):
        live = live[size[a[live]] > d]
        bad = s[lms[a[live]] + d] != s[lms[b[live]] + d]
        equal[live[bad]] = False
        live, d = live[~bad], d + 1
    rank = np.concatenate(([0], np.cumsum(~equal)))
    out = np.empty(len(lms), "int64")
    out[at] = rank
    return out, int(rank[-1]) + 1


def induced_singly(s: np.ndarray, lms: np.ndarray, is_s: np.ndarray, width: int) -> np.ndarray:
    """The same as ``induced``, suffix by suffix: for reduced strings, whose many symbols occur so rarely that waves would hold a suffix or two."""
    ends = np.cumsum(np.bincount(s, minlength=width))
    heads, tails = np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()
    symbol, small, sa, tail = s.tolist(), is_s.tolist(), [-1] * len(s), ends.tolist()
    for i in lms[::-1].tolist():
        at = tail[symbol[i]] = tail[symbol[i]] - 1
        sa[at] = i
    for k in range(len(sa)):
        i = sa[k] - 1
        if i >= 0 and not small[i]:
            c = symbol[i]
            sa[heads[c]] = i
            heads[c] += 1
    for k in range(len(sa) - 1, -1, -1):
        i = sa[k] - 1
        if i >= 0 and small[i]:
            at = tails[symbol[i]] = tails[symbol[i]] - 1
            sa[at] = i
    return np.array(sa)


#: Symbols up to which suffixes are induced in waves.
WAVES = 300


def suffix_array(s: np.ndarray, width: int) -> np.ndarray:
    """Suffix array of symbols below ``width``, of which the last one is 0 and no other."""
    if len(s) == 1:
        return np.zeros(1, "int64")
    is_s, lms = kinds(s)
    induce = induced if width <= WAVES else induced_singly
    sa = induce(s, lms, is_s, width)
    leftmost = np.zeros(len(s), bool)
    leftmost[lms] = True
    order = sa[leftmost[sa]]
    reduced, names = named(s, lms, order)
    if names < len(lms):
        order = lms[suffix_array(reduced, names)]
    return induce(s, order, is_s, width)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By position: the suffix before it in the array (-1: none), and the length of their common prefix.

    Only prefixes that cannot be extended to the left are compared; the others are one shorter than their left neighbour's.
    """
    n = len(s)
    before = np.empty(n, "int64")
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    extends = (before > 0) & (place > 0)
    extends[extends] = s[place[extends] - 1] == s[before[extends] - 1]
    compared = np.flatnonzero(~extends)
    length = np.zeros(n, "int64")
    live, d = compared[before[compared] >= 0], 0
    while len(live):
        live = live[np.maximum(live, before[live]) + d < n]
        live = live[s[live + d] == s[before[live] + d]]
        d += 1
        length[live] = d
    since = np.maximum.accumulate(np.where(extends, 0, place))
    return before, length[since] - (place - since)


def repeated_starts(parts: list[bytes], lasts: list[int]) -> list[np.ndarray]:
    """For each part of a shard: the starts (up to its last one) of 200-byte strings that start elsewhere in the shard too."""
    sizes = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"\x00".join(parts) + b"\x00\x00", "uint8").astype("uint16") + 2
    ends = np.cumsum(sizes)
    text[ends - 1] = 1
    text[-1] = 0
    before, length = permuted_prefixes(text, suffix_array(text, 258))
    long = np.flatnonzero(length >= LENGTH)
    mark = np.zeros(len(text), bool)
    mark[long] = True
    mark[before[long]] = True
    return [np.flatnonzero(mark[end - size : end - size + last + 1]) for end, size, last in zip(ends, sizes, lasts)]


# The search.


def joined_spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Bytes covered by strings that start at ``starts``, as spans of consecutive starts."""
    if not len(starts):
        return []
    split = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, split + 1)].tolist(), (starts[np.append(split, len(starts) - 1)] + LENGTH).tolist()))


def member_rows(docs: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """The bytes of the runs of ``members`` (row_id, row_hash, anchor, first, last, crowd, twin)."""
    lists = members.groupBy("row_id", "row_hash").agg(F.collect_list(F.struct("anchor", "first", "last", "crowd", "twin")).alias("runs"))
    same = docs["doc_id"].eqNullSafe(lists["row_id"]) & (row_hash(docs[text]) == lists["row_hash"])
    rows = docs.select("doc_id", text).join(lists, same).select("row_id", "row_hash", text, "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (raw, runs) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3).to_pylist())):
                for r in runs:
                    at.append(i)
                    out.append((r["anchor"], r["first"], r["last"], r["crowd"], r["twin"], raw[r["first"] : r["last"] + LENGTH]))
            at = pa.array(at, pa.int32())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
            more = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *more], ["row_id", "row_hash", "anchor", "first", "last", "crowd", "twin", "bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"row_id {kind}, row_hash long, anchor long, first int, last int, crowd boolean, twin boolean, bytes binary")


def sharded_spans(members: DataFrame) -> DataFrame:
    """Spans that the suffix arrays of shards find: whole anchors, as many as fill a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def found() -> pa.RecordBatch:
            starts = repeated_starts([r[5] for r in held], [r[3] - r[2] for r in held])
            rows = [(r[0], r[1], a + r[2], b + r[2]) for r, s in zip(held, starts) if not r[6] for a, b in joined_spans(s)]
            types = [batch_types[0], pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["row_id", "row_hash", "start", "end"])

        batch_types: list[pa.DataType] = []
        for batch in batches:
            batch_types = [c.type for c in batch.columns]
            for r in zip(*(batch.column(c).to_pylist() for c in ("row_id", "row_hash", "first", "last", "anchor", "bytes", "twin"))):
                if size >= SHARD and r[4] != held[-1][4]:
                    yield found()
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield found()

    kind = members.schema["row_id"].dataType.simpleString()
    # A shard may begin in one slice and end in another, so the rows come as they are sorted.
    dealt = members.filter("not crowd").drop("crowd").repartition("anchor").sortWithinPartitions("anchor")
    return map_arrow(dealt, run, f"row_id {kind}, row_hash long, start int, end int")


def crowded_spans(members: DataFrame) -> DataFrame:
    """Spans of the anchors with very many runs, from counts of the strings' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, digests = [], [], []
            for i, (raw, first) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("first").to_pylist())):
                for k in range(len(raw) - LENGTH + 1):
                    at.append(i)
                    starts.append(first + k)
                    digests.append(xxhash.xxh3_128_digest(raw[k : k + LENGTH]))
            two = np.frombuffer(b"".join(digests), "int64").reshape(-1, 2)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(at), batch.column("row_hash").take(at), batch.column("twin").take(at), pa.array(starts, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1])],
                ["row_id", "row_hash", "twin", "start", "d0", "d1"],
            )

    kind = members.schema["row_id"].dataType.simpleString()
    each = map_arrow(members.filter("crowd"), run, f"row_id {kind}, row_hash long, twin boolean, start int, d0 long, d1 long")
    twice = staged(each.groupBy("d0", "d1").agg(F.count("*").alias("times")).filter("times > 1").select("d0", "d1"), "crowded-strings")
    return each.filter("not twin").join(twice, ["d0", "d1"]).select("row_id", "row_hash", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Spans of every text that are covered by repeated 200-byte strings: row_id, row_hash, spans."""
    rows = docs.select("doc_id", text)
    runs = run_rows(rows, text)
    shared = staged(runs.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"), "shared-anchors", release=True)
    close = staged(runs.join(shared, "anchor"), "shared-runs", release=True)
    place = F.struct("row_id", "row_hash", "first", "last")
    kinds = staged(close.groupBy("anchor", "digest").agg(F.count("*").alias("times"), F.min(place).alias("place")), "alike-runs", release=True)
    kinds_of = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    alike = staged(kinds.join(kinds_of, "anchor").filter("times > 1 or kinds > 1").withColumn("crowd", F.col("kinds") > CROWD), "run-kinds")
    told = staged(close.join(alike.drop("place"), ["anchor", "digest"]), "told-runs", release=True)
    discard(shared, close, kinds)
    full = told.filter("times > 1").select("row_id", "row_hash", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))
    single = told.filter("times = 1").select("row_id", "row_hash", "anchor", "first", "last", "crowd", F.lit(False).alias("twin"))
    twins = alike.filter("times > 1 and kinds > 1").select("place.row_id", "place.row_hash", "anchor", "place.first", "place.last", "crowd", F.lit(True).alias("twin"))
    members = staged(member_rows(docs, single.unionByName(twins), text), "member-runs", release=True)
    each = full.unionByName(sharded_spans(members)).unionByName(crowded_spans(members))
    out = staged(each.groupBy("row_id", "row_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeated-spans", release=True)
    discard(alike, told, members)
    return out


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with kept (the bytes that stay), n_removed and n_spans, which replace columns of these names."""
    added = ("kept", "n_removed", "n_spans")
    return cut(with_spans(boxed(docs, text, *added), repeated_spans(docs, text))).select(*unboxed(docs.columns, text, *added), *added)


def op10(docs: DataFrame) -> DataFrame:
    """Removed bytes and digest of what is kept, of each document."""
    out = deduplicate(docs.select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
