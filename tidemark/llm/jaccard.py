"""N-gram Jaccard join by token-combination prefixes.

Documents become sets of hashed word shingles; equal sets are one node. Tokens are ordered by how many sets hold them, the rarest first, as
far as counts over all documents in hashed slots can tell. If a linked set may lack ``k`` tokens of a set, two linked sets have a token in
common within their first ``k + 1``: this is the prefix, and its rare tokens are indexed singly. Tokens of the frequent class are indexed as combinations
of two within one of ``c`` hashed groups, for which the prefix is extended to ``k + 1 + c`` tokens: ``c + 1`` common tokens stand in both, two of
them in one group. ``c`` grows with the size of the sets, by bands of sizes; a set is indexed for each band that a partner may be in.

A signature's nodes become candidates if their sizes and the places of the token in both prefixes allow enough overlap; only these two numbers and
an id travel. Bitmaps that never reject a true pair then thin the distinct candidates, and what is left is verified exactly: the closest candidate
of each node first, the closest between components next, and then every one between different components. A signature with more than
``group`` nodes gives chains of candidates at first. If its nodes are not all in one component after these, those outside its
largest component are compared with all of it, in blocks. So no link between components is lost, and pairs within a component are not all spelled out.

Defined results: null and empty texts have no shingles, n_shingles 0, and are linked with nothing; fewer words than
a shingle has make one shingle. Repeated rows are linked. A null doc_id never names a component unless it has no other. An empty table gives an empty
table. Texts are used whole; other columns are not looked at, whatever their names. Similarity is decided on 64-bit token hashes and 64-bit set digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, boxed, discard, map_arrow, row_hash, staged, unboxed, with_maybe


@dataclass(frozen=True)
class Join:
    """Sets of ``width``-word shingles are linked from ``percent`` per cent on.

    A token is frequent if its slot of the counts holds more than ``often`` times the mean and ``least_often`` more, and hot at ``hot`` times that; signatures of
    hot tokens are dealt to ``salts`` tasks. Signatures of up to ``group`` nodes are compared pair by pair, and blocks of larger ones hold so many. A bitmap has
    ``bits`` bits at least.
    """

    width: int = 3
    percent: int = 90
    slots: int = 1 << 21
    often: int = 8
    least_often: int = 64
    hot: int = 8
    salts: int = 16
    bits: int = 1024
    group: int = 200

    def lost(self, n: int) -> int:
        """Tokens of a set of ``n`` that a linked set may lack."""
        return n - -(-self.percent * n // 100)

    def combining(self, band: int) -> int:
        """Groups of frequent tokens for pairs whose smaller set has 2**band tokens or up to twice as many; 0 where a set has too few for combinations."""
        low = 1 << band
        groups = max(1, low // 16)
        return groups if low - self.lost(low) > groups else 0


def tokens(raw: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, "uint64")
    wide = min(width, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    n = len(h) - wide + 1
    x = np.full(n, wide, "uint64")
    for k in range(wide):
        x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return np.unique(x)


def digest(x: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63)


def parities(x: np.ndarray, join: Join) -> bytes:
    """A bitmap in which every token flips one bit: two sets differ in as many tokens as their bitmaps do in bits, or more.

    It has one to two bits a token, a power of two and ``join.bits`` at least, so it tells sets of any size apart; its halves laid over each other give
    the bitmap of half the size.
    """
    wide = max(join.bits, 1 << int(len(x) - 1).bit_length()) if len(x) else join.bits
    odd = np.bincount((x >> np.uint64(20)) & np.uint64(wide - 1), minlength=wide) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ, after the longer one is folded."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) < len(b) else (b, a)
        half = len(b) // 2
        b = (int.from_bytes(b[:half], "little") ^ int.from_bytes(b[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def narrowest(counts: np.ndarray) -> bytes:
    """The bytes of counts of one block, in the narrowest of three types."""
    top = counts.max()
    return counts.astype("uint8" if top < 1 << 8 else "uint32" if top < 1 << 32 else "int64").tobytes()


BLOCK = 1024


def set_rows(docs: DataFrame, join: Join, text: str) -> DataFrame:
    """Rows of documents (doc_id, row_hash, n, node, and bits, once a task for each set), and of the counts of their tokens (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, id_type = np.zeros(join.slots, "int64"), set(), None
        for batch in batches:
            id_type = batch.column(0).type
            sizes, nodes, bits, fresh = [], [], [], []
            for raw in as_bytes(batch.column(2)):
                x = tokens(raw, join.width)
                sizes.append(len(x))
                nodes.append(digest(x))
                bits.append(None if nodes[-1] in seen else parities(x, join))
                if nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    fresh.append((x & np.uint64(join.slots - 1)).astype("int64"))
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=join.slots)
            none = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), *none], names)
        if id_type is not None:
            parts = [narrowest(counts[i : i + BLOCK]) for i in range(0, join.slots, BLOCK)]
            k = len(parts)
            empty = pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names)

    names = ["doc_id", "row_hash", "n", "node", "bits", "block", "counts"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", row_hash(F.col(text)), text), run, f"doc_id {kind}, row_hash long, n long, node long, bits binary, block int, counts binary")


def token_classes(parts: DataFrame, join: Join) -> tuple[np.ndarray, float]:
    """The class of each slot of the counts (block, counts), twice the logarithm of its count, and the mean count. A byte a slot reaches the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(raw, {BLOCK: "uint8", 4 * BLOCK: "uint32"}.get(len(raw), "int64")).astype("int64")
                sums[block] = sums[block] + counts if block in sums else counts
        classes = [np.ceil(2 * np.log2(v + 1)).astype("uint8").tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary()), pa.array([int(v.sum()) for v in sums.values()], pa.int64())], ["block", "classes", "total"])

    out, whole = np.zeros(join.slots, "uint8"), 0
    for block, raw, total in parts.repartition("block").mapInArrow(run, "block int, classes binary, total long").collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, "uint8")
        whole += total
    return out, whole / join.slots


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def signatures(x: np.ndarray, classes: np.ndarray, frequent: int, hot: int, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set, the place in the prefix that each stands for (or an earlier one), and whether its tokens are hot.

    Tokens of class ``frequent`` and above are combined.
    """
    n, need = len(x), join.lost(len(x)) + 1
    its = classes[x & np.uint64(join.slots - 1)]
    order = np.lexsort((x, its))
    x, its = x[order], its[order]
    rare = int(np.searchsorted(its, frequent))
    single = min(rare, need)
    said, places, warm = [x[:single]], [np.arange(single)], [np.zeros(single, bool)]
    if rare < need:
        low = -(-join.percent * n // 100)
        for band in range(low.bit_length() - 1, n.bit_length()):
            groups = join.combining(band)
            if not groups:
                more = x[rare:need]
                said.append(mixed(more + np.uint64(band + 1)))
                places.append(np.arange(rare, need))
                warm.append(its[rare:need] >= hot)
                continue
            at = np.arange(rare, min(need + groups, n))
            of = (x[at] >> np.uint64(20)) % np.uint64(groups)
            for g in np.unique(of):
                mine = at[of == g]
                i, j = np.triu_indices(len(mine), 1)
                i, j = mine[i], mine[j]
                said.append(mixed(mixed(x[i] + np.uint64(band + 1)) ^ x[j]))
                places.append(np.maximum(i - groups, 0))
                warm.append(np.minimum(its[i], its[j]) >= hot)
    return np.concatenate(said), np.concatenate(places), np.concatenate(warm)


def signature_rows(docs: DataFrame, classes: np.ndarray, mean: float, join: Join, text: str) -> DataFrame:
    """One row for each signature of each set, once a task: signature, salt, node, size and place."""
    bound = join.often * mean + join.least_often
    frequent, hot = (int(np.ceil(2 * np.log2(b + 1))) for b in (bound, bound * join.hot))
    shipped = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for raw in as_bytes(batch.column(0)):
                x = tokens(raw, join.width)
                node = digest(x)
                if not len(x) or node in seen:
                    continue
                seen.add(node)
                said, places, warm = signatures(x, shipped.value, frequent, hot, join)
                said = said.view("int64")
                salt = np.where(warm, 1 + (mixed((said ^ node).view("uint64")) % np.uint64(join.salts)).astype("int64"), 0)
                out.append((said, salt, np.full(len(said), node, "int64"), np.full(len(said), len(x), "int32"), places))
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))], ["signature", "salt", "node", "size", "place"])

    return map_arrow(docs.select(text), run, "signature long, salt int, node long, size int, place int")


def candidates(rows: DataFrame, join: Join) -> DataFrame:
    """Pairs of nodes (a, b); of signatures with many nodes, which are only chained, also the members (a, and the signature as large).

    A task holds the rows of one signature up to ``join.group`` of them, and one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in ("int64", "int32", "int64", "int32", "int32")]
        chain: tuple[int, int, int] | None = None

        def settled(columns: list[np.ndarray], whole: bool) -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
            """What the signatures in ``columns`` give, and the rows of the last one, which wait if it is not ``whole`` and small."""
            nonlocal chain
            signature, salt, node, size, place = columns
            same = (signature[1:] == signature[:-1]) & (salt[1:] == salt[:-1])
            # Copies of a set from several tasks stand side by side.
            fresh = np.concatenate(([True], ~same | (node[1:] != node[:-1])))
            signature, salt, node, size, place = (c[fresh] for c in columns)
            same = (signature[1:] == signature[:-1]) & (salt[1:] == salt[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            times = np.diff(np.append(first, len(node)))
            many = (times > join.group) | (salt[first] > 0)
            goes_on = chain is not None and chain[:2] == (signature[0], salt[0])
            many[0] |= goes_on
            wait = len(node)
            if not whole and not many[-1]:
                wait, times, many, first = first[-1], times[:-1], many[:-1], first[:-1]
            rest = [c[wait:] for c in (signature, salt, node, size, place)]
            crowd = np.repeat(many, times)
            made = []
            # Pairs of small signatures: each row with those after it.
            after = np.where(crowd, 0, np.repeat(first + times, times) - np.arange(wait) - 1)
            i = np.repeat(np.arange(wait), after)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
            n, m = size[i].astype("int64"), size[j].astype("int64")
            most = np.minimum(n - place[i], m - place[j])
            fits = (100 * np.minimum(n, m) >= join.percent * np.maximum(n, m)) & (most * (100 + join.percent) >= join.percent * (n + m))
            i, j = i[fits], j[fits]
            # Chains of large ones.
            link = np.flatnonzero(crowd[:-1] & same[: max(0, wait - 1)])
            a, b = np.concatenate((node[i], node[link])), np.concatenate((node[j], node[link + 1]))
            if goes_on:
                a, b = np.append(a, chain[2]), np.append(b, node[0])
            differ = a != b
            a, b = a[differ], b[differ]
            made.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], names))
            member = np.flatnonzero(crowd)
            made.append(pa.RecordBatch.from_arrays([pa.array(node[member]), pa.nulls(len(member), pa.int64()), pa.array(signature[member])], names))
            chain = (signature[-1], salt[-1], node[-1]) if len(many) and many[-1] and wait == len(node) else None
            return made, rest

        for batch in batches:
            made, held = settled([np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)], False)
            yield from made
        if len(held[0]):
            yield from settled(held, True)[0]

    names = ["a", "b", "large"]
    # Within a signature the order is by hash, so that each signature chains its nodes in another order.
    dealt = rows.repartition("signature", "salt").sortWithinPartitions("signature", "salt", F.xxhash64("signature", "node"), "node")
    return map_arrow(dealt, run, "a long, b long, large long")


def thinned(pairs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """Those of ``pairs`` (a, b) that the bitmaps of ``nodes`` (node, n, bits) allow, and how far apart they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [apart(p, q) for p, q in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())]
            far = np.array(far, "int32")
            good = pa.array(far * (100 + join.percent) <= (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (100 - join.percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(far).filter(good)], ["a", "b", "apart"])

    of = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
    return map_arrow(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), run, "a long, b long, apart int")


def node_texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """One text for each node of ``wanted`` (node, rep). Texts are shorter than their packed tokens."""
    want = wanted.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.row_hash").alias("rep_hash"))
    near = with_maybe(docs.select("doc_id", text), want.select("rep_hash"), row_hash(F.col(text)), "maybe").filter("maybe")
    mine = near.select("doc_id", row_hash(F.col(text)).alias("row_hash"), F.col(text).cast("binary").alias("raw"))
    found = mine.join(want, mine["doc_id"].eqNullSafe(want["rep_id"]) & (mine["row_hash"] == want["rep_hash"]))
    return found.select("node", "raw").dropDuplicates(["node"])


def verified(edges: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """``edges`` (a, b) with whether the exact similarity reaches the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for p, q in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = tokens(p, join.width), tokens(q, join.width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                said.append(100 * both >= join.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(said, pa.bool_())], ["a", "b", "linked"])

    left = texts.select(F.col("node").alias("a"), F.col("raw").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("raw").alias("right"))
    return map_arrow(edges.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right"), run, "a long, b long, linked boolean")


def labelled(edges: DataFrame, found: DataFrame | None) -> DataFrame:
    """``edges`` between different components, with these as ca and cb."""
    if found is None:
        return edges.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    told = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    told = told.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    return told.filter("ca <> cb")


def closest_of_nodes(edges: DataFrame) -> DataFrame:
    """The closest edge of each node. What these link makes many of the others needless."""
    edge = F.struct("apart", "a", "b").alias("edge")
    ends = edges.select(F.col("a").alias("end"), edge).unionByName(edges.select(F.col("b").alias("end"), edge))
    return ends.groupBy("end").agg(F.min("edge").alias("edge")).select("edge.a", "edge.b").distinct()


def closest_of_components(edges: DataFrame, found: DataFrame | None) -> DataFrame:
    """The closest edge between each two components."""
    edge = F.struct("apart", "a", "b")
    return labelled(edges, found).groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(edge).alias("edge")).select("edge.a", "edge.b")


#: Parts into which the nodes of one component are dealt where labels are looked up.
PARTS = 32


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``links`` (a, b): node and component.

    Every round a node takes the least label among its neighbours' and then that label's own label, so paths shorten as they
    are followed; it ends when no label changes. A label of very many nodes is looked up in ``PARTS`` parts.
    """
    both = staged(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))), "links")
    labels = staged(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lower = staged(lower, "lower-labels")
        # Only nodes that are labels are looked up: those that have another node under them.
        named = lower.select("component").distinct()
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further")).join(named, "component", "left_semi")
        jump = jump.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        moved = lower.withColumn("part", part).join(jump, ["component", "part"], "left")
        later = staged(moved.select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        discard(labels, lower)
        labels = later
        if labels.filter("was <> component").isEmpty():
            discard(both)
            return labels.select("node", "component")


def merged(found: DataFrame | None, good: DataFrame) -> DataFrame | None:
    """Components after the links ``good`` (a, b): those of before, whose graph of components is much smaller than that of nodes."""
    if good.isEmpty():
        return found
    if found is None:
        return components(good)
    between = labelled(good, found).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    moved = components(between).select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = found.unionByName(moved.select(F.col("component").alias("node"), "component").join(found.select("node"), "node", "left_anti"))
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")
    moved = moved.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    told = known.withColumn("part", part).join(moved, ["component", "part"], "left")
    return staged(told.select("node", F.coalesce("to", "component").alias("component")), "merged")


def open_groups(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Groups to compare, of large signatures (node, large) whose nodes are in several components: node, component, group, main (the largest component), total and outside.

    Signatures with the same main component share most of their nodes as a rule. Where it is less work they are one group, in which each node stands once.
    """
    told = members.join(found, "node", "left") if found is not None else members.withColumn("component", F.lit(None).cast("long"))
    told = told.withColumn("component", F.coalesce("component", "node"))
    each = told.groupBy("large", "component").agg(F.count("*").alias("times"))
    whole = each.groupBy("large").agg(F.sum("times").alias("total"), F.max(F.struct("times", "component")).alias("top"))
    several = whole.filter("total > top.times").select("large", "total", (F.col("total") - F.col("top.times")).alias("outside"), F.col("top.component").alias("main"))
    several = staged(several, "open-signatures")
    rows = staged(told.join(several.select("large", "main"), "large"), "open-members")
    work = several.groupBy("main").agg(F.sum(F.col("total") * F.col("outside")).alias("work"))
    union = rows.select("main", "node", "component").distinct().groupBy("main").agg(F.count("*").alias("all_nodes"), F.count(F.when(F.col("component") != F.col("main"), 1)).alias("all_outside"))
    union = union.join(work, "main").filter(F.col("all_nodes") * F.col("all_outside") <= F.col("work")).select("main", "all_nodes", "all_outside")
    sized = several.join(union, "main", "left")
    joint = F.col("all_nodes").isNotNull()
    sized = sized.select(
        "large", F.when(joint, F.xxhash64("main", F.lit(1))).otherwise(F.xxhash64("large", F.lit(2))).alias("group"),
        F.coalesce("all_nodes", "total").alias("total"), F.coalesce("all_outside", "outside").alias("outside"),
    )
    return rows.join(sized, "large").drop("large").distinct()


def block_pairs(opened: DataFrame, nodes: DataFrame, join: Join, marked: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, apart, more) that the bitmaps allow, between each node outside the main component of a group, or each ``marked`` one (node), and those of other components.

    Unless nodes are marked, a block gives only the closest pair of a node and another component, and whether there are ``more`` of them. Both sides are dealt into blocks of about ``join.group`` nodes, and each block of the outsiders meets each of all nodes.
    """

    every = marked is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, theirs = None, [], []

        def out() -> pa.RecordBatch:
            found = set()
            for node, n, bits, component in mine:
                best: dict[int, tuple[int, int, bool]] = {}
                for other, m, their_bits, their_component in theirs:
                    if component != their_component and 100 * min(n, m) >= join.percent * max(n, m):
                        far = apart(bits, their_bits)
                        if far * (100 + join.percent) <= (n + m) * (100 - join.percent):
                            key = other if every else their_component
                            was = best.get(key)
                            best[key] = (far, other, False) if was is None else (*min(was[:2], (far, other)), not every)
                found |= {(min(node, other), max(node, other), far, more) for far, other, more in best.values()}
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["a", "b", "apart", "more"])

        for batch in batches:
            for *block, outsider, node, n, bits, component in zip(*(c.to_pylist() for c in batch.columns)):
                if block != key:
                    if mine and theirs:
                        yield out()
                    key, mine, theirs = block, [], []
                (mine if outsider else theirs).append((node, n, bits, component))
        if mine and theirs:
            yield out()

    if every:
        those = opened.join(marked, "node", "left_semi")
        opened = opened.drop("outside").join(those.groupBy("group").agg(F.count("*").alias("outside")), "group")
    rows = opened.withColumn("all_blocks", F.ceil(F.col("total") / join.group).cast("int")).withColumn("out_blocks", F.ceil(F.col("outside") / join.group).cast("int"))
    of = lambda count, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    everyone = rows.select("group", of("all_blocks", 1).alias("x"), each("out_blocks").alias("y"), F.lit(False).alias("outsider"), "node", "component")
    outside = (rows.join(marked, "node", "left_semi") if every else rows.filter("component <> main")).select("group", each("all_blocks").alias("x"), of("out_blocks", 2).alias("y"), F.lit(True).alias("outsider"), "node", "component")
    both = everyone.unionByName(outside).join(nodes.select("node", "n", "bits"), "node")
    dealt = both.select("group", "x", "y", "outsider", "node", "n", "bits", "component").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")
    return map_arrow(dealt, run, "a long, b long, apart int, more boolean").groupBy("a", "b").agg(F.min("apart").alias("apart"), F.max("more").alias("more"))


def link(docs: DataFrame, join: Join = Join(), text: str = "text") -> DataFrame:
    """One row per document: doc_id, row_hash, n_shingles, component_id and rep (the first doc_id and row_hash of the component)."""
    rows = docs.select("doc_id", text)
    made = staged(set_rows(rows, join, text), "sets")
    classes, mean = token_classes(made.filter("block is not null").select("block", "counts"), join)
    sized = made.filter("block is null").drop("block", "counts")
    row = F.struct("doc_id", "row_hash")
    nodes = sized.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"), F.min("doc_id").alias("least_id"), F.min(row).alias("rep"))
    nodes = staged(nodes, "nodes")
    sized = staged(sized.drop("bits"), "sizes")
    discard(made)
    maybe = staged(candidates(signature_rows(rows, classes, mean, join, text), join), "candidates", release=True)
    edges = staged(thinned(maybe.filter("b is not null").select("a", "b").distinct(), nodes, join), "edges")

    def texts_of(these: DataFrame) -> DataFrame:
        ends = these.select(F.col("a").alias("node")).union(these.select("b")).distinct()
        return staged(node_texts(rows, nodes.join(ends, "node"), text), "node-texts", release=True)

    found: DataFrame | None = None
    texts = texts_of(edges)
    # The closest edge of each node, then the closest between components, settle nearly everything; the third step tries all that are left.
    tried = None
    for step in ("nodes", "components", "rest"):
        left = edges if tried is None else edges.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pick = closest_of_nodes(left) if step == "nodes" else closest_of_components(left, found) if step == "components" else labelled(left, found).select("a", "b")
        told = staged(verified(pick, texts, join), "verified")
        found = merged(found, told.filter("linked").select("a", "b"))
        tried = told if tried is None else tried.unionByName(told)
    discard(texts)
    members = maybe.filter("large is not null").select(F.col("a").alias("node"), "large").distinct()
    # What is left of the large signatures: the closest pairs first, and then every other one of the nodes whose closest pair has failed.
    marked = None
    for every in (False, True):
        if not every:
            opened = staged(open_groups(members, found), "open-groups")
            if opened.isEmpty():
                break
        elif found is not None:
            # The groups stay what they were; only their nodes' components have grown.
            opened = opened.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        blocks = staged(block_pairs(opened, nodes, join, marked), "block-pairs")
        fresh = blocks.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        texts = texts_of(fresh)
        told = staged(verified(fresh, texts, join), "verified")
        found = merged(found, told.filter("linked").select("a", "b"))
        tried = tried.unionByName(told)
        # A closest pair that has failed, now or before, may have hidden others; one that is linked has brought them into one component.
        # Whichever pair it has hidden, one of its nodes is among these, wherever the components have grown since.
        hidden = blocks.filter("more").join(told.filter("linked"), ["a", "b"], "left_anti")
        if every or hidden.isEmpty():
            break
        marked = staged(hidden.select(F.col("a").alias("node")).union(hidden.select("b")).distinct(), "marked-nodes")
        discard(blocks, texts)
    discard(maybe, edges)
    named = nodes.select("node", "least_id", "rep", F.col("node").alias("component"))
    if found is not None:
        named = staged(nodes.select("node", "least_id", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named-nodes")
        of = named.groupBy("component").agg(F.min("least_id").alias("least_id"), F.min("rep").alias("rep")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        named = named.select("node", "component", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part")).join(of, ["component", "part"])
    named = staged(named.select("node", "least_id", "rep"), "components")
    discard(nodes)
    out = sized.join(named, "node", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id", "row_hash", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"), F.when(alone, row).otherwise(F.col("rep")).alias("rep")
    )


def first_of_each(docs: DataFrame, join: Join = Join(), text: str = "text") -> DataFrame:
    """``docs`` without the documents that are linked to one before them; rows of the same id and text are one document."""
    linked = link(docs, join, text)
    later = linked.filter(~F.struct("doc_id", "row_hash").eqNullSafe(F.col("rep"))).select(F.col("doc_id").alias("late_id"), "row_hash").distinct()
    later = staged(later, "later-rows")
    # Most rows are not late; only those that may be are shuffled to find out.
    told = with_maybe(boxed(docs, text), later.select("row_hash"), row_hash(F.col("text")), "maybe")
    ids = F.col("box").getField("doc_id")
    late = told.filter("maybe").withColumn("hash", row_hash(F.col("text"))).join(later, ids.eqNullSafe(F.col("late_id")) & (F.col("hash") == F.col("row_hash")), "left_anti")
    columns = unboxed(docs.columns, text)
    return told.filter(~F.col("maybe")).select(*columns).unionByName(late.select(*columns))


def op4(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """Set size and component of each document."""
    return link(docs.select("doc_id", "text"), join).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
linked AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) o
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)
), reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""
