"""Clustering, conversation repair and sharding against plain Python."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bisector, repair, sharding

# Clustering.


def brute_clusters(rows, plan):
    """Lloyd's rounds over all distances, in Python's integers."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == plan.width and all(c is not None and np.isfinite(c) for c in x):
            kept.append((vec_id, x, [(p * plan.scale) // q for p, q in map(float.as_integer_ratio, x)]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{plan.salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, _, v in order[: plan.k]]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(plan.rounds):
        mine = defaultdict(list)
        for _, _, v in kept:
            mine[best(v)[1]].append(v)
        centroids = [[sum(c) // len(mine[j]) for c in zip(*mine[j])] if mine[j] else old for j, old in enumerate(centroids)]
    told = [(i, *reversed(best(v))) for i, _, v in kept]
    inertia = Counter()
    for _, j, d in told:
        inertia[j] += d
    least = lambda n: min(n, bisector.LARGEST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, least(d), least(inertia[j]), least(sum(inertia.values())), digest[j]) for i, j, d in told)


@pytest.mark.parametrize("large", [1.0, 1e5, 1e200])
def test_op11_equals_brute_force(spark, large):
    rng = random.Random(int(large))
    plan = bisector.Clustering(k=5, rounds=3, width=3)
    rows = [(rng.randint(0, 40), [rng.choice([-0.5, 0.25, rng.gauss(0, 1) * large]) for _ in range(3)]) for _ in range(120)]
    rows += rows[:30] * 3 + [(None, [0.1, 0.2, 0.3]), (7, None), (8, []), (9, [1.0, None, 2.0]), (9, [1.0, float("nan"), 2.0]), (10, [1.0, float("inf"), 2.0]), (11, [1.0, 2.0])]
    given = spark.createDataFrame([(i, x, "clash") for i, x in rows], "vec_id long, embedding array<double>, cluster string").repartition(5)
    assert Counter(map(tuple, bisector.op11(given, plan).collect())) == brute_clusters(rows, plan)
    assert bisector.op11(given.limit(0), plan).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and bisector.op11(given.limit(0), plan).isEmpty()


def test_op11_has_as_many_centroids_as_vectors(spark):
    given = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<float>")
    found = {r.vec_id: (r.cluster, r.distance) for r in bisector.op11(given, bisector.Clustering(k=40, width=2)).collect()}
    # Two equal centroids: the smaller number wins both, and nothing is lost.
    assert found[1] == found[2] and found[3][0] != found[1][0] and {d for _, d in found.values()} == {0}


# Conversation repair.


def cheapest_edits(kinds):
    """Dijkstra over (row, last symbol), the heap ordered by cost and then by edits."""
    heap, settled = [(0, "", 0, "")], set()
    while heap:
        cost, said, at, last = heapq.heappop(heap)
        if (at, last) in settled:
            continue
        settled.add((at, last))
        if at == len(kinds) and last in ("", "a"):
            return cost, said
        after = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, said + "I", at, after))
        if at < len(kinds):
            initial, must_go, cut = kinds[at]
            heapq.heappush(heap, (cost + 2, said + "D", at + 1, last))
            if not must_go:
                heapq.heappush(heap, (cost + 1 + 5 * cut, said + "R", at + 1, after))
                if initial == after or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + 5 * cut, said + "K", at + 1, initial))
    raise AssertionError


def brute_repair(rows):
    """The contract in plain Python."""
    conversations = defaultdict(list)
    text_of = lambda v: " " if v is None else str(v)
    for conv_id, turn, role, text in rows:
        fate = zlib.crc32(f"{text_of(conv_id)}:{text_of(turn)}".encode()) % 20
        role, text = "user" if fate == 4 else text_of(role), "" if fate == 1 else text_of(text)
        text = "".join(c for c in text if c not in ".!?") if fate == 2 else text
        conversations[conv_id] += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv_id, turns in conversations.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            kinds.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = cheapest_edits(kinds)
        lines, last, at = [], "", 0
        for edit in audit:
            after = "a" if last == "u" else "u"
            name = {"u": "user", "a": "assistant"}[after]
            if edit == "I":
                lines.append(f"{name}:")
                last = after
                continue
            if edit != "D":
                lines.append(f"{turns[at][1] if edit == 'K' else name}:{turns[at][2]}")
                last = kinds[at][0] if edit == "K" else after
            at += 1
        numbers = {t[0] for t in turns if t[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        out[conv_id] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_turns(seed, conv_ids, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "cut off", "  ", "", None, "\t\n", "Two lines.\nand more", "Hm. ", "Ünd so "]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ukulele", "sysop"]
    return [(rng.choice(conv_ids), rng.choice([*range(30), None]), rng.choice(roles[:3]) if rng.random() < 0.8 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.randint(0, 99)}.") for _ in range(n)]


@pytest.mark.parametrize("conv_ids,n", [([*range(60), None], 400), ([1], 150), ([1, None, 1, 1, 2, 3], 300)])
def test_op12_equals_brute_force(spark, conv_ids, n):
    """Many small conversations, and long ones that go through several tasks."""
    rows = some_turns(n, conv_ids, n)
    given = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, piece int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r[0]: tuple(r[1:]) for r in repair.op12(given).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = brute_repair(rows)
    assert found.keys() == wanted.keys() and {k: (found[k], v) for k, v in wanted.items() if found[k] != v} == {}


def test_op12_without_rows(spark):
    given = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.op12(given).isEmpty()
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = repair.op12(spark.createDataFrame([(dropped, 0, "user", "Hello.")], given.schema)).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_interval_parsing_equals_a_search_over_edits():
    rng = random.Random(5)
    for n in [*range(9)] * 12 + [40, 70]:
        kinds = [(rng.choice("suao"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        assert repair.cheapest(repair.parsed([repair.leaf(repair.kind_of(*k)) for k in kinds])) == cheapest_edits(kinds), kinds


# Sharding.


def test_jump_equals_the_published_loop_and_moves_only_into_new_shards():
    def loop(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * sharding.STEP + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    rng = random.Random(0)
    keys = [0, 1, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(400)]
    before = None
    for shards in (1, 2, 3, 8, 9, 100):
        now = sharding.jump(np.array(keys, "uint64"), shards)
        assert now.tolist() == [loop(k, shards) for k in keys]
        if before is not None and shards == before[0] + 1:
            assert all(a == b or b == before[0] for a, b in zip(before[1], now))
        before = (shards, now)


def test_op13(spark):
    texts = [None, "", "é", "a\u0000b", "plain"]
    rows = [(None, "x", 1)] * 30 + [(i % 37, texts[i % 5], 2) for i in range(200)] + [(5, "same", 3)] * 25
    given = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(4)
    found = sharding.op13(given).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = defaultdict(list)
    for r in found:
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        by[r.shard].append(r)
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in found}) == len({r.doc_id for r in found})
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in sorted(mine, key=lambda r: r.slot)]
        assert keys == sorted(keys)
    assert sharding.op13(given.limit(0)).isEmpty()
    clash = sharding.placed(given.withColumn("shard", F.lit("old")), 3)
    assert clash.columns == ["doc_id", "text", "slot", "shard"] and {r.shard for r in clash.collect()} <= {0, 1, 2}
    with pytest.raises(ValueError):
        sharding.placed(given, 0)
