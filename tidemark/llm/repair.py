"""Repair of conversation structure by weighted interval parsing.

A repaired conversation's role initials match ``(s?(ua)+)?``. The grammar is in Chomsky normal form over constituents that are known by their ends: ``E`` (nothing left), ``S`` (the system's turn
alone), ``xy`` (turns that alternate from x to y) and ``sy`` (the same from u on, behind the system's turn). Every rule joins two neighbours; a row gives the leaves (kept, given another role,
deleted), and the insertion closure of a cell joins inserted turns to either side of it until nothing gets cheaper. A cell holds for each constituent the least (cost, audit), and cells are combined bottom-up by
the length of their spans. Two audits of one span and cost never begin each other, so the least of a span is made of least ones.

Since constituents are known by their ends, any boundary between rows may split a span. A long conversation is therefore parsed in blocks, whose cells are the leaves of the next level.

Rows are dealt by ranges of conversation and turn. Conversations that lie within one task are repaired there, as their rows stream by. The first and last of each task may go on in others, so these, two for each task
at most, give their rows on: their pieces are parsed side by side, the pieces' cells are joined, and the edits go back to the rows. So even a conversation with a third of all rows is parsed by many tasks; what one task then holds of it are
its audits, and its repaired texts only stream through the digest, which can't be split.

Defined results: a null role or text, and a null in the key of the damage, counts as one space. Rows without a conv_id are one conversation. Rows of one turn stand by role, the first 64 characters of the text and its hash; equal rows are told apart by where they were read. The
initial of an empty role is empty. An empty table gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, crc32_sql, discard, map_arrow, staged

Cell = dict[str, tuple[int, str]]
#: Costs of the edits, by their initials; a row that is kept or gets another role costs ``TRUNCATED`` more if its end is missing.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
BLANKS = b" \t\n\x0b\x0c\r"
#: Leaves of one interval table.
BLOCK = 16


def grammar() -> dict[str, list[tuple[str, str]]]:
    """For each left constituent the right ones that it may stand before, with what they are together."""
    turns = [x + y for x in "ua" for y in "ua"]
    ends = [*turns, "su", "sa"]
    out = {p: [(q, p[0] + q[1]) for q in turns if p[1] != q[0]] for p in ends}
    out["S"] = [("u" + y, "s" + y) for y in "ua"]
    out["E"] = [(q, q) for q in [*ends, "S", "E"]]
    for p in [*ends, "S"]:
        out[p] = [*out[p], ("E", p)]
    return out


GRAMMAR = grammar()
GOALS = ("E", "ua", "sa")


def joined(left: Cell, right: Cell, into: Cell) -> Cell:
    """``into`` with what two neighbours make."""
    for p, (cost, audit) in left.items():
        for q, made in GRAMMAR[p]:
            if q in right:
                more, rest = right[q]
                was = into.get(made)
                if was is None or cost + more <= was[0]:
                    new = (cost + more, audit + rest)
                    if was is None or new < was:
                        into[made] = new
    return into


def closed(cell: Cell) -> Cell:
    """A cell with inserted turns on either side, until nothing gets cheaper."""
    inserted: Cell = {"uu": (COST["I"], "I"), "aa": (COST["I"], "I")}
    while True:
        more = joined(inserted, cell, joined(cell, inserted, dict(cell)))
        if more == cell:
            return cell
        cell = more


def leaf(kind: str) -> Cell:
    """What one row may become. ``kind`` is x where it must go, else its initial (o for others), in capitals if it is truncated."""
    cell: Cell = {"E": (COST["D"], "D")}
    if kind != "x":
        extra = TRUNCATED if kind.isupper() else 0
        for form in ("uu", "aa"):
            cell[form] = (COST["R"] + extra, "R")
        if own := {"s": "S", "u": "uu", "a": "aa"}.get(kind.lower()):
            cell[own] = (COST["K"] + extra, "K")
    return closed(cell)


def parsed(leaves: Sequence[Cell]) -> Cell:
    """The cell of a whole sequence: interval tables of ``BLOCK`` leaves, whose own cells are the leaves of the next level."""
    leaves = list(leaves)
    while len(leaves) > 1:
        leaves = [interval(leaves[at : at + BLOCK]) for at in range(0, len(leaves), BLOCK)]
    return leaves[0] if leaves else {"E": (0, "")}


def interval(leaves: Sequence[Cell]) -> Cell:
    """Bottom-up by the length of spans, over every split of each."""
    n = len(leaves)
    cells = {(i, i + 1): cell for i, cell in enumerate(leaves)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for middle in range(i + 1, i + length):
                joined(cells[i, middle], cells[middle, i + length], cell)
            cells[i, i + length] = closed(cell)
    return cells[0, n]


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[g] for g in GOALS if g in cell)


def kind_of(initial: str, must_go: bool, truncated: bool) -> str:
    """The class of a row by which it is parsed."""
    if must_go:
        return "x"
    kind = initial if initial in ("s", "u", "a") else "o"
    return kind.upper() if truncated else kind


def faults(raw: bytes) -> tuple[bool, bool]:
    """Whether a text is blank, and whether its last character that isn't blank ends no sentence."""
    body = raw.strip(BLANKS)
    return not body, bool(body) and body[-1] not in b".!?"


def initial_of(role: bytes) -> str:
    return role.decode("utf-8", "replace")[:1]


def illegal_pairs(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def follower(last: str) -> str:
    """The initial that must come after ``last``, the one before."""
    return "a" if last == "u" else "u"


NAMES = {"u": b"user", "a": b"assistant"}


def lines(audit: str, initials: Sequence[str], roles: Sequence[bytes], texts: Sequence[bytes]) -> list[bytes]:
    """The repaired turns that the edits give, as ``role:text``."""
    out, last, at = [], "", 0
    for edit in audit:
        if edit == "I":
            last = follower(last)
            out.append(NAMES[last] + b":")
            continue
        if edit == "K":
            last = initials[at]
            out.append(roles[at] + b":" + texts[at])
        elif edit == "R":
            last = follower(last)
            out.append(NAMES[last] + b":" + texts[at])
        at += 1
    return out


def sliced(audit: str, sizes: Sequence[int], initials: Sequence[str]) -> list[tuple[str, str]]:
    """The edits of each of several pieces of a conversation, and the initial that stands before each; turns inserted between two pieces go with the later one."""
    out, at, last, row = [], 0, "", 0
    for k, size in enumerate(sizes):
        begin, before, left = at, last, size
        while at < len(audit) and (left or k == len(sizes) - 1):
            edit = audit[at]
            if edit == "K":
                last = initials[row]
            elif edit in "RI":
                last = follower(last)
            if edit != "I":
                row, left = row + 1, left - 1
            at += 1
        out.append((audit[begin:at], before))
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) as the contract damages them; one that is dropped stays as a mark without role and text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).cast("int")
    held = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate"))
    none = F.lit(None).cast("string")
    role = F.when(F.col("fate") == 0, none).when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("fate") == 0, none).when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


#: What a task gives: results of whole conversations, and rows of those that may go on (``piece`` is set; ``role`` is null for a mark of a dropped row).
GIVEN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = "piece long, seq long, turn long, role binary, text binary, mark binary, is_blank boolean, is_truncated boolean"


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text; a null role marks a conversation that may have no row): its faults, cost, edits and digest."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {GIVEN}, {OPEN}"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        memo: dict[str, tuple[int, str]] = {}
        types: list[pa.DataType] = []
        held: list[tuple] = []
        key, first = None, True
        made: list[tuple] = []

        def result(conv_id: object, turns: list[tuple]) -> tuple:
            turns = [t for t in turns if t[1] is not None]
            seen: set[bytes] = set()
            kinds, counts, initials = [], [0, 0, 0], []
            for _, role, raw, mark, blank, truncated in turns:
                repeated = not blank and mark in seen
                seen.add(mark)
                truncated = truncated and not repeated
                counts = [a + b for a, b in zip(counts, (blank, repeated, truncated))]
                initials.append(initial_of(role))
                kinds.append(kind_of(initials[-1], blank or repeated, truncated))
            said = "".join(kinds)
            if said not in memo:
                if len(memo) >= 1 << 14:
                    memo.clear()
                memo[said] = cheapest(parsed([leaf(k) for k in said]))
            cost, audit = memo[said]
            at = {t[0] for t in turns if t[0] is not None}
            gaps = max(at) - min(at) + 1 - len(at) if at else 0
            digest = hashlib.sha256(b"\n".join(lines(audit, initials, [t[1] for t in turns], [t[2] for t in turns]))).hexdigest()
            return (conv_id, gaps, *counts, illegal_pairs(initials), cost, audit, digest, *[None] * 8)

        def opened(conv_id: object, turns: list[tuple], piece: int, begin: int) -> Iterator[tuple]:
            seq = begin
            for turn, role, raw, mark, blank, truncated in turns:
                yield (conv_id, *[None] * 8, piece, None if role is None else seq, turn, role, raw, mark, blank, truncated)
                seq += role is not None

        def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t) for k, t in enumerate(types)], names)

        count = 0
        for batch in batches:
            if not types:
                long, text, raw, flag = pa.int64(), pa.string(), pa.binary(), pa.bool_()
                types = [batch.schema.field("conv_id").type, *[long] * 6, text, text, long, long, long, raw, raw, raw, flag, flag]
            # The order came from Spark; a null conv_id is a conversation of its own.
            for conv_id, turn, role, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if key is None or key[0] != conv_id:
                    if key is not None and not first:
                        made.append(result(key[0], held))
                    if key is not None:
                        first = False
                    key, held, count = (conv_id,), [], 0
                blank, truncated = faults(raw) if role is not None else (False, False)
                mark = hashlib.md5(len(role).to_bytes(4, "big") + role + raw).digest() if role is not None else None
                row = (turn, role, raw, mark, blank, truncated)
                if first:
                    # It may have begun in the task before: its rows go on at once.
                    made.extend(opened(conv_id, [row], 2 * task, count))
                    count += role is not None
                else:
                    held.append(row)
            if made:
                yield batch_of(made)
                made = []
        if held:
            yield batch_of(list(opened(key[0], held, 2 * task + 1, 0)))

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.xxhash64("text"), "tie"]
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    told = staged(map_arrow(dealt, run, schema), "conversations", release=True)
    out = told.filter("piece is null").select("conv_id", *(part.split()[0] for part in GIVEN.split(", ")))
    return out.unionByName(over_pieces(told.filter("piece is not null").select("conv_id", *(part.split()[0] for part in OPEN.split(", ")))))


def over_pieces(rows: DataFrame) -> DataFrame:
    """The same for conversations whose rows stand in several tasks: ``rows`` has conv_id, piece (ascending along a conversation), seq in the piece, and what is known of each row."""
    slim = rows.filter("role is not null").select("conv_id", "piece", "seq", "turn", "mark", "is_blank", "is_truncated", F.substring(F.col("role").cast("string"), 1, 1).alias("initial"))
    place = F.struct("piece", "seq")
    # Places are unique, so that a text repeated in a third of the rows is no hot key of the join.
    firsts = slim.groupBy("conv_id", "mark").agg(F.min(place).alias("at")).select("at.piece", "at.seq", F.lit(True).alias("is_first"))
    slim = slim.join(firsts, ["piece", "seq"], "left").withColumn("repeated", ~F.col("is_blank") & F.col("is_first").isNull())
    slim = staged(slim.withColumn("truncated", F.col("is_truncated") & ~F.col("repeated")).drop("mark", "is_first"), "open-turns")
    facts = slim.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *(F.sum(F.col(c).cast("long")).alias(name) for c, name in (("is_blank", "blank"), ("repeated", "duplicate"), ("truncated", "truncated"))),
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, leaves, initials, rows_ = None, [], [], []
        shape = ["piece", "size", "initials", "forms", "costs", "audits"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]

        def done() -> None:
            cell = parsed(leaves)
            rows_.append((piece, len(leaves), initials, list(cell), [c for c, _ in cell.values()], [a for _, a in cell.values()]))

        kinds: dict[str, Cell] = {}
        for batch in batches:
            for its, initial, blank, repeated, truncated in zip(*(batch.column(c).to_pylist() for c in ("piece", "initial", "is_blank", "repeated", "truncated"))):
                if its != piece:
                    if piece is not None:
                        done()
                    piece, leaves, initials = its, [], []
                kind = kind_of(initial, blank or repeated, truncated)
                if kind not in kinds:
                    kinds[kind] = leaf(kind)
                leaves.append(kinds[kind])
                initials.append(initial)
        if piece is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t) for k, t in enumerate(types)], shape)

    dealt = slim.select("piece", "seq", "initial", "is_blank", "repeated", "truncated").repartition("piece").sortWithinPartitions("piece", "seq")
    cells = map_arrow(dealt, parse, "piece long, size long, initials array<string>, forms array<string>, costs array<long>, audits array<string>")
    of = slim.select("conv_id", "piece").distinct()
    cells = staged(cells.join(of, "piece"), "piece-cells")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch.column(1).to_pylist():
                cell = parsed([dict(zip(p["forms"], zip(p["costs"], p["audits"]))) for p in pieces])
                cost, audit = cheapest(cell)
                initials = [i for p in pieces for i in p["initials"]]
                parts = sliced(audit, [p["size"] for p in pieces], initials)
                out.append((illegal_pairs(initials), cost, audit, [{"piece": p["piece"], "edits": e, "before": b} for p, (e, b) in zip(pieces, parts)]))
            slices = pa.list_(pa.struct([("piece", pa.int64()), ("edits", pa.string()), ("before", pa.string())]))
            arrays = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), slices))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["conv_id", "illegal", "cost", "audit", "slices"])

    # One row for each piece: as many as the conversation has tasks.
    kind = rows.schema["conv_id"].dataType.simpleString()
    whole = cells.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "size", "initials", "forms", "costs", "audits"))).alias("pieces"))
    edits = staged(map_arrow(whole, join, f"conv_id {kind}, illegal long, cost long, audit string, slices array<struct<piece:long,edits:string,before:string>>"), "edits")

    def per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, said, last, initials in zip(*(batch.column(k).to_pylist() for k in range(4))):
                seqs, ahead, roles, keep, seq, waiting = [], [], [], [], 0, b""
                for edit in said:
                    if edit == "I":
                        last = follower(last)
                        waiting += NAMES[last] + b":\n"
                        continue
                    last = initials[seq] if edit == "K" else follower(last) if edit == "R" else last
                    seqs.append(seq)
                    ahead.append(waiting)
                    roles.append(NAMES[last] if edit == "R" else None)
                    keep.append(edit != "D")
                    seq, waiting = seq + 1, b""
                if waiting:
                    seqs.append(seq)
                    ahead.append(waiting)
                    roles.append(None)
                    keep.append(False)
                arrays = [pa.array([piece] * len(seqs), pa.int64()), pa.array(seqs, pa.int64()), pa.array(ahead, pa.binary()), pa.array(roles, pa.binary()), pa.array(keep, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["piece", "seq", "ahead", "new_role", "keep"])

    slices = edits.select(F.explode("slices").alias("s")).select("s.piece", "s.edits", "s.before").join(cells.select("piece", "initials"), "piece").select("piece", "edits", "before", "initials")
    changes = map_arrow(slices, per_row, "piece long, seq long, ahead binary, new_role binary, keep boolean").join(of, "piece")
    texts = rows.filter("role is not null").select("piece", "seq", "role", "text")
    both = changes.join(texts, ["piece", "seq"], "left")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, wrote, out = None, None, False, []
        for batch in batches:
            for conv_id, ahead, new_role, keep, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ahead", "new_role", "keep", "role", "text"))):
                if key is None or key[0] != conv_id:
                    if key is not None:
                        out.append((key[0], running.hexdigest()))
                    key, running, wrote = (conv_id,), hashlib.sha256(), False
                turns = [t for t in ahead.split(b"\n") if t]
                if keep:
                    turns.append((new_role if new_role is not None else role) + b":" + text)
                for turn in turns:
                    running.update((b"\n" if wrote else b"") + turn)
                    wrote = True
        if key is not None:
            out.append((key[0], running.hexdigest()))
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field("conv_id").type), pa.array([o[1] for o in out], pa.string())], ["conv_id", "repaired_sha256"])

    stream = both.select("conv_id", "piece", "seq", "ahead", "new_role", "keep", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "piece", "seq")
    hashes = map_arrow(stream, digest, f"conv_id {kind}, repaired_sha256 string")
    out = rows.select("conv_id").distinct()
    for k, found in enumerate((facts, edits.drop("slices"), hashes)):
        key = f"_key{k}"
        out = out.join(found.withColumnRenamed("conv_id", key), F.col("conv_id").eqNullSafe(F.col(key)), "left").drop(key)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired digest of each damaged conversation."""
    return repaired(damaged(conversations.select("conv_id", "turn", "role", "text")))


def oracle() -> str:
    """DuckDB SQL for ``op12``: the cheapest edits from left to right over what may stand last (nothing, s, u or a)."""
    least = lambda *options: "list_min([{}])".format(", ".join(options))
    plus = lambda state, cost, edit: f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}'}} END"
    inserted = "{{'n': z.n, 's': z.s, 'u': {}, 'a': {}}}".format(least("z.u", plus("z.n", 5, "I"), plus("z.s", 5, "I"), plus("z.a", 5, "I")), least("z.a", plus("z.u", 5, "I")))
    own = lambda letter: f"(5 * (k BETWEEN 'A' AND 'Z')::INT + (lower(k) <> '{letter}')::INT)"
    edit = lambda letter: f"CASE WHEN lower(k) = '{letter}' THEN 'K' ELSE 'R' END"
    step = lambda state, letter: f"CASE WHEN {state} IS NOT NULL AND k <> 'x' THEN {{'c': {state}.c + {own(letter)}, 'e': {state}.e || {edit(letter)}}} END"
    kept_s = "CASE WHEN z.n IS NOT NULL AND lower(k) = 's' THEN {'c': z.n.c + 5 * (k = 'S')::INT, 'e': z.n.e || 'K'} END"
    row = "{{'n': {}, 's': {}, 'u': {}, 'a': {}}}".format(
        plus("z.n", 2, "D"), least(plus("z.s", 2, "D"), kept_s), least(plus("z.u", 2, "D"), step("z.n", "u"), step("z.s", "u"), step("z.a", "u")), least(plus("z.a", 2, "D"), step("z.u", "a"))
    )
    # Twice an insertion before each row and at the end: nothing cheaper inserts more in one place.
    begin = "{'n': {'c': 0::BIGINT, 'e': ''}, 's': CAST(NULL AS STRUCT(c BIGINT, e VARCHAR)), 'u': CAST(NULL AS STRUCT(c BIGINT, e VARCHAR)), 'a': CAST(NULL AS STRUCT(c BIGINT, e VARCHAR))}"
    return rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), f AS (SELECT *, {crc32_sql("key")} % 20 AS fate FROM d),
g AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT * FROM f WHERE fate <> 0 UNION ALL SELECT * FROM f WHERE fate = 3)
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS x FROM g),
b AS (SELECT *, trim(text, E' \t\n\x0B\x0C\r') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lead(x) OVER (PARTITION BY conv_id ORDER BY i) AS y FROM o),
k AS (
  SELECT *, body = '' AS is_blank, body <> '' AND again AS is_again, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS is_cut,
    CASE WHEN body = '' OR again THEN 'x' WHEN right(body, 1) IN ('.', '!', '?') THEN CASE WHEN x IN ('s', 'u', 'a') THEN x ELSE 'o' END ELSE CASE WHEN x IN ('s', 'u', 'a') THEN upper(x) ELSE 'O' END END AS kind FROM b
), c AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, CAST(count_if(is_blank) AS BIGINT) AS blank, CAST(count_if(is_again) AS BIGINT) AS duplicate, CAST(count_if(is_cut) AS BIGINT) AS truncated,
    CAST(count_if(y IS NOT NULL AND x || y NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal, count(*) AS n, list(kind ORDER BY i) AS kinds, list(x ORDER BY i) AS initials, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts
  FROM k GROUP BY conv_id
), walk(conv_id, pt, z) AS (
  SELECT conv_id, 0::BIGINT, {begin} FROM c
  UNION ALL
  SELECT conv_id, pt, {row} FROM (SELECT conv_id, pt + 1 AS pt, kinds[pt + 1] AS k, {inserted} AS z FROM (SELECT w.conv_id, w.pt, c.kinds, {inserted} AS z FROM walk w JOIN c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pt < c.n))
), ended AS (
  SELECT conv_id, list_min([z.n, z.a]) AS best FROM (SELECT conv_id, {inserted} AS z FROM (SELECT w.conv_id, {inserted} AS z FROM walk w JOIN c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pt = c.n))
), spelled(conv_id, p, pt, prev, said) AS (
  SELECT conv_id, 0, 0, '', CAST([] AS VARCHAR[]) FROM ended
  UNION ALL
  SELECT conv_id, p + 1, pt + (e <> 'I')::INT, CASE e WHEN 'D' THEN prev WHEN 'K' THEN initials[pt + 1] ELSE nxt END,
    CASE e WHEN 'D' THEN said WHEN 'I' THEN list_append(said, name || ':') WHEN 'K' THEN list_append(said, roles[pt + 1] || ':' || texts[pt + 1]) ELSE list_append(said, name || ':' || texts[pt + 1]) END
  FROM (SELECT s.*, best.e[p + 1] AS e, initials, roles, texts, CASE WHEN prev = 'u' THEN 'a' ELSE 'u' END AS nxt, CASE WHEN prev = 'u' THEN 'assistant' ELSE 'user' END AS name
    FROM spelled s JOIN ended e ON s.conv_id IS NOT DISTINCT FROM e.conv_id JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id WHERE s.p < length(best.e))
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(array_to_string(said, E'\n'), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON i.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN spelled s ON i.conv_id IS NOT DISTINCT FROM s.conv_id AND s.p = length(best.e)
"""
