"""Repair of conversations: weighted finite-state composition and its shortest path.

Three machines. The input acceptor is the conversation, a chain with one arc a row. The edit transducer reads a row and
writes a role (Keep, Rerole), reads it and writes nothing (Delete), or writes a role without reading (Insert). The role
grammar accepts an optional s and then pairs u a, or nothing. States of their composition are (row, inserts since the
last row, grammar state), made only when a path gets to them. Two inserts in a row are enough: a third leads back to the
grammar state of the first at a higher cost, so the composition is acyclic and (row, inserts) is a topological order.

Weights are pairs (cost, label string), compared by cost and then by string. The order of strings is kept when the same
label is put before both, but not when it is put behind (D < DI, DK > DIK), so distances are taken from the end to the
start. All arcs out of a state have different labels, so that the first label decides among equal costs and no string
is ever compared. A row's layer depends on its kind and on the differences of the four distances behind it only: layers
are made once and remembered, and a row costs one lookup and a reference.

Conversations are sorted by Spark and stream through the tasks row by row, at first without texts (a few bytes a row
are held), then with texts, which are only hashed. A conversation is one task's work, as its digest is one pass over
it; what is held of it is a few bytes a row.

Defined results. Nulls: in conv_id and turn a space in the hashed name, in role and text a space. A null conv_id is a
conversation of its own. Null turns come first; rows of one turn are ordered by role, then by the SHA-256 of the text.
A role's initial is its first character, and a role that is empty has none: it can't be kept. Repeated rows: later ones are duplicates.
Empty texts: blank. Texts of any length are read whole. No rows left: zeros, no edits. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import pick, stage

ROLES = {"u": "user", "a": "assistant"}
#: Grammar: state -> {initial: next state}. 0: nothing yet, 1: after s, 2: after u, 3: after a.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: What edits cost, what an undeleted truncated row costs besides, and inserts between two rows.
KEEP, REROLE, DELETE, INSERT, TRUNCATED, INSERTS = 0, 3, 4, 3, 3, 2
_FAR = 1 << 60
#: Characters that are white space here.
SPACE = " \t\n\x0b\f\r"


def arcs(kind: tuple[str, str], state: int, inserts: int):
    """Arcs of the composition out of (row, inserts, state): label, cost, whether the row is read, next grammar state.

    kind: the row's initial and fault. ("", "end") stands behind the last row.
    """
    initial, fault = kind
    if fault != "end":
        yield "D", DELETE, True, state
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED * (fault == "truncated")
            if initial in GRAMMAR[state]:
                yield "K", KEEP + more, True, GRAMMAR[state][initial]
            for role in ROLES:
                if role in GRAMMAR[state]:
                    yield "R", REROLE + more, True, GRAMMAR[state][role]
    if inserts < INSERTS:
        for role in ROLES:
            if role in GRAMMAR[state]:
                yield "I", INSERT, False, GRAMMAR[state][role]


@lru_cache(maxsize=1 << 16)
def layer(kind: tuple[str, str], behind: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """Distances before a row from those behind it, by grammar state: (distances less their least, the least, best (labels, next state))."""
    best: dict[tuple[int, int], tuple[int, str, int]] = {}
    for inserts in range(INSERTS, -1, -1):
        for state in range(len(GRAMMAR)):
            found = [(0, "", state)] if kind[1] == "end" and state in FINAL else []
            for label, cost, reads, to in arcs(kind, state, inserts):
                rest, labels, last = (behind[to], "", to) if reads else best[inserts + 1, to]
                found.append((min(_FAR, cost + rest), label + labels, last))
            best[inserts, state] = min(found, default=(_FAR, "", state), key=lambda w: (w[0], w[1][:1]))
    ways = [best[0, q] for q in range(len(GRAMMAR))]
    least = min(w[0] for w in ways)
    return tuple(_FAR if w[0] >= _FAR else w[0] - least for w in ways), least, tuple((w[1], w[2]) for w in ways)


def repair(kinds: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, edits' initials in order) of the least path; kinds: initial and fault of each row."""
    if not kinds:
        return 0, ""
    behind, cost, last = layer(("", "end"), ())
    layers = [last]
    for kind in reversed(kinds):
        behind, least, ways = layer(kind, behind)
        layers.append(ways)
        cost += least
    state, said = 0, []
    cost += behind[0]
    for ways in reversed(layers):
        labels, state = ways[state]
        said.append(labels)
    return cost, "".join(said)


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with known faults: conv_id, turn, role, text; a fault depends on conv_id and turn alone."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    at = pick(rows, "conv_id", "turn", "role", "text").withColumn("_f", F.crc32(named.cast("binary")) % 20)
    role = F.when(F.col("_f") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return at.filter("_f <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_t")).drop("_t")


def _fault(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    return F.when(last == "", "blank").when(~last.rlike("[.!?]"), "truncated").otherwise("")


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_FOUND = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
_ORDER = ("turn", "role", "digest")


def plan(rows: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost and audit of conversations with rows; rows: conv_id, turn, role, text without nulls in role and text."""
    light = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), _fault(F.col("text")).alias("fault"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    light = light.withColumn("fault", F.when((F.col("fault") != "blank") & seen, "duplicate").otherwise(F.col("fault")))
    streamed = light.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    schema = pa.schema([("conv_id", pa.int64()), *_FOUND])
    legal = {"su", "ua", "au"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, kinds, low, high, turns, before = [], (), [], None, None, 0, None
        known: dict[tuple[str, str], tuple[str, str]] = {}

        def done() -> tuple:
            cost, audit = repair(kinds)
            counts = [sum(k[1] == f for k in kinds) for f in ("blank", "duplicate", "truncated")]
            illegal = sum(x[0] + y[0] not in legal for x, y in zip(kinds, kinds[1:], strict=False))
            return (*current, high - low + 1 - turns if turns else 0, *counts, illegal, cost, audit)

        for batch in batches:
            for conv, turn, role, fault in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if current != (conv,):
                    if current:
                        out.append(done())
                    current, kinds, low, high, turns, before = (conv,), [], None, None, 0, None
                kind = role[:1], fault
                kinds.append(known.setdefault(kind, kind))
                if turn is not None and turn != before:  # turns ascend
                    low, high, turns, before = turn if low is None else low, turn, turns + 1, turn
            if out:
                yield _batches(out, schema)
                out = []
        if current:
            yield _batches([done()], schema)

    return streamed.select("conv_id", "turn", "role", "fault").mapInArrow(work, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema))


def edited(kept: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, from its rows in order. Where the roles are odd in number, s comes first."""
    lead, at = sum(c != "D" for c in audit) % 2, 0
    for label in audit:
        role, text = (None, "") if label == "I" else next(kept)
        if label != "D":
            yield role if label == "K" else ROLES["ua"[(at - lead) % 2]], text
            at += 1


def _edit(rows: DataFrame, plans: DataFrame, schema: str, each) -> DataFrame:
    """Rows of `each(conv_id, rows)` for every planned conversation: its plan comes first, then its rows in the same order, as a stream."""
    body = rows.select("conv_id", F.lit(1).alias("k"), "turn", "role", F.sha2("text", 256).alias("digest"), "text")
    head = plans.select("conv_id", F.lit(0).alias("k"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    streamed = head.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "k", *_ORDER).select("conv_id", "role", "text")
    fields = pa.schema([(n, pa.int64() if kind == "long" else pa.string()) for n, kind in map(str.split, schema.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
        out = []
        for conv, _, audit in rest:
            for row in each(conv, edited(((role, text) for _, role, text in rest), audit)):
                out.append(row)
                if len(out) == 1024:
                    yield _batches(out, fields)
                    out = []
        if out:
            yield _batches(out, fields)

    return streamed.mapInArrow(work, schema)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the repaired conversations as rows."""
    return _edit(rows, plans, "conv_id long, position long, role string, text string", lambda conv, found: ((conv, k, *row) for k, row in enumerate(found)))


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired role:text lines, which are hashed as they pass."""

    def each(conv, found):
        digest = hashlib.sha256()
        for k, (role, text) in enumerate(found):
            digest.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
        return [(conv, digest.hexdigest())]

    return _edit(rows, plans, "conv_id long, repaired_sha256 string", each)


def report(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table after damage and repair: counts, cost, audit and digest."""
    rows = stage(damaged(conversations), "damaged")
    plans = stage(plan(rows), "plans")
    all_ids = pick(conversations, "conv_id").distinct()
    names = [n for n, _ in _FOUND]
    found = all_ids.join(plans.withColumnRenamed("conv_id", "_c"), F.expr("conv_id <=> _c"), "left").drop("_c")
    found = found.join(digests(rows, plans).withColumnRenamed("conv_id", "_c"), F.expr("conv_id <=> _c"), "left").drop("_c")
    nothing = hashlib.sha256().hexdigest()
    filled = [F.coalesce(n, F.lit("" if n == "audit" else 0)).alias(n) for n in names]
    return found.select("conv_id", *filled, F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
