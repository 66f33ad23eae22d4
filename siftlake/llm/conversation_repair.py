"""Conversation structure repair by lazy weighted determinisation.

The rows of a conversation are read as symbols: the initial of the role, and
what is wrong with the row.  Edits of a row (keep, rerole, delete) and inserted
rows are weighted arcs of an automaton whose states say what was last kept:
nothing, the system row, a user row, an assistant row.  The automaton is
determinised while it is used: the costs to go from its four states, less the
smallest of them, are one state of the deterministic automaton, and its
transition table is filled when a symbol is first met in a state.  A scan of
the table over the rows, last to first, sums the weights and gives the cost of
the conversation; the trace runs back against the scan, along arcs that are
tight (cost before = cost of the edit + cost after), and takes the edit with
the least letter of them.

On Spark: the rows' faults are columns; repeated rows are found by a window in
the partitioning by conversation; compact rows (no texts) stream in order
through the table, which gives an audit for each conversation; then audit and
texts stream together.  Sorts may spill, a text is never held longer than its
row, and of a conversation two bytes a row are kept, less than the audit and
the digest that stand in one row of the result need.  Audits of different
conversations are independent, so an executor that is lost costs its
partitions only.

Results for odd input: null roles and texts are one space; a role that does
not begin with s, u or a (an empty one too) fits nowhere and is reroled or
deleted; a null conv_id is a conversation of its own; rows are taken by turn,
null turns first, rows of one turn by role and by digest of the text; rows
repeated exactly are duplicates; other columns are not read; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import over_batches, ship

#: White space of the contract: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What was kept last: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a row with this initial leads to, by the state before: role initials are (s?(ua)+)?
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
#: The only state that a reroled or inserted row (user or assistant) can lead to, and the role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: Symbols: initials (with none of them last) kept whole or truncated, then a row that has to go.
GONE = 2 * (len(INITIALS) + 1)


def symbol(role: str, fault: int) -> int:
    if fault in (BLANK, DUPLICATE):
        return GONE
    at = INITIALS.find(role[:1]) if role else -1
    return (at if at >= 0 else len(INITIALS)) + (len(INITIALS) + 1) * (fault == TRUNCATED)


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Repairer:
    """The lazily determinised automaton.  Tables grow with the different cost vectors met, not with the rows."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        far = 4 * (costs.insert + 1)
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.last, self.base = self._number(self._closed([0 if q in FINAL else far for q in range(4)]))

    def _closed(self, v: list[int]) -> list[int]:
        """With rows inserted before: twice, as a row is followed by one of two states."""
        for _ in range(2):
            v = [min(v[q], self.costs.insert + v[NEXT[q]]) for q in range(4)]
        return v

    def _number(self, v: list[int]) -> tuple[int, int]:
        low = min(v)
        key = tuple(x - low for x in v)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
            self.table.append([None] * (GONE + 1))
        return self.numbers[key], low

    def _arcs(self, q: int, x: int):
        """(letter, cost, state after) of the edits of a row with symbol x in state q."""
        yield "D", self.costs.delete, q
        if x != GONE:
            bad = self.costs.truncated if x > len(INITIALS) else 0
            initial = (INITIALS + "?")[x % (len(INITIALS) + 1)]
            if (q, initial) in STEP:
                yield "K", self.costs.keep + bad, STEP[q, initial]
            yield "R", self.costs.rerole + bad, NEXT[q]

    def _before(self, state: int, x: int) -> tuple[int, int]:
        after = self.vectors[state]
        to = self._number(self._closed([min(c + after[r] for _, c, r in self._arcs(q, x)) for q in range(4)]))
        self.table[state][x] = to
        return to

    def _trace(self, state: int, x: int, q: int) -> tuple[str, int]:
        """Letters up to and with the edit of the row, and the state after; the vector after the row is ``state``."""
        before, w = self.table[state][x]
        v, after, letters = self.vectors[before], self.vectors[state], ""
        at = q
        while True:
            arcs = [(e, r) for e, c, r in self._arcs(at, x) if c + after[r] == v[at] + w]
            if self.costs.insert + v[NEXT[at]] == v[at]:
                arcs.append(("I", -1))
            e, r = min(arcs)
            letters += e
            if e != "I":
                self.traces[state, x, q] = letters, r
                return letters, r
            at = NEXT[at]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits; of several the least audit."""
        table, state, total = self.table, self.last, self.base
        path = array("H", [state])
        for x in reversed(symbols):
            to = table[state][x] or self._before(state, x)
            state = to[0]
            total += to[1]
            path.append(state)
        q, audit, traces = START, [], self.traces
        for k, x in enumerate(symbols):
            after = path[len(symbols) - 1 - k]
            letters, q2 = traces.get((after, x, q)) or self._trace(after, x, q)
            audit.append(letters)
            q = q2
        end = self.vectors[self.last]
        while end[q] > 0 or q not in FINAL:  # rows that are missing at the end
            audit.append("I")
            q = NEXT[q]
        return total + self.vectors[state][START], "".join(audit)


def damage(rows: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """conv_id, turn, role, text, copies of rows damaged by crc32(conv_id:turn) % 20.

    0 drops a row (copies 0), 1 empties its text, 2 removes its ends of
    sentences, 3 repeats it (copies 2), 4 makes its role user.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(some(conv_id), F.lit(":"), some(turn)).cast("binary")) % 20
    base = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"), lot.alias("lot"))
    return base.select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("lot") == 0, 0).when(F.col("lot") == 3, 2).otherwise(1).alias("copies"),
    )


def _prepared(rows: DataFrame) -> DataFrame:
    """With the digest of the text, which orders rows of one turn and role and stands for the text."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), copies.cast("int").alias("copies")).withColumn("digest", F.unhex(F.sha2("text", 256)))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audit_kernel(costs: Costs):
    def run(batches):
        repairer = Repairer(costs)
        out: list[tuple] = []
        nothing = object()
        own = nothing

        def close():
            gaps = high - low + 1 - distinct if distinct else 0
            cost, audit = repairer.repair(bytes(symbols))
            out.append((own, gaps, *counts[1:], illegal, cost, audit))

        def flush(kind):
            nonlocal out
            names = ["conv_id", *_COUNTS, "audit"]
            kinds = [kind, *[pa.int64()] * 6, pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
            out = []
            return batch

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for conv, turn, role, copies, fault, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own is nothing or conv != own:
                    if own is not nothing:
                        close()
                    own, symbols, counts, illegal = conv, bytearray(), [0, 0, 0, 0], 0
                    low = high = before = None
                    distinct = 0
                if copies and turn is not None and turn != high:
                    low = turn if low is None else low
                    high = turn
                    distinct += 1
                for k in range(copies):
                    f = fault if fault == BLANK or (first and k == 0) else DUPLICATE
                    counts[f] += 1
                    symbols.append(symbol(role, f))
                    if before is not None and before[:1] + role[:1] not in ("su", "ua", "au"):
                        illegal += 1
                    before = role
            if len(out) > 5000:
                yield flush(kind)
        if own is not nothing:
            close()
        if out:
            yield flush(kind)

    return run


def audits(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation.

    rows: conv_id, turn, role, text and, if rows are dropped or repeated,
    copies.  A conversation whose rows are all dropped has zeros and an empty audit.
    """
    ship(rows.sparkSession)
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    compact = _prepared(rows).select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault")).repartition("conv_id")
    # dropped rows are seen by no one, so they are counted apart
    seen = Window.partitionBy("conv_id", "role", "digest", F.col("copies") > 0).orderBy(F.asc_nulls_first("turn"))
    marked = compact.withColumn("first", F.row_number().over(seen) == 1).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    kind = dict(rows.dtypes)["conv_id"]
    return marked.select("conv_id", "turn", "role", "copies", "fault", "first").mapInArrow(
        over_batches(_audit_kernel(costs)), f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
    )


def _apply_kernel(batches):
    """Audits and rows in order: the rows that the audits leave, after a row of position 0 for every conversation."""
    names = ["conv_id", *_COUNTS, "audit", "position", "edit", "role", "text"]
    for b in batches:
        kinds = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        out: list[tuple] = []
        size = 0

        def flush():
            nonlocal out, size
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)  # noqa: B023
            out, size = [], 0
            return batch

        own = [b.column(k).to_pylist() for k in range(b.num_columns - 1)]
        for k in range(b.num_rows):
            conv, head, copies, role = own[0][k], own[1][k], own[2][k], own[3][k]
            if head:
                audit = own[-1][k]
                counts = tuple(c[k] for c in own[4:-1])
                at, position, q = 0, 0, START
                out.append((conv, *counts, audit, 0, None, None, None))
                left = len(audit) - audit.count("I")
                copies = 0

            def inserted():
                nonlocal at, q, position
                while at < len(audit) and audit[at] == "I":
                    q, at, position = NEXT[q], at + 1, position + 1
                    out.append((conv, *[None] * 7, position, "I", ROLE[q], ""))  # noqa: B023

            for _ in range(copies):
                inserted()
                edit, at, left = audit[at], at + 1, left - 1
                if edit == "D":
                    continue
                if edit == "R":
                    q = NEXT[q]
                    role = ROLE[q]
                else:
                    q = STEP[q, role[:1]]
                position += 1
                text = b.column(b.num_columns - 1)[k].as_py()
                out.append((conv, *[None] * 7, position, edit, role, text))
                size += len(text)
            if not left:
                inserted()
            if size > 4 << 20 or len(out) > 5000:
                yield flush()
        if out:
            yield flush()


def _applied(rows: DataFrame, costs: Costs) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    full = _prepared(rows).filter("copies > 0")
    found = audits(rows, costs)
    tail = [*_COUNTS, "audit"]
    heads = found.select("conv_id", F.lit(True).alias("head"), F.lit(0).alias("copies"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), *tail, none("string").alias("text"))
    own = full.select("conv_id", F.lit(False).alias("head"), "copies", "turn", "role", "digest", *[none("long").alias(c) for c in _COUNTS], none("string").alias("audit"), "text")
    both = heads.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), F.asc_nulls_first("turn"), "role", "digest")
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, position long, edit string, role string, text string"
    return both.select("conv_id", "head", "copies", "role", *tail, "text").mapInArrow(over_batches(_apply_kernel), schema)


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, position (from 1), edit (K, R or I), role and text of the repaired conversations."""
    return _applied(rows, costs).filter("position > 0").select("conv_id", "position", "edit", "role", "text")


def _digest_kernel(batches):
    own, sha = None, None
    for b in batches:
        out = []
        for k, position in enumerate(b.column(8).to_pylist()):
            if position == 0:
                if own is not None:
                    out.append((*own, sha.hexdigest()))
                own, sha = tuple(b.column(j)[k].as_py() for j in range(8)), hashlib.sha256()
                continue
            line = f"{b.column(9)[k].as_py()}:{b.column(10)[k].as_py()}"
            sha.update((("\n" if position > 1 else "") + line).encode())
        kind = b.schema.field(0).type
        yield _digests(out, kind)
    if own is not None:
        yield _digests([(*own, sha.hexdigest())], kind)


def _digests(out, kind):
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])


def repaired_digests(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The columns of ``audits`` with the digest of the repaired rows as lines role:text."""
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return _applied(rows, costs).select("conv_id", *_COUNTS, "audit", "position", "role", "text").mapInArrow(over_batches(_digest_kernel), schema)
