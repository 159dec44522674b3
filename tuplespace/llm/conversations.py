"""Repair of conversation structure: least-cost edits by rank-convergence parallel Viterbi.

The rows of a conversation, by turn, are edited until their roles read
``(s?(ua)+)?`` (an optional system row, then user and assistant in turn). A row is
kept (0), gets the other legal role (1) or is deleted (2; blank rows and repeats of an
earlier role and text must be), an empty user or assistant row can be inserted anywhere
(5), and a truncated row that stays costs 5 more. The states of the grammar are: start, after the system
row, after a user, after an assistant.

* Rows get a global rank (range partitions, no window over a conversation), and
  ``chunk`` consecutive ranks are a chunk, whatever conversation they belong to: one
  that holds a third of all rows is many chunks.
* Each chunk computes the costs to go backwards. Where a conversation goes on in the
  next chunk, it starts from a speculative vector, that of a conversation's end.
* Fix-up passes: a segment whose successor's vector differs from the one it started
  from by more than a constant runs again, until the old and new vectors differ by a
  constant only; then the rest of it holds as it is. Passes go on until no segment has
  to run, at most one for each chunk of the longest stretch that doesn't converge.
  Rows that must be deleted shift all costs alike; segments of such rows alone are passed over.
* The stitched costs, less their minimum, stand on each row. One walk over the sorted
  rows takes at each step the least letter among the cheapest edits and digests the
  repaired text, which passes by as a stream: a SHA-256 can't be split, so a
  conversation is walked by one task, in bounded memory but for its audit.

Cases: a null role or text counts as one space, a null conv_id is a conversation, null
turns come first. Rows of one turn are ordered by role, then by a hash of the text; equal rows are adjacent. A role
that starts with none of s, u, a can't be kept. Texts are compared by 64-bit hash.
Further columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuplespace.llm.common import WHITE_SPACE, small_batches
from tuplespace.operators.ranks import distributed_rank
from tuplespace.session import cut_lineage, drop_table

CHUNK = 8_192
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
# Row codes: role initial 0 to 2 (s, u, a) or 3 (another), 4 more if truncated, 8 if it must be deleted.
NEXT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
OTHER = (USER, USER, ASSISTANT, USER)  # the state after an inserted or re-roled row
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}  # types of a conversation id
ROLES = {USER: "user", ASSISTANT: "assistant"}


def _pack(costs) -> int:
    least = min(costs)
    return sum((c - least) << (8 * k) for k, c in enumerate(costs))


def unpack(packed: int) -> list[int]:
    return [(packed >> (8 * k)) & 255 for k in range(4)]


def with_inserts(costs: list[int]) -> list[int]:
    """Costs to go if rows may be inserted first; two inserts reach every state that any number does."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[OTHER[s]]) for s, c in enumerate(costs)]
    return costs


END = _pack(with_inserts([0, 99, 99, 0]))
_STEPS: dict[tuple[int, int], int] = {}


def choices(code: int, state: int, after: list[int]):
    """(letter, cost, next state) of the edits of one row in a state."""
    yield "D", DELETE, state
    if code < 8:
        stays = TRUNCATED if code & 4 else 0
        kept = NEXT[state][code & 3]
        if kept is not None:
            yield "K", KEEP + stays, kept
        yield "R", REROLE + stays, OTHER[state]


def step_back(after: int, code: int) -> int:
    """Costs to go before a row from those after it, both without their constant."""
    if code >= 8:
        return after
    known = _STEPS.get((after, code))
    if known is None:
        costs = unpack(after)
        own = [min(c + costs[t] for _, c, t in choices(code, s, costs)) for s in range(4)]
        known = _STEPS[after, code] = _pack(with_inserts(own))
    return known


# Damage of the contract -----------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, and how many times the row then stands there."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                       F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


# Stitched costs -------------------------------------------------------------------

def _row_code(role: Column, last: Column) -> Column:
    initial = F.substring(role, 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return code + F.when((last != "") & ~last.isin(".", "!", "?"), 4).otherwise(0)


def coded_rows(rows: DataFrame, chunk: int) -> DataFrame:
    """Written: every row's rank, chunk, code and fault (1 blank, 2 duplicate, 3 truncated), without its text."""
    last = F.right(F.rtrim(F.col("text"), F.lit(WHITE_SPACE)), F.lit(1))
    slim = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "conv_id", "turn", "role", F.xxhash64("text").alias("h"), _row_code(F.col("role"), last).alias("code"), (last == "").alias("blank"))
    ranked = distributed_rank(slim, ["conv_id", "turn", "role", "h"], "rank")
    first = ranked.where("NOT blank").groupBy("conv_id", "role", "h").agg(F.min("rank").alias("rank"))
    marked = ranked.join(first.select("rank", F.lit(True).alias("new")), "rank", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("new").isNull(), 2).when(F.col("code") >= 4, 3).otherwise(0)
    return cut_lineage(marked.select(
        "conv_id", "turn", "role", "h", "rank", F.floor(F.col("rank") / chunk).cast("long").alias("chunk"), fault.alias("fault"),
        (F.col("code") + F.when(fault.isin(1, 2), 8).otherwise(0)).cast("int").alias("code")), "conversation-rows")


def _columns(table: pa.Table, *names):
    order = np.argsort(np.asarray(table.column("rank").combine_chunks()), kind="stable")
    table = table.take(pa.array(order))
    return [table.column(c).to_pylist() for c in names]


def _typed(function):
    function.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return function


def _borders(conv: list) -> tuple[int, int]:
    """End of the first conversation's rows and begin of the last one's."""
    a, b = 1, len(conv) - 1
    while a < len(conv) and conv[a] == conv[0]:
        a += 1
    while b and conv[b - 1] == conv[-1]:
        b -= 1
    return a, b


def _run_back(codes: list[int], after: int) -> int:
    for code in reversed(codes):
        after = step_back(after, code)
    return after


def _speculate(kind):
    def run(table: pa.Table) -> pa.Table:
        """The chunk's first and last segments: the vector they started from and the one they reach."""
        conv, codes, chunk = _columns(table, "conv_id", "code", "chunk")
        a, b = _borders(conv)
        parts = [(0, len(conv))] if b < a else [(0, a), (b, len(conv))]
        return pa.table({
            "conv_id": pa.array([conv[x] for x, _ in parts], kind), "chunk": pa.array([chunk[0]] * len(parts), pa.int64()),
            "closes": [y == len(conv) for _, y in parts], "free": [any(c < 8 for c in codes[x:y]) for x, y in parts],
            "used": pa.array([END] * len(parts), pa.int64()), "reached": pa.array([_run_back(codes[x:y], END) for x, y in parts], pa.int64())})

    return _typed(run)


def _fix_up(table: pa.Table) -> pa.Table:
    """One segment from its successor's vector, until it differs from the former one by a constant only."""
    codes, former, now, reached = _columns(table, "code", "used", "want", "reached")
    old, new, last = former[0], now[0], reached[0]
    for code in reversed(codes):
        if old == new:
            break
        old, new = step_back(old, code), step_back(new, code)
    else:
        last = new
    one = table.slice(0, 1)
    return pa.table({"conv_id": one.column("conv_id"), "chunk": one.column("chunk"), "closes": one.column("closes"), "free": [True],
                     "used": one.column("want"), "reached": pa.array([last], pa.int64())})


def segments(coded: DataFrame) -> DataFrame:
    """Written: the first and last segment of every chunk, each started from its successor's final vector."""
    kind = coded.schema["conv_id"].dataType.simpleString()
    arrow = ARROW[kind]
    layout = f"conv_id {kind}, chunk long, closes boolean, free boolean, used long, reached long"
    rows = coded.select("conv_id", "rank", "chunk", "code")
    segs = cut_lineage(rows.groupBy("chunk").applyInArrow(_speculate(arrow), layout), "segments")
    later = Window.partitionBy("conv_id").orderBy("chunk")  # one row a chunk
    while True:
        want = F.coalesce(F.lead("reached").over(later), F.lit(END).cast("long"))
        stale = segs.where("free").withColumn("want", want).where("want != used")
        stale = cut_lineage(stale, "stale-segments")
        if stale.isEmpty():
            return segs
        own = stale.withColumnsRenamed({"conv_id": "_c", "chunk": "_k"})
        again = rows.join(own, (rows["chunk"] == own["_k"]) & rows["conv_id"].eqNullSafe(own["_c"])).select(
            "conv_id", "chunk", "rank", "code", "closes", "used", "want", "reached")
        done = again.groupBy("chunk", "conv_id").applyInArrow(_typed(_fix_up), layout)
        left = segs.join(own.select("_c", "_k"), (segs["chunk"] == own["_k"]) & segs["conv_id"].eqNullSafe(own["_c"]), "left_anti")
        newer = cut_lineage(left.unionByName(done), "segments")
        drop_table(segs)
        drop_table(stale)
        segs = newer


def _annotate(table: pa.Table) -> pa.Table:
    conv, codes, used = _columns(table, "conv_id", "code", "used")
    after, vectors = used[0], []
    for k in range(len(codes) - 1, -1, -1):
        if k + 1 < len(codes) and conv[k] != conv[k + 1]:
            after = END
        vectors.append(after)
        after = step_back(after, codes[k])
    rank = np.sort(np.asarray(table.column("rank").combine_chunks()))
    return pa.table({"rank": rank, "after": pa.array(vectors[::-1], pa.int64())})


def stitched(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Coded rows with the costs to go after each, less their minimum (``after``, a byte a state)."""
    coded = coded_rows(rows, chunk)
    # A segment of forced rows alone hands on what the next free one reached: its own vector isn't read by the walk.
    closing = segments(coded).where("closes").select("chunk", "used")
    costs = coded.select("conv_id", "rank", "chunk", "code").join(closing, "chunk").groupBy("chunk").applyInArrow(
        _typed(_annotate), "rank long, after long")
    return coded.join(costs, "rank")


# The walk -------------------------------------------------------------------------

def edits(code: int, state: int, after: list[int]):
    """Least cheapest edits of one row from ``state``: (letters, cost, roles inserted, state after)."""
    letters, cost, inserted = "", 0, []
    own = with_inserts([min(c + after[t] for _, c, t in choices(code, s, after)) for s in range(4)])
    while True:
        options = {letter: (c, t) for letter, c, t in choices(code, state, after) if c + after[t] == own[state]}
        if "D" in options or INSERT + own[OTHER[state]] != own[state]:
            letter = min(options)
            return letters + letter, cost + options[letter][0], inserted, options[letter][1]
        state = OTHER[state]
        inserted.append(ROLES[state])
        letters, cost = letters + "I", cost + INSERT


class Walk:
    """One conversation's state: counts, audit, digest of the repaired rows."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit = conv, START, 0, bytearray()
        self.digest, self.lines = hashlib.sha256(), 0
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = self.turn = None
        self.turns = 0
        self.out: list[tuple[str, str, str]] = []
        self.pending: tuple[str, str] | None = None

    def line(self, edit: str, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        self.out.append((edit, role, text))

    def row(self, turn, role: str, code: int, fault: int, after: int) -> None:
        letters, cost, inserted, self.state = edits(code, self.state, unpack(after))
        for name in inserted:
            self.line("I", name, "")
        if letters[-1] != "D":
            self.pending = (letters[-1], role if letters[-1] == "K" else ROLES[self.state])
        self.audit += letters.encode()
        self.cost += cost
        self.faults[fault] += 1
        self.illegal += self.last is not None and (self.last, code & 3) not in ((0, 1), (1, 2), (2, 1))
        self.last = code & 3
        if turn is not None and turn != self.turn:
            self.turn, self.high, self.turns = turn, turn, self.turns + 1
            self.low = turn if self.low is None else self.low

    def text(self, text: str) -> None:
        if self.pending:
            self.line(*self.pending, text)
            self.pending = None

    def end(self):
        while self.last is not None and self.state not in (START, ASSISTANT):
            self.state = OTHER[self.state]
            self.line("I", ROLES[self.state], "")
            self.audit += b"I"
            self.cost += INSERT
        gaps = 0 if self.turn is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


_REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _walk(kind: pa.DataType, turns: bool):
    names = [f.split()[0] for f in _REPORT.split(", ")]

    def report(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], kind), *(pa.array([d[k] for d in done], pa.int64() if k < 7 else pa.string()) for k in range(1, 9))],
            names=["conv_id", *names])

    def repaired(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()),
             *(pa.array([r[k] for r in rows], pa.string()) for k in (2, 3, 4))], names=["conv_id", "place", "edit", "role", "text"])

    def run(batches):
        walk = None
        for batch in batches:
            done, rows = [], []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "kind", "code", "fault", "after", "text")]
            for conv, turn, role, what, code, fault, after, text in zip(*columns, strict=True):
                if walk is None or conv != walk.conv:
                    if walk is not None:
                        done.append(walk.end())
                        rows += _taken(walk)
                    walk = Walk(conv)
                if what == 0:
                    walk.row(turn, role, code, fault, after)
                elif what == 1:
                    walk.text(text)
                if walk.out:
                    rows += _taken(walk) if turns else ()
                    walk.out = []
            yield repaired(rows) if turns else report(done)
        if walk is not None:
            done, rows = [walk.end()], _taken(walk)
            yield repaired(rows) if turns else report(done)

    return run


def _taken(walk: Walk):
    first = walk.lines - len(walk.out)
    return [(walk.conv, first + k, *x) for k, x in enumerate(walk.out)]


def _repair(rows: DataFrame, chunk: int, turns: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = {c: F.lit(None).cast("int") for c in ("code", "fault")} | {"after": F.lit(None).cast("long")}
    own = stitched(rows, chunk).select("conv_id", "turn", "role", "h", F.lit(0).alias("kind"), "rank", "code", "fault", "after",
                                       F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("h"), F.when(F.col("copies") > 0, 1).otherwise(2).alias("kind"),
                        F.lit(None).cast("long").alias("rank"), *(c.alias(n) for n, c in none.items()), "text")
    key = ["conv_id", "turn", "role", "h", "kind", "rank"]
    placed = own.unionByName(texts).repartition("conv_id").sortWithinPartitions(*key)
    layout = "place long, edit string, role string, text string" if turns else _REPORT
    return placed.mapInArrow(_walk(ARROW[kind], turns), f"conv_id {kind}, {layout}")


def _plain(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role, text, F.lit(1).alias("copies"))


def repair_conversations(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired rows of ``rows`` (conv_id, turn, role, text): conv_id, place, edit (K, R or I), role, text."""
    return _repair(_plain(rows), chunk, True)


def repair_report(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conv_id of ``rows``, damaged by the contract's rule: faults, cost, audit and digest of the repair."""
    return _repair(damaged(rows), chunk, False)
