"""Repair of conversation structure at least cost, by A* on the lattice of edits.

A conversation is a sequence of rows; a repaired one has role initials ``(s?(ua)+)?``.  An
edit keeps a row (0), gives it the role that has to come next (1), deletes it (2, required
for blank and duplicate rows), or inserts an empty turn before it or at the end (5); a
truncated row that stays costs 5 more.  A lattice node is (rows consumed, last initial), and
each letter of an audit string (K, R, D, I) leads from a node to exactly one other.

The heuristic of a node is the sum over the rows to come of what each costs at least: 2 for
a mandatory deletion, and 2 for a truncated row, which is deleted or charged.  It is
consistent, so with nodes keyed by (cost plus heuristic, audit) the first path to reach the
goal is the cheapest and, of those, the least in ASCII order.

Rows are dealt out in ranges of (conversation, turn), so a long conversation is spread over
tasks.  A conversation that lies inside a range is repaired there.  What a range's ends cut,
or what is too large to hold, sends one byte a row to where its audit string is made (which
has one letter a row, too): blocks of rows are searched from every state, the costs between
blocks are summed from the end, and then each block is searched once more for the cheapest
way on.  Its texts then stream past the audit string in order; a digest is sequential by
nature, but takes no memory.

Defined results: null roles and texts count as one space.  Rows go by turn, nulls first, then
by role and text.  A null id is a conversation like any other; a conversation of which no row
is left has zeros, an empty audit string and the digest of the empty string.  An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsquall.llm.common import kept

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States by the last initial: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 0
#: Codes of rows: an initial (0: none of s, u, a) plus four times the fault.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What a kept initial leads to from each state, and which role a new or rerolled turn has to have.
KEEPS = ({SYSTEM: SYSTEM, USER: USER}, {USER: USER}, {ASSISTANT: ASSISTANT}, {USER: USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (0, None, None, 0)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Rows of a block of a long conversation; rows and characters that are held to repair a conversation at once.
BLOCK, HELD_ROWS, HELD_CHARS = 128, 65_536, 8_000_000


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: rows with a part of them broken, by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (``gone``), 1 empties the text, 2 takes ``.!?`` out of it, 3 repeats the
    row, 4 makes its role user.  Nulls count as one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).cast("int")
    text = F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(blank("role"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    broken = rows.select("conv_id", "turn", "role", "text", kind.alias("k"))
    return broken.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def search(codes: bytes, start: int, goals: tuple, tail: bool) -> tuple[int, str, int]:
    """Cost, audit and last state of the cheapest way from ``start`` over all rows to a state with a goal cost.

    ``tail`` allows turns to be inserted behind the last row.
    """
    n = len(codes)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if codes[k] > 3 else 0)
    least = min(g for g in goals if g is not None)
    heap = [(ahead[0] + least, "", 0, start, 0)]
    closed = set()
    while heap:
        _, audit, i, state, g = heapq.heappop(heap)
        if i > n:
            return g, audit, state
        if (i, state) in closed:
            continue
        closed.add((i, state))
        to = NEXT[state]
        if i < n:
            initial, fault = codes[i] & 3, codes[i] >> 2
            rest = ahead[i + 1] + least
            heapq.heappush(heap, (g + DELETE + rest, audit + "D", i + 1, state, g + DELETE))
            if fault in (FINE, TRUNCATED):
                stay = CUT_OFF if fault == TRUNCATED else 0
                if initial in KEEPS[state]:
                    heapq.heappush(heap, (g + stay + rest, audit + "K", i + 1, KEEPS[state][initial], g + stay))
                heapq.heappush(heap, (g + REROLE + stay + rest, audit + "R", i + 1, to, g + REROLE + stay))
        elif goals[state] is not None:
            heapq.heappush(heap, (g + goals[state], audit, n + 1, state, g + goals[state]))
        if i < n or tail:
            heapq.heappush(heap, (g + INSERT + ahead[i] + least, audit + "I", i, to, g + INSERT))
    raise ValueError("no goal can be reached")


@lru_cache(maxsize=20_000)
def exits(codes: bytes, start: int) -> tuple:
    """The least cost from ``start`` over all rows of a block to each state, None where there is no way."""
    here: list = [None] * 4
    here[start] = 0
    for code in codes:
        initial, fault = code & 3, code >> 2
        for s in (START, SYSTEM, USER, ASSISTANT, USER):  # inserted turns; twice round settles all
            if here[s] is not None and (here[NEXT[s]] is None or here[NEXT[s]] > here[s] + INSERT):
                here[NEXT[s]] = here[s] + INSERT
        then: list = [None if g is None else g + DELETE for g in here]
        if fault in (FINE, TRUNCATED):
            stay = CUT_OFF if fault == TRUNCATED else 0
            for s, g in enumerate(here):
                if g is not None:
                    for to, cost in ((KEEPS[s].get(initial), stay), (NEXT[s], REROLE + stay)):
                        if to is not None and (then[to] is None or then[to] > g + cost):
                            then[to] = g + cost
        here = then
    return tuple(here)


@lru_cache(maxsize=20_000)
def short(codes: bytes) -> tuple[int, str]:
    return search(codes, START, ACCEPTED, True)[:2]


def cheapest(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit string of a conversation's cheapest repair, ties to the least string.

    A long one is searched by blocks.  Each block ends with a consumed row, so no block's
    string is the beginning of another of the same block, and ties are settled block by block.
    """
    if len(codes) <= block:
        return short(codes)
    parts = [codes[k : k + block] for k in range(0, len(codes), block)]
    onward = [tuple(search(parts[-1], s, ACCEPTED, True)[0] for s in range(4))]
    for part in parts[-2::-1]:
        ways = [[g + onward[-1][t] for t, g in enumerate(exits(part, s)) if g is not None] for s in range(4)]
        onward.append(tuple(min(w) for w in ways))
    onward.reverse()
    state, audits = START, []
    for k, part in enumerate(parts[:-1]):
        _, audit, state = search(part, state, onward[k + 1], False)
        audits.append(audit)
    audits.append(search(parts[-1], state, ACCEPTED, True)[1])
    return onward[0][START], "".join(audits)


class Turns:
    """The repaired turns of a conversation, row by row, along its audit string."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield ROLE[self.state], "", "I"

    def row(self, code: int, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEEPS[self.state][code & 3]
            yield role, text, "K"
        elif edit == "R":
            self.state = NEXT[self.state]
            yield ROLE[self.state], text, "R"


class Report:
    """Counts and digest of a conversation as its rows go by."""

    def __init__(self, cost: int, audit: str):
        self.turns, self.cost, self.digest, self.first = Turns(audit), cost, hashlib.sha256(), True
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.distinct = 0

    def put(self, turns: Iterator[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
        out = list(turns)
        for role, text, _ in out:
            self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.first = False
        return out

    def row(self, turn: int | None, role: str, text: str, code: int) -> list[tuple[str, str, str]]:
        self.faults[code >> 2] += 1
        self.illegal += self.last is not None and (self.last, code & 3) not in LEGAL
        self.last = code & 3
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += turn != self.high
            self.high = turn
        return self.put(self.turns.row(code, role, text))

    def end(self) -> tuple[list[tuple[str, str, str]], tuple]:
        more = self.put(self.turns.inserted())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return more, (gaps, *self.faults[1:], self.illegal, self.cost, self.turns.audit, self.digest.hexdigest())


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
NAMES = [c.split()[0] for c in REPORT.split(", ")]


class Sink:
    """Rows of the union schema, given out in batches."""

    def __init__(self, kind: pa.DataType, turn: pa.DataType):
        fields = [("c", kind), ("done", pa.bool_()), ("part", pa.int32()), ("pos", pa.int64()), ("turn", turn), ("role", pa.string()), ("text", pa.string()), ("code", pa.int32()), ("codes", pa.binary()), ("edit", pa.string())]
        self.schema = pa.schema([*fields, *((n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in NAMES)])
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, c, done, part=None, pos=None, turn=None, role=None, text=None, code=None, codes=None, edit=None, report=(None,) * len(NAMES)) -> None:
        self.rows.append((c, done, part, pos, turn, role, text, code, codes, edit, *report))
        self.size += 200 + len(text or "") + len(report[-2] or "")

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.rows, self.size = [], 0


def _finish(sink: Sink, c, rows: list[tuple], turns: bool) -> None:
    """Repairs a conversation that is held as a whole."""
    report = Report(*cheapest(bytes(r[3] for r in rows)))
    out = [t for r in rows for t in report.row(*r)]
    more, found = report.end()
    if turns:
        for k, (role, text, edit) in enumerate([*out, *more]):
            sink.add(c, True, pos=k, role=role, text=text, edit=edit)
    else:
        sink.add(c, True, report=found)


def _inside(batches: Iterator[pa.RecordBatch], turns: bool, held_rows: int, held_chars: int) -> Iterator[pa.RecordBatch]:
    """Repairs the conversations that lie inside a range of rows; passes on the rows of the others, and a row of all their codes.

    Columns: conversation, range, turn, role, text, gone, fault but for repeats of a row, whether the initial is s, u or a.
    """
    sink = last = None
    c, rows, chars, loose, first, part, pos = None, [], 0, True, True, 0, 0
    begun, codes = False, bytearray()

    def spill() -> None:
        nonlocal rows, chars, pos
        for turn, role, text, code in rows:
            sink.add(c, False, part, pos, turn, role, text, code)
            codes.append(code)
            pos += 1
        rows, chars = [], 0

    def close(end: bool) -> None:
        nonlocal codes
        if loose or first or end:
            spill()
            sink.add(c, False, part, -1, codes=bytes(codes))
            codes = bytearray()
        else:
            _finish(sink, c, rows, turns)

    for batch in batches:
        if sink is None:
            sink = Sink(batch.schema[0].type, batch.schema[2].type)
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            now, part, turn, role, text, gone, fault, initial = row
            if not begun or now != c:
                if begun:
                    close(False)
                    first = False
                    yield from sink.batches(1_000_000)
                c, rows, chars, loose, last, begun = now, [], 0, False, None, True
            if gone:
                continue
            same = (turn, role, text)
            fault = DUPLICATE if fault != BLANK and same == last else fault
            last = same
            rows.append((turn, role, text, initial | fault << 2))
            chars += len(text)
            if len(rows) >= held_rows or chars >= held_chars:
                loose = True
                spill()
                yield from sink.batches(1_000_000)
    if begun:
        close(True)
        yield from sink.batches()


def _streamed(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """Goes along each audit string, which comes first, with the conversation's rows, which follow in order."""
    sink = None
    c, report, pos = None, None, 0

    def put(out: list[tuple[str, str, str]]) -> None:
        nonlocal pos
        for role, text, edit in out if turns else ():
            sink.add(c, True, pos=pos, role=role, text=text, edit=edit)
            pos += 1

    def close() -> None:
        more, found = report.end()
        put(more)
        if not turns:
            sink.add(c, True, report=found)

    for batch in batches:
        if sink is None:
            sink = Sink(batch.schema[0].type, batch.schema[3].type)
        for now, _, at, turn, role, text, code, cost, audit in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if at < 0:
                if report is not None:
                    close()
                c, report, pos = now, Report(cost, audit), 0
            else:
                put(report.row(turn, role, text, code))
            yield from sink.batches(1_000_000)
    if report is not None:
        close()
        yield from sink.batches()


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c, parts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            cost, audit = cheapest(b"".join(p["codes"] for p in parts))
            yield pa.RecordBatch.from_arrays([pa.array([c], batch.schema[0].type), pa.array([cost]), pa.array([audit])], names=["c", "cost", "audit"])


def _repaired(rows: DataFrame, turns: bool, held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS) -> DataFrame:
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    r = rows.select(F.col("conv_id").alias("c"), "turn", space("role").alias("role"), space("text").alias("text"), gone.alias("gone"))
    said = r.filter("NOT gone").select("c", "turn", "role", F.unhex(F.sha2("text", 256)).alias("t"))
    again = said.groupBy(F.col("c").alias("c2"), F.col("role").alias("role2"), "t").agg(F.min(F.struct("turn")).alias("first"), F.max(F.struct("turn")).alias("last"))
    again = kept(again.filter("first != last").select("c2", "role2", "t", F.struct("first.turn").alias("first")), "again")
    e = r.join(again, F.col("c").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("role2")) & (F.unhex(F.sha2("text", 256)) == F.col("t")), "left")
    end = F.rtrim("text", F.lit(BLANKS))
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.length(end) == 0, BLANK).when(later, DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    s = F.substring("role", 1, 1)
    initial = F.when(s == "s", SYSTEM).when(s == "u", USER).when(s == "a", ASSISTANT).otherwise(OTHER)
    marked = e.select("c", "turn", "role", "text", "gone", fault.alias("fault"), initial.alias("initial"), F.substring("text", 1, 32).alias("_begins"))
    dealt = marked.repartitionByRange("c", "turn", "role", "_begins").sortWithinPartitions("c", "turn", "role", "text")
    dealt = dealt.select("c", F.spark_partition_id().alias("part"), "turn", "role", "text", "gone", "fault", "initial")
    c, t = (dealt.schema[x].dataType.simpleString() for x in ("c", "turn"))
    schema = f"c {c}, done boolean, part int, pos bigint, turn {t}, role string, text string, code int, codes binary, edit string, {REPORT}"
    first = kept(dealt.mapInArrow(lambda b: _inside(b, turns, held_rows, held_chars), schema), "repaired")
    cut = first.filter("NOT done")
    codes = cut.filter("pos < 0").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "codes"))).alias("codes"))
    audits = codes.mapInArrow(_audits, f"c {c}, cost bigint, audit string")
    none = lambda n, kind: F.lit(None).cast(kind).alias(n)
    lead = audits.select("c", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("pos"), none("turn", t), none("role", "string"), none("text", "string"), none("code", "int"), "cost", "audit")
    rest = cut.filter("pos >= 0").select("c", "part", "pos", "turn", "role", "text", "code", none("cost", "bigint"), none("audit", "string"))
    stream = lead.unionByName(rest).repartition("c").sortWithinPartitions("c", "part", "pos")
    return first.filter("done").unionByName(stream.mapInArrow(lambda b: _streamed(b, turns), schema))


def repair_report(rows: DataFrame, **held: int) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every ``conv_id`` of ``conv_id, turn, role, text`` (and ``gone``, for rows that only name their conversation).

    Each row's first fault counts.  ``gaps`` are missing whole numbers between the least and
    the greatest turn, ``illegal`` neighbours whose initials are not su, ua or au.
    """
    return _repaired(rows, False, **held).select(F.col("c").alias("conv_id"), *NAMES)


def repaired_turns(rows: DataFrame, **held: int) -> DataFrame:
    """``conv_id, pos, role, text, edit``: the repaired conversations themselves, with the edit (K, R, I) that each turn comes from."""
    return _repaired(rows, True, **held).select(F.col("c").alias("conv_id"), "pos", "role", "text", "edit")
