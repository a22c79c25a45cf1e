"""Cheapest repair of conversations whose turns are lost, empty, doubled, cut off or under the wrong role.

A repair is a derivation. Items say that what begins at row ``i`` can follow a role state; a deduction puts one edit before
an item and gives an item of that row or the row before. Knuth's agenda pops items by (cost, audit): both functions are
superior, as an edit put in front never lowers a cost and keeps the order of audits; so the first derivation of an item
that is popped is its lightest, and the agenda ends when its goals are final.

A conversation may have any number of rows. Its rows are dealt in blocks; a block gives its costs from each state to each
state, these are put together from the last block back, and then each block finds its own edits. No task holds more
rows of a conversation than a block, but for the digest, which is one chain by its nature and is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.lookback import in_ranges

#: Rows of a block.
BLOCK = 4096
NEVER = 1 << 40
#: What has been said: nothing, a system turn, a user's, an assistant's. Where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (0, NEVER, NEVER, 0)
#: The state after a user's or an assistant's turn that an edit puts after a state: what may follow is never in doubt.
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost of the edits that aren't free, and of a row that stays cut off.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row's letter: initial of its role (s, u, a, another, none) times three, plus its fault (none or truncated or what must go).
INITIALS, OK, CUT_OFF, MUST_GO = "sua", 0, 1, 2


def _edits(letter: str) -> list[tuple[str, int, int, int]]:
    """The edits of a row: (initial, cost, state before, state after)."""
    initial, fault = divmod(ord(letter) - ord("A"), 3)
    out = [("D", DELETE, q, q) for q in range(4)]
    if fault == MUST_GO:
        return out
    more = TRUNCATED if fault == CUT_OFF else 0
    kept = {0: [(START, SYSTEM)], 1: [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], 2: [(USER, ASSISTANT)], 3: [], 4: [(q, q) for q in range(4)]}[initial]
    return out + [("K", more, *k) for k in kept] + [("R", REROLE + more, q, NEXT[q]) for q in range(4)]


#: Deductions that lead to an item of the row before, by the row's letter and the state after the edit.
_ROW = {chr(ord("A") + i): [[e for e in _edits(chr(ord("A") + i)) if e[3] == after] for after in range(4)] for i in range(15)}
_INSERTED = [[q for q in range(4) if NEXT[q] == after] for after in range(4)]


@lru_cache(maxsize=20_000)
def lightest(letters: str, ends: tuple[int, ...] = ENDS, last: bool = True, goals: tuple[int, ...] = (START,)) -> dict[int, tuple[int, str, int]]:
    """The lightest derivation from each state of ``goals``: its cost with what ``ends`` charges, its audit, the state it ends in.

    ``letters`` are a block's rows, ``ends`` the cost of what follows by state; turns are inserted before rows, and at
    the end only of a conversation's ``last`` block.
    """
    n, final, found = len(letters), {}, {}
    agenda: list[tuple[int, str, int, int, int]] = []
    wanted = set(goals)

    def deduce(cost: int, audit: str, i: int, state: int, end: int) -> None:
        if (i, state) not in final and found.get((i, state), (NEVER,)) > (cost, audit):
            found[i, state] = cost, audit
            heappush(agenda, (cost, audit, i, state, end))

    for state, cost in enumerate(ends):
        if cost < NEVER:
            deduce(cost, "", n, state, state)
    while agenda and wanted:
        cost, audit, i, state, end = heappop(agenda)
        if (i, state) in final:
            continue
        final[i, state] = cost, audit, end
        if i == 0:
            wanted.discard(state)
        if i < n or last:
            for before in _INSERTED[state]:
                deduce(cost + INSERT, "I" + audit, i, before, end)
        if i:
            for initial, more, before, _ in _ROW[letters[i - 1]][state]:
                deduce(cost + more, initial + audit, i - 1, before, end)
    return {q: final[0, q] for q in goals if (0, q) in final}


def edits_of(audit: str, letters: str, state: int) -> list[str]:
    """An audit row by row: roles inserted before (u, a), what becomes of the row (K, D, or its new role U, A), roles after."""
    out, before = [], ""
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            before += "ua"[state - USER]
            continue
        initial = (ord(letters[len(out)]) - ord("A")) // 3
        if edit == "R":
            state = NEXT[state]
        elif edit == "K" and initial < 3:
            state = (SYSTEM, USER, ASSISTANT)[initial]
        out.append(before + ("UA"[state - USER] if edit == "R" else edit))
        before = ""
    out[-1] += before
    return out


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's least costs from each state to each state, 16 to a block."""
    for batch in batches:
        out = []
        for letters, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            to = [lightest(letters, tuple(0 if r == end else NEVER for r in range(4)), last, (0, 1, 2, 3)) for end in range(4)]
            out.append([to[end].get(q, (NEVER,))[0] for q in range(4) for end in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["key", "block", "costs"])


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What follows each block of a conversation costs at least, by state."""
    for batch in batches:
        out = []
        for blocks in batch.column(1).to_pylist():
            after, own = list(ENDS), []
            for block in reversed(blocks):
                own.append({"block": block["block"], "ends": after})
                after = [min(NEVER, min(block["costs"][4 * q + r] + after[r] for r in range(4))) for q in range(4)]
            out.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("ends", pa.list_(pa.int64()))])))], ["key", "blocks"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's lightest edits from each state that it may begin in: (state, cost, audit, state after)."""
    kind = pa.list_(pa.struct([("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("after", pa.int32())]))
    for batch in batches:
        out = []
        for letters, first, last, ends in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6))):
            ends = tuple(ends) if ends else ENDS
            found = lightest(letters, ends, last, (START,) if first else (0, 1, 2, 3))
            out.append([{"state": q, "cost": cost - ends[end], "audit": audit, "after": end} for q, (cost, audit, end) in found.items()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, kind)], ["key", "block", "at", "letters", "ways"])


@lru_cache(maxsize=20_000)
def _illegal(letters: str) -> int:
    initials = [(ord(x) - ord("A")) // 3 for x in letters]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:]))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Go through a conversation's blocks from the first on and take the edits from the state at hand."""
    parts = pa.list_(pa.struct([("block", pa.int64()), ("at", pa.int64()), ("edits", pa.list_(pa.string()))]))
    for batch in batches:
        illegal, costs, audits, edits = [], [], [], []
        for blocks in batch.column(1).to_pylist():
            state, cost, audit, own, before, pairs = START, 0, [], [], "", 0
            for block in blocks:
                way = next(w for w in block["ways"] if w["state"] == state)
                own.append({"block": block["block"], "at": block["at"], "edits": edits_of(way["audit"], block["letters"], state)})
                pairs += _illegal(block["letters"]) + (_illegal(before + block["letters"][0]) if before else 0)
                state, cost, before = way["after"], cost + way["cost"], block["letters"][-1]
                audit.append(way["audit"])
            illegal.append(pairs)
            costs.append(cost)
            audits.append("".join(audit))
            edits.append(own)
        columns = [batch.column(0), pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(edits, parts)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "illegal", "cost", "audit", "parts"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lines, newline-joined; rows come sorted and pass one at a time."""
    key, hashed, some = None, None, False
    for batch in batches:
        done: list[tuple[str, str]] = []
        for k, lines in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != key:
                if key is not None:
                    done.append((key, hashed.hexdigest()))
                key, hashed, some = k, hashlib.sha256(), False
            for line in lines:
                hashed.update((b"\n" if some else b"") + line.as_buffer().to_pybytes())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], ["key", "sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([hashed.hexdigest()])], ["key", "sha256"])


def _key(column: str = "conv_id"):
    """A text that tells conversations apart, null ids too."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


class Repair:
    """The repair of ``turns(conv_id, turn, role, text)``: faults and edits, and the repaired turns themselves.

    Rows of a conversation are taken by turn (null first, also what is no whole number), then role and text; null roles
    and texts are one space; null ids are one conversation; rows that repeat are duplicates but for the first; other
    columns are left out, whatever their names; no rows give none.
    """

    def __init__(self, turns: DataFrame):
        text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
        given = turns.select(_key().alias("key"), F.col("conv_id").alias("conv_id"), F.col("turn").try_cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        # Equal rows may change places; a number of their own lets ranges part them.
        given = given.withColumn("row", F.monotonically_increasing_id())
        initial = F.substring("role", 1, 1)
        last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
        given = given.withColumns({
            "initial": F.when(initial == "", 4).otherwise(F.coalesce(*(F.when(initial == c, i) for i, c in enumerate(INITIALS)), F.lit(3))),
            "blank": last == "",
            "cut_off": ~last.isin(".", "!", "?"),
            "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256),
        })
        self.rows = in_ranges(given, ["key", "turn", "role", "text", "row"])
        self._faults()
        self._repair()

    def _faults(self) -> None:
        """Rows without their texts: the first fault of each, and its letter."""
        first = self.rows.groupBy(F.col("key").alias("of"), F.col("digest").alias("same")).agg(F.min(F.struct("__part", "__at")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
        narrow = self.rows.select("key", "turn", "__part", "__at", "initial", "blank", "cut_off", "digest").join(first, (F.col("key") == F.col("of")) & (F.col("digest") == F.col("same")), "left")
        again = F.coalesce(F.struct("__part", "__at") > F.col("first"), F.lit(False))
        fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut_off"), "truncated")
        cost = F.when(fault == "truncated", CUT_OFF).when(fault.isNotNull(), MUST_GO).otherwise(OK)
        block = F.shiftleft(F.col("__part").cast("long"), 32) + F.floor(F.col("__at") / BLOCK)
        letter = F.expr("chr(65 + 3 * initial + cost)")
        self.faults = narrow.select("key", "turn", fault.alias("fault"), cost.alias("cost"), "initial", block.alias("block"), "__at").withColumn("letter", letter)

    def _repair(self) -> None:
        ordered = F.array_sort(F.collect_list(F.struct("__at", "letter")))
        blocks = self.faults.groupBy("key", "block").agg(F.min("__at").alias("at"), F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("letters"))
        ends = blocks.groupBy(F.col("key").alias("of")).agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
        blocks = blocks.join(ends, F.col("key") == F.col("of")).select("key", "block", "at", "letters", (F.col("block") == F.col("lo")).alias("first"), (F.col("block") == F.col("hi")).alias("last"))
        several = blocks.filter("NOT (first AND last)").select("key", "block", "letters", "last")
        costs = several.mapInArrow(_costs, "key string, block long, costs array<long>").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("blocks"))
        after = costs.mapInArrow(_remaining, "key string, blocks array<struct<block:long,ends:array<long>>>").select(F.col("key").alias("of"), F.explode("blocks").alias("x")).select("of", F.col("x.block").alias("b"), "x.ends")
        joined = blocks.join(after, (F.col("key") == F.col("of")) & (F.col("block") == F.col("b")), "left").select("key", "block", "at", "letters", "first", "last", "ends")
        solved = joined.mapInArrow(_solved, "key string, block long, at long, letters string, ways array<struct<state:int,cost:long,audit:string,after:int>>")
        chains = solved.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "at", "letters", "ways"))).alias("blocks"))
        self.repairs = chains.mapInArrow(_chained, "key string, illegal long, cost long, audit string, parts array<struct<block:long,at:long,edits:array<string>>>")

    def _made(self) -> DataFrame:
        """``key, conv_id, part, at, made``: what each row becomes, a list of turns (role, text, edit)."""
        parts = self.repairs.select(F.explode("parts").alias("p")).select(F.shiftright("p.block", 32).cast("int").alias("part"), F.col("p.at").alias("from"), F.posexplode("p.edits").alias("i", "edit"))
        edits = parts.select("part", (F.col("from") + F.col("i")).alias("at"), "edit")
        rows = self.rows.select("key", "conv_id", "role", "text", "__part", "__at").join(edits, (F.col("__part") == F.col("part")) & (F.col("__at") == F.col("at")))
        role = lambda letter: F.when(F.lower(letter) == "u", "user").otherwise("assistant")
        own = F.struct(F.when(F.regexp_extract("edit", "[KUA]", 0) == "K", F.col("role")).otherwise(role(F.regexp_extract("edit", "[KUA]", 0))).alias("role"), F.col("text").alias("text"), F.when(F.col("edit").contains("K"), "K").otherwise("R").alias("edit"))
        turn = lambda x: F.when(x.isin("u", "a"), F.struct(role(x).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))).when(x.isin("K", "U", "A"), own)
        return rows.select("key", "conv_id", "part", "at", F.array_compact(F.transform(F.split("edit", "(?!^)"), turn)).alias("made"))

    def turns(self) -> DataFrame:
        """``key, conv_id, part, at, nth, role, text, edit``: the repaired turns, in order of ``part, at, nth``; ``edit`` is K, R or I."""
        return self._made().select("key", "conv_id", "part", "at", F.posexplode("made").alias("nth", "t")).select("key", "conv_id", "part", "at", "nth", "t.role", "t.text", "t.edit")

    def report(self) -> DataFrame:
        """``key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation that has rows."""
        kinds = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
        wide = lambda c: c.cast("decimal(20,0)")
        gaps = F.coalesce((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")).try_cast("long"), F.lit(0)).alias("gaps")
        counted = self.faults.groupBy("key").agg(gaps, *kinds)
        lines = self._made().select("key", "part", "at", F.transform("made", lambda t: F.concat(t["role"], F.lit(":"), t["text"])).alias("lines"))
        sorted_lines = lines.repartition("key").sortWithinPartitions("key", "part", "at").select("key", "lines")
        digests = sorted_lines.mapInArrow(_digests, "key string, sha256 string")
        found = counted.join(self.repairs.drop("parts"), "key").join(digests, "key", "left")
        return found.withColumn("repaired_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).drop("sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults made by a checksum of id and turn: rows dropped, emptied, without their ends of
    sentences, doubled, or under the user's name. Nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The repair of :func:`damaged` conversations, one row for each id of ``conversations``; without rows left: zeros, an
    empty audit and the digest of nothing. See :class:`Repair` for nulls, ties, repeats and names."""
    ids = conversations.select("conv_id").distinct().withColumn("key", _key())
    found = ids.join(Repair(damaged(conversations)).report(), "key", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
