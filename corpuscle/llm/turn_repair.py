"""Repair of conversation structure at least cost, in linear space by divide and conquer.

A conversation may start with a system turn; then user and assistant take turns, the assistant last. Rows in order are
kept (0), given the role that is due (3), or deleted (4); empty turns are inserted (3). Blank rows and repeats of an earlier
role and text must go; a row that ends without a sentence stop costs 3 more if it stays. Four states say what came last:
nothing, system, user, assistant. Of all cheapest repairs the one whose audit (initials of its edits, in order) is least in
ASCII is taken; the state and the audit fix the result, since an inserted or renamed turn takes the role that is due.

Hirschberg's method: forward costs from the start and backward costs from the end, four numbers each, meet in the middle row. The
state with the least sum is crossed; if several tie, the backward sweep over the first half carries along where the
audit-least path of each state comes out. Both halves are then solved alike, so only four numbers per level are held.

A conversation of ordinary size is one sorted run inside a task. One of more than `whole_rows` rows or `whole_bytes` bytes
is cut into ranges of its order: each range gives its 4 x 4 least costs, these are combined from the end to the costs
after every range and then from the start to the state before it, and every range is repaired by itself. Only one row a range
meets per conversation. The SHA-256 of such a conversation is read as one sorted stream, as the hash is sequential by nature; it holds no more than one row.

Defined cases: a null role or text counts as one space, a null conversation is one of its own, null turns come first. Rows of
one turn are ordered by role, the first 64 characters and a hash of the text; equal rows are adjacent, all but the
first are duplicates. A role whose initial is none of s, u, a cannot be kept. A conversation whose rows all have
`copies` 0 is reported with zeros and an empty audit. An empty table gives an empty report; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.config import broadcast_if_small, materialize

WHOLE_ROWS = 20_000
WHOLE_BYTES = 64 << 20
RANGE_ROWS = 65_536

KEEP, RENAME, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
BLANKS = " \t\n\v\f\r"
STOPS = ".!?"
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
DUE = (USER, USER, ASSISTANT, USER)  # the role that an inserted or renamed turn takes in each state
FAR = 1 << 60
START = (0, FAR, FAR, FAR)
# Cost to end: nothing or an assistant turn may be last.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
LEGAL = ("su", "ua", "au")

# A row is a code: DEAD, or the state that keeping it leads to (0: none), plus 4 if it is unfinished.
DEAD = 8
_BY_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_FITS = {SYSTEM: (NONE,), USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}


def _steps(code: int) -> list[list[tuple[str, int, int]]]:
    """Per state the ways past a row, (audit, cost, next state), the least audit first; inserts stand before the row."""
    out = []
    for state in range(4):
        ways, at = [], state
        for n in range(3):
            before, cost = "I" * n, INSERT * n
            ways.append((before + "D", cost + DELETE, at))
            if code != DEAD:
                extra = UNFINISHED if code & 4 else 0
                if at in _FITS.get(code & 3, ()):
                    ways.append((before + "K", cost + KEEP + extra, code & 3))
                ways.append((before + "R", cost + RENAME + extra, DUE[at]))
            at = DUE[at]
        out.append(sorted(ways))
    return out


STEPS = [_steps(code) for code in range(DEAD + 1)]

# Items are (code, n): n rows of one code in a row, n > 1 only for dead ones, which are all deleted.
Item = tuple[int, int]


def backward(items: list[Item], after: tuple, low: int, high: int) -> tuple:
    """Least cost to go before item `low`, per state, from the costs after item `high - 1`."""
    for i in range(high - 1, low - 1, -1):
        code, n = items[i]
        if code == DEAD:
            after = tuple(c + n * DELETE for c in after)
        else:
            after = tuple(min(cost + after[to] for _, cost, to in ways) for ways in STEPS[code])
    return after


def exits(items: list[Item], after: tuple, low: int, high: int) -> list[int]:
    """Per state before item `low`, where the audit-least of the cheapest ways stands after item `high - 1`."""
    out = [0, 1, 2, 3]
    for i in range(high - 1, low - 1, -1):
        code, n = items[i]
        if code == DEAD:
            after = tuple(c + n * DELETE for c in after)
            continue
        costs, ways_out = [], []
        for ways in STEPS[code]:
            least = min(cost + after[to] for _, cost, to in ways)
            costs.append(least)
            ways_out.append(next(out[to] for _, cost, to in ways if cost + after[to] == least))
        after, out = tuple(costs), ways_out
    return out


def forward(items: list[Item], before: tuple, low: int, high: int) -> tuple:
    """Least cost from the start, per state after item `high - 1`."""
    for i in range(low, high):
        code, n = items[i]
        if code == DEAD:
            # Inserts among deleted rows could as well stand after them.
            before = tuple(c + n * DELETE for c in before)
            continue
        found = [FAR] * 4
        for state, ways in enumerate(STEPS[code]):
            for _, cost, to in ways:
                found[to] = min(found[to], before[state] + cost)
        before = tuple(found)
    return before


def repair_items(items: list[Item], state: int = NONE, after: tuple = END) -> list[str]:
    """The edits per item of the audit-least cheapest repair that starts in `state` and pays `after` at the end."""
    out: list[str] = []
    todo = [(0, len(items), state, after)]
    while todo:
        low, high, state, after = todo.pop()
        if high - low <= 1:
            for i in range(low, high):
                code, n = items[i]
                if code == DEAD:
                    out.append("D" * n)
                else:
                    least = min(cost + after[to] for _, cost, to in STEPS[code][state])
                    out.append(next(audit for audit, cost, to in STEPS[code][state] if cost + after[to] == least))
            continue
        middle = (low + high) // 2
        to_go = backward(items, after, middle, high)
        so_far = forward(items, tuple(0 if s == state else FAR for s in range(4)), low, middle)
        sums = [a + b for a, b in zip(so_far, to_go, strict=True)]
        crossing = sums.index(min(sums))
        if sums.count(min(sums)) > 1:
            crossing = exits(items, to_go, low, middle)[state]
        todo.append((middle, high, crossing, after))
        todo.append((low, middle, state, tuple(0 if s == crossing else FAR for s in range(4))))
    return out


def follow(state: int, edits: str, code: int) -> int:
    for edit in edits:
        if edit in "IR":
            state = DUE[state]
        elif edit == "K":
            state = code & 3
    return state


def repaired(state: int, edits: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that come of one row and the inserts before it."""
    for edit in edits:
        if edit == "D":
            continue
        if edit in "IR":
            state = DUE[state]
        yield edit, role if edit == "K" else NAMES[state], "" if edit == "I" else text


def row_code(role: str, text: str) -> tuple[bool, int]:
    """(blank, code of the row if it is neither blank nor a duplicate)."""
    seen = text.rstrip(BLANKS)
    return not seen, _BY_INITIAL.get(role[:1], 0) + (4 if seen and seen[-1] not in STOPS else 0)


def whole(rows: list[tuple]) -> tuple[dict, list[tuple[str, str, str]]]:
    """Report and repaired turns of one conversation from its ordered (turn, role, text, copies)."""
    items: list[Item] = []
    sources: list[tuple[str, str]] = []
    seen: set[tuple[str, str]] = set()
    turns: set[int] = set()
    blank = duplicate = truncated = illegal = 0
    last = None
    for turn, role, text, copies in rows:
        if not copies:
            continue
        if turn is not None:
            turns.add(turn)
        illegal += copies - 1 + (last is not None and last + role[:1] not in LEGAL)
        last = role[:1]
        empty, code = row_code(role, text)
        extra = copies
        if empty:
            blank += copies
        else:
            if (role, text) not in seen:
                seen.add((role, text))
                extra -= 1
                truncated += code >= 4
                items.append((code, 1))
                sources.append((role, text))
            duplicate += extra
        if extra:
            items.append((DEAD, extra))
            sources.append((role, text))
    edits = repair_items(items)
    turns_out: list[tuple[str, str, str]] = []
    state, cost = NONE, backward(items, END, 0, len(items))[NONE]
    for (code, _), edit, (role, text) in zip(items, edits, sources, strict=True):
        turns_out += repaired(state, edit, role, text)
        state = follow(state, edit, code)
    for _ in TAIL[state]:
        state = DUE[state]
        turns_out.append(("I", NAMES[state], ""))
    report = {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
        "cost": cost, "audit": "".join(edits) + TAIL[follow_all(items, edits)],
        "repaired_sha256": hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns_out).encode("utf-8", "surrogatepass")).hexdigest(),
    }
    return report, turns_out


def follow_all(items: list[Item], edits: list[str]) -> int:
    state = NONE
    for (code, _), edit in zip(items, edits, strict=True):
        state = follow(state, edit, code)
    return state


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPORT = ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
_TURNS = "place bigint, edit string, role string, text string"


def _prepared(turns: DataFrame, copies: Column | None) -> DataFrame:
    blank = F.lit(" ")
    return turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.substring("text", 1, 64).asc(), F.xxhash64("text").asc()]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Conversations of a sorted stream, equal neighbours as one row with more copies."""
    key, rows = None, None
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "copies"))
        for conv, *row in zip(*columns, strict=True):
            if rows is None or conv != key:
                if rows is not None:
                    yield key, rows
                key, rows = conv, []
            if rows and rows[-1][:3] == row[:3]:
                rows[-1][3] += row[3]
            else:
                rows.append(row)
    if rows is not None:
        yield key, rows


def _small(rows: DataFrame, conv_type: str, as_turns: bool) -> DataFrame:
    """Conversations that fit a task: a report each, or their repaired turns."""
    ordered = rows.repartition("conv").sortWithinPartitions(F.col("conv"), *_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string()] * 3 if as_turns else [pa.int64()] * 6 + [pa.string()] * 2
            names = ["place", "edit", "role", "text"] if as_turns else [*COUNTS, "audit", "repaired_sha256"]
            kinds = [pa.int64(), *kinds] if as_turns else kinds
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], ["conv_id", *names])

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        key_type = first.schema.field("conv").type
        for conv, turns in _conversations(chain([first], batches)):
            report, made = whole(turns)
            if as_turns:
                out += [(conv, i, *t) for i, t in enumerate(made)]
                size += sum(len(t[2]) for t in made) + len(made)
            else:
                out.append((conv, *report.values()))
                size += len(report["audit"]) + 1000
            if size > 1 << 20 and out:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return ordered.mapInArrow(run, f"conv_id {conv_type}, {_TURNS if as_turns else _REPORT}")


class _Ranges:
    """Conversations cut into ranges of their order; `number` stands for the conversation."""

    def __init__(self, rows: DataFrame, heavy: DataFrame, n_rows: int, range_rows: int):
        live = rows.filter("copies > 0").join(broadcast_if_small(heavy, 64), F.col("conv").eqNullSafe(F.col("_conv")))
        distinct = live.groupBy("number", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
        keys = [F.col("number").asc(), *_order()]
        placed = distinct.repartitionByRange(n_rows // range_rows + 1, *keys).sortWithinPartitions(*keys)
        self.heavy = heavy
        self.rows = materialize(placed.withColumn("pos", F.monotonically_increasing_id()), "turns")
        self.codes = materialize(self._codes(), "codes")
        self.inputs = self._inputs()

    def _codes(self) -> DataFrame:
        seen = F.rtrim(F.translate("text", BLANKS, " " * len(BLANKS)))
        initial = F.substring("role", 1, 1)
        code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
        first = self.rows.groupBy("number", "role", F.md5("text")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
        narrow = self.rows.select(
            "number", "pos", F.shiftright("pos", 33).alias("part"), "turn", "copies", initial.alias("initial"), (seen == "").alias("blank"),
            (code + F.when(F.substring(seen, -1, 1).isin(*STOPS), 0).otherwise(4)).alias("code"),
        )
        return narrow.join(first, "pos", "left").withColumn("first", F.col("_first").isNotNull() & ~F.col("blank")).drop("_first")

    @staticmethod
    def _items(rows: pd.DataFrame) -> tuple[list[Item], list[int]]:
        """Items of a range and the position that each is of."""
        rows = rows.sort_values("pos")
        items, at = [], []
        for pos, code, first, copies in zip(rows["pos"].tolist(), rows["code"].tolist(), rows["first"].tolist(), rows["copies"].tolist(), strict=True):
            if first:
                items.append((code, 1))
                at.append(pos)
            if copies > first:
                items.append((DEAD, copies - first))
                at.append(pos)
        return items, at

    def _inputs(self) -> DataFrame:
        """Per range: the state before it and the costs after it; per conversation also the total cost and the final state."""
        items_of = self._items

        def summarize(rows: pd.DataFrame) -> pd.DataFrame:
            items, _ = items_of(rows)
            rows = rows.sort_values("pos")
            initials, copies = rows["initial"].tolist(), rows["copies"].tolist()
            illegal = sum(copies) - len(copies) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            costs = [c for s in range(4) for c in forward(items, tuple(0 if s == q else FAR for q in range(4)), 0, len(items))]
            return pd.DataFrame({
                "number": [rows["number"].iat[0]], "part": [rows["part"].iat[0]], "costs": [costs], "illegal": [illegal],
                "head": [initials[0]], "tail": [initials[-1]],
            })

        def combine(parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values("part", ascending=False)
            after, out = END, []
            for costs in parts["costs"]:
                out.append(list(after))
                after = tuple(min(costs[4 * s + to] + after[to] for to in range(4)) for s in range(4))
            heads, tails = parts["head"].tolist(), parts["tail"].tolist()
            seams = sum(a + b not in LEGAL for a, b in zip(tails[1:], heads, strict=False))
            return parts[["number", "part"]].assign(after=out, cost=int(after[NONE]), illegal=int(parts["illegal"].sum()) + seams)

        def leave(key: tuple, rows: pd.DataFrame, costs: pd.DataFrame) -> pd.DataFrame:
            items, _ = items_of(rows)
            found = exits(items, tuple(int(c) for c in costs["after"].iat[0]), 0, len(items))
            return costs.assign(exits=[found])

        def enter(parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values("part")
            state, states = NONE, []
            for found in parts["exits"]:
                states.append(state)
                state = int(found[state])
            return parts.drop(columns="exits").assign(state=states, last=state)

        grouped = self.codes.groupBy("number", "part")
        # One row per range of RANGE_ROWS rows meets in a group below.
        summary = grouped.applyInPandas(summarize, "number bigint, part bigint, costs array<bigint>, illegal bigint, head string, tail string")
        costs = "number bigint, part bigint, after array<bigint>, cost bigint, illegal bigint"
        after = materialize(summary.groupBy("number").applyInPandas(combine, costs), "ranges")
        left = grouped.cogroup(after.groupBy("number", "part")).applyInPandas(leave, f"{costs}, exits array<int>")
        return materialize(left.groupBy("number").applyInPandas(enter, f"{costs}, state int, last int"), "ranges")

    def edits(self) -> DataFrame:
        """(number, pos, item, state, edits) of every item, the turns inserted at the end as one more."""
        items_of = self._items

        def solve(key: tuple, rows: pd.DataFrame, costs: pd.DataFrame) -> pd.DataFrame:
            items, at = items_of(rows)
            state, after = int(costs["state"].iat[0]), tuple(int(c) for c in costs["after"].iat[0])
            edits = repair_items(items, state, after)
            states = []
            for (code, _), edit in zip(items, edits, strict=True):
                states.append(state)
                state = follow(state, edit, code)
            return pd.DataFrame({"number": key[0], "part": key[1], "pos": at, "item": range(len(at)), "state": states, "edits": edits})

        grouped = self.codes.groupBy("number", "part").cogroup(self.inputs.groupBy("number", "part"))
        solved = grouped.applyInPandas(solve, "number bigint, part bigint, pos bigint, item bigint, state int, edits string")
        tails = self.inputs.groupBy("number").agg(F.max("part").alias("part"), F.first("last").alias("state"))
        audit = F.element_at(F.array(*map(F.lit, TAIL)), F.col("state") + 1)
        end = tails.select("number", "part", F.lit(1 << 60).alias("pos"), F.lit(1 << 40).alias("item"), "state", audit.alias("edits"))
        return solved.unionByName(end)

    def turns(self, edits: DataFrame) -> DataFrame:
        """(number, pos, item, nth, edit, role, text) of the repaired turns."""
        # A row's kept item is the one that yields turns; dead ones only delete.
        live = edits.filter(F.translate("edits", "D", "") != "")
        joined = live.join(self.rows.select("pos", "role", "text"), "pos", "left")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    made = repaired(r["state"], r["edits"], r["role"] or "", r["text"] or "")
                    out += [{"number": r["number"], "pos": r["pos"], "item": r["item"], "nth": i, "edit": e, "role": a, "text": t} for i, (e, a, t) in enumerate(made)]
                yield pa.RecordBatch.from_pylist(out, SCHEMA)

        names = {"number": pa.int64(), "pos": pa.int64(), "item": pa.int64(), "nth": pa.int32(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
        SCHEMA = pa.schema(list(names.items()))
        return joined.mapInArrow(make, "number bigint, pos bigint, item bigint, nth int, edit string, role string, text string")

    def report(self) -> DataFrame:
        edits = materialize(self.edits(), "edits")
        counts = self.codes.groupBy("number").agg(
            F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.col("first").cast("bigint"))).alias("duplicate"),
            F.count_if(F.col("first") & (F.col("code") >= 4)).alias("truncated"),
        )
        spread = self.codes.filter("turn is not null").select("number", "turn").distinct()
        gaps = spread.groupBy("number").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
        costs = self.inputs.groupBy("number").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
        # The audit is one value of the result, so its parts come together here; a range's edits are joined before.
        pieces = lambda key, out: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, out))), lambda x: x[out]), "").alias(out)
        audit = edits.groupBy("number", "part").agg(pieces(["pos", "item"], "edits")).groupBy("number").agg(pieces(["part"], "edits"))

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, state = None, None
            for batch in batches:
                for key, role, text in zip(*(batch.column(n).to_pylist() for n in ("number", "role", "text")), strict=True):
                    if key != number:
                        if state:
                            yield pa.RecordBatch.from_pydict({"number": [number], "sha": [state.hexdigest()]})
                        number, state = key, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if state:
                yield pa.RecordBatch.from_pydict({"number": [number], "sha": [state.hexdigest()]})

        hashes = self.turns(edits).repartition("number").sortWithinPartitions("number", "pos", "item", "nth").mapInArrow(digest, "number bigint, sha string")
        found = self.heavy.join(costs, "number", "left").join(counts, "number", "left").join(gaps, "number", "left").join(audit, "number", "left").join(hashes, "number", "left")
        return found.select(
            F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
            F.coalesce("edits", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )


def _split(rows: DataFrame, whole_rows: int, whole_bytes: int, range_rows: int) -> tuple[DataFrame, _Ranges | None]:
    """Rows of ordinary conversations, and the ranges of the others if there are any."""
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = sizes.filter((F.col("n") > whole_rows) | (F.col("bytes") > whole_bytes))
    heavy = materialize(large.select(F.col("conv").alias("_conv"), F.monotonically_increasing_id().alias("number"), "n"), "heavy")
    n_rows = heavy.agg(F.sum("n")).first()[0]
    if n_rows is None:
        return rows, None
    names = heavy.select("_conv", "number")
    rest = rows.join(broadcast_if_small(names.select("_conv"), 64), F.col("conv").eqNullSafe(F.col("_conv")), "left_anti")
    return rest, _Ranges(rows, names, n_rows, range_rows)


def repair(
    turns: DataFrame, copies: Column | None = None, whole_rows: int = WHOLE_ROWS, whole_bytes: int = WHOLE_BYTES, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """A report per conversation of (conv_id, turn, role, text): faults, least cost, audit and the hash of the repaired `role:text` lines.

    `copies` says how often a row counts (default once); with 0 it only names its conversation.
    """
    rows = _prepared(turns, copies)
    conv_type = rows.schema["conv"].dataType.simpleString()
    rest, ranges = _split(rows, whole_rows, whole_bytes, range_rows)
    small = _small(rest, conv_type, False)
    return small.unionByName(ranges.report()) if ranges else small


def repaired_turns(
    turns: DataFrame, copies: Column | None = None, whole_rows: int = WHOLE_ROWS, whole_bytes: int = WHOLE_BYTES, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """The repaired conversations: conv_id, place (rising; gap-free within ordinary ones), edit (K, R or I), role, text."""
    rows = _prepared(turns, copies)
    conv_type = rows.schema["conv"].dataType.simpleString()
    rest, ranges = _split(rows, whole_rows, whole_bytes, range_rows)
    small = _small(rest, conv_type, True)
    if not ranges:
        return small
    made = ranges.turns(ranges.edits()).join(broadcast_if_small(ranges.heavy, 64), "number")
    # A row gives three turns at most: two inserts and itself.
    return small.unionByName(made.select(F.col("_conv").alias("conv_id"), (4 * F.col("pos") + F.col("nth")).alias("place"), "edit", "role", "text"))
