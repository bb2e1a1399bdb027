import hashlib
import itertools
import random
import zlib

import pytest

from corpuscle.llm import queries, turn_repair as tr


def every_repair(items):
    """All repairs with up to two inserts at a place, by enumeration."""
    best = None
    choices = [["D"] if c == tr.DEAD else ["D", "K", "R"] for c in items]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(range(3), repeat=len(items) + 1):
            audit, state, cost, legal = "", tr.NONE, 0, True
            for i in range(len(items) + 1):
                for _ in range(inserts[i]):
                    audit, state, cost = audit + "I", tr.DUE[state], cost + 3
                if i == len(items):
                    break
                edit, code = edits[i], items[i]
                audit += edit
                if edit == "D":
                    cost += 4
                    continue
                cost += 3 if code & 4 else 0
                if edit == "R":
                    state, cost = tr.DUE[state], cost + 3
                else:
                    role = code & 3
                    before = {tr.SYSTEM: "0", tr.USER: "013", tr.ASSISTANT: "2"}.get(role, "")
                    if str(state) not in before:
                        legal = False
                        break
                    state = role
            if legal and state in (tr.NONE, tr.ASSISTANT):
                best = min(best or (cost, audit), (cost, audit))
    return best


def whole_audit(items):
    pairs = [(c, 1) for c in items]
    edits = tr.repair_items(pairs)
    return tr.backward(pairs, tr.END, 0, len(pairs))[0], "".join(edits) + tr.TAIL[tr.follow_all(pairs, edits)]


CODES = [0, 1, 2, 3, 4, 5, 6, 7, tr.DEAD]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_all_short_conversations(n):
    for items in itertools.product(CODES, repeat=n):
        assert whole_audit(items) == every_repair(items)


def test_random_conversations_against_whole_strings():
    """Costs by plain dynamic programming, audits by greedy walk over its full table."""
    rng = random.Random(7)
    for _ in range(300):
        items = [rng.choice(CODES) for _ in range(rng.randint(4, 60))]
        table = [None] * len(items) + [tr.END]
        for i in range(len(items) - 1, -1, -1):
            table[i] = tr.backward([(items[i], 1)], table[i + 1], 0, 1)
        audit, state = "", tr.NONE
        for i, code in enumerate(items):
            step = min((a, to) for a, cost, to in tr.STEPS[code][state] if cost + table[i + 1][to] == table[i][state])
            audit, state = audit + step[0], step[1]
        assert whole_audit(items) == (table[0][0], audit + tr.TAIL[state])


def brute(rows):
    """Report of one conversation from (turn, role, text) in order, from the contract's words."""
    seen, items, kept = set(), [], []
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        last = [c for c in text if c not in " \t\n\v\f\r"]
        if not last:
            counts["blank"] += 1
            items.append(tr.DEAD)
        elif (role, text) in seen:
            counts["duplicate"] += 1
            items.append(tr.DEAD)
        else:
            short = last[-1] not in ".!?"
            counts["truncated"] += short
            items.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + 4 * short)
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = every_repair(items) if len(items) <= 3 else whole_audit(items)
    state, at = "", 0
    for edit in audit:
        due = "assistant" if state[:1] == "u" else "user"
        if edit == "I":
            kept.append(f"{due}:")
            state = due
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "K":
            kept.append(f"{role}:{text}")
            state = role
        elif edit == "R":
            kept.append(f"{due}:{text}")
            state = due
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest()}


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        shown = [" " if v is None else v for v in (conv, turn, role, text)]
        fault = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2], shown[3]
        mine = out.setdefault(conv, [])
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if fault == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def as_dict(df):
    return {r.conv_id: {k: r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")} for r in df.collect()}


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = as_dict(queries.QUERIES["op12_turn_repair"](spark, sf_dir))
    want = {c: brute(r) for c, r in damaged(data).items()}
    assert got == want
    assert sum(r["cost"] > 0 for r in want.values()) > 20


def random_rows(seed, n_conversations, length):
    rng = random.Random(seed)
    texts = ["", " \n", "Yes.", "No", "Why?", "é!", "x" * 500, "a\vb", "stop. ", None]
    rows = []
    for conv in [*range(n_conversations), None]:
        turns = rng.sample(range(2 * length), length) + ([None] if conv == 2 else [])
        rows += [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}.") for t in turns]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def test_ranges_as_whole_conversations(spark, rows):
    data = random_rows(3, 5, 80)
    df = rows(SCHEMA, *data)
    want = {c: brute(r) for c, r in plain(data).items()}
    assert as_dict(tr.repair(df)) == want
    assert as_dict(tr.repair(df, whole_rows=70, range_rows=40)) == want
    turns = lambda d: {c: [(r.edit, r.role, r.text) for r in g] for c, g in itertools.groupby(d.orderBy("conv_id", "place").collect(), key=lambda r: r.conv_id)}
    assert turns(tr.repaired_turns(df)) == turns(tr.repaired_turns(df, whole_rows=70, range_rows=40))


def test_repeats_and_ties(spark, rows):
    data = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Ho."), (1, 1, "assistant", "Ho.")] + [(2, 0, "user", "Same.")] * 500
    df = rows(SCHEMA, *data)
    got = as_dict(tr.repair(df))
    assert got == as_dict(tr.repair(df, whole_rows=1, range_rows=2))
    assert got[1]["duplicate"] == 2 and got[1]["illegal"] == 1
    assert got[2]["duplicate"] == 499 and got[2]["illegal"] == 499 and got[2]["audit"] == "K" + "D" * 499 + "I"


def test_nothing_left_and_empty_table(spark, rows):
    from pyspark.sql import functions as F

    df = rows(f"{SCHEMA}, cost string, conv string", (1, 0, "user", "Hi.", "a", "b"), (2, 0, "user", "Hi.", "a", "b"))
    copies = F.when(F.col("conv_id") == 1, 0).otherwise(1)
    for limit in (tr.WHOLE_ROWS, -1):
        got = as_dict(tr.repair(df, copies, whole_rows=limit))
        assert got[1] == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
        assert got[2]["audit"] == "KI" and got[2]["cost"] == 3
    assert tr.repair(df.limit(0)).count() == 0


def test_deep_conversation_in_linear_space():
    items = [(random.Random(1).choice(CODES), 1) for _ in range(3000)] + [(tr.DEAD, 10**6)]
    edits = tr.repair_items(items)
    assert len(edits) == len(items) and len(edits[-1]) == 10**6
