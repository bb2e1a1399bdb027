import random
import re

import numpy as np
import pytest

from corpuscle.llm import line_dedup

SCHEMA = "doc_id bigint, text string, keys string"


def words(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return {w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", low) if w}


def brute(docs):
    """Removed line numbers by doc_id, by comparing every line with all earlier ones."""
    lines = [
        ((d, i), words(x)) for d, t in docs if d is not None and t is not None for i, x in enumerate(t.split("\n")) if words(x)
    ]
    lines.sort(key=lambda x: x[0])
    gone = {}
    for (d, i), own in lines:
        for place, other in lines:
            if place >= (d, i):
                break
            if 9 * len(own & other) >= 4 * (len(own) + len(other)):
                gone.setdefault(d, set()).add(i)
                break
    return {d: sorted(x) for d, x in gone.items()}


def corpus(seed, n=50, vocabulary=400):
    rnd = random.Random(seed)
    known = [f"w{int(vocabulary * rnd.random() ** 2)}" for _ in range(vocabulary)]
    made, docs = [], []
    for d in range(n):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            if made and rnd.random() < 0.5:
                line = rnd.choice(made).split()
                for _ in range(rnd.randint(0, 3)):
                    line[rnd.randrange(len(line))] = rnd.choice(known)
            else:
                line = [rnd.choice(known) for _ in range(rnd.randint(1, 24))]
            rnd.shuffle(line)
            lines.append(" ".join(line))
            made.append(lines[-1])
        docs.append((d, "\n".join(lines)))
    return docs


def found(spark, docs):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)
    return {r["doc_id"]: r["removed"] for r in line_dedup.removed_lines(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    docs = corpus(seed)
    want = brute(docs)
    assert want
    assert found(spark, docs) == want


def test_long_lines(spark):
    rnd = random.Random(5)
    base = [f"t{i}" for i in range(150)]
    docs = []
    for d in range(40):
        line = list(base)
        for _ in range(d % 30):
            line[rnd.randrange(150)] = f"u{rnd.randrange(2000)}"
        docs.append((d, " ".join(line)))
    assert found(spark, docs) == brute(docs)


def test_hot_words_and_second_round(spark, monkeypatch):
    # Every word is frequent, so keys are word triples; a first round of one candidate leaves work for the second.
    monkeypatch.setattr(line_dedup, "HOT_CLASS", line_dedup.rarity_class(3))
    monkeypatch.setattr(line_dedup, "FIRST", 1)
    monkeypatch.setattr(line_dedup, "WEAK", 1)
    monkeypatch.setattr(line_dedup.candidates, "__defaults__", (1,))
    docs = corpus(3, n=60, vocabulary=60)
    assert found(spark, docs) == brute(docs)


def test_defined_cases(spark):
    docs = [
        (1, "a b c d e\n\n!!\nx"), (2, "A B C D E"), (None, "a b c d e"), (3, None), (4, ""), (5, "e d c b a f\nx\nnew words here now"),
        (6, "q r s t u v"), (6, "q r s t u v"), (7, "é è à ü ö\r\ny"),
    ]
    assert found(spark, docs) == {2: [0], 5: [0, 1]}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)
    out = {(r["doc_id"], r["text"], r["keys"]) for r in line_dedup.dedup(df).collect()}
    assert (5, "new words here now", "x") in out and (2, "", "x") in out and (None, "a b c d e", "x") in out and (3, None, "x") in out
    assert line_dedup.dedup(df).columns == df.columns and line_dedup.dedup(df).count() == len(docs)


def test_long_text_and_empty_table(spark):
    docs = [(1, "\n".join(f"line number {i} of {i * 7} and {i * 13}" for i in range(30000))), (2, "line number 5 of 35 and 65")]
    assert found(spark, docs)[2] == [0]
    assert found(spark, []) == {}


def test_many_keys_travel_in_a_row(spark):
    docs = corpus(7, n=1500, vocabulary=3000)
    df = spark.createDataFrame([(d, t) for d, t in docs], "doc_id bigint, text string").coalesce(1)
    classes = line_dedup.count_words(df)
    sent = line_dedup.dealt(df, classes)
    n = np.concatenate([line_dedup._unpacked(b)["n"] for b in sent.toArrow().combine_chunks().to_batches()])
    assert len(n) > 10000 and sent.count() <= 1 << line_dedup.MIN_BUCKET_BITS
    # Only the keys asked for, a row each, without settled lines.
    all_keys = np.ones(1 << line_dedup.COUNTER_BITS, bool)
    assert line_dedup.dealt(df, classes, all_keys).count() == (n > 0).sum() < len(n)
    assert line_dedup.dealt(df, classes, ~all_keys).count() == 0


def test_comparisons_stay_within_similar_lengths(monkeypatch):
    # One key, 3000 lines of 4 to 3003 words: each meets only those that are up to a quarter longer.
    n = np.arange(4, 3004)
    compared = []
    count = np.bitwise_count
    monkeypatch.setattr(line_dedup.np, "bitwise_count", lambda x: compared.append(len(x)) or count(x))
    rnd = np.random.default_rng(1)
    wide = rnd.integers(0, 1 << 63, (len(n), 4)).astype(np.uint64)
    rows = {
        "key": np.zeros(len(n), np.int64), "doc": np.arange(len(n)), "line": np.zeros(len(n), np.int32), "n": n.astype(np.int32),
        "place": np.zeros(len(n), np.uint16), "bits": np.bitwise_xor.reduce(wide, axis=1), "a": rnd.integers(0, 1 << 63, len(n)).astype(np.uint64),
        "wanted": np.ones(len(n), bool), "wide": wide[n >= line_dedup.LONG], "at": np.cumsum(n >= line_dedup.LONG) - 1,
    }
    compared.clear()
    line_dedup._near(rows, 1 << 40)
    within = sum(int((n[i + 1 :] <= 5 * n[i] // 4).sum()) for i in range(len(n)))
    assert compared and max(compared) <= len(n) and sum(compared) < 2.2 * within < 0.5 * len(n) ** 2


@pytest.mark.parametrize("hot", [line_dedup.HOT_CLASS, line_dedup.rarity_class(3)])
def test_keys_and_comparisons_lose_no_similar_line(monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_CLASS", hot)
    rnd = np.random.default_rng(3)
    made, lines = [], []
    for _ in range(500):
        if made and rnd.random() < 0.6:
            line = set(made[rnd.integers(len(made))])
            for _ in range(rnd.integers(0, 6)):
                line.discard(next(iter(line)))
                line.add(int(rnd.integers(200)))
        else:
            line = set(rnd.integers(0, 200, rnd.integers(1, 110)).tolist())
        made.append(line)
        lines.append(np.sort(np.array([(80 + w % 100 << 36) + w for w in line], np.uint64)))
    n = np.array([len(x) for x in lines])
    tokens = np.concatenate(lines)
    starts = np.cumsum(n) - n
    x = {"doc": np.arange(len(n)) // 3, "line": np.arange(len(n)) % 3, "a": line_dedup.mix(np.add.reduceat(line_dedup.mix(tokens), starts)), "n": n, "tokens": tokens}
    batch = line_dedup._unpacked(line_dedup._packed([line_dedup._keyed(x, None)], 12))
    settled = {(d, i) for d, i, size in zip(batch["doc"].tolist(), batch["line"].tolist(), batch["n"].tolist(), strict=True) if size == 0}
    live = batch["n"] > 0
    rows = {c: v if c == "wide" else v[live] for c, v in batch.items()}
    later, earlier, status = line_dedup._near(rows, 1 << 40)
    place = [int(d) * 3 + int(i) for d, i in zip(rows["doc"], rows["line"], strict=True)]
    pairs = {(place[i], place[j]) for i, j in zip(later, earlier, strict=True)}
    same = {place[i] for i, s in zip(later, status, strict=True) if s == line_dedup.SAME} | {3 * d + i for d, i in settled}
    assert all(i > j for i, j in pairs)
    for i, own in enumerate(made):
        alike = [j for j in range(i) if 9 * len(own & made[j]) >= 4 * (len(own) + len(made[j]))]
        assert (i in same) == any(made[j] == own for j in range(i))
        assert i in same or not alike or any((i, j) in pairs for j in alike)


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_second_round_finds_what_the_first_left_out(spark, monkeypatch, few):
    # Lines of 60 words, most of which differ in 16 words: too many, though their bitmaps often differ in 12 bits and less.
    rnd = random.Random(11)
    base, lines = [f"b{i}" for i in range(60)], []
    for d in range(160):
        line = list(lines[rnd.randrange(100)] if d > 130 else base)
        for _ in range(5 if d > 130 else 4):
            line[rnd.randrange(60)] = f"u{rnd.randrange(4000)}"
        lines.append(line)
    docs = [(d, " ".join(line)) for d, line in enumerate(lines)]
    rounds = []
    dealt = line_dedup.dealt
    monkeypatch.setattr(line_dedup, "dealt", lambda df, classes, asked=None: rounds.append(asked) or dealt(df, classes, asked))
    monkeypatch.setattr(line_dedup.candidates, "__defaults__", (1,))
    monkeypatch.setattr(line_dedup, "FEW_KEYS", few)
    assert found(spark, docs) == brute(docs)
    assert len(rounds) == 2 and rounds[0] is None and rounds[1].all() == (few == 0)


def test_lines_of_very_many_words(spark):
    def line(n, changed=0):
        return " ".join(f"x{i}" if i >= changed else f"y{n}z{i}" for i in range(n))

    docs = [
        (1, line(33000)), (2, line(40000)), (3, line(41251)), (4, line(33001, 3600)), (5, line(400000)), (6, line(400000, 44000)), (7, line(400001, 45000)),
        (8, "v " + line(330000)), (9, line(32000)),
    ]
    assert found(spark, docs) == brute(docs)
