import random
import re

from corpuscle.llm import quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, failed string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    out = ["", None, " \n\t", "a", "a b c d e a b c d e", "a a a a a a a a a a a a", "x\x0by\x0cz", "é#*|<\n\né#*|<\n é#*|<", "  nbsp"]
    for _ in range(n):
        words = [rnd.choice("ab") + rnd.choice(["", "é", "##", "XY"]) for _ in range(rnd.randint(1, 50))]
        out.append("".join(w + rnd.choice([" ", "\n", "  ", "\r\n"]) for w in words))
    return out


def test_base_counts(spark):
    rows = [(i, t, "en", "s", "x", "y") for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), repr(t)
        assert not (r["kept"] and r["base_failed"])


def prose(rnd, n=60):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_fences_follow_the_group(spark):
    rnd = random.Random(2)
    # In source "code" symbols are usual, in the other they are not.
    rows = [(i, prose(rnd), "en", "plain") for i in range(300)] + [(1000 + i, prose(rnd).replace(" ", " # "), None, "code") for i in range(300)]
    rows += [(5000, prose(rnd).replace(" ", " # "), "en", "plain"), (5001, prose(rnd).replace(" ", " # "), "en", "tiny"), (5002, prose(rnd).upper(), "en", None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert all(got[i]["kept"] for i in range(300)) and all(got[1000 + i]["kept"] for i in range(300))
    assert "symbol_rate" in got[5000]["failed"] and "symbol_rate" in got[5001]["failed"] and "capital_rate" in got[5002]["failed"]
    assert len(got) == len(rows)


def test_sketches_are_mergeable_and_near_the_quantiles(spark):
    rnd = random.Random(3)
    values = [int(rnd.expovariate(1 / 5000)) for _ in range(3000)]
    names = ", ".join(f"{n} bigint" for n in quality_rules.SIGNALS)
    df = spark.createDataFrame([("en", "ab"[i % 2], *[v] * len(quality_rules.SIGNALS)) for i, v in enumerate(values)], f"lang string, source string, {names}")
    parts = quality_rules.sketch(df.filter("source = 'a'")).union(quality_rules.sketch(df.filter("source = 'b'")))
    merged, whole = (sorted(map(tuple, quality_rules.quartiles(x, ["lang"]).collect())) for x in (parts, quality_rules.sketch(df)))
    assert merged == whole
    values.sort()
    for _, _, docs, q1, q3 in whole:
        assert docs == 3000
        for got, at in ((q1, 750), (q3, 2250)):
            assert values[at - 1] <= got <= values[at - 1] * (1 + 1 / 63) + 1


def test_empty_repeated_and_long(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j", "en", "s", "x", "y")] * 2, SCHEMA)
    assert quality_rules.judge(df.limit(0)).count() == 0
    assert [r["kept"] for r in quality_rules.judge(df).collect()] == [True, True]
    text = " ".join(f"w{i % 5000}" for i in range(200000))
    r = quality_rules.judge(spark.createDataFrame([(1, text, "en", "s", "x", "y")], SCHEMA)).first()
    assert r["n_words"] == r["n_repeat_words"] == 200000
