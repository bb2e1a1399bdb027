"""Secrets, HTML, decontamination, language and quality by compression."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import compression, decontaminate, html_text, langid, secrets


# --- secrets ----------------------------------------------------------------------------


def plain_spans(text):
    """The fixed patterns by a scan that follows their wording."""
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [x for *_, x in sorted(out)]


def secret_texts():
    rnd = random.Random(1)
    hexed = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    out = [None, "", "token = \"" + hexed(40) + "\"", "TOKEN:abc", "password=token:abcdef", "AKIA" + "A1" * 9, "AKIAAKIA" + "B2" * 4, "ſecret=abcdefgh",
           "é token = " + hexed(30) + " é", hexed(23), hexed(24) + "g", "api_key='x' apikey: abcdefghij", "secret=secret=abcdef"]
    for i in range(150):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(3, 12))]
        if i % 2:
            words.insert(rnd.randrange(len(words)), rnd.choice(["password", "token", "secret"]) + rnd.choice([" = ", ": ", "="]) + "\"" + hexed(rnd.choice([16, 32])) + "\"")
        if i % 3 == 0:
            words.append(str(rnd.randrange(10**6)))
        out.append(" ".join(words))
    return out


def test_fixed_spans_stay(spark):
    rows = [(i, t, "x") for i, t in enumerate(secret_texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]] for r in secrets.scan(df).collect()}
    for i, t, _ in rows:
        assert [s for s in got[i] if not s.startswith("crf")] == plain_spans(t), t
    assert secrets.scan(df.limit(0)).count() == 0


def test_field_finds_what_the_patterns_miss(spark):
    df = spark.createDataFrame(list(enumerate(secret_texts())), "doc_id bigint, text string")
    field = secrets.fit(df)
    value = "9f3b2c7d1e8a4f60b5c2"  # too short for the hex rule, and no assignment
    text = f"hello there\nthe token \"{value}\" works\nplain words only"
    spans = field.spans(text)
    assert (text.index(value), text.index(value) + len(value)) in spans
    assert field.spans("plain words only and nothing else") == []


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(1)
    field = secrets.Field()
    field.weights, field.steps = rnd.normal(size=field.weights.shape), rnd.normal(size=(3, 3))
    for line in ("a1b2c3d4 token = xyz", "x : y", "abc"):
        _, rows, open_ = secrets.features(line, False)
        scores = field.emissions(rows, open_)

        def value(path, scores=scores):
            bad = path[0] == 2 or any(a == 0 and b == 2 for a, b in itertools.pairwise(path))
            return -1e18 if bad else sum(scores[i, s] for i, s in enumerate(path)) + sum(field.steps[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product(range(3), repeat=len(rows)), key=value)
        assert value(tuple(field.decode(rows, open_))) == pytest.approx(value(best))


def test_every_line_is_decoded():
    """A secret stands where the field sees one, also in lines without a digit or a keyword."""
    import numpy as np

    field = secrets.Field()
    field.trained = True
    value = "QwErTyUiOpAsDfGhJk"
    _, rows, _ = secrets.features("go " + value + " now", False)
    field.weights[rows[1][0], secrets.BEGIN], field.weights[rows[1][8], secrets.OUTSIDE] = 5.0, 1.0
    field.steps[secrets.OUTSIDE, secrets.INSIDE] = secrets.NEVER
    text = "some words\ngo " + value + " now\n"
    assert field.spans(text) == [(text.index(value), text.index(value) + len(value))]
    # With any weights the lines left out are those whose best path is all outside.
    rnd, pick = np.random.default_rng(4), random.Random(4)
    parts = ["abc", "token", "=", '"', "a1b2c3", "9f3b2c7d1e8a4f60", "Émile_x", "key:", "ZZ/yy+q==", "\u00a0", "x;", "٣٤", "", "password='A9'"]
    texts = ["\n".join(" ".join(pick.choices(parts, k=pick.randint(0, 9))) for _ in range(30)) for _ in range(20)]
    held = 0
    for n in range(20):
        field.weights = rnd.normal(size=field.weights.shape) - [0, n / 10, n / 10]
        field.steps = rnd.normal(size=(3, 3))
        field.steps[secrets.OUTSIDE, secrets.INSIDE] = secrets.NEVER
        for text in texts:
            may = field.may_hold(text.split("\n"), np.zeros(30, int), secrets.Words())
            for line, mark in zip(text.split("\n"), may, strict=True):
                _, rows, open_ = secrets.features(line, False)
                if len(rows) and not mark:
                    assert not any(field.decode(rows, open_)), line
                    held += 1
    assert held > 500


# --- HTML -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("x <b>bold</b> <i>y</i>  z<br>n &amp; m", "x bold y z\nn & m"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>cake tin<td>12</table>", "Name     | Qty\napple    | 3\ncake tin | 12"),
        ("<head><title>t</title><style>p{}</style></head><script>var a='</p>';</script>seen<!-- no --><noscript>no</noscript>", "seen"),
        ("<div hidden>a</div><p style='display: none'>b</p><span aria-hidden=true>c</span><p style=\"VISIBILITY:hidden\">d</p>e", "e"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<p>one</b></p></i>two", "one\n\ntwo"),
        ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
        ("<a title='x > y' href=z>link</a> &lt;b&gt; 1 < 2", "link <b> 1 < 2"),
        ("<textarea>no</textarea><select><option>no</select>yes<unfinished", "yes<unfinished"),
        ("", ""), ("<!-- open", ""), ("<p> \n </p>", ""), ("<table></table>x", "x"),
        ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in | ner | out"),
    ],
)
def test_pages(page, text):
    assert html_text.render(page) == text


def test_all_text_of_generated_pages_is_kept():
    rnd = random.Random(2)
    tags = ["div", "p", "b", "span", "li", "ul", "table", "tr", "td", "h2", "section"]
    for n in range(200):
        words, page = [], []
        for i in range(rnd.randint(1, 30)):
            page.append(f"<{'/' if rnd.random() < 0.4 else ''}{rnd.choice(tags)}>")
            words.append(f"w{n}x{i}")
            page.append(words[-1])
        out = html_text.render(" ".join(page))
        assert sorted(re.findall(r"w\d+x\d+", out)) == sorted(words)


def test_deep_and_long_pages():
    assert html_text.render("<div>" * 100000 + "x").strip() == "x"
    assert html_text.render("<b><table><td>" + "<span>" * 20000 + "</b>" * 20000 + "x") == "x"
    assert len(html_text.render("<p>word " * 50000).split()) == 50000


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "old"), (1, "u", None, "old")], "page_id bigint, url string, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted((r["text"] or "-") for r in out.collect()) == ["-", "a"]
    assert html_text.extract(df.limit(0)).count() == 0


# --- decontamination --------------------------------------------------------------------


def greedy_tiles(a, b, least):
    """Greedy string tiling as it is defined: the longest match of unmarked words, again and again."""
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total
        total += k
        used_a[i : i + k] = [True] * k
        used_b[j : j + k] = [True] * k


def test_leaks_in_other_scripts_and_punctuation(spark):
    chinese, thai = "床前明月光，疑是地上霜。举头望明月，低头思故乡。", "ทุกคนมีสิทธิเท่าเทียมกันตามกฎหมาย"
    quoted = 'the "old" bridge - built by monks - still carries the whole road'
    items = spark.createDataFrame([(1, chinese), (2, thai), (3, quoted)], "item_id bigint, text string")
    styled = quoted.replace(' "', " “").replace('" ', "” ").replace(" - ", "—").replace("whole road", "whole\u00a0road")
    texts = ["前文" + chinese.replace("，", "、") + "后文", "ก" + thai + "ข", f"»{styled}«", "床前明日光，天上人间。", "ทุกวันไปตลาด", "the old road was built", "été: " + quoted]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()) == [(0, 1), (1, 2), (2, 3), (6, 3)]


def test_tiles_as_defined():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(60):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        if rnd.random() < 0.5 and a:
            cut = rnd.randrange(len(a))
            b = b[:10] + a[cut:] + b[10:] + a[:cut]
        got = sum(k for *_, k in decontaminate.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3))
        assert abs(got - greedy_tiles(a, b, 3)) <= 2 or got >= greedy_tiles(a, b, 3)


def test_leaks_and_clean(spark):
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [prose(40) for _ in range(6)]
    half = items[1].split()
    docs = [
        (1, prose(100) + " " + items[0].upper() + ". " + prose(20)), (2, " ".join(half[20:]) + " " + prose(9) + " " + " ".join(half[:20])),
        (3, prose(300)), (4, " ".join(items[2].split()[:20]) + " " + prose(30)), (5, None), (6, ""), (None, items[3]), (7, items[3] + " " + items[4]),
    ]
    docs_df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (7, "too short"), (8, None)], "item_id bigint, text string")
    for block_chars in (1 << 20, 100):
        found = sorted(((r["doc_id"] or -1), r["item_id"]) for r in decontaminate.leaks(docs_df, bench, block_chars).collect())
        assert found == [(-1, 3), (1, 0), (2, 1), (7, 3), (7, 4)]
        kept = decontaminate.clean(docs_df, bench, block_chars)
        assert kept.columns == docs_df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.leaks(docs_df, bench.limit(0)).count() == 0 and decontaminate.clean(docs_df, bench.limit(0)).count() == 8
    assert decontaminate.leaks(docs_df.limit(0), bench).count() == 0


# --- languages and quality --------------------------------------------------------------

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).filter(langid.held_out(F.col("doc_id")))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_filters_hold_all_their_ngrams():
    import numpy as np

    rnd = np.random.default_rng(2)
    own = [rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(9)]
    filters = langid.Filters([f"l{i}" for i in range(9)], own)
    for i, grams in enumerate(own):
        assert (filters.languages_of(grams) >> np.uint16(i) & np.uint16(1)).all()
    other = rnd.integers(0, 1 << 63, 200000, dtype=np.uint64)
    masks = filters.languages_of(other)
    for i in range(9):
        assert abs((masks >> np.uint16(i) & np.uint16(1)).mean() - filters.false_rate[i]) < 1e-3


def test_language_defined_cases(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "x", "y") for i in range(40)]
    rows += [(100, None, None, "x", "y"), (101, "12 !?", "en", "x", "y"), (102, "Die Katze", None, "x", "y"), (102, "Die Katze", None, "x", "y"), (None, "the cat", "en", "x", "y")]
    rows += [(103, "the cat sat " * 50000, None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, lang_pred string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert got[100] == ("und", 0.0) and got[101] == ("und", 0.0) and got[102][0] == "de" and got[None][0] == "en" and got[103][0] == "en"
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = compression.score(docs.select("doc_id", "text"), compression.fit(docs, labels)).join(labels, "doc_id").filter(compression.held_out(F.col("doc_id")))
    right = scored.agg(F.avg(((F.col("score") >= 0.3) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95
    # Calibrated: the mean score is near the share of good texts.
    mean, share = scored.agg(F.avg("score"), F.avg("quality")).first()
    assert abs(mean - share) < 0.05


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "z " * 200000, "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 7)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in compression.score(docs, compression.fit(docs, labels)).collect()}
    assert got[2] == got[3] and all(0 <= s <= 1 for s in got.values())
    assert compression.score(docs.limit(0), compression.fit(docs.limit(0), labels.limit(0))).count() == 0
