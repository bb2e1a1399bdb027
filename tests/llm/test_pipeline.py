import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corpuscle.config import materialize
from corpuscle.llm import queries, shingle_dedup, simhash
from corpuscle.llm.components import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables with cases that the stages must catch, and documents that they must keep."""
    rnd = random.Random(6)
    sf = str(tmp_path_factory.mktemp("sf"))
    item = words(rnd, "abcdefgh", 30)
    rows = []

    def add(text, lang, source=None):
        rows.append((len(rows), text, lang, source or rnd.choice(["web", "web", "web", "books", None]), len(text or "")))
        return rows[-1][0]

    clean = [add("\n".join(words(rnd, "abcdefgh" if i % 2 else "opqrstuv", 15) for _ in range(3)), "en" if i % 2 else "xx") for i in range(60)]
    foreign = add(words(rnd, "αβγδεζηθ", 40), None)
    empty, marks = add("", "en"), add("123 456 !!", "en")
    copies = [add(rows[clean[0]][1], "xx"), add(rows[clean[0]][1], "xx")]
    lines = add(rows[clean[2]][1].split("\n")[1] + "\n" + words(rnd, "abcdefgh", 20), "en")
    leak = add(words(rnd, "abcdefgh", 20) + " " + item + " " + words(rnd, "abcdefgh", 20), "en")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, {"clean": clean, "foreign": foreign, "junk": [empty, marks], "copies": copies, "lines": lines, "leak": leak, "text": {r[0]: r[1] for r in rows}}


def test_stages(spark, planted):
    sf, case = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        out[name] = docs
        if name != "source_mix":
            assert docs.columns == COLUMNS
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in out.items()}
    gone = {case["foreign"], *case["junk"]}
    assert ids["language_id"] == set(case["text"]) - gone
    assert ids["line_dedup"] == ids["language_id"] - set(case["copies"])
    kept = {r["doc_id"]: r for r in out["line_dedup"].collect()}
    assert kept[case["lines"]]["text"] == case["text"][case["lines"]].split("\n")[1]
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    assert ids["near_dedup"] == ids["line_dedup"]
    assert ids["decontamination"] == ids["near_dedup"] - {case["leak"]}
    assert ids["source_mix"] <= ids["decontamination"] and set(case["clean"]) <= ids["decontamination"]
    assert {c for c in COLUMNS} <= set(out["source_mix"].columns)
    # The whole run gives the same rows, again and again.
    run = sorted(map(str, corpus_pipeline.run(spark, sf).drop("text").collect()))
    assert run == sorted(map(str, out["source_mix"].drop("text").collect()))


def test_near_duplicates_go_where_no_line_repeats(spark, planted):
    rnd = random.Random(7)
    line = words(rnd, "abcdefgh", 400)
    rows = [(1, line, "en", "web", 1), (2, line, "en", "web", 1), (3, words(rnd, "abcdefgh", 400), "en", "web", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, docs, planted[0]).collect()) == [1, 3]


def test_edited_copies_go(spark, planted):
    """Copies with some words changed, of similarity 0.8 and more, go; those below stay."""
    rnd = random.Random(8)

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows, gone = [], set()
    for group in range(12):
        first = words(rnd, "abcdefgh", 200)
        rows.append((len(rows), first, "en", "web", 1))
        for edits in (1, 2, 3, 4, 10, 20):
            edited = first.split()
            for at in rnd.sample(range(5, 195), edits):
                edited[at] = f"edit{group}x{edits}x{at}"
            a, b = shingles(first), shingles(" ".join(edited))
            alike = len(a & b) / len(a | b) >= 0.8
            assert alike == (edits <= 4)
            gone |= {len(rows)} if alike else set()
            rows.append((len(rows), " ".join(edited), "en", "web", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, docs, planted[0]).collect()}
    assert kept == {r[0] for r in rows} - gone


def test_fingerprints_group_documents(spark, planted):
    """Texts of one fingerprint whose shingle sets hardly overlap: a long repeated part, and an end of their own."""
    rnd = random.Random(9)
    part = words(rnd, "abcdefgh", 21)
    rows = [(i, " ".join([part] * 50 + [words(rnd, "abcdefgh", 30)]), "en", "web", 1) for i in range(3)]
    rows += [(3, words(rnd, "abcdefgh", 400), "en", "web", 1), (None, rows[0][1], "en", "web", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, docs, planted[0]).collect()} == {0, 3, None}


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_links_hidden_by_a_bucket(spark, planted):
    """Pairs of 0.8 among many texts of one template that are less alike: every link counts, whichever texts share its buckets."""
    rnd = random.Random(10)
    base = words(rnd, "abcdefgh", 200).split()

    def edited(text, n, name):
        out = list(text)
        for at in rnd.sample(range(5, 195), n):
            out[at] = f"{name}x{at}"
        return out

    texts = [edited(base, 4, f"own{i}") for i in range(600)]
    texts += [edited(texts[i], 4, f"copy{i}") for i in range(560, 600)]
    sets = [shingles(" ".join(t)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 9 * common >= 4 * (len(sets[i]) + len(sets[j])) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert len(set(root)) > 20 and all(root[i] == root[i + 40] for i in range(560, 600))
    docs = spark.createDataFrame([(i, " ".join(t), "en", "web", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    # In small blocks; below in blocks of the usual size.
    joined = components(shingle_dedup.links(docs, 5, 16)).collect()
    assert {r["node"]: r["component"] for r in joined} == {i: r for i, r in enumerate(root) if i != r}
    near = simhash.groups(docs).filter("doc_id <> component_id").collect()
    for r in near:
        low, high = sorted((root[r["doc_id"]], root[r["component_id"]]))
        root = [low if x == high else x for x in root]
    assert {r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, docs, planted[0]).collect()} == set(root)


def test_groups_follow_both_kinds_of_links(spark, planted):
    """0 and 2 have one fingerprint, 1 and 2 like sets; 0 and 1 have neither. Of an id with two rows one counts."""
    rnd = random.Random(11)
    part, first, second, third = (words(rnd, "abcdefgh", n) for n in (21, 30, 30, 100))
    rows = [(0, " ".join([part] * 50 + [first])), (1, f"{part} {second}"), (2, " ".join([part] * 50 + [second])), (3, "A " + third), (3, " ".join([part] * 50 + [first]))]
    docs = spark.createDataFrame([(*r, "en", "web", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r["doc_id"], r["text"][:2]) for r in corpus_pipeline.near_deduplication(spark, docs, planted[0]).collect()) == [(0, part[:2]), (3, "A ")]


def test_empty_tables(spark, planted, tmp_path):
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{planted[0]}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) == {"op2_quality_rules", "op4_mixing", "op13_phrase_mining"} and set(queries.ORACLE) <= set(entry.oracle_sql())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
