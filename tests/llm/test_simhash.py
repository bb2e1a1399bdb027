import random
import re

import pytest
import xxhash

from corpuscle.llm import simhash
from corpuscle.llm.components import components


def brute_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) > size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marked, radius=3):
    root = list(range(len(marked)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(marked):
        for j in range(i):
            if (a ^ marked[j][1]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    sets = {}
    for i, (d, _) in enumerate(marked):
        sets.setdefault(find(i), []).append(d)
    return {d: min(x for x in ds if x is not None) for ds in sets.values() for d in ds if d is not None}


TEXTS = ["One two THREE four", "one two three four", "", None, "  \t\n", "Éa b", "a b", "a b c", "a b c a b c a b c", "x\x0by\x0cz w", "x y z w"]


def test_fingerprints(spark):
    rnd = random.Random(1)
    texts = TEXTS + [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(df, 5).collect()}
    assert got == {i: brute_fingerprint(t, 5) for i, t in enumerate(texts)}


def cloud(seed, n):
    """Fingerprints in clusters around a few centres, so that nodes are crowded."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    out = []
    for i in range(n):
        fp = rnd.choice(centres) if i % 3 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 6)):
            fp ^= 1 << rnd.randrange(64)
        out.append((i, fp))
    return out


@pytest.mark.parametrize("node", [4096, 8])
def test_links_as_brute_force(spark, node):
    marked = cloud(node, 300)
    entries = {}
    for d, fp in marked:
        entries.setdefault(fp, d)
    df = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp, d) for fp, d in entries.items()], "fp bigint, first bigint")
    joined = {r["node"]: r["component"] for r in components(simhash.links(df, 3, node)).collect()}
    want = brute_groups(sorted((d, fp) for fp, d in entries.items()))
    assert {d: joined.get(d, d) for d in want} == want


def test_components_of_a_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {i: 7 for i in range(200, 260)}


def test_groups_and_defined_cases(spark):
    rows = [(9, "same text here now", "k"), (4, "same text here now", "k"), (4, "same text here now", "k"), (None, "same text here now", "k"),
            (5, None, "k"), (6, " ", "k"), (7, "quite another text of words", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.groups(df).collect() if r["doc_id"] is not None)
    assert got == [(4, 4), (4, 4), (5, 5), (6, 5), (7, 7), (9, 4)]
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or -1), r["fp"]) for r in kept.collect()) == [(-1, "k"), (4, "k"), (5, "k"), (7, "k")]
    empty = df.limit(0)
    assert simhash.groups(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_long_text(spark):
    text = " ".join(str(i % 977) for i in range(300000))
    df = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id bigint, text string")
    assert {r["component_id"] for r in simhash.groups(df).collect()} == {1}
