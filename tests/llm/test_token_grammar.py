import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from corpuscle.config import scratch_path
from corpuscle.llm import queries, token_grammar as tg

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def expected(tokenizer, pairs, end_id=2):
    out, start = [], 0
    for doc_id, text in pairs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out, start


def test_words_as_whole_texts(tokenizer):
    import pyarrow as pa

    rng = random.Random(4)
    signs = [" ", "\t", "\n", "\v", "\f", "\r", "\x85", "\xa0", "　", "a", "B", "H", "é", "é", "̱", "1", "9", "'s", "'", "!", ".", ",", "中", "😀", "İ", "Σ",
             "<|endoftext|>", "<|ENDOFTEXT|>", "\0", "\x1c", "word.", "Word", "WORD,"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, offsets = tg.WordTokens(FILE)(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_latin_words_go_to_the_model(tokenizer, monkeypatch):
    """Words of Latin letters, with their stops apart, need no call that goes through the whole tokenizer."""
    import pyarrow as pa

    tokens, slow = tg.WordTokens(FILE), []
    learn = tokens._learn_one_by_one
    monkeypatch.setattr(tokens, "_learn_one_by_one", lambda words: slow.extend(words) or learn(words))
    letters = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and c != "İ")
    texts = ["Élan café. über, naïve ÆØÅ!? ŉ ǅ ßtraße; " + letters, " ".join(letters), ". ".join(letters) + ".", "İ. éİ, é̱. ÷. 1é."]
    ids, offsets = tokens(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert not [w for w in slow if w[0] in letters and "İ" not in w and "̱" not in w]


def test_tasks_of_a_worker_share_the_words():
    assert tg._word_tokens(FILE, True) is tg._word_tokens(FILE, True)


@pytest.mark.parametrize("vocabulary", [50, 70000])
def test_grammar_round_trip(vocabulary):
    rng = np.random.default_rng(1)
    kind = np.uint16 if vocabulary < 1 << 16 else np.uint32
    passage = rng.integers(0, 50, 40)
    parts = [passage[: rng.integers(1, 40)] if i % 2 else rng.integers(0, 50, rng.integers(1, 30)) for i in range(2000)] + [np.full(5001, 7)] * 2
    lengths = np.array([len(p) for p in parts])
    tokens = np.concatenate(parts).astype(kind)
    closed = np.zeros(len(tokens), bool)
    closed[np.cumsum(lengths) - 1] = True
    symbols, ends, rules = tg.compress(tokens.copy(), closed.copy(), vocabulary, least=8)
    assert len(symbols) < 0.7 * len(tokens) and ends.sum() == len(parts)
    decoder = tg.Decoder(rules, tg.expansion_lengths(rules, vocabulary), vocabulary)
    assert (decoder.expand(symbols, step=100) == tokens).all()
    # No symbol reaches over the end of a document.
    widths = np.diff(np.flatnonzero(ends), prepend=-1)
    sums = np.add.reduceat(decoder.lengths[symbols], np.cumsum(widths) - widths)
    assert (sums == lengths).all()
    for first, beyond in [(0, 1), (17, 900), (len(tokens) - 3, len(tokens))]:
        assert (decoder.between(symbols, first, beyond) == tokens[first:beyond]).all()


def test_first_round_takes_the_most_frequent_pair():
    tokens = np.array([1, 2] * 40 + [3, 1, 2, 4] * 10 + [5, 6] * 3, np.uint16)
    closed = np.zeros(len(tokens), bool)
    rules = tg.compress(tokens, closed, 10, least=20)[2]
    assert rules[0].tolist() == [1, 2]


def test_runs_of_one_symbol_settle_in_few_steps():
    tokens = np.zeros(1 << 20, np.uint16)
    symbols, _, rules = tg.compress(tokens, np.zeros(len(tokens), bool), 1)
    assert len(symbols) <= 32 and len(rules) <= 20


def test_write_and_read(spark, rows, tokenizer):
    rng = random.Random(2)
    words = ["the", "cat,", "Été", "sat.", "on", "12", "mat!", "x" * 300]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    data = [(i, t, "src") for i, t in enumerate(texts)]
    data[7] = (7, None, None)
    data[8] = (8, "", "src")
    data[9] = (9, "long " * 30000, "src")
    rng.shuffle(data)
    docs = rows("doc_id bigint, text string, start string", *data)
    path = scratch_path(spark, "tokens")
    tg.write_tokens(docs, path, FILE, 2, partition_bytes=20000, shard_tokens=1500, least=8)
    assert spark.read.parquet(path).count() > 5
    got = [tuple(r) for r in tg.read_tokens(spark, path).selectExpr("doc_id", "start", "n_tokens", "crc32(tokens)").orderBy("doc_id").collect()]
    want, total = expected(tokenizer, sorted((d[0], d[1]) for d in data))
    assert got == want
    every = [t for r in tg.read_range(spark, path, 0, total).orderBy("start").collect() for t in r.tokens]
    assert len(every) == total
    for first, beyond in [(0, 5), (1400, 3100), (total - 2, total)]:
        assert [t for r in tg.read_range(spark, path, first, beyond).orderBy("start").collect() for t in r.tokens] == every[first:beyond]


def test_repeats_null_ids_and_empty_table(spark, rows, tokenizer):
    docs = rows("doc_id bigint, text string", *[(5, "a b c")] * 400, (None, "x"), (5, "a b c d"), (1, "y"))
    path = scratch_path(spark, "tokens")
    tg.write_tokens(docs, path, FILE, 2, partition_bytes=100, shard_tokens=50)
    got = tg.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1] + [5] * 401
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]
    assert max(r[0] for r in spark.read.parquet(path).selectExpr("size(ids)").collect()) < 200  # one id over many shards
    path = scratch_path(spark, "tokens")
    tg.write_tokens(docs.limit(0), path, FILE, 2)
    assert tg.read_tokens(spark, path).count() == 0


def test_query(spark, tokenizer):
    sf_dir = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries.QUERIES["op11_token_output"](spark, sf_dir).orderBy("doc_id").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert got == expected(tokenizer, [tuple(r) for r in docs])[0]
