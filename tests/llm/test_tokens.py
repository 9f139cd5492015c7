import random
import tracemalloc
import unicodedata

import numpy as np
import pytest

from tidelog.llm import bpe, letters, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["'", "s", "t", "re", "'re", "'ll", " ", "  ", "\n", "\t", "a", "É", "é", "1", "２", "!", "#", "<|endoftext|>", "<|startoftext|>", "\x85", "\xa0", "\u3000", "ß", "Σ", "İ", "\x1c", "\0", "漢", "😀", "ﬁ", "가", "ᄀ", "ᅡ"]


def strange(n, seed=5):
    rng = random.Random(seed)
    return [None, "", " ", "x" * 5000, *("".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(n))]


def config(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def rows():
    return [(k, t, f"clash{k}") for k, t in enumerate(strange(400))] + [(None, "no id", "x"), (7, "twice", "x"), (7, "twice", "x")]


def test_counts_equal_the_library(spark, rows):
    lib = tokenizers.Tokenizer.from_str(config("byte_bpe_50k.json"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, config("byte_bpe_50k.json")).collect())
    want = sorted((str(i), len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in rows)
    assert got == want


def test_boundaries_do_not_depend_on_the_cut_into_chunks():
    to, begins = token_counts.splitter()
    rng = np.random.default_rng(1)
    for _ in range(50):
        text = rng.integers(0, 9, rng.integers(1, 300)).astype(np.uint8)
        state, want = 0, []
        for k, s in enumerate(text):
            if begins[s, state]:
                want.append(k)
            state = to[s, state]
        for length in (1, 7, 64, 1024):
            assert token_counts.boundaries(text, to, begins, length).tolist() == want


def test_encoding_and_decoding_equal_the_library(spark, rows):
    lib = tokenizers.Tokenizer.from_str(config("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids, r.decoded) for r in bpe.encode_documents(docs, config("word_bpe_49k.json")).collect())
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(docs, config("byte_bpe_50k.json")).collect() == []
    assert bpe.digests(bpe.encode_documents(docs, config("word_bpe_49k.json"))).collect() == []


def test_merges_take_ranks_in_order():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    merges = bpe.Merges(vocab, [["b", "c"], ["a", "b"], ["a", "bc"]])
    assert merges.merge_all([[0, 1, 2], [0, 1, 0, 1, 2], [], [1]]) == [[5], [3, 5], [], [1]]


SHORT = ["a", "!", "\n", "7 7 7", "zq", "", None]


def test_texts_without_a_ranked_pair(spark):
    """Alone, and as the only new words of a late batch."""
    byte, word = (tokenizers.Tokenizer.from_str(config(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    counter, encoder = token_counts.Counter(config("byte_bpe_50k.json")), bpe.WordBpe(config("word_bpe_49k.json"))
    for text in ["a first batch of words", *SHORT]:
        assert counter.count([text or ""]) == [len(byte.encode(text or "", add_special_tokens=False).ids)]
        assert [ids for _, ids, _ in encoder.encode([text or ""])] == [" ".join(map(str, word.encode(text or "", add_special_tokens=False).ids))]
    for text in SHORT:
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert token_counts.count_tokens(docs, config("byte_bpe_50k.json")).first().n_tokens == len(byte.encode(text or "", add_special_tokens=False).ids)
        assert bpe.encode_documents(docs, config("word_bpe_49k.json")).first().n_tokens == len(word.encode(text or "", add_special_tokens=False).ids)


def test_every_code_point_is_classed_as_by_the_library():
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x14400 or 0x16000 <= c < 0x18E00 or 0x1C000 <= c < 0x20000 or c % 97 == 0)]
    texts = [f"x{chr(c)}1{chr(c)} {chr(c)}'s" for c in codes]
    lib = tokenizers.Tokenizer.from_str(config("byte_bpe_50k.json"))
    got = token_counts.Counter(config("byte_bpe_50k.json")).count(texts)
    assert [hex(c) for c, n, e in zip(codes, got, lib.encode_batch(texts, add_special_tokens=False), strict=True) if n != len(e.ids)] == []
    lib = tokenizers.Tokenizer.from_str(config("word_bpe_49k.json"))
    got = bpe.WordBpe(config("word_bpe_49k.json")).encode(texts)
    assert [hex(c) for c, (_, ids, _), e in zip(codes, got, lib.encode_batch(texts, add_special_tokens=False), strict=True) if ids != " ".join(map(str, e.ids))] == []


def test_counts_do_not_depend_on_what_is_compiled(monkeypatch):
    """Steps one by one, and a start anew whenever more than a few states are known."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbz eé漢=-_\n\t1'") for _ in range(rng.randrange(1, 90))) for _ in range(600)] + ["=" * 700, " " * 300, "xyz" * 2000]
    lib = tokenizers.Tokenizer.from_str(config("byte_bpe_50k.json"))
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.Counter(config("byte_bpe_50k.json"))
    assert counter.count(texts) == want and counter.count(texts) == want
    for few, states in ((0, 10), (10**9, 10), (48, 200)):
        monkeypatch.setattr(token_counts, "FEW", few)
        monkeypatch.setattr(token_counts, "STATES", states)
        counter.clear()
        assert [n for k in range(0, len(texts), 50) for n in counter.count(texts[k : k + 50])] == want


def test_sequences_of_marks_are_composed_as_by_the_library():
    """Every combining mark with every seventh and with all that are newer than the library's tables, then longer sequences."""
    from tokenizers.normalizers import NFC

    rng, plain = random.Random(6), NFC()
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    newer = [m for m in marks if letters.NEWER.match(m)]
    bases = ["a", "q", "\u05d0", "\u1100", "\uac00", "\u09c7", "\U00011099", "\U00011935", "\U00011938", "\U00011930", ""]
    texts = [rng.choice(bases) + a + b for a in marks for b in marks[::7] + newer]
    texts += ["".join(rng.choice(marks + bases * 20) for _ in range(rng.randrange(2, 9))) for _ in range(100_000)]
    assert len(newer) > 100
    assert [t for t in texts if bpe.composed(t) != plain.normalize_str(t)][:3] == []
    lib = tokenizers.Tokenizer.from_str(config("word_bpe_49k.json"))
    some = texts[::50]
    got = [ids for _, ids, _ in bpe.WordBpe(config("word_bpe_49k.json")).encode(some)]
    assert got == [" ".join(map(str, e.ids)) for e in lib.encode_batch(some, add_special_tokens=False)]


def test_what_a_worker_remembers_is_small():
    encoder = bpe.WordBpe(config("word_bpe_49k.json"))
    words = [f"{a}{b}ing" for a in ("walk", "talk", "read", "sort", "join", "scan") for b in range(10_000)]
    tracemalloc.start()
    try:
        want = [n for n, _, _ in encoder.encode(words)]
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert [len(encoder.memo[w]) for w in words] == want
    assert kept < 240 * len(words) and most < 660 * len(words)
