import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidelog.llm import exact_spans, simhash
from tidelog.llm.components import components


def corpus(seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh ", "aé \n"][seed % 3]
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [text(rng.randrange(40, 200)) for _ in range(6)]
    rows = [(3 * k + 1, "".join(rng.choice([*pool, text(rng.randrange(120))]) for _ in range(rng.randrange(6)))) for k in range(25)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a" * 300), (103, "a" * 120), (104, None), (105, ""), (100, rows[3][1]), (None, rows[4][1]), (106, pool[0] * 400)]
    return rows


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            if i is not None:
                first[raw[s : s + length]] = min(i, first.get(raw[s : s + length], i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if i is not None and first[raw[s : s + length]] < i:
                gone[s : s + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((str(i), len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_removed_bytes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, blob string, pack int").repartition(3)
    got = exact_spans.remove_repeats(docs)
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == brute(rows)


def test_packs_and_buckets_follow_the_bytes(spark, monkeypatch):
    """However many shuffle partitions there are, none holds more than a bound; results are the same."""
    assert exact_spans.dealt(0, 4) == (8, 4) and exact_spans.dealt(1 << 20, 4) == (8, 4)
    for size in (1 << 30, 6 << 30):
        packs, buckets = exact_spans.dealt(size, 4)
        assert size / packs <= 8 << 20 and size / buckets <= 12 << 20
    monkeypatch.setattr(exact_spans, "PACK_BYTES", 500)
    monkeypatch.setattr(exact_spans, "BUCKET_BYTES", 700)
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, blob string, pack int")
    got = exact_spans.remove_repeats(docs)
    plan = got._jdf.queryExecution().analyzed().toString()
    packs = exact_spans.dealt(sum(len((r[1] or "").encode()) for r in rows), 4)[0]
    assert packs > 8 and f"{packs} as bigint" in plan
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == brute(rows)


def test_a_bucket_is_sorted_in_parts(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(100)] * 2
    pack = exact_spans.Pack(pa.table({"id": pa.array(range(200), pa.int64()), "tag": pa.array(range(200), pa.int64()), "text": texts}), 1)
    flags = exact_spans._flags(exact_spans._rows(0, [*pack.anchors()]))
    pack.chosen(dict(zip(flags.column("bucket").to_pylist(), flags.column("blob").to_pylist(), strict=True)))
    sorted_at_once, real = [], exact_spans.smallest
    monkeypatch.setattr(exact_spans, "smallest", lambda lengths, least, text: sorted_at_once.append(len(text)) or real(lengths, least, text))
    answers = exact_spans._answers(exact_spans._rows(0, [*pack.requests()]))
    assert len(sorted_at_once) > 8 and max(sorted_at_once) < sum(sorted_at_once) / 4
    gone = pack.removed(dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True)))
    assert gone.sum() == len(gone) // 2 and gone[len(gone) // 2 :].all()


def test_long_documents_come_in_parts(spark, monkeypatch):
    """As texts do that are too long for 28-bit positions; worked out in the test's own process."""
    rng = np.random.default_rng(1)
    pool = [bytes(rng.integers(97, 100, 300, dtype=np.uint8)) for _ in range(3)]
    texts = [b"".join(pool[int(k)] for k in rng.integers(0, 3, n)) for n in (4, 9, 2)]
    text, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    starts_of = lambda found: {(int(s), int(h)) for h, a, z in zip(*found, strict=True) for s in range(a, z + 1)}
    want = starts_of(exact_spans.segments(text, ends))
    assert len(want) == sum(len(t) - 49 for t in texts)
    monkeypatch.setattr(exact_spans, "_SLICE", 64)
    for longest in (50, 97, 500):
        monkeypatch.setattr(exact_spans, "_LONGEST", longest)
        assert starts_of(exact_spans.segments(text, ends)) == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_spans.remove_repeats(docs).collect() == []
    assert simhash.near_duplicates(docs).collect() == []


def test_two_stage_order_is_the_order_of_suffixes():
    rng = random.Random(2)
    for _ in range(20):
        raw = bytes(rng.choice(rng.choice([b"ab", b"abc", bytes(range(256))])) for _ in range(rng.randrange(60, 300)))
        text = np.frombuffer(raw + bytes(64), np.uint8)
        wanted = np.array([k < len(raw) and rng.random() < 0.6 for k in range(len(text))])
        order, _ = exact_spans.sort_suffixes(text, wanted)
        keys = [text.tobytes()[k : k + 50] for k in order]
        assert keys == sorted(keys)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_pair_within_the_radius_shares_a_table():
    masks = [m % (1 << 64) for m in simhash.masks()]
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        assert any(not m & sum(1 << b for b in bits) for m in masks)
    rng = random.Random(1)
    for radius in (1, 2, 4, 5, 6):
        masks = [m % (1 << 64) for m in simhash.masks(radius)]
        assert min(m.bit_count() for m in masks) >= 24
        for _ in range(3000):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & bits for m in masks)


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        text = rng.choices(words, k=150)
        for _ in range(rng.randrange(1, 6)):
            rows.append((len(rows) * 2, " ".join(text)))
            text = [*text]
            text[rng.randrange(150)] = rng.choice(words)
    rows += [(1, ""), (3, None), (5, " \t"), (7, "One"), (9, "one"), (None, "one"), (11, "one two"), (0, rows[0][1])]
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((str(i), f"{prints[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    prose = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    texts = [prose(400) for _ in range(12)]
    item = "the quick question asks how far a train goes in 3 hours when it leaves at noon from the old station"
    near = texts[0].split()
    near[200] = "changed"
    texts += [texts[0], " ".join(near), prose(300) + " " + item, "too short", "again and again " * 100, texts[2][:900] + " token = abcdef123456 end", None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept[0] == [*range(15), 17]
    assert kept[1] == [*range(12), 14, 17]
    assert kept[2] == kept[3] == [*range(12), 17]
    assert "token" not in docs.where("doc_id = 17").first().text
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in final.collect()) == kept[3]
    assert final.where("n_tokens > 0").count() == len(kept[3])


def test_wide_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.wide_masks()]
    rng = random.Random(3)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), simhash.WIDE))
        assert any(not m & bits for m in masks)


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(600)]
    rows, distances = [], []
    for _ in range(60):
        text = rng.choices(words, k=90)
        rows.append((len(rows), " ".join(text)))
        for n in (1, 2, 3, 4, 6):
            near = [*text]
            for k in rng.sample(range(90), n):
                near[k] = rng.choice(words)
            rows.append((len(rows), " ".join(near)))
    rows += [(2, "another text of the same id as one above"), (2, "another text of  the same ID as one above"), (None, "one"), (900, ""), (901, None), (902, "one")]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root, missed = list(range(len(rows))), 0

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            distances.append((fingerprint(rows[a][1]) ^ fingerprint(rows[b][1])).bit_count())
            if distances[-1] <= simhash.WIDE:  # what lies further apart is not compared
                root[find(a)] = find(b)
            else:
                missed += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    assert 6 < max(distances) and missed <= 0.1 * len(distances)
    got = sorted(r.doc_id for r in simhash.keep_unlike(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None)
    assert got == sorted(least.values())


def test_different_texts_of_one_id_stay(spark):
    rng = random.Random(5)
    prose = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(120))
    a, b = prose(), prose()
    for rows in ([(1, a), (1, b)], [(1, b), (1, a)], [(1, a), (1, b), (1, a), (2, b + " end")]):
        kept = simhash.keep_unlike(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, kept)) == sorted([(1, a), (1, b)])


def test_clusters_of_many_blocks(spark, monkeypatch):
    """The kept rows don't depend on how a cluster is dealt out."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):
        words = [*base]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(150)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(r.doc_id for r in simhash.keep_unlike(docs).collect())
    monkeypatch.setattr(simhash, "BLOCK", 8)
    assert sorted(r.doc_id for r in simhash.keep_unlike(docs).collect()) == want and 0 in want and len(want) < 30
