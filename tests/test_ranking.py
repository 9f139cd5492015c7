"""The six-part ranking against a plain one."""

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tidelog.operators import ranking
from tidelog.operators.retrieval import terms, tfidf

DOCS = [
    (1, "Failed login for admin from 10.0.0.9", "s1", "sshd"),
    (2, "authentication succeeded: user bob, EventData.CommandLine=/usr/bin/id", "s1", None),
    (3, "authenticated session opened", "s2", "pam"),
    (4, "", "s2", None),
    (5, None, "s3", None),
    (6, "Failed failed FAILED logins x", "s3", "sshd"),
    (7, "unrelated text entirely", "s9", ""),
]


def plain(docs, question, fields, tokens):
    def vector(text):
        low = (text or "").lower()
        words = re.findall(r"\b[a-z0-9][a-z0-9_.:/-]*\b", low)
        grams = []
        for w in low.split():
            p = f" {w} "
            grams += [p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1)]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]), Counter(grams)

    n, vectors, asked = len(docs), {d[0]: vector(d[1]) for d in docs}, vector(question)
    cosine = dict.fromkeys(vectors, 0.0)
    for kind, share in ((0, 0.65), (1, 0.35)):
        df = Counter(g for v in vectors.values() for g in v[kind])
        weigh = lambda v: {g: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[g])) + 1) for g, c in v.items() if g in df}  # noqa: B023, E731
        q = weigh(asked[kind])
        for k, v in vectors.items():
            w = weigh(v[kind])
            dot, size = sum(w[g] * q[g] for g in w if g in q), math.sqrt(sum(x * x for x in w.values()) * sum(x * x for x in q.values()))
            cosine[k] += share * dot / size if dot else 0.0
    wanted, mean = tokens[None], sum(map(len, (tokens[d[0]] for d in docs))) / n
    df = {t: sum(t in tokens[d[0]] for d in docs) for t in wanted}
    bm25 = {d[0]: sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(tokens[d[0]]) / mean)) for t in wanted if t in tokens[d[0]]) for d in docs}
    even = lambda xs: {k: (x - min(xs.values())) / (max(xs.values()) - min(xs.values())) for k, x in xs.items()}
    bm, co = even(bm25), even(cosine)
    out = {}
    for d in docs:
        common = len(set(wanted) & set(tokens[d[0]]))
        entities = sum(e in (d[1] or "").lower() for p in ranking.ENTITIES for e in re.findall(p, question.lower()))
        named = sum(len(set(wanted) & set(fields[f])) for f, value in zip(fields, d[1:]) if value)
        overlap = common / math.sqrt(len(wanted) * len(tokens[d[0]])) if tokens[d[0]] else 0.0
        out[d[0]] = 0.5 * bm[d[0]] + 0.3 * co[d[0]] + 0.1 * overlap + 0.07 * common / len(wanted) + 0.02 * min(entities, 3) / 3 + 0.01 * min(named, 4) / 4, entities
    return out


def test_scores_equal_a_plain_ranking(spark):
    df = spark.createDataFrame(DOCS, "id long, text string, session string, process string")
    fields = ["text", "session", "process"]
    index = ranking.build(df, "id", "text", fields, F.col("session"))
    of = lambda rows: {r.k: r.t for r in rows.select("k", terms(F.col("x")).alias("t")).collect()}
    named = of(spark.createDataFrame([(f, f) for f in fields], "k string, x string"))
    for question in ("failed logins of the process", "authentication commandline", "who came from 10.0.0.9, session s1?", "zzz"):
        tokens = of(spark.createDataFrame([*((d[0], d[1]) for d in DOCS), (None, question)], "k long, x string"))
        parts = {r.id: r for r in index.parts(question).collect()}
        assert set(parts) == {d[0] for d in DOCS}
        got = {r.id: r.score for r in index.search(question).collect()}
        if question == "zzz":
            assert list(got) == [1, 2, 3, 4, 5, 6, 7] and set(got.values()) == {0.0}
            continue
        want = plain(DOCS, question, named, tokens)
        assert all(abs(got[k] - want[k][0]) < 1e-9 for k in got)
        best, entities = max(s for s, _ in want.values()), any(e for _, e in want.values())
        kept = {k for k, (s, _) in want.items() if s > 1e-6 and (entities or s >= 0.45 * best)}
        chunks = {d[2] for d in DOCS if d[0] in kept}
        assert set(got) == kept | {d[0] for d in DOCS if d[2] in chunks}
    assert [r.id for r in index.search("failed login", 1).collect()] == [6]


def test_morphology_is_found_by_grams(spark):
    df = spark.createDataFrame(DOCS, "id long, text string, session string, process string")
    found = {r.id: r.cosine for r in ranking.build(df, "id", "text").cosines("authenticating").collect()}
    assert min(found[2], found[3]) > 5 * found.get(7, 0.0)


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert ranking.hybrid(df, "failed login", "id", "text").count() == 0


def test_tfidf_reads_texts_no_more_than_it_must_and_joins_rows_of_one_id(spark, tmp_path):
    docs = [(1, "apache license apache"), (1, "version two"), (2, "the License, version 2"), (None, "apache version"), (None, "the apache"), (3, "nothing the nothing"), (4, None), (5, "a b c")]
    spark.createDataFrame(docs, "id long, text string").write.parquet(str(tmp_path / "docs"))
    out = tfidf(spark.read.parquet(str(tmp_path / "docs")), "apache license", "id", "text")
    assert not any("/docs/" in f for f in out.inputFiles())
    counts = {}
    for k, text in docs:
        words = re.findall("[a-z0-9]{2,}", (text or "").lower())
        counts.setdefault(k, Counter()).update([*words, *map(" ".join, zip(words, words[1:]))])
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    q = {t: idf[t] for t in ("apache", "license", "apache license") if t in idf}
    want = {}
    for k, c in counts.items():
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        if any(t in w for t in q):
            want[k] = sum(w.get(t, 0) * x for t, x in q.items()) / math.sqrt(sum(x * x for x in w.values()) * sum(x * x for x in q.values()))
    got = {r.id: r.score for r in out.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tasks_of_the_index_follow_the_texts(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"login {k} from 10.0.0.{k % 9}") for k in range(200)], "id long, text string")
    seen = []
    for texts, frequent in ((1000, 100), (5, 2), (5, 1000)):
        monkeypatch.setattr(ranking, "TEXTS", texts)
        monkeypatch.setattr(ranking, "FREQUENT", frequent)
        index = ranking.build(df, "id", "text")
        seen.append((len(index.postings.inputFiles()), {r.id: (round(r.words, 9), round(r.grams, 9)) for r in index.rows.collect()}))
    assert seen[0][1] == seen[1][1] == seen[2][1] and len(seen[0][1]) == 200
    assert seen[1][0] > 4 * seen[0][0]


def test_postings_equal_those_of_columns(spark, monkeypatch):
    """Texts are taken apart in batches, each distinct word once: the same grams, hashes and counts as by columns, with repeats, blanks and letters beyond ASCII."""
    monkeypatch.setattr(ranking, "CHARACTERS", 60)
    texts = ["user 42 by user 42", "", None, "  a\tb  A ", "Ünïcode/é 😀😀 x.y-z", "aaaa aaaa aaaa", "10.0.0.1 from 10.0.0.1", "\n", "word " * 40, "é"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    want = Counter()
    for r in df.select("id", ranking.phrases(F.col("text")).alias("p"), F.flatten(F.transform(ranking.between_blanks(F.col("text")), ranking.grams)).alias("g")).collect():
        want.update([(r.id, False, g) for g in r.p] + [(r.id, True, g) for g in r.g])
    postings = ranking.build(df, "id", "text").postings
    rows = ranking.texts_of(postings, "gram", "g").collect()
    assert len(rows) == len(want) and {(r.id, r.gram, r.g): round(r.tf, 9) for r in rows} == {k: round(1 + math.log(n), 9) for k, n in want.items()}
    assert ranking.build(df.limit(0), "id", "text").postings.count() == 0
    split = [pa.RecordBatch.from_pydict({"id": [1, 2], "words": [["a", "a"]] * 2, "parts": [["a", "a"]] * 2})]
    hashed, real = [], ranking._hashes
    monkeypatch.setattr(ranking, "CHARACTERS", 1 << 20)
    monkeypatch.setattr(ranking, "_hashes", lambda xs: hashed.append(list(xs)) or real(xs))
    assert sum(b.num_rows for b in ranking.counted(iter(split))) == 3 and hashed == [["a"], ["a a"], [" a "]]
