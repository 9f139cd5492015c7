"""Queries that SQL can't express, against plain versions of them."""

import itertools
import random
from collections import defaultdict

import pytest
import regex

from tidelog.llm import decontamination, exact_spans, url_filter


def expanded(mined):
    """The smallest token sets of the mined rules."""
    rules, tokens = mined
    of = defaultdict(list)
    for r in tokens.collect():
        of[r.item].append(r.token)
    every = {frozenset(x) for r in rules.collect() for x in itertools.product(*(of[i] for i in r["items"]))}
    return {x for x in every if not any(y < x for y in every)}


def rules_of(rows, letters, support=url_filter.SUPPORT):
    """All token sets that pass support and confidence, and of these the smallest."""
    full = [(set(t), b) for t, b in rows if t or b]
    n, share = len(full), sum(b for _, b in full) / len(full)
    least = max(support * n, url_filter.LEAST)
    good = set()
    for size in range(1, len(letters) + 1):
        for tokens in map(frozenset, itertools.combinations(letters, size)):
            inside = [b for t, b in full if tokens <= t]
            if sum(inside) >= least and sum(inside) >= url_filter.CONFIDENCE * len(inside) and sum(inside) / len(inside) > share:
                good.add(tokens)
    return good, {x for x in good if not any(y < x for y in good)}


def test_mined_rules_equal_all_subsets(spark):
    rng = random.Random(3)
    for twins in (False, True):
        rows = []
        for _ in range(160):
            tokens = {t for t in "abcdef" if rng.random() < 0.45} | {"g"}
            if twins:  # x and y stand where d stands
                tokens |= {"x", "y"} if "d" in tokens else set()
            rows.append((sorted(tokens), rng.random() < (0.9 if {"a", "b", "d"} <= tokens or {"c", "e", "f"} <= tokens else 0.3)))
        rows += [([], True), ([], False)]
        got = expanded(url_filter.mine(spark.createDataFrame(rows, "items array<string>, block boolean")))
        want = rules_of(rows, "abcdefgxy")[1]
        assert got == want and want


def test_matches_equal_subset_tests(spark):
    rng = random.Random(4)
    rules = [(k, rng.sample("abcdefgh", rng.randrange(1, 4))) for k in range(5)]
    urls = [(f"u{k}", [t for t in "abcdefghA" if rng.random() < 0.4]) for k in range(60)]
    tokens = spark.createDataFrame([(t, t.lower()) for t in "abcdefghA"], "token string, item string")
    got = {r.url for r in url_filter.matches(spark.createDataFrame(urls, "url string, items array<string>"), spark.createDataFrame(rules, "rule long, items array<string>"), tokens).collect()}
    assert got == {u for u, items in urls if any(set(t) <= {x.lower() for x in items} for _, t in rules)}


def test_url_verdicts_equal_brute_force(spark):
    """The whole query: parsing, labels, mining and matching, over URLs that share parts."""
    rng = random.Random(11)
    pages, labels, fixed = [], [], {"block": 0, "allow": 0}
    for k in range(400):
        parts = sorted(p for p in ("ads", "news", "win", "blog", "x", "y") if rng.random() < 0.4)
        url = f"http://{rng.choice(['a', 'b'])}.info/" + "/".join(parts) + rng.choice(["", ".php", "?id=1", "?id=2&ref=3"])
        if k % 9 == 0:
            url = pages[rng.randrange(len(pages))][1] if pages else url
        pages.append((k, url))
        if k % 4:
            bad = {"ads", "win"} <= set(parts) or ("x" in parts and "b.info" in url)
            labels.append((k, int(not bad) if rng.random() < 0.9 else int(bad), 0))
    pages += [(900, None), (901, "http://q.net/de/1"), (None, pages[3][1])]

    def tokens(url):
        host, rest = url.split("://")[1].split("/", 1)
        path, _, query = rest.partition("?")
        end = path.rsplit(".", 1)[-1] if "." in path else ""
        return {f"host={h}" for h in host.split(".")} | {f"path={p}" for p in path.split("/") if p} | ({f"end={end}"} if end else set()) | {f"arg={a.split('=')[0]}" for a in query.split("&") if a}

    marks = {k: not q for k, q, _ in labels}
    known = defaultdict(bool)
    for k, url in pages:
        if k in marks:
            known[url] |= marks[k]
    rows = [(sorted(tokens(u)), b) for u, b in known.items()]
    frequent = sorted({t for items, _ in rows for t in items if sum(t in i and b for i, b in rows) >= url_filter.LEAST})
    good = rules_of(rows, frequent)[1]
    assert good and max(map(len, good)) > 1
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = {k: "block" if u and "://" in u and "q.net" not in u and any(g <= tokens(u) for g in good) else "allow" for k, u in pages}
    assert got == want and {"block", "allow"} == set(want.values())


def test_deep_urls_end(spark):
    """URLs that share many path parts: identical parts are one item, so no subsets of them are made."""
    pages = [(k, "http://h.info/" + "/".join(f"p{d}" for d in range(40)) + ("/" + "/".join(f"q{d}" for d in range(30)) if k % 2 else "") + f"/{k}") for k in range(120)]
    labels = [(k, int(k % 2 == 0), 0) for k in range(100)]
    rows = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.page_id: r.verdict for r in rows.collect()} == {k: "block" if k % 2 else "allow" for k, _ in pages}


NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"


def canonical(text):
    """Template and plain words of a text."""
    text = regex.sub(r"(?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", NAME, (text or "").translate({1: None, 2: None, 3: None}))
    text = text.translate({ord(c): None for c in decontamination._PUNCTUATION})
    shape = regex.sub(NAME + r"\p{L}+", NAME, text)
    shape = regex.sub(r"[0-9]+", NUMBER, shape)
    shape = regex.sub(rf"(?<={NUMBER} )(?:{decontamination.UNITS})(?![^ \t\n\x0b\f\r])", UNIT, shape).lower()
    cut = lambda t: [w for w in regex.split(r"[ \t\n\x0b\f\r]+", t) if w]
    return cut(shape), cut(text)


def leaks(docs, bench):
    slot = lambda w: any(c in w for c in (NAME, NUMBER, UNIT))
    size, index, total = decontamination.WINDOW, defaultdict(list), defaultdict(set)
    for item, text in bench:
        shape, plain = canonical(text)
        for k in range(len(shape) - size + 1):
            w = tuple(shape[k : k + size])
            if sum(not set(x) <= {NAME, NUMBER, UNIT} for x in w) >= decontamination.LITERALS:
                index[w].append((item, k, plain[k : k + size]))
                total[item].add(k)
    out = {}
    for doc, text in docs:
        shape, plain = canonical(text)
        lines = defaultdict(lambda: (set(), set()))
        for k in range(len(shape) - size + 1):
            for item, at, values in index.get(tuple(shape[k : k + size]), ()):
                places, pairs = lines[item, k - at]
                places.add(at)
                pairs |= {(a, b) for s, a, b in zip(shape[k : k + size], values, plain[k : k + size], strict=True) if slot(s)}
        held = defaultdict(set)
        for (item, _), (places, pairs) in lines.items():
            if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                held[item] |= places
        out[doc] = sorted(i for i, p in held.items() if len(p) >= decontamination.SHARE * len(total[i]))
    return out


def test_contaminated_documents_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["apple", "river", "Anna", "Peter", "Maria", "12", "7", "km", "kg", "sold", "went", "to", "and,", "the", "over.", "days"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(k, say(rng.randrange(4, 25))) for k in range(12)]
    docs = []
    for k in range(120):
        parts = [say(rng.randrange(30))]
        for _, text in rng.sample(bench, rng.randrange(3)):
            own = text.split()
            if rng.random() < 0.5:
                swap = dict(zip(["Anna", "Peter", "12", "7"], rng.sample(["Lena", "Boris", "99", "5"], 4), strict=True))
                own = [swap.get(w, w) for w in own]
            own = own[rng.randrange(3) :] if rng.random() < 0.5 else own
            parts += [" ".join(own), say(rng.randrange(10))]
        docs.append((k, "\n".join(parts)))
    want = leaks(docs, bench)
    got = {r.doc_id: r["items"] for r in decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want
    assert 10 < sum(map(bool, want.values())) < 110


def test_blobs_round_trip():
    import numpy as np

    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.empty(0, np.int64), np.array([1, 255], np.uint8)]
    back = exact_spans.open_blob(exact_spans.pack_blob(*arrays), np.uint64, np.int64, np.uint8)
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, back, strict=True))


REPARAMETERISED = [
    ("Anna buys 3 apples and 5 pears in the old market and pays 9 dollars for all of them.", "Boris buys 4 apples and 4 pears in the old market and pays 7 dollars for all of them.", "values become equal"),
    ("The shop sells 2 red lamps before noon and then it sells 2 blue lamps in the afternoon, how many lamps did it sell?", "The shop sells 3 red lamps before noon and then it sells 5 blue lamps in the afternoon, how many lamps did it sell?", "equal values differ"),
    ("Peter runs 6 km. Maria walks home. Anna rides far.", "Lena runs 8 km. Olga walks home. Boris rides far.", "names at starts"),
]


def test_reparameterised_items_are_found(spark):
    bench = spark.createDataFrame([(k, item) for k, (item, _, _) in enumerate(REPARAMETERISED)], "item_id long, text string")
    docs = [(k, "some words before it. " + text + " And some more words after it") for k, (_, text, _) in enumerate(REPARAMETERISED)]
    docs += [(10, "The shop opens before noon and sells nothing in the afternoon"), (11, None), (12, "Lena runs"), (13, "a few words of small letters only")]
    got = {r.doc_id: r["items"] for r in decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench, reworded=True).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 10: [], 11: [], 12: [], 13: []}


def test_rows_without_an_id_or_with_the_same_one_are_tested_apart(spark):
    item = "in the quiet morning the old miller carried nine heavy sacks of flour over the narrow bridge to the market"
    words = item.split()
    halves = [" ".join(words[:11]) + " and nothing more", "something else " + " ".join(words[11:])]
    rows = [(None, halves[0]), (None, halves[1]), (3, halves[0]), (3, halves[1]), (None, item), (3, "clean"), (3, item), (3, item)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    for reworded in (False, True):
        got = sorted((str(r.doc_id), r.contaminated) for r in decontamination.decontaminate(docs, bench, reworded=reworded, share=0.6).collect())
        assert got == sorted((str(i), t == item) for i, t in rows)
        kept = decontamination.keep_clean(docs, bench, reworded=reworded, share=0.6).collect()
        assert sorted(map(str, map(tuple, kept))) == sorted(str(r) for r in rows if r[1] != item)


def test_common_windows_are_looked_for_only_where_needed(spark):
    """Items with one common passage: documents with that passage alone meet none of them, and rare places decide."""
    common = "please read the following passage and then answer the question below"
    bench = [(k, f"{common} about w{k}x of w{k}y with w{k}z and w{k}u for w{k}v near w{k}t from w{k}s after w{k}r until w{k}q") for k in range(30)]
    letters = str.maketrans("0123456789", "abcdefghij")  # numbers would be one placeholder
    bench = [(k, t.translate(letters)) for k, t in bench]
    items = spark.createDataFrame(bench, "item_id long, text string")
    docs = [(100, common + " of this text"), (101, bench[7][1]), (102, "before it " + bench[29][1] + " behind it")]
    got = {r.doc_id: r["items"] for r in decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {100: [], 101: [7], 102: [29]} and got == leaks(docs, bench)


@pytest.mark.parametrize("reworded", [False, True])
def test_needles_lose_no_document(spark, monkeypatch, reworded):
    """The same pairs as from windows alone, with items of few words of letters, capitals, signs inside of words and other scripts."""
    rng = random.Random(9)
    words = ["the", "Tom's", "co-op", "12", "3.5", "km", "Anna", "apples", "x9", "straße", "ΑΣ", "İz", "wie", "viele", "—", "don't", "dont", "Äpfel", "hat", "5kg"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30)))) for k in range(40)] + [(100, "7 x1 8 y2 9 z3 10 q4 11 r5"), (101, "1 2 3 4 5 6 7"), (102, None)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(60)]
    for k, (_, text) in enumerate(items[:41]):
        parts = (text or "").split()
        changed = " ".join(str(rng.randrange(90)) if w.isdigit() else w for w in parts)
        docs += [(1000 + k, f"Hello. {text}, yes"), (2000 + k, f"A b {changed.upper()} c"), (3000 + k, " ".join(parts[: len(parts) * 2 // 3])), (None, f"{changed} \x01\x04 end")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda: sorted((str(r.id), r.tag, r.item, r.share) for r in decontamination.contaminated(*frames, reworded=reworded).collect())
    got, known = pairs(), decontamination.needed
    monkeypatch.setattr(decontamination, "needed", lambda items, share: known(items, share).limit(0))
    assert got == pairs() and len(got) > 40
