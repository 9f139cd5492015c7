"""Conversation repair, mixing and the manifest against plain versions of them, and their handling of odd rows."""

import hashlib
import random
import zlib

import pytest

from tidelog.llm import manifest, mixing, repair

SPACE = " \t\n\v\f\r"


# conversations


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """The least (cost, letters) over all edits, by rows used and last initial."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(0, ""): (0, "")}

    def better(key, cost, letters):
        best[key] = min(best.get(key, (10**9, "")), (cost, letters))

    for i in range(len(rows) + 1):
        for _ in range(3):
            for q in follows:
                if (i, q) in best:
                    cost, letters = best[i, q]
                    better((i, "a" if q == "u" else "u"), cost + 3, letters + "I")
        if i < len(rows):
            for q in follows:
                if (i, q) in best:
                    cost, letters = best[i, q]
                    better((i + 1, q), cost + 4, letters + "D")
                    if faults[i] not in "bd":
                        extra = 3 * (faults[i] == "t")
                        initial = rows[i][2][:1]
                        if initial and initial in follows[q]:
                            better((i + 1, initial), cost + extra, letters + "K")
                        better((i + 1, "a" if q == "u" else "u"), cost + 3 + extra, letters + "R")
    return min(best[len(rows), q] for q in ("", "a") if (len(rows), q) in best)


def rebuilt(rows, letters):
    q, out, left = "", [], iter(rows)
    for e in letters:
        row = None if e == "I" else next(left)
        if e == "K":
            q = row[2][0]
            out.append((row[2], row[3]))
        elif e in "IR":
            q = "a" if q == "u" else "u"
            out.append(({"u": "user", "a": "assistant"}[q], row[3] if row else ""))
    return out


def plain_report(original):
    rows, out = damage(original), []
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = "", set()
        for r in mine:
            text = r[3].rstrip(SPACE)
            faults += "b" if not text else "d" if r[2:] in seen else "t" if text[-1] not in ".!?" else "-"
            seen.add(r[2:])
        turns = [r[1] for r in mine if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, letters = cheapest(mine, faults)
        whole = "\n".join(f"{role}:{text}" for role, text in rebuilt(mine, letters))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(x) for x in "bdt"), illegal, cost, letters, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", "User", None, "unknown", "a"], ["Hi.", "No end", "", " \t\n", "Yes!", "What?", "no end ", None, "x.\n", "\xa0.", "é…"]
    draw = lambda n, convs: [(rng.choice(convs), rng.choice([None, *range(-3, n)]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)) for _ in range(n * len(convs))]
    rows = draw(25, [None, 1, 2, 3]) + draw(2, list(range(10, 25))) + [(99, k, "user", f"question {k}.") for k in range(60)]
    return rows + [(98, 1, "user", "same.")] * 30


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("stretch, branches", [(1024, 1024), (3, 2), (8, 3)])
def test_report_equals_search(spark, monkeypatch, stretch, branches):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    monkeypatch.setattr(repair, "BRANCHES", branches)
    rows = talk(stretch)
    got = sorted((tuple(r) for r in repair.report(spark.createDataFrame(rows, TALK)).collect()), key=repr)
    assert got == plain_report(rows)


def test_repaired_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH", 4)
    rows = [(c, t, r, x) for c, t, r, x in talk(1) if r is not None and x is not None]
    df = spark.createDataFrame(rows, TALK)
    got = {}
    for r in repair.repaired(df.withColumnRenamed("conv_id", "conv")).orderBy("conv", "at", "part").collect():
        got.setdefault(r.conv, []).append((r.role, r.text))
    letters = {r.conv_id: r for r in repair.report(df, df.withColumnRenamed("conv_id", "conv")).collect()}
    for conv, r in letters.items():
        lines = got.get(conv, [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() == r.repaired_sha256
        initials = "".join(a[0] for a, _ in lines).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)


def test_conversations_without_rows(spark):
    assert repair.report(spark.createDataFrame([], TALK + ", conv string, at long")).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    row = repair.report(spark.createDataFrame([(7, gone, "user", "Hi.", "x", 1)], TALK + ", conv string, at long")).first()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_block_tables_equal_single_steps():
    rng = random.Random(5)
    for _ in range(300):
        letters = "".join(rng.choice("suaoSUAObd") for _ in range(rng.randrange(40)))
        symbols, head, codes = repair.cut(letters)
        costs = repair.END
        for symbol in reversed(symbols):
            costs = repair.before(costs, symbol)
        vector, total, _ = repair.tables().back(head, codes, repair.tables().ids[repair.END])
        assert tuple(c + total for c in repair.tables().vectors[vector]) == costs
        assert repair.times(repair.matrix(letters), list(repair.END)) == list(costs)


# mixing


def levels(sizes, weights=(5, 2, 1)):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest, shares = total - sum(2 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / shares for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


DOCS = "doc_id long, text string, source string, lang string, n_chars long, size string, key string"


def documents(seed, n=300):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" * rng.randrange(1, 5) for _ in range(int(rng.expovariate(0.02)))), rng.choice(["a", "é", "Z", "", None, "b"] + ["hot"] * 4), rng.choice(["en", "de", None, ""]), rng.choice([None, k]), "x", "y") for k in range(n)]
    return rows + [(None, None, "a", None, None, "x", "y"), (1005, "Same Text here", "b", "en", 3, "x", "y"), (1005, "Same Text here", "b", "en", 3, "x", "y"), (1006, " \n", "lone", "it", 0, "x", "y")]


@pytest.mark.parametrize("whole", [False, True])
def test_mix_meets_targets(spark, whole):
    rows = documents(2)
    got = mixing.mix(spark.createDataFrame(rows, DOCS), whole=whole).collect()
    words = lambda t: len((t or "").translate({ord(c): " " for c in SPACE}).split(" ")) - (t or "").translate({ord(c): " " for c in SPACE}).split(" ").count("")
    sizes, largest = {}, {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + words(r[1])
        largest[r[2]] = max(largest.get(r[2], 0), words(r[1]))
    want = levels(sizes)
    source, size = {}, {}
    for r in rows:
        source[r[0]], size[r[0]] = r[2], words(r[1])
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), words(r[1])) for r in rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size and r.taken >= int(r.target / max(1, r.source_size)) * r.size
        assert not whole or r.size == 0 or r.taken % r.size == 0
        taken[source[r.doc_id]] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= (largest[s] / 2 + 1 if whole else 1)


def test_mix_takes_the_least_keys(spark):
    rows = [(k, "w " * 10, "a" if k % 2 else "b", "en", 1, "x", "y") for k in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, weights=(1, 3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7), weights=(1, 3)).collect()))
    for s in (0, 1):
        mine = sorted((r for r in got if r.doc_id % 2 == s), key=lambda r: r.key)
        extra = [r.taken - int(r.target / r.source_size) * r.size for r in mine]
        assert extra == sorted(extra, reverse=True) and sum(0 < x < 10 for x in extra) <= 1


def test_heavier_documents_are_taken_more_often(spark):
    from pyspark.sql import functions as F

    rows = [(k, "w " * 10, "a", "en", 1, "x", "y") for k in range(2000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, total=0.25, weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    heavy = sum(r.taken for r in got if r.doc_id % 2 == 0) / sum(r.taken for r in got)
    assert 0.66 < heavy < 0.78  # about 0.72 where a quarter is taken


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert [tuple(r)[1:5] for r in mixing.mix(spark.createDataFrame([(1, None, None, None, None, "x", "y")], DOCS)).collect()] == [(0, 0, 0.0, 0)]


# the manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """The root of a list of hashes, and the siblings of each of them."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
            own[k] = at // 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    """Of rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], sha("".join(map(field, r))), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = climb([x[1] for x in by[lang]])
    root, tops = climb([trees[lang][0] for lang in langs]) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops):
        for (key, leaf, r), path in zip(by[lang], trees[lang][1]):
            path, now = path + top, leaf
            if key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and r[4] is not None:
                now = sha("".join(map(field, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))))
            for left, right in path:
                now = sha(left + now + right)
            out.append((key, leaf, trees[lang][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65, 300])
def test_manifest_equals_plain_trees(spark, n):
    rows = documents(4, n) if n > 9 else [r for r in documents(4, 300)[:n]]
    rows += [(k, "İ ÀB Cd", "s", f"l{k:02}", 1, "x", "y") for k in range(70)] if n == 300 else []
    got = manifest.manifest(spark.createDataFrame(rows, DOCS)).drop("path").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_manifest([(r[0], r[2], r[3], r[4], r[1]) for r in rows])
    assert n < 300 or {r.verified for r in got} == {True, False}
