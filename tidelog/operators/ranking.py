"""An index of texts and a ranking of six parts over it.

The index is built once: postings of words, pairs of words and character grams with their weights, how many texts hold each,
and for each text its length as a vector. A question reads the postings of its own grams only, as every file is sorted by gram.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import written
from .retrieval import B, K1, terms

#: The parts of a score, and of the vectors' likeness.
PARTS = {"bm25": 0.5, "cosine": 0.3, "overlap": 0.1, "exact": 0.07, "entities": 0.02, "fields": 0.01}
WORDS, GRAMS = 0.65, 0.35
#: Entities and fields that count at most, the share of the best score below which a text is left out, and lengths of grams.
MOST_ENTITIES, MOST_FIELDS, CUT, SHORTEST, LONGEST = 3, 4, 0.45, 3, 5
#: Texts that a task counts, about; a gram that more than one text in FREQUENT has is looked up in every task.
TEXTS, FREQUENT = 5_000, 100
#: Characters of texts whose grams a task counts at once.
CHARACTERS = 1 << 20
#: What names one thing: addresses, vulnerabilities, digests, URLs, paths.
ENTITIES = [r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\bcve-\d{4}-\d{4,8}\b", r"\b[0-9a-f]{32,128}\b", r"https?://[^\s\"']+", r"(?:[a-z]:[\\/]|/)[^\s,;]+"]


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(_low(text), F.lit(r"\b[a-z0-9][a-z0-9_.:/-]*\b"), F.lit(0))


def phrases(text: Column) -> Column:
    """Hashes of words and of pairs of words, with repeats."""
    words = words_of(text)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.transform(F.concat(words, pairs), lambda x: F.xxhash64(x))


def between_blanks(text: Column) -> Column:
    return F.filter(F.split(_low(text), r"\s+"), lambda w: w != "")


def grams(word: Column) -> Column:
    """Hashes of the 3, 4 and 5 characters of a word with a blank on either side, with repeats."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    every = lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.xxhash64(F.substring(padded, i, F.lit(n))))
    return F.concat(*(F.when(F.length(padded) >= n, every(n)).otherwise(F.array().cast("array<long>")) for n in range(SHORTEST, LONGEST + 1)))


def _hashes(texts: list[str]) -> np.ndarray:
    """As xxhash64() of the strings."""
    return np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in texts], np.uint64).view(np.int64)


def _known(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and number of every word in a column of lists, and the distinct words by number."""
    words = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()


def _counts(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of equal ones."""
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    heads = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | np.append(True, g[1:] != g[:-1])[: len(g)])
    return rows[heads], g[heads], np.diff(heads, append=len(g))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, g, ids and tfs of texts (id, words, parts), as phrases() and grams() have them. Every distinct word of some CHARACTERS is taken apart once, and a gram is one row for those texts."""
    for batch in batches:
        sizes = pc.add(pc.list_value_length(batch.column("words")), pc.list_value_length(batch.column("parts"))).to_numpy()
        letters = np.append(0, np.cumsum(pc.binary_length(batch.column("parts").flatten()).to_numpy()))
        ends = letters[np.cumsum(pc.list_value_length(batch.column("parts")).to_numpy())] + np.cumsum(sizes)
        start = base = 0
        while start < len(ends):
            to = max(start + 1, int(np.searchsorted(ends, base + CHARACTERS, "right")))
            part, start, base = batch.slice(start, to - start), to, int(ends[to - 1])
            row, word, names = _known(part.column("words"))
            next_to = np.flatnonzero(row[1:] == row[:-1])
            pairs, pair = np.unique(word[next_to] * len(names) + word[next_to + 1], return_inverse=True)
            joined = [f"{names[p // len(names)]} {names[p % len(names)]}" for p in pairs.tolist()]
            phrase = _counts(np.append(row, row[next_to]), np.append(_hashes(names)[word], _hashes(joined)[pair]))
            row, word, names = _known(part.column("parts"))
            lists = [[w[k : k + n] for n in range(SHORTEST, LONGEST + 1) for k in range(len(w) - n + 1)] for w in (f" {x} " for x in names)]
            many = np.array([len(x) for x in lists], np.int64)
            heads, n = np.cumsum(many) - many, many[word]
            at = np.repeat(heads[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            letter = _counts(np.repeat(row, n), _hashes([x for xs in lists for x in xs])[at])
            for gram, (rows, g, times) in ((False, phrase), (True, letter)):
                order = np.argsort(g, kind="stable")
                rows, g, times = rows[order], g[order], times[order]
                heads = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
                listed = lambda values: pa.ListArray.from_arrays(pa.array(np.append(heads, len(g)), pa.int32()), values)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), gram)), pa.array(g[heads]), listed(part.column("id").take(pa.array(rows))), listed(pa.array(1 + np.log(times)))], ["gram", "g", "ids", "tfs"])


def texts_of(postings: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept``, and id and tf of every text of the postings."""
    return postings.select(*kept, F.inline(F.arrays_zip("ids", "tfs"))).withColumnsRenamed({"ids": "id", "tfs": "tf"})


@dataclass(frozen=True)
class Index:
    """``rows``: id, text (lower case), terms, size, fields (names of those with a value), chunk, words and grams (lengths of the vectors). ``postings``: gram, g, ids, tfs.
    ``vocabulary``: gram, g, df. ``n`` texts have ``mean`` terms."""

    rows: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    n: int
    mean: float

    def idf(self, df: Column | float):
        return math.log((1 + self.n) / (1 + df)) + 1 if isinstance(df, (int, float)) else F.log(F.lit(1.0 + self.n) / (1 + df)) + 1

    def asked(self, question: str) -> list[tuple[bool, int, float]]:
        """Gram, hash and weight of what the question has in common with the vocabulary, each kind of length 1. As many as the question has grams."""
        row = self.rows.sparkSession.range(1).select(phrases(F.lit(question)).alias("p"), F.flatten(F.transform(between_blanks(F.lit(question)), grams)).alias("g")).first()
        counts = Counter([(False, g) for g in row.p] + [(True, g) for g in row.g])
        if not counts:
            return []
        known = self.vocabulary.where(F.col("g").isin([g for _, g in counts])).collect()
        weights = {(r.gram, r.g): (1 + math.log(counts[r.gram, r.g])) * self.idf(r.df) for r in known if (r.gram, r.g) in counts}
        length = {kind: math.sqrt(sum(w * w for (k, _), w in weights.items() if k == kind)) for kind in (False, True)}
        return [(kind, g, w / length[kind]) for (kind, g), w in weights.items()]

    def cosines(self, question: str) -> DataFrame:
        """id and the vectors' likeness to the question; texts that share no gram with it are left out."""
        asked = self.asked(question)
        spark = self.rows.sparkSession
        weights = F.broadcast(spark.createDataFrame(asked, "gram boolean, g long, q double").join(self.vocabulary.where(F.col("g").isin([g for _, g, _ in asked])), ["gram", "g"]))  # as many rows as the question has grams
        hits = texts_of(self.postings.where(F.col("g").isin([g for _, g, _ in asked])).join(weights, ["gram", "g"]), "gram", "df", "q")
        part = lambda kind: F.sum(F.when(F.col("gram") == kind, F.col("tf") * self.idf(F.col("df")) * F.col("q")).otherwise(0.0))
        dots = hits.groupBy("id").agg(part(False).alias("w"), part(True).alias("c")).join(self.rows.select("id", "words", "grams"), "id")
        share = lambda dot, length: F.coalesce(F.try_divide(F.col(dot), F.col(length)), F.lit(0.0))
        return dots.select("id", (WORDS * share("w", "words") + GRAMS * share("c", "grams")).alias("cosine"))

    def parts(self, question: str) -> DataFrame:
        """id, chunk and the six parts, as they are, of every text."""
        spark = self.rows.sparkSession
        wanted = [r.t for r in spark.range(1).select(F.explode(terms(F.lit(question))).alias("t")).collect()]
        held = [F.array_contains("terms", t) for t in wanted]
        counts = self.rows.agg(F.count("*"), *map(F.count_if, held)).first()
        idf = [math.log(1 + (self.n - df + 0.5) / (df + 0.5)) for df in counts[1:]]
        norm = 1 + K1 * (1 - B + B * F.col("size") / (self.mean or 1.0))
        total = lambda xs: sum(xs, F.lit(0.0))
        common = F.size(F.array_intersect("terms", F.array(*map(F.lit, wanted)).cast("array<string>")))
        low = question.lower()
        entities = [e for p in ENTITIES for e in re.findall(p, low)]
        names = {f: len(set(wanted) & {r.t for r in spark.range(1).select(F.explode(terms(F.lit(f))).alias("t")).collect()}) for f in self._fields()}
        points = {
            "bm25": total(F.when(h, i * (K1 + 1) / norm).otherwise(0.0) for h, i in zip(held, idf, strict=True)),
            "overlap": F.coalesce(F.try_divide(common.cast("double"), F.sqrt(len(wanted) * F.col("size").cast("double"))), F.lit(0.0)),
            "exact": common / max(1, len(wanted)),
            "entities": total(F.col("text").contains(e).cast("int") for e in entities),
            "fields": total(F.when(F.array_contains("fields", f), float(k)).otherwise(0.0) for f, k in names.items() if k),
        }
        scored = self.rows.join(self.cosines(question), "id", "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
        return scored.select("id", "chunk", "cosine", *(c.alias(name) for name, c in points.items()))

    def _fields(self) -> list[str]:
        """All field names: as many as the log has columns."""
        return [r.f for r in self.rows.select(F.explode("fields").alias("f")).distinct().collect()]

    def search(self, question: str, most: int = 24) -> DataFrame:
        """id, score and parts of the ``most`` best texts, by id: those above CUT of the best, unless one names an entity of the question. If they are fewer, others of
        their chunks follow, best first. Without any that scores the first texts stand for all."""
        parts = written(self.parts(question), "parts")
        ends = parts.agg(*(f(c) for c in ("bm25", "cosine") for f in (F.min, F.max))).first()
        if ends[0] is None:
            return parts.select("id", F.lit(0.0).alias("score"), *PARTS)
        moved = lambda c, lo, hi: (F.col(c) - lo) / (hi - lo) if hi > lo else F.lit(1.0 if hi > 0 else 0.0)
        even = {"bm25": moved("bm25", ends[0], ends[1]), "cosine": moved("cosine", ends[2], ends[3]), "entities": F.least("entities", F.lit(MOST_ENTITIES)) / MOST_ENTITIES, "fields": F.least("fields", F.lit(MOST_FIELDS)) / MOST_FIELDS}
        score = sum((even.get(p, F.col(p)) * w for p, w in PARTS.items()), F.lit(0.0))
        scored = parts.withColumn("score", score)
        best, named = scored.agg(F.max("score"), F.max("entities")).first()
        least = max(1e-6, 0.0 if named else CUT * best)
        chosen = scored.where(F.col("score") >= least) if best > 1e-6 else scored
        top = written(chosen.orderBy(F.desc("score"), "id").limit(most), "top")
        missing = most - top.count()
        if missing > 0 and most > 1:
            near = scored.join(top.select("chunk").distinct(), "chunk", "left_semi").join(top.select("id"), "id", "left_anti")
            top = top.unionByName(near.select(*top.columns).orderBy(F.desc("score"), "id").limit(missing))
        return top.select("id", "score", *PARTS).orderBy("id")


def build(docs: DataFrame, id_col: str, text_col: str, fields: list[str] | None = None, chunk: Column | None = None) -> Index:
    """The index of texts with distinct ids. Empty and null texts are in it without grams. ``fields`` are columns whose names questions may hold; texts of a ``chunk`` belong together."""
    present = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.lit(f)) for f in fields or []))).cast("array<string>")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), present.alias("fields"), (chunk if chunk is not None else F.col(id_col)).cast("string").alias("chunk"))
    n = base.count()
    # dealt out by id while texts are whole, so counting a text's grams needs no shuffle; the number of tasks follows that of the texts, so a task's memory does not
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TEXTS + 1)
    dealt = base.select("id", "text").repartition(tasks, "id")
    kind = base.schema["id"].dataType.simpleString()
    split = dealt.select("id", words_of(F.col("text")).alias("words"), between_blanks(F.col("text")).alias("parts"))
    postings = written(split.mapInArrow(counted, f"gram boolean, g long, ids array<{kind}>, tfs array<double>").sortWithinPartitions("g"), "postings")
    vocabulary = written(postings.groupBy("gram", "g").agg(F.sum(F.size("ids")).alias("df")), "vocabulary")
    # grams that one text in FREQUENT has are at most FREQUENT times as many as a text's; the postings of all others are shuffled, and none has many
    frequent = F.broadcast(vocabulary.where(F.col("df") * FREQUENT > n))
    others = vocabulary.where(F.col("df") * FREQUENT <= n).repartition(tasks, "gram", "g")
    rest = postings.join(frequent.select("gram", "g"), ["gram", "g"], "left_anti").repartition(tasks, "gram", "g").join(others.hint("merge"), ["gram", "g"])
    weighed = texts_of(postings.join(frequent, ["gram", "g"]).unionByName(rest), "gram", "df")
    weight = F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    squares = lambda kind: F.sum(F.when(F.col("gram") == kind, weight * weight).otherwise(0.0))
    lengths = weighed.groupBy("id").agg(F.sqrt(squares(False)).alias("words"), F.sqrt(squares(True)).alias("grams"))
    rows = base.join(lengths, "id", "left").select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), terms(F.col("text")).alias("terms"), "fields", "chunk", "words", "grams")
    rows = written(rows.withColumn("size", F.size("terms")), "texts")
    return Index(rows, postings, vocabulary, n, rows.agg(F.avg("size")).first()[0] or 0.0)


def hybrid(docs: DataFrame, question: str, id_col: str, text_col: str, most: int = 24, fields: list[str] | None = None, chunk: Column | None = None) -> DataFrame:
    """id, score and parts of the best texts for one question; keep the index where more are asked."""
    return build(docs, id_col, text_col, fields, chunk).search(question, most)
