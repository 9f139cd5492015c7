"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: one conjunction for each string that a match must
hold. Postings (trigram, document) are made for the trigrams that occur in queries, and intersected by counting for
each conjunction. Only the candidates of a rule are matched against its pattern. A rule whose matches need no trigram
is matched against every text.
"""

from __future__ import annotations

from collections.abc import Callable
from re import _constants as op  # type: ignore[attr-defined]
from re import _parser as syntax  # type: ignore[attr-defined]
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    #: The group's least number of characters; shorter matches are dropped.
    least: int = 0


#: The three base rules, then public formats of credentials.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of any length, less those that are too short
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
]


#: Matches in a block whose lengths are added up together, and characters in a block of text.
BLOCK, PIECE = 256, 512


def _strings(parsed) -> list[set[str]]:
    """For a parsed pattern: runs in its order, each the set of strings of which one must occur, in lower case."""
    runs: list[set[str]] = [{""}]

    def grow(options: set[str] | None) -> None:
        if options and len(options) * len(runs[-1]) <= 64:
            runs[-1] = {a + b for a in runs[-1] for b in options}
        elif runs[-1] != {""}:
            runs.append({""})

    for kind, value in parsed:
        if kind is op.LITERAL:
            grow({chr(value).lower()})
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
            grow({chr(v).lower() for _, v in value})
        elif kind is op.SUBPATTERN:
            for k, run in enumerate(_strings(value[-1])):
                grow(None) if k else None
                grow(run)
        elif kind is op.BRANCH:
            ways = [_strings(way) for way in value[1]]
            grow({s for way in ways for s in way[0]} if all(len(way) == 1 for way in ways) else None)
        elif kind is op.MAX_REPEAT and value[:2] == (0, 1):
            inner = _strings(value[2])
            grow({"", *inner[0]} if len(inner) == 1 else None)
        else:
            grow(None)
    return runs


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The pattern's query: a list of conjunctions of trigrams of which one must hold. Empty if a match needs no trigram."""
    best: list[frozenset[str]] = []
    for run in _strings(syntax.parse(pattern)):
        ways = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in run}
        if all(ways) and ways != {frozenset()} and (not best or min(map(len, ways)) > min(map(len, best))):
            best = sorted(ways, key=sorted)
    return best


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, id, tag) for each of the trigrams that a text holds, in either case."""
    low = docs.select("id", "tag", F.lower("text").alias("low"))
    return low.select("id", "tag", F.explode(F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """id, tag and kinds: the rules whose query holds for a text. Postings are joined with the queries' fixed table and counted."""
    spark = docs.sparkSession
    clauses = [(rule.kind, k, t, len(way)) for rule in rules for k, way in enumerate(trigram_query(rule.pattern)) for t in sorted(way)]
    query = spark.createDataFrame(clauses, "kind string, clause int, trigram string, need long")
    found = postings(docs, sorted({t for _, _, t, _ in clauses})).join(F.broadcast(query), "trigram")  # the table is as large as the rules
    whole = found.groupBy("id", "tag", "kind", "clause", "need").agg(F.countDistinct("trigram").alias("n")).where("n = need")
    return whole.groupBy("id", "tag").agg(F.collect_set("kind").alias("kinds"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, merge: Callable[[Column, Column], Column], levels: int = 1) -> Column:
    """For each of the whole numbers in an array what ``merge`` makes of all those before it and 0. Values are merged by blocks, and the
    blocks in turn, so the work follows their number."""

    def prefix(block: Column, start: Column) -> Column:
        return F.transform(block, lambda _, i: F.aggregate(F.slice(block, 1, i), start, merge))

    def parts(values: Column) -> Column:
        if not levels:
            return prefix(values, F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))
        ends = lambda blocks: before(F.transform(blocks, lambda v: F.aggregate(v, F.lit(0), merge)), merge, levels - 1)
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, ends(blocks), prefix)))

    return let(values, lambda x: F.when(F.size(x) > 0, parts(x)).otherwise(F.array().cast("array<int>")))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """start, rank and end (code points) of each match that is long enough: what lies between matches and the matches themselves give the offsets."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("hit"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def spans(parts: Column) -> Column:
        whole = F.transform(parts, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0)))
        starts = F.zip_with(parts, before(whole, lambda a, x: a + x), lambda x, at: F.when(x["part"] >= max(1, rule.least), F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["gap"] + x["hit"]).alias("end"))))
        return F.array_compact(starts)

    return F.coalesce(let(parts, spans), none)


def scan(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """The text of each row, its other columns as struct ``row``, and ``found``: the spans of all rules by start, then by the order of rules. A null text has none.

    Rows are known by their id and their text's hash, so rows without an id, or with the same one, keep their own candidates and are dealt out.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"), F.struct(*(F.col(c) for c in docs.columns if c != text_col)).alias("row"))
    likely = candidates(source, rules).select(F.col("id").alias("of"), F.col("tag").alias("of_tag"), "kinds")
    joined = source.join(likely, F.col("id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    found = []
    for rank, rule in enumerate(rules):
        likely_here = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else F.col("text").rlike(rule.pattern)
        found.append(F.when(likely_here, spans_of(F.col("text"), rule, rank)).otherwise(none))
    return joined.select("id", "row", "text", F.array_sort(F.concat(*found)).alias("found"))


def _listed(spans: Column, rules: list[Rule]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, the number of spans of each base rule, ``base_sha256`` over the base spans and ``spans``, all of them.

    A null or empty text has none. Repeated rows and null ids stay, other columns are left out. Spans of different rules may overlap.
    """
    rules = [*BASE, *MORE]
    rows = scan(docs.select(id_col, text_col), rules, id_col, text_col).select("id", "found", F.filter("found", lambda s: s["rank"] < len(BASE)).alias("base"))
    ranks = F.transform("base", lambda s: s["rank"])
    counts = [(F.size("base") - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_listed(F.col("base"), rules), 256).alias("base_sha256"), _listed(F.col("found"), rules).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each run of characters that spans cover replaced by ``mark``; null texts stay null. A column n_chars follows the text."""
    rows = scan(docs, [*BASE, *MORE], id_col, text_col)
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """The characters from a on before b, out of the blocks that hold them: a search from the text's start would take longer the further it goes."""
        first = F.floor(a / PIECE).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
        return F.substring(held, a - first * PIECE + 1, b - a)

    def pieces(blocks: Column) -> Column:
        reached = before(F.transform("found", lambda s: s["end"]), lambda a, x: F.greatest(a, x))  # the end of all spans before each
        parts = F.zip_with("found", reached, lambda s, at: F.when(s["start"] > at, F.concat(between(blocks, at, s["start"]), F.lit(mark))).when(at == 0, F.lit(mark)).otherwise(""))
        end = F.array_max(F.transform("found", lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), F.when(end < F.length("text"), between(blocks, end, F.length("text"))).otherwise(""))

    none = F.size("found") == 0
    rows = rows.select("row", "text", "found", F.when(~none, let(blocks, pieces)).alias("clean"))
    values = {text_col: F.when(none, F.col("text")).otherwise(F.col("clean"))} | ({"n_chars": F.when(none, F.col("row.n_chars")).otherwise(F.length("clean"))} if "n_chars" in docs.columns else {})
    return rows.select(*(values.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
