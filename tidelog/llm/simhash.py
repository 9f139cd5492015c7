"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of RADIUS + 1 bits. Table v keeps the bits whose vector has an odd product
with v. Any RADIUS bits leave some v to which all of them are even, so two fingerprints that differ in no more than
RADIUS bits agree on what that table keeps: no pair within the radius is missed, by structure and not by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, checkpointing
from .components import components

RADIUS = 3
WORDS = 3
SEED = 42


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps, as signed 64-bit numbers: about half of them. There are 2**(radius+1) - 1 tables, for a radius up to 6.

    With seven bits the vectors are the columns of a first-order Reed-Muller code, so that every table keeps 32 bits; the one that keeps all is left out.
    """
    if not 0 < radius <= 6:
        raise ValueError("the radius must be 1 to 6")
    top = 2 ** (radius + 1) - 1
    vectors = [64 + i if radius == 6 else i % top + 1 for i in range(64)]
    out = []
    for v in range(1, top + 1):
        mask = sum(1 << i for i in range(64) if (v & vectors[i]).bit_count() & 1)
        if mask.bit_count() < 64:
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprint(text: bytes) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)[: max(1, len(words) - WORDS + 1)]
    ends = ends[min(WORDS, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        count += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (a long) for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([fingerprint(x or b"") for x in texts], pa.int64())], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def forest(prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the graph that links distinct prints within the radius: a search in which each print
    reached looks only at those not reached yet. No list of all pairs is made."""
    rest, edges = prints, []
    while len(rest) > 1:
        todo, rest = [rest[:1]], rest[1:]
        while todo and len(rest):
            for x in todo.pop():
                near = np.bitwise_count((rest ^ x).view(np.uint64)) <= radius
                if near.any():
                    found = rest[near]
                    edges.append((np.full(len(found), x), found))
                    todo.append(found)
                    rest = rest[~near]
                    if not len(rest):
                        break
    return edges


def links(prints: DataFrame, radius: int = RADIUS, tables: list[int] | None = None) -> DataFrame:
    """Edges (a, b) that connect what is within the radius: of each bucket of each table a spanning forest. ``prints``: distinct fp. ``tables``: masks that cover the radius."""
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for k, mask in enumerate(tables or masks(radius))))
    keyed = prints.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def edges(parts):
            t, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(t) != 0)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(fp))
            many = ends - starts > 1
            out = [e for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True) for e in forest(fp[a:b], radius)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])

        for batch in batches:  # sorted, so a bucket that the batch's end may cut waits for the next batch
            t, key, fp = (batch.column(k).to_numpy() for k in range(3))
            if not len(t):
                continue
            last = len(t) - int(np.argmax(np.append((t[::-1] != t[-1]) | (key[::-1] != key[-1]), True)))
            if last:
                yield from edges([*held, (t[:last], key[:last], fp[:last])])
                held = []
            held.append((t[last:], key[last:], fp[last:]))
        if held:
            yield from edges(held)

    return keyed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links of at most ``radius`` differing bits.

    Equal fingerprints are one node, so copies cost nothing more. A null or text without words has fingerprint zero and links like any other.
    Repeated rows stay; null ids stay and get the smallest id of their component, null if it has none. Other columns are left out.
    """
    checkpointing(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col).checkpoint()
    classes = rows.groupBy("fp").agg(F.min("id").alias("least")).checkpoint()
    roots = components(links(classes.select("fp"), radius)).checkpoint()
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("of"), "component_id")
    return rows.join(named, F.col("fp") == F.col("of")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Similar texts: words in a shingle, the least Jaccard similarity of the shingle sets, and the bits in which the prints of compared texts may differ.
SHINGLE, ALIKE, WIDE = 5, 0.8, 9
#: Parts into which a print is cut for the wide search. Some part of two prints within WIDE bits is within WIDE // PARTS.
PARTS = 2
#: Texts of a cluster that are compared in one task with as many others of it, about.
BLOCK = 256
#: Texts in clusters up to which their numbers are broadcast (8 bytes each).
BROADCAST_NODES = 1_000_000


def wide_masks(radius: int = WIDE, parts: int = PARTS) -> list[int]:
    """The bits that each table keeps: for every part of the print, covering masks of radius // parts bits inside it."""
    top = 2 ** (radius // parts + 1) - 1
    out = []
    for bits in np.array_split(np.arange(64), parts):
        for v in range(1, top + 1):
            mask = sum(1 << int(b) for i, b in enumerate(bits) if (v & (i % top + 1)).bit_count() & 1)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles in order; a shorter text is one shingle, one without words has none."""
    parts = text.lower().split()
    starts = range(max(1, len(parts) - words + 1)) if parts else range(0)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(parts[k : k + words]), SEED) for k in starts), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; 1 if both are empty."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def alike(group: pa.Table, radius: int = WIDE) -> pa.Table:
    """Edges (a, b) between texts of a block and texts of another, or of the same one, that have ALIKE of their shingles in common: a spanning forest, in
    which texts that are connected already are not compared. ``group``: node, fp, grams, block, first and second (the blocks)."""
    node, fp, block = (group.column(c).to_numpy() for c in ("node", "fp", "block"))
    grams = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
    size = np.array([len(g) for g in grams])
    first, second = group.column("first")[0].as_py(), group.column("second")[0].as_py()
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    apart = np.bitwise_count((fp[left, None] ^ fp[None, right]).view(np.uint64))
    near = (apart <= radius) & (np.minimum(size[left, None], size[None, right]) >= ALIKE * np.maximum(size[left, None], size[None, right]))
    x, y = np.nonzero(near)
    order = np.argsort(apart[x, y], kind="stable")  # the likeliest first
    x, y = left[x[order]], right[y[order]]
    root = list(range(len(node)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    edges = []
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        if a != b and (p := find(a)) != (q := find(b)) and similarity(grams[a], grams[b]) >= ALIKE:
            root[p] = q
            edges.append((a, b))
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})


def keep_unlike(docs: DataFrame, radius: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without similar texts: of each component of texts that have ALIKE of their five-word shingles in common the row with the smallest id, once.

    Prints choose which texts are compared, their shingles decide. Prints within ``radius`` bits are linked to clusters by a spanning forest of each bucket;
    a cluster's texts are dealt out to blocks, and every two blocks are compared by a task of their own, so no list of pairs is made and no task holds
    more than about 2 * BLOCK texts. Equal texts are one node. A null text counts as empty. Rows without an id can't be told apart and stay; of rows
    with one id and different texts only similar ones go.
    """
    checkpointing(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), pa.array([fingerprint(x or b"") for x in texts], pa.int64())], ["id", "node", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in by_bytes(batches, "text"):
            new = [(n, t) for n, t in zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True) if n not in seen and not seen.add(n)]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in new], pa.int64()), pa.array([shingles(t or b"").tobytes() for _, t in new], pa.binary())], ["node", "grams"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(prints, f"id {texts.schema['id'].dataType.simpleString()}, node long, fp long")
    nodes = rows.groupBy("node", "fp").agg(F.min("id").alias("least")).checkpoint()
    of_print = nodes.groupBy("fp").agg(F.count("*").alias("n")).checkpoint()
    roots = components(links(of_print.select("fp"), radius, wide_masks(radius))).select(F.col("node").alias("of"), "root")
    clusters = of_print.join(roots, F.col("fp") == F.col("of"), "left").where("root is not null or n > 1").select("fp", F.coalesce("root", "fp").alias("cluster"), "n")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    used = nodes.join(clusters.drop("n"), "fp").join(blocks, "cluster").select("node", "fp", "cluster", "blocks").checkpoint()
    few = used.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    numbers = used.select("node")
    grams = texts.select("node", "text").join(F.broadcast(numbers) if few else numbers, "node", "left_semi").mapInArrow(sets, "node long, grams binary").dropDuplicates(["node"])
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = used.select("node", "fp", "cluster", "blocks", block.alias("block")).join(grams, "node")
    dealt = dealt.select("node", "fp", "grams", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", "fp", "grams", "cluster", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    edges = dealt.groupBy("cluster", "first", "second").applyInArrow(lambda group: alike(group, radius), "a long, b long")
    labels = components(edges).select(F.col("node").alias("of"), "root")
    named = nodes.join(labels, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("label"))
    kept = named.where("least is not null").groupBy("label").agg(F.min(F.struct("least", "node")).alias("x")).select(F.col("x.least").alias("__id"), F.col("x.node").alias("__of"))
    known = docs.where(F.col(id_col).isNotNull()).withColumn("__node", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    known = known.join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__node") == F.col("__of")), "left_semi").dropDuplicates([id_col, "__node"])
    return known.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
