"""Quality rules on repetition, by suffix arrays of words.

The words of a batch of documents become one sequence in which only words of the same document can be equal. Its
suffix array comes from prefix doubling over the suffixes that still tie; the ranks of each round give the lengths of
the common prefixes of neighbours. The deepest common-prefix interval that holds a suffix is the longest repeated
substring that begins there. The union of those spans, taken from a least length on, is the covered part of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, texts_of

#: Repeats count as covered from this many words on.
LEAST_WORDS = 8
#: Documents of which repeats cover more than this share are rejected.
MOST_COVERED = 0.3
#: Documents with a repeat of more words than this are rejected.
MOST_REPEATED = 200
#: Bytes of text whose words make one suffix array: it takes some hundred times as much while it is sorted.
BATCH = 1 << 19


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and ranks[k]: the rank of each suffix by its first 2**k tokens. The last token must be unique."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable").astype(np.int32)
    head = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order[:1]] - 1))
    sizes = np.diff(head, append=n)
    rank = np.empty(n, np.int32)  # one is kept of each round, so they are half as wide as the keys
    rank[order] = np.repeat(head, sizes)
    ranks, slots, step = [rank.copy()], np.flatnonzero(np.repeat(sizes > 1, sizes)), 1
    while len(slots):
        at = order[slots]
        key = rank[at].astype(np.int64) * n + rank[at + step]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        head = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(head, append=len(key))
        rank[at] = np.repeat(slots[head], sizes)
        ranks.append(rank.copy())
        slots = slots[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order, ranks


def repeat_lengths(tokens: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring that begins there and occurs elsewhere too."""
    out = np.zeros(len(tokens), np.int64)
    if not len(tokens):
        return out
    order, ranks = suffix_array(tokens)
    a, b = order[:-1], order[1:]
    tied = ranks[0][a] == ranks[0][b]
    a, b = a[tied], b[tied]
    common = np.zeros(len(a), np.int64)
    for k in reversed(range(len(ranks))):
        common += (ranks[k][a + common] == ranks[k][b + common]).astype(np.int64) << k
    out[b] = common
    out[a] = np.maximum(out[a], common)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    edges = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edges[:n]) > 0


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text that the rules use; nulls count as empty."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    words, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    count = np.bincount(owner, minlength=n)
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    base = max(1, len(ids))
    tokens = np.empty(len(ids) + n, np.int64)
    place = np.arange(len(ids)) + owner
    tokens[place] = owner * base + ids
    tokens[np.cumsum(count) + np.arange(n)] = n * base + np.arange(n)  # an end of its own for each text
    whose = np.empty(len(tokens), np.int64)
    whose[place] = owner
    whose[np.cumsum(count) + np.arange(n)] = np.arange(n)
    length = repeat_lengths(tokens)
    out = {"n_words": count, "word_chars": np.bincount(owner, pc.utf8_length(words).to_numpy(), n).astype(np.int64), "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy().astype(np.int64)}
    for name, least, capped in (("n_repeat_words", 3, True), ("n_covered", LEAST_WORDS, False)):
        at = np.flatnonzero(length >= least)
        inside = covered(at, np.full(len(at), least) if capped else length[at], len(tokens))
        out[name] = np.bincount(whose[inside], minlength=n)
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], whose, length)
    return out


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed, and kept: neither that nor the limits on repetition fail."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return failed, ~failed & (m["n_covered"] <= MOST_COVERED * m["n_words"]) & (m["longest_repeat"] <= MOST_REPEATED)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, the counts of COUNTS, ``base_failed`` and ``kept``.

    Words are what ASCII white space separates. ``n_covered`` are the words in repeats of LEAST_WORDS or more and ``longest_repeat`` is in words.
    A null or empty text has no words, so it fails. Repeated rows and null ids stay, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            m = measures(batch.column("text"))
            m["n_dup_lines"] = np.fromiter(map(repeated_lines, texts_of(batch, "text")), np.int64, batch.num_rows)
            failed, kept = verdicts(m)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(m[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(kept)], ["id", *COUNTS, "base_failed", "kept"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, BATCH):
            yield batch.filter(pa.array(verdicts(measures(batch.column(text_col)))[1]))

    return docs.mapInArrow(run, docs.schema)
