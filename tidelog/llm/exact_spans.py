"""Removal of repeated passages by suffix arrays, exact to the byte.

A passage is a string of LENGTH bytes. Every passage has an anchor, the least by hash of the GRAM-byte strings in it,
so equal passages have equal anchors, and successive passages with one anchor form a short segment of text. Documents
are dealt out to packs, anchors to buckets:

1. each pack sends a bucket the hashes of its anchors; the bucket answers, a bit each, which occur in two documents;
2. each pack sends the segments of those anchors, every distinct one once with the smallest document that has it; the
   bucket sorts the suffixes of all of them, finds equal passages by the common prefixes of neighbours, and answers
   with the smallest document of each passage;
3. each pack removes the passages whose smallest document is smaller than the one they stand in.

What passes between packs and buckets are arrays of distinct items, so copies cost one item for a pack, no matter how
many there are. Suffixes are sorted in two stages: those smaller than their successors directly, the rest are induced
by a scan over the buckets of first bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM = 50, 16
#: Packs and buckets for each shuffle partition at least, and bytes of text for each at most: one task holds one of them at a time, and needs some 20 times a pack's bytes. A pack writes
#: to every bucket, so messages number their product, or that of the anchors if there are fewer.
PACKS, BUCKETS, PACK_BYTES, BUCKET_BYTES = 2, 1, 8 << 20, 12 << 20
#: Parts of a bucket by anchor. Each is sorted alone, which takes some 40 times its bytes; the segments of repeated texts are about three times as long as those.
CELLS = 16
_SLICE, _LONGEST = 1 << 19, 1 << 27
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 over the golden ratio, made odd
_WORDS = -(-LENGTH // 8)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on (GRAM is a power of two), by doubling."""
    h, n = text.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = (h[:-n] * _ODD) ^ h[n:]
        h ^= h >> np.uint64(29)
        n *= 2
    h *= _ODD
    h ^= h >> np.uint64(32)
    return h


def slices(text: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """start, bytes and ends of documents of parts of the text: documents together up to about _SLICE bytes. A longer document than _LONGEST comes in
    parts that overlap, so that every passage begins in one of them: positions in a part have 28 bits."""
    k, base = 0, 0
    while k < len(ends):
        to = max(k + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
        end = int(ends[to - 1])
        for start in range(base, max(end, base + 1), _LONGEST):
            upto = min(start + _LONGEST + LENGTH - 1, end)
            yield start, text[start:upto], ends[k:to] - base if upto - start == end - base else np.array([upto - start])
        base, k = end, to


def segments(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash of the anchor, and first and last start of the passages that have it, by position. ``ends``: of the documents in the text."""
    out: list[tuple[np.ndarray, ...]] = []
    for base, part, stops in slices(text, ends):
        if len(part) >= LENGTH:
            h = gram_hashes(part)
            n = len(part) - LENGTH + 1
            width = LENGTH - GRAM + 1
            least = (h & ~np.uint64((1 << 28) - 1)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones
            step = 1
            while 2 * step <= width:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            least = np.minimum(least[:n], least[width - step : width - step + n])
            anchor = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
            inside = np.ones(n, bool)
            for back in range(1, LENGTH):  # passages that run over a document's end
                at = stops[:-1] - back
                inside[at[(at >= 0) & (at < n)]] = False
            starts = np.flatnonzero(inside)
            if len(starts):
                anchor = anchor[starts]
                first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
                last = np.append(first[1:], len(starts)) - 1
                out.append((h[anchor[first]], starts[first] + base, starts[last] + base))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pack_blob(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; numbers are split into planes of bytes."""
    parts = [np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64).tobytes()]
    parts += [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def open_blob(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for (width, count), kind in zip(sizes.tolist(), kinds, strict=True):
        planes = np.frombuffer(raw, np.uint8, width * count, at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += width * count
    return out


class Pack:
    """The documents of a pack, in the order of their ids and texts' hashes, and their segments."""

    def __init__(self, table: pa.Table, buckets: int):
        self.rows = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("tag", "ascending")]))
        texts = self.rows.column("text").cast(pa.large_binary()).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        texts = pc.fill_null(texts, b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = texts.buffers()[2]
        self.text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.ends = offsets[1:] - offsets[0]
        self.known = self.rows.column("id").is_valid().to_numpy()
        self.ids = pc.fill_null(self.rows.column("id"), 0).to_numpy().astype(np.int64)
        h, first, last = segments(self.text, self.ends)
        doc = np.searchsorted(self.ends, first, "right")
        known = self.known[doc]  # a row without an id is neither before nor behind another
        self.hash, self.first, self.last, self.doc = h[known], first[known], last[known], doc[known]
        self.buckets = buckets
        self.distinct, self.which = np.unique(self.hash, return_inverse=True)
        self.cell = (self.distinct >> np.uint64(20)) % np.uint64(buckets * CELLS)
        self.bucket = self.cell // np.uint64(CELLS)

    def anchors(self) -> Iterator[tuple[int, bytes]]:
        """For each bucket the anchors' hashes in order, and whether two documents of the pack have them."""
        low, high = np.full(len(self.distinct), 1 << 62), np.full(len(self.distinct), -1)
        np.minimum.at(low, self.which, self.doc)
        np.maximum.at(high, self.which, self.doc)
        several = self.ids[np.minimum(low, len(self.ids) - 1)] != self.ids[high] if len(low) else low < high
        order = np.argsort(self.bucket, kind="stable")
        for b, a, z in runs(self.bucket[order].astype(np.int64)):
            own = order[a:z]
            yield b, pack_blob(np.diff(self.distinct[own], prepend=np.uint64(0)), np.packbits(several[own]))

    def chosen(self, flags: dict[int, bytes]) -> None:
        """Keeps the segments whose anchors the buckets found in several documents, and numbers the distinct ones in each bucket."""
        keep = np.zeros(len(self.distinct), bool)
        for b, blob in flags.items():
            own = np.flatnonzero(self.bucket == b)
            keep[own] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), count=len(own)).astype(bool)
        at = np.flatnonzero(keep[self.which])
        at = at[np.argsort(self.cell[self.which[at]], kind="stable")]
        self.at, self.of = at, self.cell[self.which[at]].astype(np.int64)
        raw = self.text.tobytes()
        names: dict[bytes, int] = {}
        cut = [raw[a:b] for a, b in zip(self.first[at].tolist(), (self.last[at] + LENGTH).tolist(), strict=True)]
        self.number = np.fromiter((names.setdefault(x, len(names)) for x in cut), np.int64, len(cut))
        self.names = [*names]  # equal segments have equal anchors, so numbers ascend with the cells, and so with the buckets

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """For each bucket the number in each cell, and the lengths, smallest documents and text of its distinct segments."""
        least = np.full(len(self.names), np.iinfo(np.int64).max)
        np.minimum.at(least, self.number, self.ids[self.doc[self.at]])
        home = np.empty(len(self.names), np.int64)
        home[self.number] = self.of
        for b, a, z in runs(home // CELLS):
            yield b, pack_blob(np.bincount(home[a:z] % CELLS, minlength=CELLS).astype(np.uint32), np.array([len(x) for x in self.names[a:z]], np.uint8), least[a:z], np.frombuffer(b"".join(self.names[a:z]), np.uint8))

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes of the pack's text go."""
        home = np.empty(len(self.names), np.int64)
        home[self.number] = self.of
        counts, lengths, least = [np.empty(0, np.uint8)], [np.empty(0, np.uint8)], [np.empty(0, np.int64)]
        for b, _, _ in runs(home // CELLS):
            for into, x in zip((counts, lengths, least), open_blob(answers[b], np.uint8, np.uint8, np.int64), strict=True):
                into.append(x)
        counts, lengths, least = np.concatenate(counts).astype(np.int64), np.concatenate(lengths).astype(np.int64), np.concatenate(least)
        heads = np.cumsum(counts) - counts
        lead = np.cumsum(lengths) - lengths  # passages before each run
        n = counts[self.number]
        run = np.repeat(heads[self.number] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        where, doc = np.repeat(self.first[self.at], n), np.repeat(self.ids[self.doc[self.at]], n)
        start = where + lead[run] - np.repeat(lead[heads[self.number]] if len(n) else n, n)
        gone = least[run] < doc
        edges = np.bincount(start[gone], minlength=len(self.text) + 1) - np.bincount(start[gone] + lengths[run][gone] - 1 + LENGTH, minlength=len(self.text) + 1)
        return np.cumsum(edges)[: len(self.text)] > 0


def runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """value, start and end of each run."""
    heads = np.flatnonzero(np.diff(values, prepend=-1))
    if not len(heads):
        return []
    return [(int(values[a]), int(a), int(z)) for a, z in zip(heads, [*heads[1:], len(values)], strict=True)]


def sort_suffixes(text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The wanted positions in the order of the suffixes that begin there, and the words of eight bytes from each position on.

    Suffixes are compared by at least _WORDS words; ties keep any order. Stage one sorts those smaller than their successors; stage two goes through
    the buckets of first bytes upwards and puts what stands before each sorted suffix, if that is the larger, next in its own bucket. Positions behind a
    wanted one are taken in until one is smaller than its successor. ``text`` must end with 8 * (_WORDS + 1) spare bytes.
    """
    n = len(text)
    rising = text[:-1] < text[1:]
    differs = np.append(np.flatnonzero(text[:-1] != text[1:]), n - 1)
    follow = np.append(rising, True)[differs[np.searchsorted(differs, np.arange(n))]]  # smaller than its successor; the end counts as such
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    smaller = np.append(np.flatnonzero(follow), n - 1)
    upto = smaller[np.searchsorted(smaller, last)]
    taken = wanted | (np.cumsum(np.bincount(last, minlength=n + 1) - np.bincount(np.minimum(upto, n - 1) + 1, minlength=n + 1))[:n] > 0)
    word, width = text.astype(np.uint64), 1
    while width < 8:
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
        width *= 2
    word = np.append(word, np.zeros(8 * (_WORDS + 1), np.uint64))
    direct = np.flatnonzero(taken & follow)
    direct = direct[np.lexsort([word[direct + 8 * k] for k in reversed(range(_WORDS))])]
    heads = np.searchsorted(text[direct], np.arange(257))
    induced = taken & ~follow
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        layer = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        own = []
        while len(layer):
            own.append(layer)
            layer = layer[layer > 0] - 1
            layer = layer[induced[layer] & (text[layer] == c)]
        own.append(direct[heads[c] : heads[c + 1]])
        done = np.concatenate(own)
        out.append(done)
        before = done[done > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            for b, a, z in runs(text[before].astype(np.int64)):
                waiting[b].append(before[a:z])
    order = np.concatenate(out)
    return order[wanted[order]], word


def smallest(lengths: np.ndarray, least: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct segments with the smallest document of each: of their passages' smallest documents the number of runs, the runs' lengths and values."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = lengths - LENGTH + 1
    passage = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    wanted = np.zeros(len(text) + 8 * (_WORDS + 1), bool)
    wanted[passage] = True
    text = np.append(text, np.zeros(8 * (_WORDS + 1), np.uint8))
    order, word = sort_suffixes(text, wanted)
    a, b = order[:-1], order[1:]
    whole, rest = divmod(LENGTH, 8)
    same = np.ones(len(a), bool)
    for k in range(whole):  # is the common prefix of neighbours a whole passage?
        same &= word[a + 8 * k] == word[b + 8 * k]
    if rest:
        same &= (word[a + 8 * whole] >> np.uint64(64 - 8 * rest)) == (word[b + 8 * whole] >> np.uint64(64 - 8 * rest))
    owner = np.full(len(text), -1, np.int32)
    owner[passage] = np.repeat(np.arange(len(lengths), dtype=np.int32), n)
    heads = np.append(0, np.flatnonzero(~same) + 1)
    value = np.empty(len(text), np.int64)
    value[order] = np.repeat(np.minimum.reduceat(least[owner[order]], heads), np.diff(heads, append=len(order)))
    value, owner = value[passage], owner[passage]
    first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | np.append(True, value[1:] != value[:-1]))
    return np.bincount(owner[first], minlength=len(lengths)), np.diff(first, append=len(passage)), value[first]


def _rows(pack, rows: list[tuple[int, bytes]]) -> pa.Table:
    b, blobs = zip(*rows, strict=True) if rows else ((), ())
    return pa.table({"pack": pa.array([pack] * len(b), pa.int32()), "bucket": pa.array(b, pa.int32()), "blob": pa.array(blobs, pa.binary())})


_MAIL = "pack int, bucket int, blob binary"


def _flags(table: pa.Table) -> pa.Table:
    """A bucket's answer to the packs: the anchors that occur in several documents."""
    rows = table.sort_by("pack")
    parts, flags = [], []
    for blob in rows.column("blob").to_pylist():
        steps, bits = open_blob(blob, np.uint64, np.uint8)
        parts.append(np.cumsum(steps))
        flags.append(np.unpackbits(bits, count=len(steps)).astype(bool))
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(every[order]) != 0))
    sizes = np.diff(heads, append=len(every))
    found = (sizes > 1) | np.logical_or.reduceat(np.concatenate(flags)[order], heads)
    hit = np.empty(len(every), bool)
    hit[order] = np.repeat(found, sizes)
    press = zstandard.ZstdCompressor(level=1).compress
    answers = [press(np.packbits(x).tobytes()) for x in np.split(hit, np.cumsum([len(p) for p in parts])[:-1])]
    return pa.table({"pack": rows.column("pack"), "bucket": rows.column("bucket"), "blob": pa.array(answers, pa.binary())})


def _answers(table: pa.Table) -> pa.Table:
    """A bucket's answer to the packs: the smallest document of each passage of their segments. One cell after the other is sorted."""
    rows = table.sort_by("pack")
    sent = []
    for blob in rows.column("blob").to_pylist():
        cells, lengths, low, text = open_blob(blob, np.uint32, np.uint8, np.int64, np.uint8)
        sent.append((np.append(0, np.cumsum(cells.astype(np.int64))), np.append(0, np.cumsum(lengths.astype(np.int64))), low, text))
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in sent]
    for c in range(CELLS):
        names: dict[bytes, int] = {}
        numbers, least = [], []
        for cells, ends, low, text in sent:
            ends = ends[cells[c] : cells[c + 1] + 1]
            raw, ends = text[ends[0] : ends[-1]].tobytes(), (ends - ends[0]).tolist()
            cut = [raw[a:b] for a, b in zip(ends, ends[1:])]
            numbers.append(np.fromiter((names.setdefault(x, len(names)) for x in cut), np.int64, len(cut)))
            least.append(low[cells[c] : cells[c + 1]])
        if not names:
            continue
        low = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(low, np.concatenate(numbers), np.concatenate(least))
        counts, lengths, values = smallest(np.array([len(x) for x in names], np.int64), low, np.frombuffer(b"".join(names), np.uint8))
        heads = np.cumsum(counts) - counts
        for parts, own in zip(found, numbers, strict=True):
            n = counts[own]
            run = np.repeat(heads[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            parts.append((n.astype(np.uint8), lengths[run].astype(np.uint8), values[run]))
    answers = [pack_blob(*map(np.concatenate, zip(*parts, strict=True))) for parts in found]
    return pa.table({"pack": rows.column("pack"), "bucket": rows.column("bucket"), "blob": pa.array(answers, pa.binary())})


def _mail(table: pa.Table, kind: int) -> dict[int, bytes]:
    own = table.filter(pc.equal(table.column("kind"), kind))
    return dict(zip(own.column("bucket").to_pylist(), own.column("blob").to_pylist(), strict=True))


def dealt(n_bytes: int, partitions: int) -> tuple[int, int]:
    """Packs and buckets for so many bytes of text: they follow the text, so what one of them holds doesn't."""
    return max(PACKS * partitions, -(-n_bytes // PACK_BYTES)), max(BUCKETS * partitions, -(-n_bytes // BUCKET_BYTES))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_bytes`` of the text in UTF-8, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``
    of the bytes that are left and, if asked for, ``kept`` (binary).

    A byte goes if it lies in a string of LENGTH bytes that also begins in a document with a smaller id. Null texts are empty. Rows of the same id never
    remove from each other; a row without an id is left whole and removes nothing. Ids are whole numbers. Other columns are left out.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs, n = dealt(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0, partitions)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    packed = source.select(F.pmod(F.xxhash64("id", "tag"), F.lit(packs)).cast("int").alias("pack"), "id", "tag", "text")

    def ask(table: pa.Table) -> pa.Table:
        return _rows(table.column("pack")[0].as_py(), [*Pack(table, n).anchors()])

    def send(table: pa.Table, mail: pa.Table) -> pa.Table:
        if not len(table):
            return _rows(0, [])
        pack = Pack(table, n)
        pack.chosen(_mail(mail, 0))
        return _rows(table.column("pack")[0].as_py(), [*pack.requests()])

    def finish(table: pa.Table, mail: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({c: [] for c in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}, schema=shape)
        pack = Pack(table, n)
        pack.chosen(_mail(mail, 0))
        gone = pack.removed(_mail(mail, 1))
        total = np.append(0, np.cumsum(gone))
        starts = pack.ends - np.diff(pack.ends, prepend=0)
        begins = gone & ~np.append(False, gone[:-1])
        begins[starts[starts < len(gone)]] = gone[starts[starts < len(gone)]]
        spans = np.append(0, np.cumsum(begins))
        left = pack.text[~gone].tobytes()
        kept_ends = (pack.ends - total[pack.ends]).tolist()
        kept = [left[a:b] for a, b in zip([0, *kept_ends[:-1]], kept_ends, strict=True)]
        cols = [pack.rows.column("id"), pa.array(pack.ends - starts), pa.array(total[pack.ends] - total[starts]), pa.array(spans[pack.ends] - spans[starts])]
        return pa.Table.from_arrays([*cols, pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept if keep_text else [None] * len(kept), pa.binary())], schema=shape)

    shape = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    flags = packed.groupBy("pack").applyInArrow(ask, _MAIL).groupBy("bucket").applyInArrow(_flags, _MAIL).withColumn("kind", F.lit(0))
    requests = packed.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(send, _MAIL)
    answers = requests.groupBy("bucket").applyInArrow(_answers, _MAIL).withColumn("kind", F.lit(1))
    done = packed.groupBy("pack").cogroup(flags.unionByName(answers).groupBy("pack")).applyInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))
