"""Byte pair merging with a pair occurrence index, and an encoder and decoder for word-level BPE vocabularies.

``merge_all`` takes the words of a partition together. It maps every adjacent pair that has a rank to the list
of all its positions, takes the active ranks in ascending order, merges at all of a rank's positions, and enters
the pairs that come to be into the lists of their ranks.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, texts_of
from .letters import NEWER, SMALL, WHITE, bracket, letters_and_numbers

#: Words whose ids a worker remembers in each of two generations.
MEMO = 150_000
#: Bytes of text that are encoded together, and words that are merged together: lists of all their symbols take a hundred times as much for a while.
BATCH, WORDS = 1 << 20, 1 << 14
_GAP = 0xFFFFF


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    kept = set(own)
    return [chr(b if b in kept else next(rest)) for b in range(256)]


class Merges:
    """The rank and product of each pair, by the pair's two ids in one integer."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        self.rank, self.first, self.second, self.made = {}, [], [], []
        for a, b in merges:
            x, y = vocab[a], vocab[b]
            self.rank[x << 20 | y] = len(self.made)
            self.first.append(x)
            self.second.append(y)
            self.made.append(vocab[a + b])

        self.pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        self.order = np.argsort(self.pairs)
        self.pairs = self.pairs[self.order]

    def index(self, ids: np.ndarray) -> dict[int, list[int]]:
        """The positions of every pair that has a rank, by rank."""
        pairs = ids[:-1] << 20 | ids[1:]
        if not len(self.pairs):
            return {}
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        places = np.flatnonzero(self.pairs[at] == pairs)
        if not len(places):
            return {}
        ranks = self.order[at[places]]
        places = places[by_rank := np.argsort(ranks, kind="stable")]
        ranks = ranks[by_rank]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        flat = places.tolist()
        return {r: flat[a:b] for r, a, b in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(flat)], strict=True)}

    def merge_all(self, words: Iterable[list[int]]) -> list[list[int]]:
        """The ids of each word after all merges. Every product has one pair only, so ranks never come up too late."""
        rank_of, first, second, made, push = self.rank.get, self.first, self.second, self.made, heapq.heappush
        ids, starts = [_GAP], []
        for word in words:
            starts.append(len(ids))
            ids += word
            ids.append(_GAP)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where = self.index(np.asarray(ids, np.int64))
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, c = first[r], second[r], made[r]
            places = where.pop(r)
            if a == b:
                places.sort()  # pairs of equal symbols overlap, and the first of them merges
            for p in places:
                if ids[p] != a or ids[q := after[p]] != b:
                    continue
                ids[p], ids[q] = c, -1
                after[p] = t = after[q]
                before[t] = p
                if (x := ids[s := before[p]]) != _GAP and (k := rank_of(x << 20 | c)) is not None:
                    if k in where:
                        where[k].append(s)
                    else:
                        where[k] = [s]
                        push(active, k)
                if (x := ids[t]) != _GAP and (k := rank_of(c << 20 | x)) is not None:
                    if k in where:
                        where[k].append(p)
                    else:
                        where[k] = [p]
                        push(active, k)
        out = []
        for p in starts:
            one = []
            while ids[p] != _GAP:
                one.append(ids[p])
                p = after[p]
            out.append(one)
        return out


class Memo(dict):
    """Remembers what was met of late: when the young generation is full it becomes the old one, and the old one goes."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """Keys that neither generation has; those of the old one become young again."""
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()
        keys = keys - self.keys()
        self.update({k: self.old[k] for k in keys & self.old.keys()})
        return keys - self.keys()


class WordBpe:
    """A vocabulary whose text is normalised (NFC, one blank for white space, lower case), split by a pattern and merged
    within words that end in a suffix. White space never stays, so each stretch without it is encoded on its own."""

    def __init__(self, config: str):
        spec = json.loads(config)
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.merges = Merges(vocab, spec["model"]["merges"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        self.token, self.digits = ([f(i) for i in range(max(names) + 1)] for f in (names.get, str))
        of_byte = byte_letters()
        self.inner, self.last = [vocab[c] for c in of_byte], [vocab[c + self.suffix] for c in of_byte]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        letters, digits = map(bracket, letters_and_numbers())
        white = bracket(WHITE)
        self.words = re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace(r"\s", white))
        self.capitals = re.compile(f"[{bracket(SMALL)}]")
        self.stretches = re.compile(f"[^{white}]+")
        self.special = re.compile("|".join(map(re.escape, self.added)))
        self.memo, self.of_word = Memo(), Memo()  # ids of a stretch and of a word: tuples of the vocabulary's own integers, nearly all of one or two
        self.alone = {i: (i,) for i in sorted({*self.inner, *self.last, *self.merges.made})}

    def merge(self, words: Iterable[str]) -> None:
        """Encodes words that were not met of late, all together."""
        inner, last, alone, words = self.inner, self.last, self.alone, iter(words)
        while new := list(islice(words, WORDS)):
            symbols = []
            for word in new:
                raw = word.encode()
                ids = [inner[b] for b in raw]
                ids[-1] = last[raw[-1]]
                symbols.append(ids)
            for word, ids in zip(new, self.merges.merge_all(symbols), strict=True):
                self.of_word[word] = tuple(ids) if len(ids) > 1 else alone[ids[0]]

    def learn(self, stretches: Iterable[str]) -> None:
        """Takes stretches of normalised text apart into words; letters alone are one word."""
        split = [(x, (x,) if x.isalpha() else self.words.findall(x)) for x in stretches]
        self.merge(self.of_word.missing({w for _, words in split for w in words}))
        of_word = self.of_word
        for stretch, words in split:
            if len(words) == 1:
                self.memo[stretch] = of_word[words[0]]
            else:
                self.memo[stretch] = tuple(chain.from_iterable([of_word[w] for w in words]))

    def split(self, text: str) -> list[str]:
        """The stretches of a text in normal form and lower case.

        Python's own split takes four control characters for white space, which the pattern does not, and its lower case looks at what follows a sigma.
        """
        if not text.isascii():
            text = composed(text)
            if "\u03a3" in text:
                text = "".join(map(str.lower, text))
            text = text.translate(SMALL) if self.capitals.search(text) else text
        text = text.lower()
        return self.stretches.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of its ids, the ids and the tokens, each joined by one blank."""
        split: list[list] = []
        for text in texts:
            parts, at = [], 0
            for m in self.special.finditer(text) if "<|" in text else ():
                parts += self.split(text[at : m.start()])
                parts.append((self.added[m[0]],))
                at = m.end()
            split.append(parts + self.split(text[at:]) if at else self.split(text))
        self.learn(self.memo.missing({x for parts in split for x in parts if type(x) is str}))
        memo, digits, token = self.memo, self.digits.__getitem__, self.token.__getitem__
        for parts in split:
            ids = list(chain.from_iterable([memo[p] if type(p) is str else p for p in parts]))
            yield len(ids), " ".join(map(digits, ids)), " ".join(map(token, ids))


def composed(text: str) -> str:
    """NFC by the library's tables: what is newer than they are stands apart, and only what is between is normalised."""
    if NEWER.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in NEWER.split(text))


@functools.lru_cache(1)
def encoder(config: str) -> WordBpe:
    """A worker's encoder: the words that it remembers serve the tasks that come later."""
    return WordBpe(config)


def encode_documents(docs: DataFrame, config: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_tokens``, ``ids`` (decimal, joined by one blank) and ``decoded`` (the tokens, joined by one blank, as a library without a decoder gives them).

    ``config`` is the vocabulary file's JSON text. A null or empty text has no tokens. Repeated rows and null ids stay, other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in by_bytes(batches, "text", BATCH):
            gc.disable()  # nothing here makes cycles, and collections would walk through all that is remembered
            try:
                n, ids, decoded = zip(*bpe.encode(texts_of(batch, "text")), strict=True)
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids string, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """SHA-256 of the ids and of the decoded text in place of both."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
