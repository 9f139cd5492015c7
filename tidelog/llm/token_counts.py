"""Token counts by a compiled finite-state tokenizer: two deterministic transducers, one behind the other.

The splitter, of eight states over nine symbols, emits a mark where a piece begins. A batch of text is cut into chunks
of equal length. For every chunk the map from the state before it to the state after it and to the number of marks
between is computed for all states at once; the maps are composed by a parallel prefix scan, which gives each chunk's
entry state; a second pass emits the marks.

The counter reads the bytes of a piece. Its state is what the tokens of a prefix depend on: the longest end of the
prefix that a token may begin with, and for every such end the last token before it and the tokens emitted since. Its
transitions are annotated with the number of tokens that they emit, which is negative where a longer token takes the
place of several. A piece's count is the sum along its path. Transitions are compiled from the vocabulary when first
met, by tests of neighbouring tokens; no text is ever merged. All pieces of a batch take their steps together.
"""

from __future__ import annotations

import functools
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import by_bytes, texts_of
from .letters import WHITE, letters_and_numbers

# States: what the piece so far is.
FREE, LETTERS, DIGITS, OTHERS, BLANKS, BLANK, TAIL1, TAIL2 = range(8)
# Symbols: the class of a character, with what follows it where that matters. CUT2 and CUT3 are apostrophes that begin
# a contraction of two or three characters; MORE is white space before more of it or the end; ONE_BLANK and ONE_OTHER
# are white space before another character; STOP lies between texts.
LETTER, DIGIT, OTHER, CUT2, CUT3, MORE, ONE_BLANK, ONE_OTHER, STOP = range(9)
#: States of the counter up to which compiled transitions are kept; beyond, compilation starts anew.
STATES = 250_000
#: Pieces below which steps are taken one by one.
FEW = 48


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """The state after each symbol and state, and whether a piece begins there."""
    to, begins = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    for s in range(8):
        for symbol, run in ((LETTER, LETTERS), (DIGIT, DIGITS), (OTHER, OTHERS)):
            to[symbol, s], begins[symbol, s] = run, s not in (run, BLANK)
        for symbol, tail in ((CUT2, TAIL1), (CUT3, TAIL2)):
            goes_on = s in (OTHERS, BLANK)
            to[symbol, s], begins[symbol, s] = (OTHERS if goes_on else tail), not goes_on
        to[MORE, s], begins[MORE, s] = BLANKS, s != BLANKS
        to[ONE_BLANK, s], begins[ONE_BLANK, s] = BLANK, True
        to[ONE_OTHER, s], begins[ONE_OTHER, s] = FREE, True
    to[LETTER, TAIL2], begins[LETTER, TAIL2] = TAIL1, False
    to[LETTER, TAIL1], begins[LETTER, TAIL1] = FREE, False
    return to, begins


@functools.cache
def classes() -> np.ndarray:
    """LETTER, DIGIT, OTHER or MORE (white space) for each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, codes in ((LETTER, letters_and_numbers()[0]), (DIGIT, letters_and_numbers()[1]), (MORE, WHITE)):
        out[list(codes)] = kind
    return out


def symbols(codes: np.ndarray, kinds: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The splitter's input for a text of code points; ``stops`` are the positions between texts, the last one included."""
    out = kinds[codes]
    out[stops] = MORE
    white = out == MORE
    lone = np.flatnonzero(white[:-1] & ~white[1:])
    out[lone] = np.where(codes[lone] == 0x20, ONE_BLANK, ONE_OTHER)
    quote = np.flatnonzero(codes == 0x27)
    quote = quote[quote < len(codes) - 2]
    if len(quote):
        first, second = np.where(np.isin(quote + 1, stops), 0, codes[quote + 1]), codes[quote + 2]
        out[quote[np.isin(first, [*map(ord, "stmd")])]] = CUT2
        for a, b in ("re", "ve", "ll"):
            out[quote[(first == ord(a)) & (second == ord(b))]] = CUT3
    out[stops] = STOP
    return out


def scan(maps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix composition of maps from a state to a state and a count (both chunks x states), by doubling: log2 of the number of chunks rounds."""
    step = 1
    while step < len(maps):
        before = maps[:-step].copy()
        counts[step:] = counts[:-step] + np.take_along_axis(counts[step:], before, axis=1)
        maps[step:] = np.take_along_axis(maps[step:], before, axis=1)
        step *= 2
    return maps, counts


def boundaries(text: np.ndarray, to: np.ndarray, begins: np.ndarray, length: int = 1024) -> np.ndarray:
    """Positions at which a piece begins, for a sequence of symbols."""
    n = len(text)
    chunks = max(1, -(-n // length))
    rows = np.full(chunks * length, STOP, np.uint8)
    rows[:n] = text
    steps = np.ascontiguousarray(rows.reshape(chunks, length).T).astype(np.intp) * 8
    flat, emits = to.ravel(), begins.ravel()
    maps, counts = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1)), np.zeros((chunks, 8), np.int64)
    for at in steps:
        edge = at[:, None] + maps
        counts += emits[edge]
        maps = flat[edge]
    maps, counts = scan(maps, counts)
    state, number = np.zeros(chunks, np.uint8), np.zeros(chunks, np.int64)
    state[1:], number[1:] = maps[:-1, FREE], counts[:-1, FREE]
    out = np.empty(int(counts[-1, FREE]), np.int64)  # each chunk puts its marks behind those of the chunks before it
    for k, at in enumerate(steps):
        edge = at + state
        marked = np.flatnonzero(emits[edge])
        out[number[marked]] = marked * length + k
        number[marked] += 1
        state = flat[edge]
    return out[: np.searchsorted(out, n)]


class Vocabulary:
    """The tokens of a byte-level BPE vocabulary as a tree, and the test of neighbours."""

    def __init__(self, config: str):
        spec = json.loads(config)
        vocab = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            x, y = vocab[a], vocab[b]
            self.rank[x << 20 | y] = r
            self.parts[vocab[a + b]] = x, y, r
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.edges: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        depth, token = [0], [-1]
        for name, number in vocab.items():
            node = 0
            for c in name:
                key = node << 8 | byte_of[c]
                if (child := self.edges.get(key)) is None:
                    child = self.edges[key] = len(depth)
                    children[node].append((key & 255, child))
                    children.append([])
                    depth.append(depth[node] + 1)
                    token.append(-1)
                node = child
            token[node] = number
        #: For each node: the node of its longest proper end; the (length, token) of its ends that are tokens; the lengths of its ends that go on to longer tokens.
        self.shorter, self.tokens, self.open = [0] * len(depth), [()] * len(depth), [()] * len(depth)
        self.open[0] = (0,)
        queue = [0]
        for node in queue:
            for byte, child in children[node]:
                end = self.shorter[child] = self.step(self.shorter[node], byte) if node else 0
                self.tokens[child] = ((depth[child], token[child]), *self.tokens[end]) if token[child] >= 0 else self.tokens[end]
                self.open[child] = (depth[child], *self.open[end]) if children[child] else self.open[end]
                queue.append(child)
        self.known: dict[int, bool] = {}
        self.sides: tuple[dict, dict] = {}, {}

    def step(self, node: int, byte: int) -> int:
        """The node of the longest end of ``node`` and a byte."""
        while (found := self.edges.get(node << 8 | byte)) is None and node:
            node = self.shorter[node]
        return found or 0

    def side(self, token: int, which: int) -> list[tuple[int, float]]:
        """The parts along a token's right (1) or left (0) side, each with the rank at which it goes into a larger one."""
        if (out := self.sides[which].get(token)) is None:
            out, part = [(token, float("inf"))], token
            while part in self.parts:
                whole = self.parts[part]
                part = whole[which]
                out.append((part, whole[2]))
            self.sides[which][token] = out
        return out

    def neighbours(self, x: int, y: int) -> bool:
        """Whether two tokens stay as they are side by side: no pair of parts at their border merges before one of both goes into its larger part.
        Of equal pairs the left one merges first."""
        key = x << 20 | y
        if (good := self.known.get(key)) is None:
            rank = self.rank.get
            good = self.known[key] = not any((r := rank(a << 20 | b)) is not None and r < upto and r <= until for a, upto in self.side(x, 1) for b, until in self.side(y, 0))
        return good


class Counter:
    """The transducer that counts the tokens of pieces, as far as it is compiled."""

    def __init__(self, config: str):
        self.vocabulary = Vocabulary(config)
        self.to, self.begins = splitter()
        self.clear()

    def clear(self) -> None:
        self.number = {(0, -1, 0): 0}
        self.states = [(0, -1, 0)]
        #: By state and byte: the next state and the tokens emitted, in one number.
        self.edges: dict[int, int] = {}
        self.bits = 16
        self.room(1 << self.bits)

    def room(self, size: int) -> None:
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)  # fixed value: 2**64 over the golden ratio

    def enter(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Puts compiled transitions into the table that all pieces look up at once."""
        at = self.slots(keys)
        while len(keys):
            self.keys[at] = np.where(self.keys[at] == -1, keys, self.keys[at])  # of several for one free slot one stays
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & (len(self.keys) - 1)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The transitions' values; -1 where one is not compiled."""
        at = self.slots(keys)
        found = self.keys[at]
        out = self.values[at]
        rest = np.flatnonzero(found != keys)
        if len(rest):
            out[rest[found[rest] == -1]] = -1
            rest = rest[found[rest] != -1]
            at = at[rest]
            while len(rest):
                at = (at + 1) & (len(self.keys) - 1)
                found = self.keys[at]
                out[rest] = np.where(found == -1, -1, self.values[at])
                on = (found != keys[rest]) & (found != -1)
                rest, at = rest[on], at[on]
        return out

    def compile(self, key: int) -> int:
        """The transition of a state and a byte: the last token is the one that ends there and may stand behind what lies before it."""
        v, state = self.vocabulary, self.states[key >> 8]
        ends = v.open[state[0]]
        node = v.step(state[0], key & 255)
        for length, token in v.tokens[node]:
            at = 2 * ends.index(length - 1) + 1
            if state[at] < 0 or v.neighbours(state[at], token):
                break
        emitted = state[at + 1] + 1
        new = [node]
        for length in v.open[node]:
            if length:
                at = 2 * ends.index(length - 1) + 1
                new += (state[at], state[at + 1] - emitted)
            else:
                new += (token, 0)
        name = tuple(new)
        if (number := self.number.get(name)) is None:
            number = self.number[name] = len(self.states)
            self.states.append(name)
        value = self.edges[key] = number << 16 | emitted + 32768
        return value

    def add(self, keys: list[int]) -> None:
        values = [self.compile(k) for k in keys]
        if 3 * len(self.edges) > len(self.keys):
            while 3 * len(self.edges) > len(self.keys):
                self.bits += 1
                self.room(1 << self.bits)
            self.enter(np.fromiter(self.edges, np.int64, len(self.edges)), np.fromiter(self.edges.values(), np.int64, len(self.edges)))
        else:
            self.enter(np.array(keys, np.int64), np.array(values, np.int64))

    def pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece of the bytes."""
        if len(self.states) > STATES:
            self.clear()
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        alive = len(starts) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) if len(lengths) else 0), "right")  # pieces longer than k
        state, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for k, n in enumerate(alive.tolist()):
            if n < FEW:
                self.one_by_one(raw, starts[:n], lengths[:n], state, count, k)
                break
            keys = state[:n] << 8 | raw[starts[:n] + k]
            value = self.look(keys)
            if (new := value < 0).any():
                self.add(np.unique(keys[new]).tolist())
                value[new] = self.look(keys[new])
            state[:n] = value >> 16
            count[:n] += (value & 65535) - 32768
        out = np.empty(len(starts), np.int64)
        out[order] = count
        return out

    def one_by_one(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray, count: np.ndarray, k: int) -> None:
        """The rest of the longest pieces, from their k-th bytes on."""
        added: list[int] = []
        for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            now, total, get = int(state[i]), int(count[i]), self.edges.get
            for byte in raw[a + k : a + n].tobytes():
                if (value := get(key := now << 8 | byte)) is None:
                    value = self.compile(key)
                    added.append(key)
                now = value >> 16
                total += (value & 65535) - 32768
            count[i] = total
        if added:
            self.add(added)

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; a special token's string in a text is one token."""
        parts, owner, extra = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            own = [text]
            for special in self.vocabulary.special:
                if special in text:
                    own = [x for part in own for x in part.split(special)]
            extra[k] = len(own) - 1
            parts += own
            owner += [k] * len(own)
        joined = "\0".join(parts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum([len(x) + 1 for x in parts]) - 1
        starts = boundaries(symbols(codes, classes(), stops), self.to, self.begins)
        part = np.searchsorted(stops, starts)
        ends = np.minimum(np.append(starts[1:], len(codes)), stops[part]) if len(starts) else starts
        if not joined.isascii():  # from characters to bytes
            at = np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))
            starts, ends = at[starts], at[ends]
        counts = self.pieces(np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8), starts, ends)
        total = np.bincount(np.asarray(owner, np.int64)[part], counts, len(texts)).astype(np.int64) + np.asarray(extra, np.int64)
        return total.tolist()


@functools.lru_cache(1)
def counter(config: str) -> Counter:
    """A worker's counter: what it has compiled serves the tasks that come later."""
    return Counter(config)


def count_tokens(docs: DataFrame, config: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``config`` is the vocabulary file's JSON text. A null or empty text has no bytes and no tokens. Repeated rows and null ids stay, other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for batch in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(own.count(texts_of(batch, "text")), pa.int64())], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
