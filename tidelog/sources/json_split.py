"""Large JSON files without line ends between their records, read by many tasks.

Spark's text reader cuts a file into byte ranges and ends a piece at every closing brace, in quotes or not. A task can't
know whether its range begins inside a string or how deep it is, so it says what the range does from either quote state: the
brackets that it closes and those that it leaves open. These maps, one for each range, are composed in the order of the file
and give every range its true start. A second read cuts out records; one that crosses ranges is put together from its parts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of an outer object up to which it is looked at as a whole; longer ones must wrap a list of records.
LIMIT = 1 << 20
#: Closing brackets of outer levels that a range tells the places of.
CLOSERS = 256

_EVENT = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{\[\]]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.S)

Open = list  # bracket, its place in the file, the key in front of it


def events(piece: str, quoted: bool) -> tuple[list[tuple[str, int]], bool]:
    """Brackets outside strings and their places, the brace at the end included, and whether the piece ends in a string."""
    out, at = [], 0
    if quoted:
        rest = _REST.match(piece)
        if not rest[1]:
            return out, True
        at = rest.end()
    for m in _EVENT.finditer(piece, at):
        if m[1] is None:
            out.append((m[0], m.start()))
        elif not m[1]:
            return out, True
    out.append(("}", len(piece)))
    return out, False


def _key(piece: str, at: int) -> str:
    found = _KEY.search(piece, max(0, at - 300), at)
    return found[1] if found else ""


class Summary:
    """What a range does from one quote state."""

    def __init__(self, quoted: bool):
        self.quoted, self.closed, self.closers, self.open = quoted, 0, [], []

    def add(self, piece: str, start: int) -> None:
        found, self.quoted = events(piece, self.quoted)
        for bracket, at in found:
            if bracket in "{[":
                self.open.append([bracket, start + at, _key(piece, at)])
            elif self.open:
                self.open.pop()
            else:
                self.closed += 1
                if len(self.closers) < CLOSERS:
                    self.closers.append(start + at)

    def tell(self) -> list:
        return [self.quoted, self.closed, self.closers, self.open]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, str, dict]]:
    """file, range, place and text of the pieces in order, and the other columns' values of their range. Places count characters from the range's first byte, so they ascend in a file."""
    now, place = None, 0
    for b in batches:
        names = [n for n in b.schema.names if n not in ("file", "start", "value")]
        others = [b.column(n).to_pylist() for n in names]
        for k, (file, start, value) in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "start", "value")), strict=True)):
            if (file, start) != now:
                now, place = (file, start), start
                if not start:
                    value = value.removeprefix("\ufeff")
            yield file, start, place, value, {n: o[k] for n, o in zip(names, others, strict=True)}
            place += len(value) + 1


def summaries(pieces: DataFrame) -> DataFrame:
    """file, start and told of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, both, done = None, [], []
        for file, start, place, value, _ in _ranges(batches):
            if (file, start) != now:
                if both:
                    done.append((*now, json.dumps([s.tell() for s in both])))
                now, both = (file, start), [Summary(False), Summary(True)]
            for s in both:
                s.add(value, place)
        if both:
            done.append((*now, json.dumps([s.tell() for s in both])))
        files, starts, told = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(told, pa.string())], ["file", "start", "told"])

    return pieces.mapInArrow(run, "file string, start long, told string")


def _begin(ranges: pd.DataFrame, limit: int) -> pd.DataFrame:
    """The quote state and open brackets in front of each range of one file, and whether the outer value that crosses its start, and its end, is a long one."""
    ranges = ranges.sort_values("start")
    quoted, stack, begun, ends = False, [], [], {}
    for told in map(json.loads, ranges["told"]):
        begun.append((quoted, list(stack)))
        quoted, closed, closers, opened = told[quoted]
        if stack and closed >= len(stack):
            ends[stack[0][1]] = closers[len(stack) - 1] if len(stack) <= len(closers) else None
        stack = stack[: max(0, len(stack) - closed)] + opened
    long = lambda s: bool(s) and (ends.get(s[0][1]) is None or ends[s[0][1]] - s[0][1] > limit)
    after = [s for _, s in begun[1:]] + [stack]
    return pd.DataFrame({"file": ranges["file"], "start": ranges["start"], "begin": [json.dumps([q, s, long(s), long(a)]) for (q, s), a in zip(begun, after, strict=True)]})


class Cutter:
    """Cuts the records out of one range: rows of unit (place of its first character), kind, top, box, key, alone and text.

    A top-level object up to the limit is a unit of kind "whole"; objects in a top-level list, or in the outermost lists of a long object, are units of kind
    "item" of ``box``, their list's place. ``top`` is the long object's place, -1 where the list is the top itself. A long object gives a row of kind "top".
    """

    def __init__(self, begin: str, limit: int):
        self.quoted, self.stack, long, self.long_end = json.loads(begin)
        self.limit = limit
        self.fresh = self.item_fresh = False  # the outer object, and the item, begin in this range
        self.whole: list[str] | None = [] if self.stack and self.stack[0][0] == "{" and not long else None
        self.held: list[tuple] = []
        self.size, self.item = 0, None
        if self.whole is None and self._inside():
            self.item = []

    def _box(self) -> int | None:
        """The index of the outermost list."""
        return next((k for k, o in enumerate(self.stack) if o[0] == "["), None)

    def _inside(self) -> bool:
        k = self._box()
        return k is not None and len(self.stack) > k + 1 and self.stack[k + 1][0] == "{"

    def _row(self, parts: list[str], alone: bool) -> tuple:
        if self.whole is not None and parts is self.whole:
            return self.stack[0][1], "whole", -1, -1, "", alone, "".join(parts)
        k = self._box()
        box = self.stack[k]
        return self.stack[k + 1][1], "item", -1 if k == 0 else self.stack[0][1], box[1], box[2] if k == 1 else "", alone, "".join(parts)

    def add(self, piece: str, place: int) -> Iterator[tuple]:
        found, self.quoted = events(piece, self.quoted)
        text = piece + "}"
        # where what was open before goes on
        whole_from, item_from = 0, 0
        for bracket, at in found:
            if bracket in "{[":
                self.stack.append([bracket, place + at, _key(piece, at)])
                if len(self.stack) == 1:
                    self.whole, self.held, self.size, whole_from = ([] if bracket == "{" else None), [], 0, at
                    self.fresh = True
                k = self._box()
                if bracket == "{" and k is not None and len(self.stack) == k + 2:
                    self.item, self.item_fresh, item_from = [], True, at
            elif self.stack:
                if bracket == "}":  # the piece's end
                    if self.item is not None and len(self.stack) == self._box() + 2:
                        self.item.append(text[item_from:])
                        row = self._row(self.item, self.item_fresh)
                        self.item = None
                        if self.whole is None:
                            yield row
                        else:
                            self.held.append(row)
                    if self.whole is not None and len(self.stack) == 1:
                        self.whole.append(text[whole_from:])
                        yield self._row(self.whole, self.fresh)
                        self.whole, self.held, self.stack = None, [], []
                        return
                    self._keep(text, whole_from, item_from)
                    self.stack.pop()
                    yield from self._grown()
                    return
                self.stack.pop()
        if self.quoted:
            self._keep(text, whole_from, item_from)
            yield from self._grown()

    def _keep(self, text: str, whole_from: int, item_from: int) -> None:
        if self.item is not None:
            self.item.append(text[item_from:])
        if self.whole is not None:
            self.whole.append(text[whole_from:])
            self.size += len(self.whole[-1])

    def _grown(self) -> Iterator[tuple]:
        if self.whole is not None and self.size > self.limit and self.fresh:
            yield from self._lengthened()

    def _lengthened(self) -> Iterator[tuple]:
        yield self.stack[0][1] if self.stack else 0, "top", self.stack[0][1], -1, "", True, ""
        yield from self.held
        self.whole, self.held = None, []

    def end(self) -> Iterator[tuple]:
        """What the range's end cuts off."""
        if self.whole is not None and self.stack:
            if self.fresh and self.long_end:
                yield from self._lengthened()
            else:
                yield self._row(self.whole, False)
                return
        if self.item:
            yield self._row(self.item, False)


UNIT = "file string, unit long, kind string, top long, box long, key string, part long, alone boolean, text string"


def units(pieces: DataFrame, limit: int) -> DataFrame:
    """The units of pieces with ``begin``, as rows of UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        names, rows, size, now, cutter = [x.split(" ")[0] for x in UNIT.split(", ")], [], 0, None, None

        def give() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def take(found: Iterator[tuple]) -> int:
            n = 0
            for unit, kind, top, box, key, alone, text in found:
                rows.append((now[0], unit, kind, top, box, key, now[1], alone, text))
                n += len(text)
            return n

        for file, start, place, value, more in _ranges(batches):
            if (file, start) != now:
                if cutter is not None:
                    take(cutter.end())
                now, cutter = (file, start), Cutter(more["begin"], limit)
            size += take(cutter.add(value, place))
            if size > 4 << 20:
                yield give()
                size = 0
        if cutter is not None:
            take(cutter.end())
        yield give()

    return pieces.mapInArrow(run, UNIT)


def split_json(spark: SparkSession, path: str, wrappers: list[str], limit: int = LIMIT) -> DataFrame:
    """file, line (place in the file), kind and text of every top-level object and of every object in a top-level list or in the list that a long object wraps.

    Of a long object's outermost lists of objects the one whose key comes first in ``wrappers`` counts, else the one with most objects; without any it is an
    error. All ranges' maps go to each task: one row for each of Spark's splits, so some 100 bytes for each spark.sql.files.maxPartitionBytes.
    """
    pieces = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    begins = summaries(pieces).groupBy("file").applyInPandas(lambda ranges: _begin(ranges, limit), "file string, start long, begin string")
    rows = units(pieces.join(F.broadcast(begins), ["file", "start"]), limit)
    broken = rows.where("NOT alone").groupBy("file", "unit", "kind", "top", "box", "key").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    joined = broken.select("file", "unit", "kind", "top", "box", "key", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    whole = rows.where("alone").select(*joined.columns).unionByName(joined)
    counts = whole.where("top >= 0").groupBy("file", "top", "box", "key").agg(F.count_if(F.col("kind") == "item").alias("n"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, wrappers)), F.col("key")), F.lit(0)), F.lit(len(wrappers) + 1))
    chosen = counts.groupBy("file", "top").agg(F.min_by("box", F.struct(F.col("n") == 0, rank, -F.col("n"), F.col("box"))).alias("of"), F.max("n").alias("most"))
    checked = chosen.select(F.col("file").alias("f"), F.col("top").alias("t"), F.when(F.col("most") > 0, F.col("of")).otherwise(F.raise_error(F.concat(F.lit("an object longer than the limit wraps no list of objects: "), "file")).cast("long")).alias("of"))
    inner = whole.where("top >= 0 AND kind = 'item'").join(checked, (F.col("file") == F.col("f")) & (F.col("top") == F.col("t")) & (F.col("box") == F.col("of")), "left_semi")
    return whole.where("top < 0").unionByName(inner).select("file", F.col("unit").alias("line"), "kind", "text")
