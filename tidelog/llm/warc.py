"""WARC records and a Merkle fixity audit of their replicas, with DataFrame functions only.

Every record is hashed. Within a file the hashes of ordered offset ranges are hashed together, FANOUT at a time, up to
the file's root; the roots of files go on in the same way up to the replica's root. Two replicas are compared from their
roots down; only below a node that differs are children looked at, so the rows compared follow the damage.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointing

FANOUT = 16
#: Records in a file: two levels of the tree.
PER_FILE = FANOUT * FANOUT
#: Files that take the records which no id places.
HASHED_FILES = 1 << 20


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id and record: the page as a WARC/1.1 resource record. A null url or page is empty."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.col(id_col).alias("id"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def write_files(recs: DataFrame, path: str) -> None:
    """Writes records as WARC files by Spark's text writer, in the order of their ids; the writer's line end is the last one of each record."""
    recs.sortWithinPartitions("id").select(F.substring("record", F.lit(1), F.length("record") - 1).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def read_files(spark, path: str) -> DataFrame:
    """id, url, html and whole (the length is as stated) of records in the files that ``write_files`` made. A body may hold anything but the mark that begins a record."""
    rows = spark.read.text(path, lineSep="WARC/1.1\r\n").where("value <> ''")
    header = lambda name: F.regexp_extract("value", rf"(?s)^(?:[^\r\n]+\r\n)*?{name}: ([^\r\n]*)\r\n", 1)
    body = F.regexp_replace("rest", r"(?s)\r\n\r\n\z", "")
    rest = F.regexp_extract("value", r"(?s)^(?:[^\r\n]+\r\n)*\r\n(.*)\z", 1)
    out = rows.select(F.regexp_extract(header("WARC-Record-ID"), r"<urn:page:(-?\d*)>", 1).alias("id"), header("WARC-Target-URI").alias("url"), header("Content-Length").alias("size"), rest.alias("rest"))
    return out.select(F.when(F.col("id") != "", F.col("id").cast("long")).alias("id"), "url", body.alias("html"), (F.octet_length(body) == F.expr("try_cast(size as int)")).alias("whole"))


def hashed(recs: DataFrame) -> DataFrame:
    """id, size, hash and copies of each distinct record."""
    lean = recs.select("id", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("hash"))
    return lean.groupBy("id", "size", "hash").agg(F.count("*").alias("copies"))


def leaves(lean: DataFrame, full: DataFrame) -> DataFrame:
    """file, node, id, start, end, copies and hash of each distinct record: a file holds PER_FILE successive ids, ``node`` is the id's place among them,
    so that a lost or added record moves no other. ``start`` and ``end`` are the record's offsets in its own replica.

    Records without an id, or with one of the ids in ``full`` (of more than PER_FILE different records), are dealt out by hash to files and nodes of their own.
    """
    apart = lean.join(full, "id", "left").select(*lean.columns, (F.col("id").isNull() | F.col("full").isNotNull()).alias("apart"))
    spread = F.pmod(F.xxhash64("id", "hash"), F.lit(HASHED_FILES * PER_FILE))
    place = F.when(F.col("apart"), spread).otherwise(F.col("id"))
    file = whole(place, PER_FILE)
    placed = apart.select(F.when(F.col("apart"), -1 - (1 << 40) - file).otherwise(file).alias("file"), F.pmod(place, F.lit(PER_FILE)).cast("long").alias("node"), "id", "size", "hash", "copies")
    end = F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("file").orderBy("node", "id", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.select("file", "node", "id", (end - F.col("size") * F.col("copies")).alias("start"), end.alias("end"), "copies", "hash")


def _up(nodes: DataFrame, by: dict[str, Column]) -> DataFrame:
    """The next level: a hash over the ordered children, with the range of offsets that they cover. Offsets are not hashed, as they move with every record before."""
    copies = F.col("copies") if "copies" in nodes.columns else F.lit(1).cast("long").alias("copies")
    keyed = nodes.select(*(c.alias(f"of_{k}") for k, c in by.items()), F.struct("node", "hash", copies).alias("kid"), "start", "end")
    up = keyed.groupBy(*(F.col(f"of_{k}").alias(k) for k in by)).agg(F.array_sort(F.collect_list("kid")).alias("kids"), F.min("start").alias("start"), F.max("end").alias("end"))
    text = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["node"].cast("string"), k["copies"].cast("string"), k["hash"])), ",")
    return up.select(*by, "start", "end", F.sha2(text, 256).alias("hash"))


def whole(a: Column, n: int) -> Column:
    """The whole part of a / n, rounded down, without doubles: ids of 64 bits keep all of theirs."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n).cast("long"))


def parent(depth: int) -> dict[str, Column]:
    """The key of the node above one of a level: 0 are records and 1 ranges of a file, keyed by file and node, 2 are files and above them ranges of files, keyed by node."""
    if depth == 0:
        return {"file": F.col("file"), "node": whole(F.col("node"), FANOUT)}
    return {"node": F.col("file") if depth == 1 else whole(F.col("node"), FANOUT)}


def trees(*replicas: DataFrame) -> list[list[DataFrame]]:
    """The levels of each replica's tree from the records up, all equally high. The records' hashes are written once, so that levels read hashes only."""
    checkpointing(replicas[0].sparkSession)
    lean = [hashed(recs).checkpoint() for recs in replicas]
    many = [x.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > PER_FILE).select("id") for x in lean]
    full = functools.reduce(DataFrame.union, many).distinct().withColumn("full", F.lit(True)).checkpoint()
    out = [[leaves(x, full).checkpoint()] for x in lean]
    for levels in out:
        levels.append(_up(levels[0], parent(0)))
        levels.append(_up(levels[1], parent(1)).checkpoint())
    while (most := max(levels[-1].count() for levels in out)) > 1:
        key = parent(2) if most > FANOUT else {"node": F.lit(0).cast("long")}
        for levels in out:
            levels.append(_up(levels[-1], key).checkpoint())
    return out


def audit(recs: DataFrame, replica: DataFrame) -> DataFrame:
    """file, rank, start, end, id, expected and found: the records of a replica that differ. ``rank`` is the place in the file, ``start`` and ``end`` are
    the offsets in the first replica, or in the second where the first lacks the record. Equal roots give no rows: the comparison ends there.

    Both take (id, record). A record that one side lacks has a null hash there and is one row, wherever it stood. Different records of one id are set
    against each other in the order of their hashes, without those that both sides have. A record that one side has more often has the same hash twice.
    Empty tables are equal.
    """
    ours, theirs = trees(recs, replica)
    bad: DataFrame | None = None
    for depth in reversed(range(len(ours))):
        keys = ["file", "node"] if depth < 2 else ["node"]
        sides = []
        for levels in (ours, theirs):
            level = levels[depth]
            if bad is not None:
                last = depth + 2 == len(ours) and depth > 1  # all nodes below the root
                above = {"node": F.lit(0).cast("long")} if last else parent(depth)
                level = level.select("*", *(c.alias(f"up_{k}") for k, c in above.items())).join(bad, [f"up_{k}" for k in above], "left_semi")
            sides.append(level)
        if depth:
            names = [side.select(*keys, F.col("hash").alias(f"hash{k}")) for k, side in enumerate(sides)]
            bad = names[0].join(names[1], keys, "full").where(~F.col("hash0").eqNullSafe(F.col("hash1"))).select(*(F.col(k).alias(f"up_{k}") for k in keys)).checkpoint()
            if bad.isEmpty():  # nothing below differs
                keys, sides = ["file", "node"], [levels[0].limit(0) for levels in (ours, theirs)]
                break
    # below the ranges that differ are at most FANOUT nodes each, of at most PER_FILE different records
    one = F.struct("hash", "copies", "id", "start", "end")
    listed = [side.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias(f"side{k}")) for k, side in enumerate(sides)]
    both = listed[0].join(listed[1], keys, "full")
    lacks = lambda a, b: F.filter(F.coalesce(a, F.array()), lambda x: ~F.exists(F.coalesce(b, F.array()), lambda y: (x["hash"] == y["hash"]) & (x["copies"] == y["copies"]) & x["id"].eqNullSafe(y["id"])))
    pairs = F.arrays_zip(lacks(F.col("side0"), F.col("side1")).alias("a"), lacks(F.col("side1"), F.col("side0")).alias("b"))
    rows = both.select("file", "node", F.explode(pairs).alias("x"))
    first = lambda c: F.coalesce(F.col(f"x.a.{c}"), F.col(f"x.b.{c}")).alias(c)
    return rows.select("file", F.col("node").alias("rank"), first("start"), first("end"), first("id"), F.col("x.a.hash").alias("expected"), F.col("x.b.hash").alias("found"))
