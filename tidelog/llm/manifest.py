"""A Merkle manifest of a dataset: a tree for each group of rows and one over their roots, with a proof for each row.

Slot pivot: conditional aggregates put the children of a node into FANOUT columns. All columns joined and hashed are the
node; all but a child's own column are its siblings. Going down, a node hands its children the siblings of all levels above,
so a row's proof comes with its parent's slots and no table is joined with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import positions
from ..stored import written

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as text, their number in front."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tampered(text: Column, key: Column) -> Column:
    """The text as a careless copy has it: without capitals A-Z where 3 divides the key's checksum. A null key's text stays."""
    return F.when(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER))


def _names() -> list[str]:
    return [f"s{k}" for k in range(FANOUT)]


def pivot(nodes: DataFrame, kept: Column) -> DataFrame:
    """tree, pos, n, s0, s1, ... of the parents of nodes (tree, pos, n, ...): ``kept`` of each child in its slot's column."""
    slot = F.col("pos") % FANOUT
    up = nodes.withColumn("kept", kept).groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("pos"), "n")
    return up.agg(*(F.max(F.when(slot == k, F.col("kept"))).alias(s) for k, s in enumerate(_names())))


def hashes(slots: list[Column]) -> Column:
    """The node over its children's hashes; the last slots may be empty."""
    return F.sha2(F.concat(*(F.coalesce(s, F.lit("")) for s in slots)), 256)


def forest(leaves: DataFrame, payload: list[str]) -> list[DataFrame]:
    """The levels of trees over leaves (tree, pos from 0 in it, n leaves in it, hash, payload): level 1 holds parents with their leaves (hash, payload) as slots,
    those above hold hashes. A tree ends where one node is left; a lone leaf has no level."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    while FANOUT ** len(levels) < most:
        if not levels:
            up = pivot(leaves.where("n > 1"), F.struct("hash", *payload)).withColumn("hash", hashes([F.col(f"{s}.hash") for s in _names()]))
        else:
            below = levels[-1].where(F.col("n") > FANOUT ** len(levels))
            up = pivot(below, F.col("hash")).withColumn("hash", hashes([F.col(s) for s in _names()]))
        levels.append(written(up, f"level{len(levels) + 1}"))
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree and hash of each tree's last node."""
    out = leaves.where("n = 1").select("tree", "hash")
    for k, level in enumerate(levels, 1):
        out = out.union(level.where(F.col("n") <= FANOUT**k).select("tree", "hash"))
    return out


def _children(level: DataFrame, payload: bool, more: list[str]) -> DataFrame:
    """A row for each child of the nodes: tree, pos, n, its slot and its siblings in front of those that its parent has."""
    names = _names()
    own = [F.col(f"{s}.hash") if payload else F.col(s) for s in names]
    joined = lambda of: F.concat(F.lit(""), *(F.coalesce(s, F.lit("")) for s in of))
    each = F.array(*(F.struct((F.col("pos") * FANOUT + k).alias("pos"), F.col(s).alias("child"), joined(own[:k]).alias("left"), joined(own[k + 1 :]).alias("right")) for k, s in enumerate(names)))
    rows = level.select("tree", "n", *more, "path", F.explode(each).alias("x")).where("x.child is not null")
    step = F.array(F.struct("x.left", "x.right"))
    return rows.select("tree", "x.pos", "n", *more, F.concat(step, F.col("path")).alias("path"), "x.child")


def proofs(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, payload: list[str]) -> DataFrame:
    """tree, hash, payload, path and the other columns of ``tops`` for each leaf: ``path`` holds its siblings (left, right), its own run first.

    ``tops`` has tree, path (above the tree's root) and further columns to hand down."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    lone = leaves.where("n = 1").join(tops, "tree").select("tree", "hash", *payload, *more, "path")
    above = None
    for k in range(len(levels), 0, -1):
        level = levels[k - 1].drop("hash")
        known = level.where(F.col("n") <= FANOUT**k).join(tops, "tree")
        if above is not None:
            known = known.unionByName(level.where(F.col("n") > FANOUT**k).join(above, ["tree", "pos", "n"]))
        above = _children(known, k == 1, more).drop(*(["child"] if k > 1 else []))
    if above is None:
        return lone
    return above.select("tree", "child.hash", *(f"child.{c}" for c in payload), *more, "path").unionByName(lone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda now, step: digest(step["left"], now, step["right"]))


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (tree, ...) with pos in their tree and n, its number of leaves. Trees may hold any share of the rows."""
    rows = positions(leaves, ["tree", *order], "at")
    trees = rows.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    return rows.join(trees, "tree").withColumn("pos", F.col("at") - F.col("first")).drop("at", "first")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of each row, and path, its siblings from the leaf up as (left, right).

    A leaf is the hash of the row's fields; leaves of a group ascend by id, nulls first, those of one id by hash, so repeated rows are leaves of their own
    side by side. The groups' roots ascend by group, null first, to the root. A lone leaf is its group's root, a lone group the root, an empty table gives no
    rows. ``folded_root`` is what the row's tampered copy and its siblings give; rows that tampering leaves as they are fold to the root. Other columns are left out.
    """
    fields = fields or FIELDS
    before = [field(F.col(c)) for c in fields]
    hurt = [field(F.coalesce(tampered(F.col(text_col), F.col(id_col)), F.col(text_col))) if c == text_col else b for c, b in zip(fields, before, strict=True)]
    marked = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    # a sign in front of every group, so that null comes before the empty name
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    lean = written(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), digest(*before).alias("hash"), F.when(marked, digest(*hurt)).alias("hurt")), "leaves")
    leaves = written(placed(lean, ["id", "hash"]), "placed")
    levels = forest(leaves, ["id", "hurt"])
    subroots = written(roots(leaves, levels), "subroots")
    groups = written(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash"), ["of"]), "groups")
    upper = forest(groups, ["of"])
    top = roots(groups, upper).select("tree", F.col("hash").alias("root"), F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    tops = written(proofs(groups, upper, top, ["of"]).select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", "path"), "tops")
    rows = proofs(leaves, levels, tops, ["id", "hurt"]).withColumn("folded_root", fold(F.coalesce("hurt", "hash"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), ""), 256)
    return rows.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path")
