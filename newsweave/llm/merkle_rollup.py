"""Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf; a group's leaves ascend by id, and while several nodes
remain, every ``FAN`` consecutive ones become one node. A leaf's rank within
its group, written in base ``FAN``, is its way down the tree. Blocks of
``FAN ** DIGITS`` consecutive leaves are rolled up on their own: the rank's
digits are grouped away one after the other, each time nesting the child
structs in their parent, all in the partitioning of the block. So a block is
one row of bounded size with its whole subtree. The table of block digests
(one row per ``FAN ** DIGITS`` leaves) is rolled up the same way, until one node
remains for each group; the groups' digests then form the last tree.

Going down, each level is one explode of the children, and the siblings passed
on the way are the proof: no leaf is joined with anything. The one join is by
block, which receives the digests above it.

H(x, y, ...) is the lowercase hex sha256 of the inputs concatenated; digests
go in as hex text. A leaf is H over its fields, each as its UTF-8 byte count,
``:`` and its value, or ``-`` for null, so no two rows share an input.

Nulls: every field may be null; the group null comes first. A null id ranks
first in its group and is never tampered with. Repeated ids: every row is a
leaf of its own; ties rank by leaf digest, and equal rows are interchangeable.
A run may hold a single node, which is hashed all the same; a group of one
leaf has that leaf as its root. Empty table: no rows. Columns that are not
fields are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import distributed_row_number
from ..session import broadcast_if_small
from .common import written

FAN = 8
#: Levels inside a block: 512 leaves, about 150 kB as one row.
DIGITS = 3
_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _several(level: int) -> Column:
    """More than one node remains below this level (levels count from 1)."""
    return F.col("total") > FAN ** (level - 1)


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """group, block, total and the nested tree ``n`` of each block."""
    size = FAN ** DIGITS
    cur = nodes.select(
        "group", F.expr(f"rank div {size}").alias("block"), "total", (F.col("rank") % size).alias("at"),
        F.struct((F.col("rank") % FAN).cast("int").alias("d"), F.col("node").alias("h"), *payload).alias("n")) \
        .repartition("group", "block")
    for level in range(1, DIGITS + 1):
        cur = cur.groupBy("group", "block", "total", F.expr(f"at div {FAN}").alias("at")) \
            .agg(F.array_sort(F.collect_list("n")).alias("kids"))
        joined = digest(F.array_join(F.col("kids.h"), ""))
        cur = cur.select("group", "block", "total", "at", F.struct(
            (F.col("at") % FAN).cast("int").alias("d"),
            F.when(_several(level), joined).otherwise(F.col("kids")[0]["h"]).alias("h"), "kids").alias("n"))
    return cur.select("group", "block", "total", "n")


def paths(nodes: DataFrame, payload: list[str], above=None) -> DataFrame:
    """``nodes`` has group, rank (from 0), total (nodes of its group), node (a
    digest) and the ``payload`` columns. Returns group, rank, node, payload,
    ``path`` (from the node upwards: own place ``at`` among the digests
    ``run``) and ``top`` (digest of the group's tree). ``above`` takes the table (group, top) of
    all groups and returns it with path and top of the trees above."""
    blocks = written(_blocks(nodes, payload), "merkle-blocks")
    heads = blocks.select("group", F.col("block").alias("rank"), F.col("n.h").alias("node"),
                          F.ceil(F.col("total") / FAN ** DIGITS).cast("long").alias("total"))
    none = F.expr("cast(array() as array<struct<at: int, run: array<string>>>)")
    if heads.where("total > 1").take(1):
        up = paths(heads, [], above).select("group", F.col("rank").alias("block"), "path", "sub", "top")
    else:
        tops = heads.select("group", F.col("node").alias("sub"))
        up = tops.select("group", F.lit(0).cast("long").alias("block"), none.alias("path"), "sub",
                         F.col("sub").alias("top"))
        if above is not None:
            up = _with_above(up, above)
    up = written(up, "merkle-above")
    cur = blocks.join(broadcast_if_small(up), ["group", "block"]) \
        .select("group", "total", "sub", "top", "path", F.col("block").alias("rank"), "n")
    for level in range(DIGITS, 0, -1):
        cur = cur.select("group", "total", "sub", "top", "path", "rank", F.col("n.kids.h").alias("run"), "n") \
            .select("group", "total", "sub", "top", "path", "rank", "run", F.posexplode("n.kids").alias("at", "n"))
        step = F.array(F.struct("at", "run"))
        cur = cur.select("group", "total", "sub", "top", "n", (F.col("rank") * FAN + F.col("at")).alias("rank"),
                         F.when(_several(level), F.concat(step, "path")).otherwise(F.col("path")).alias("path"))
    return cur.select("group", "rank", F.col("n.h").alias("node"), *[F.col(f"n.{c}").alias(c) for c in payload],
                      "path", "sub", "top")


def _with_above(up: DataFrame, above) -> DataFrame:
    more = above(up.select("group", "sub"))
    return up.drop("top").join(broadcast_if_small(more.withColumnRenamed("path", "more")), "group") \
        .withColumn("path", F.concat("path", "more")).drop("more")


def _over_groups(tops: DataFrame) -> DataFrame:
    """The tree over the groups' digests, in the order of the groups: group,
    path and top of each."""
    listed = tops.select(F.col("group").alias("name"), F.col("sub").alias("node"), F.lit("").alias("group"))
    ranked = distributed_row_number(listed, ["group"], [F.col("name")])
    n = ranked.count()
    got = paths(ranked.select("group", (F.col("row_number") - 1).alias("rank"), "node", F.lit(n).cast("long").alias("total"),
                              "name"), ["name"])
    return got.select(F.col("name").alias("group"), "path", "top")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             changed: Column | None = None, changed_fields: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, the proof as
    ``path``, and ``presented``: the leaf that is checked against the proof,
    made with ``changed_fields`` in place of the fields of that name where
    ``changed`` holds."""
    values = {c: F.col(c) for c in fields}
    leaf = digest(*[field(v) for v in values.values()])
    presented = leaf
    if changed is not None:
        other = digest(*[field((changed_fields or {}).get(c, v)) for c, v in values.items()])
        presented = F.when(F.coalesce(changed, F.lit(False)), other).otherwise(leaf)
    # "-" for null comes before "=" and the name: ascending bytes, null first
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    leaves = docs.select(group.alias("group"), F.col(id_col).alias("doc_id"), leaf.alias("node"),
                         presented.alias("presented"))
    ranked = distributed_row_number(leaves, ["group"], [F.col("doc_id"), F.col("node")])
    totals = ranked.groupBy("group").agg(F.count("*").alias("total"))
    nodes = ranked.join(broadcast_if_small(totals), "group").select(
        "group", (F.col("row_number") - 1).alias("rank"), "total", "node", "doc_id", "presented")
    return paths(nodes, ["doc_id", "presented"], _over_groups) \
        .select("doc_id", F.col("node").alias("leaf"), F.col("sub").alias("subroot"), F.col("top").alias("root"), "path",
                "presented")


def siblings(path: str = "path") -> Column:
    """The proof's digests, level by level, left to right."""
    return F.flatten(F.transform(path, lambda s: F.filter(s["run"], lambda x, i: i != s["at"])))


def fold(start: str = "presented", path: str = "path") -> Column:
    """The root that a leaf leads to with its proof."""
    def step(node: Column, s: Column) -> Column:
        run = F.transform(s["run"], lambda x, i: F.when(i == s["at"], node).otherwise(x))
        return F.sha2(F.array_join(run, ""), 256)

    return F.aggregate(path, F.col(start), step)


def verify(docs: DataFrame) -> DataFrame:
    """Every document's proof, and whether it holds after the upper-case
    letters of every third document were made small."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    small = {"text": F.translate("text", _A_TO_Z, _A_TO_Z.lower())}
    m = manifest(docs, changed=third, changed_fields=small)
    return m.select("doc_id", "leaf", "subroot", "root",
                    F.sha2(F.array_join(siblings(), ""), 256).alias("proof_sha256"), fold().alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
