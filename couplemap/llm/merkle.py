"""Merkle manifest of a dataset by nested-struct rollup.

Leaves are hashes of rows.  Within a group (a source) leaves are ranked; the
hexadecimal digits of the rank say where a leaf hangs.  The rank's leading
digits name a block of ``16 ** DIGITS`` leaves at most; inside a block the
digit columns are grouped away one after the other, each ``groupBy`` nesting
the children's structs in their parent's, so a block ends as one row that
holds its whole subtree (one shuffle: all groupings of a block are finer than
the block).  The blocks' hashes are the leaves of the next tier, until one
node is left per group; the groups' roots are rolled up in the same way.

Proofs come from the top: every node hands its children the steps above them
(what stands left and right of each ancestor in its run), ``transform`` gives
each child its own step and ``explode`` emits the children.  A tier's steps
meet the blocks below in one ``groupBy`` on the block.  Nothing is joined.

Run rule: every 16 consecutive nodes become the hash of their hashes while
more than one node remains.  The first run has one node only when one node
remains, so this is decided inside the run: a lone node of run 0 goes up as it
is, without a step; a lone node of a later run is hashed.

Definitions.  A null value is ``-``, any other one its UTF-8 byte count, a
colon and its text.  Null ids come before all others.  Rows with equal ids are
ordered by their leaves (repeated rows are leaves of their own).  A null group
is a group and comes first; groups are ordered bytewise.  The hash of no
sibling is the hash of the empty text.  An empty table has an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import with_global_index, with_group_index
from ..session import cut_lineage

FAN = 16
DIGITS = 2
STEPS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def fold(start: Column, steps: Column) -> Column:
    """The root that ``start`` leads to along its proof."""
    return F.aggregate(steps, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof_digest(steps: Column) -> Column:
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


# ---- up: digits grouped away ------------------------------------------------------------

def _blocks(nodes: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(grp, block, tree): the nodes (grp, rank, h, item) rolled up per block."""
    names = [f"d{k}" for k in range(digits)]  # d0 is the last digit
    rows = nodes.select(
        "grp", F.shiftright("rank", 4 * digits).alias("block"),
        *[F.shiftright("rank", 4 * k).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(n) for k, n in enumerate(names)],
        F.struct("h", "item").alias("tree"))
    rows = rows.repartition("grp", "block")
    for k, name in enumerate(names):
        upper = names[k + 1:]
        first_run = F.lit(True)
        for column in (*upper, "block"):
            first_run = first_run & (F.col(column) == 0)
        kids = rows.groupBy("grp", "block", *upper).agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("d"), "tree"))).alias("kids"))
        kids = kids.select("grp", "block", *upper, F.transform("kids", lambda x: x["tree"]).alias("kids"), (first_run & (F.size("kids") == 1)).alias("lone"))
        hashes = F.array_join(F.transform("kids", lambda x: x["h"]), "")
        rows = kids.select(
            "grp", "block", *upper,
            F.struct(F.when(F.col("lone"), F.col("kids")[0]["h"]).otherwise(digest(hashes)).alias("h"), "lone", "kids").alias("tree"))
    return rows


def _tiers(nodes: DataFrame, digits: int) -> list[DataFrame]:
    """Written block tables, from the leaves up to one block per group."""
    out = []
    while True:
        tier = cut_lineage(_blocks(nodes, digits))
        out.append(tier)
        if not tier.where("block > 0").limit(1).count():
            return out
        nodes = tier.select("grp", F.col("block").alias("rank"), F.col("tree.h").alias("h"), F.lit(None).cast("string").alias("item"))


# ---- down: steps handed to the children ----------------------------------------------------

def _hand_down(rows: DataFrame, levels: int) -> DataFrame:
    """(grp, block, root, subroot, steps, tree) -> one row per leaf of the
    tree, with its place in the block and the steps from it up to the root."""
    rows = rows.withColumn("place", F.lit(0).cast("long"))
    for _ in range(levels):
        hashes = F.transform("tree.kids", lambda x: x["h"])

        def child(x: Column, i: Column) -> Column:
            step = F.struct(
                F.array_join(F.slice(F.col("hashes"), F.lit(1), i), "").alias("left"),
                F.array_join(F.slice(F.col("hashes"), i + 2, F.lit(FAN)), "").alias("right"))
            return F.struct(x.alias("tree"), i.cast("long").alias("i"), step.alias("step"))

        rows = rows.withColumn("hashes", hashes).select(
            "grp", "block", "root", "subroot", "steps", "place", F.col("tree.lone").alias("lone"),
            F.explode(F.transform("tree.kids", child)).alias("kid"))
        steps = F.when(F.col("lone"), F.col("steps")).otherwise(F.concat(F.array("kid.step"), F.col("steps")))
        rows = rows.select(
            "grp", "block", "root", "subroot", steps.alias("steps"), (F.col("place") * FAN + F.col("kid.i")).alias("place"), F.col("kid.tree").alias("tree"))
    return rows


def _proofs(tiers: list[DataFrame], above: DataFrame, digits: int) -> DataFrame:
    """One row per leaf of the lowest tier; ``above`` is (grp, root, subroot,
    steps) per group, a null subroot standing for the group's own hash."""
    schema = "struct<root:string,subroot:string,steps:" + STEPS + ">"
    heads = above.select("grp", F.lit(0).cast("long").alias("block"), F.struct("root", "subroot", "steps").cast(schema).alias("head"))
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k].withColumn("head", F.lit(None).cast(schema))
        both = tier.unionByName(heads.withColumn("tree", F.lit(None).cast(tier.schema["tree"].dataType)))
        met = both.groupBy("grp", "block").agg(F.collect_list("tree")[0].alias("tree"), F.collect_list("head")[0].alias("head"))
        rows = _hand_down(met.select("grp", "block", "head.root", F.coalesce("head.subroot", "tree.h").alias("subroot"), "head.steps", "tree"), digits)
        if k:  # the leaves of an upper tier are the blocks of the next one
            rows = rows.withColumn("block", F.col("block") * FAN**digits + F.col("place"))
            heads = rows.select("grp", "block", F.struct("root", "subroot", "steps").alias("head"))
    return rows


def merkle_manifest(rows: DataFrame, id_col: str, group_col: str, leaf_hash: Column, claim: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """(id, group, leaf, claim, subroot, root, steps) per row: the leaf's hash,
    its group's root, the dataset's root, and the proof as ``steps`` from the
    leaf to the root (hashes standing left and right in each run, joined).
    ``claim`` is any text to hand through (null without one)."""
    leaves = cut_lineage(rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("grp"), leaf_hash.alias("h"),
        (F.lit(None) if claim is None else claim).cast("string").alias("claim")))
    ranked = with_group_index(leaves, ["grp"], [F.col("id"), F.col("h"), F.col("claim")], name="rank")
    tiers = _tiers(ranked.select("grp", "rank", "h", F.struct("id", "claim").alias("item")), digits)

    roots = tiers[-1].select(F.col("grp").alias("source"), F.col("tree.h").alias("h"))
    order = with_global_index(roots, [F.col("source").asc_nulls_first()], name="rank")
    tops = _tiers(order.select(F.lit("").alias("grp"), "rank", "h", F.struct("source", "h").alias("item")), digits)
    start = tops[-1].select("grp", F.col("tree.h").alias("root"), F.lit("").alias("subroot"), F.array().cast(STEPS).alias("steps"))
    groups = cut_lineage(_proofs(tops, start, digits).select(F.col("tree.item.source").alias("grp"), "root", F.col("tree.h").alias("subroot"), "steps"))
    out = _proofs(tiers, groups, digits)
    return out.select(
        F.col("tree.item.id").alias("id"), F.col("grp").alias("group"), F.col("tree.h").alias("leaf"), F.col("tree.item.claim").alias("claim"), "subroot", "root", "steps")
