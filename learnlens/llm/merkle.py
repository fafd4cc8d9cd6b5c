"""A Merkle manifest of a dataset, and every row's proof by a recursive query.

Leaves are hashes of rows. Within a group (a source) they are ordered, and every
run of 16 consecutive nodes becomes its parent, level by level, down to one
subroot; the subroots of all groups make the root in the same way. The levels are
stored as one table of nodes, each linked to its parent. A recursive query then
climbs from every leaf: one step joins the parent's row, appends the siblings it
holds (by naming the run and the place in it), and folds the (perhaps tampered)
hash with them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FANOUT = 16
#: Leaves that meet in one key of the climb's join, at least; with more than
#: MOST_BLOCKS times as many, that share of all leaves.
BLOCK, MOST_BLOCKS = 4096, 65_536
#: Nodes that one file of a level holds, about (some 650 bytes each).
NODES_A_FILE = 50_000
#: The tree whose leaves are the subroots.
TOP = -1


def field(value: Column) -> Column:
    """A value as hashed: ``-`` for null, else its UTF-8 byte count, ``:``, its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the joined parts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(binary: Column | str) -> Column:
    return F.lower(F.hex(binary))


def with_ordinal(df: DataFrame, by: list[Column], label: str) -> DataFrame:
    """``df`` with ``ordinal``, its rows' place (from 0) in the order of ``by``.

    The rows are range partitioned and written with their place in the partition;
    the driver sees one count per partition. Rows equal in all of ``by`` are told
    apart by their place in ``df``, so many of them fill many partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = (tied.repartitionByRange(n, *by, "_tie").sortWithinPartitions(*by, "_tie")
              .withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    placed = common.written(ranged, label).withColumn("_part", F.shiftright("_at", 33))
    base, before = [], 0
    for row in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        base.append((row["_part"], before))
        before += row["n"]
    starts = df.sparkSession.createDataFrame(base, "_part long, _base long")  # one row per partition
    return placed.join(F.broadcast(starts), "_part").withColumn(
        "ordinal", F.col("_base") + F.col("_at") - F.shiftleft("_part", 33)).drop("_part", "_at", "_base")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: one row per dataset row, with its place, hash and parent link;
    ``nodes``: every inner node, linked to its parent, with its children's hashes."""

    leaves: DataFrame
    nodes: DataFrame
    n_leaves: int


def _parent(tree: Column, level: Column, no: Column, width: Column, trees: int) -> list[Column]:
    """The parent link (p_tree, p_level, p_no, pos) of node ``no`` of ``width`` on
    its level; nulls at the root."""
    inside, top = width > 1, (tree != TOP) & F.lit(trees > 1)
    pick = lambda a, b: F.when(inside, a).when(top, b)
    return [pick(tree, F.lit(TOP).cast("long")).alias("p_tree"), pick(level + 1, F.lit(1)).alias("p_level"),
            pick(F.floor(no / FANOUT), F.floor(tree / FANOUT)).alias("p_no"),
            pick(no % FANOUT, tree % FANOUT).cast("int").alias("pos")]


def _levels(nodes: DataFrame, n: int, trees: int, widest: int, label: str) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, no, width, hash, lo, hi; ``n`` of them) of all
    trees, until each has one node; a tree that has one already gets none."""
    found, level = [], 0
    while widest > 1:
        level, widest, n = level + 1, -(-widest // FANOUT), -(-n // FANOUT) + trees
        runs = nodes.where("width > 1").groupBy("tree", F.floor(F.col("no") / FANOUT).alias("no")).agg(
            F.array_sort(F.collect_list(F.struct("no", "hash"))).alias("run"),  # 16 at most
            F.ceil(F.max("width") / FANOUT).alias("width"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        joined = runs.withColumn("children", F.unhex(F.array_join(
            F.transform("run", lambda x: hexed(x["hash"])), ""))).drop("run")
        nodes = common.written(joined.select(
            "tree", F.lit(level).alias("level"), "no", "width", "children",
            digest(hexed("children")).alias("hash"), "lo", "hi").coalesce(-(-n // NODES_A_FILE)), f"{label}-{level}")
        found.append(nodes)
    return found


def build(rows: DataFrame, group: Column, order: Column, leaf: Column,
          carry: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of ``rows``: groups ascend by ``group`` (null first, text
    bytewise), leaves within a group by ``order`` (null first), then by hash.

    ``leaf`` is the text that a row is hashed as (null counts as empty), ``carry``
    names more columns that the leaves keep. Repeated rows are leaves
    of their own; an empty table has no nodes. The leaves' texts are read once
    and never moved; what moves is a narrow row per leaf.
    """
    carry = carry or {}
    narrow = common.written(rows.select(
        group.alias("_group"), order.alias("_order"), digest(F.coalesce(leaf, F.lit(""))).alias("leaf"),
        *[c.alias(n) for n, c in carry.items()]), "merkle-rows")
    by = [F.col("_group").asc_nulls_first(), F.col("_order").asc_nulls_first(), F.col("leaf")]
    placed = with_ordinal(narrow, by, "merkle-ordered").withColumnRenamed("ordinal", "g")
    n = placed.count()

    # Groups, and the stretch of ordinals of each. A stretch is joined back by
    # group and piece of the order, so that a large group is many small keys.
    piece = F.floor(F.col("g") / BLOCK).alias("_piece")
    groups = placed.groupBy("_group").agg(F.min("g").alias("lo"), F.count("*").alias("width"))
    trees = with_ordinal(groups, [F.col("lo")], "merkle-groups").withColumnRenamed("ordinal", "tree")
    totals = trees.agg(F.count("*").alias("trees"), F.max("width").alias("widest")).first()
    stretches = trees.withColumn("_piece", F.explode(F.sequence(
        F.floor(F.col("lo") / BLOCK), F.floor((F.col("lo") + F.col("width") - 1) / BLOCK))))
    placed = placed.withColumn("_piece", piece).alias("a").join(
        stretches.alias("b"),
        (F.col("a._piece") == F.col("b._piece")) & F.col("a._group").eqNullSafe(F.col("b._group")))
    no, tree, width = F.col("g") - F.col("lo"), F.col("tree"), F.col("width")
    leaves = common.written(placed.select(
        "g", "tree", no.alias("no"), "width", "leaf", *carry,
        *_parent(tree, F.lit(0), no, width, totals.trees),
        (width == 1).alias("lone")), "merkle-leaves")

    first = leaves.select("tree", "no", "width", F.col("leaf").alias("hash"), F.col("g").alias("lo"), F.col("g").alias("hi"))
    levels = _levels(first, n, totals.trees, totals.widest or 0, "merkle-level")
    own = ["tree", "no", "width", "hash", "lo", "hi"]
    subroots = first.where("width = 1")
    for level in levels:
        subroots = subroots.union(level.where("width = 1").select(*own))
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("no"),
                          F.lit(totals.trees).cast("long").alias("width"), "hash", "lo", "hi")
    levels += _levels(top, totals.trees, 1, totals.trees, "merkle-top")
    empty = "tree long, level int, no long, width long, children binary, hash binary, lo long, hi long"
    nodes = rows.sparkSession.createDataFrame([], empty)
    for level in levels:
        nodes = nodes.unionByName(level)
    nodes = nodes.select(
        "*", *_parent(tree, F.col("level"), F.col("no"), width, totals.trees),
        ((width == 1) & (tree != TOP)).alias("subroot"))
    return Manifest(leaves, nodes, n)


CLIMB = """
WITH RECURSIVE climb(g, block, level, folded, subroot, root, p_tree, p_level, p_no, pos) AS (
  SELECT g, block, 0, start, IF(lone, leaf, NULL), IF(p_tree IS NULL, leaf, NULL), p_tree, p_level, p_no, pos
  FROM {leaves}
  UNION ALL
  SELECT c.g, c.block, c.level + 1,
         unhex(sha2(lower(hex(
           substring(n.children, 1, 32 * c.pos) || c.folded || substring(n.children, 32 * c.pos + 33))), 256)),
         IF(n.subroot, n.hash, NULL), IF(n.p_tree IS NULL, n.hash, NULL),
         n.p_tree, n.p_level, n.p_no, n.pos
  FROM climb c JOIN {nodes} n
    ON c.p_tree = n.tree AND c.p_level = n.level AND c.p_no = n.no AND c.block = n.block)
SELECT g, block, level, folded, subroot, root, p_tree, p_level, p_no, pos FROM climb LIMIT ALL"""


def climb(made: Manifest, start: Column) -> DataFrame:
    """Every leaf's way up: g, proof (array of the siblings' bytes, a level each,
    from the leaf), folded_root (what ``start``, the leaf or its tampered form,
    folds to), subroot and root (of the manifest), all hashes as bytes.

    The recursive query emits one row per leaf and level: the folded hash, and as
    the siblings to append the run that holds them and the place in it. Spark keeps
    every row of the recursion, and siblings are fifteen hashes to the folded one,
    so their bytes are put in the runs' place only as a leaf's rows meet.

    A node's row is copied once per block of leaves below it, and the joins have the
    block as a key, so the few nodes near the root, which every leaf passes, are
    no hot keys.
    """
    block = max(BLOCK, -(-made.n_leaves // MOST_BLOCKS))
    leaves = made.leaves.select("g", F.floor(F.col("g") / block).alias("block"), "leaf", start.alias("start"),
                                "lone", "p_tree", "p_level", "p_no", "pos")
    nodes = made.nodes.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("lo") / block), F.floor(F.col("hi") / block)))).select(
        "tree", "level", "no", "block", "children", "hash", "subroot", "p_tree", "p_level", "p_no", "pos")
    steps = made.leaves.sparkSession.sql(CLIMB, leaves=leaves, nodes=nodes)
    runs = nodes.select(F.col("tree").alias("p_tree"), F.col("level").alias("p_level"), F.col("no").alias("p_no"),
                        "block", "children")
    siblings = F.concat(F.substring("children", F.lit(1), 32 * F.col("pos")),
                        F.substring("children", 32 * F.col("pos") + 33, F.lit(32 * FANOUT)))
    ways = steps.join(runs, ["block", "p_tree", "p_level", "p_no"], "left").groupBy("g").agg(  # a row per level each
        F.array_sort(F.collect_list(F.when(F.col("children").isNotNull(), F.struct("level", siblings.alias("s"))))).alias("way"),
        F.max(F.when(F.col("p_tree").isNull(), F.col("folded"))).alias("folded_root"),
        F.max("subroot").alias("subroot"), F.max("root").alias("root"))
    return ways.select("g", F.transform("way", lambda x: x["s"]).alias("proof"), "folded_root", "subroot", "root")


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             group_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
             tampered: Column | None = None) -> DataFrame:
    """Per row its doc_id, leaf, subroot, root, proof (array of siblings, a level
    each) and folded_root, hashes as bytes, and verified.

    Rows for which ``tampered`` holds are folded as if their text's A-Z had been
    lower-cased after the manifest was made. A row is one leaf however often it
    is repeated; ties of ids are ordered by the leaf's hash; null ids and groups
    come first; null and empty values hash differently; texts of any length are
    hashed whole; an empty table gives no rows; columns that are not named are
    ignored, whatever their names.
    """
    def leaf(text: Column) -> Column:
        return F.concat(*[field(text if f == text_col else F.col(f)) for f in fields])

    changed = F.when(F.lit(False) if tampered is None else tampered,
                     digest(leaf(common.ascii_lower(F.col(text_col)))))
    made = build(docs, F.col(group_col).cast("string"), F.col(id_col), leaf(F.col(text_col)),
                 {"doc_id": F.col(id_col), "changed": changed})
    ways = climb(made, F.coalesce("changed", "leaf"))
    return made.leaves.select("g", "doc_id", "leaf").join(ways, "g").select(
        "doc_id", "leaf", "subroot", "root", "proof", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
