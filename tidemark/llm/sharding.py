"""Sharding by a hierarchical weighted hash tree.

A cluster is a tree of regions, racks and shards. A row descends the tree: at each level every child of
the node draws ``-ln(u) / weight`` with ``u`` hashed from (row key, child), and the least draw wins; a
node weighs what its shards weigh together. If the weight of a subtree changes, only draws on the path to
it change, so rows move only between that subtree and the rest. A shard that opens a region of its own
(as ``topology`` does for the one beyond the planned size) therefore takes rows only into itself.

The descent and the numbering are built-in functions: no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import materialize


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. ``name`` must be unique in the tree; ``shard`` is set on leaves only."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def topology(shards: int, racks_per_region: int = 3, shards_per_rack: int = 4, planned: int = 24) -> Node:
    """Even tree over ``shards``; each shard from ``planned`` on opens its own region and rack."""
    leaf = lambda s: Node(f"shard-{s}", shard=s)
    size, regions = racks_per_region * shards_per_rack, []
    inside = min(shards, planned)
    for r in range(0, inside, size):
        racks = [Node(f"rack-{k}", tuple(leaf(s) for s in range(k, min(k + shards_per_rack, r + size, inside)))) for k in range(r, min(r + size, inside), shards_per_rack)]
        regions.append(Node(f"region-{r}", tuple(racks)))
    regions += [Node(f"region-{s}", (Node(f"rack-{s}", (leaf(s),)),)) for s in range(planned, shards)]
    return Node("root", tuple(regions))


def _inner(tree: Node) -> tuple[list[Node], int]:
    """Every node, the root first, and the depth of the tree."""
    nodes, depth, level = [tree], 0, [tree]
    while level := [c for n in level for c in n.children]:
        nodes += level
        depth += 1
    return nodes, depth


def place(df: DataFrame, key: str, tree: Node, into: str = "shard") -> DataFrame:
    """Adds the shard of each row. Rows with equal keys, and all rows with a null key, share a shard.

    One step per level: the children of the node reached draw ``-ln(u) / weight``, and the least draw is the next node.
    Children of no weight get nothing.
    """
    nodes, depth = _inner(tree)
    number_of = {id(n): i for i, n in enumerate(nodes)}
    if len({n.name for n in nodes}) < len(nodes):
        raise ValueError("the names of a tree's nodes must differ")
    none = F.filter(F.array(F.struct(F.lit("").alias("name"), F.lit(1.0).alias("weight"), F.lit(0).alias("node"))), lambda c: F.lit(False))
    family = [[F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(number_of[id(c)]).alias("node")) for c in n.children if c.weight > 0] for n in nodes]
    children = F.array(*[F.array(*f) if f else none for f in family])
    hashed = F.coalesce(F.col(key).cast("string"), F.lit(""))

    def draw(c: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(hashed, c["name"]), 11)
        u = (bits.cast("double") + F.lit(1.0)) / F.lit(float(2**53 + 1))
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["node"].alias("node"))

    at = df.withColumn("_node", F.lit(0))
    for _ in range(depth):
        step = F.array_min(F.transform(F.element_at(children, F.col("_node") + 1), draw))["node"]
        at = at.withColumn("_node", F.coalesce(step, F.col("_node")))
    shards = F.array(*[F.lit(n.shard).cast("int") for n in nodes])
    return at.withColumn(into, F.element_at(shards, F.col("_node") + 1)).drop("_node")


def number(df: DataFrame, shard: str, order: list[str], cell_rows: int = 20_000, into: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard, without gathering a shard in one task.

    Rows of a shard fall into cells by a hash of ``order``. Cell counts give each cell's first number, and only
    a cell is sorted at once. Equal rows may swap numbers, nothing else is left to chance. The number of cells
    follows the number of rows.
    """
    rows = df.count()
    shards = max(1, df.select(shard).distinct().count())
    cells = max(16, rows // (cell_rows * shards) + 1)
    celled = df.withColumn("_cell", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(cells)).cast("int"))
    counts = materialize(celled.groupBy(F.col(shard).alias("_shard"), "_cell").agg(F.count("*").alias("_n")), "slots")
    before = Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", F.col("_cell").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(shard, "_cell").orderBy(*order)) - 1
    ranked = celled.withColumn("_rank", rank)
    joined = ranked.join(starts, (ranked[shard] == starts["_shard"]) & (ranked["_cell"] == starts["_at"]), "left")
    return joined.withColumn(into, (F.col("_start") + F.col("_rank")).cast("long")).drop("_cell", "_shard", "_at", "_start", "_rank")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document.

    ``size`` is the text's UTF-8 bytes plus 8; a null text has no bytes. An empty table gives an empty result;
    a repeated row gets a slot for each copy; further columns are left out.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = place(place(slim, "doc_id", topology(shards)), "doc_id", topology(shards + 1, planned=shards), "grown_shard")
    out = number(materialize(placed, "placed"), "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
