"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn level by level.

At each level every child draws ``-ln(u) / weight`` for the document, with ``u`` in (0, 1] from a hash of document and
child; the smallest draw wins, so a child is chosen in proportion to its weight. A draw depends on the document, the
child and the child's own weight only: when a weight changes, documents move only into or out of the children whose
weights changed. In a region or rack that grows, only documents that newly enter it, or that its grown child attracts,
move; all other subtrees keep their documents. ``grown`` adds a shard as a region of its own, so that the new shard takes
documents and no old one does.

The law of this assignment is ``key``: id and tree decide. Draws are Column expressions; the tree is a few literals.
Slots number each shard's documents without gaps: shards are cut into SLICES hashed slices, numbered within each
slice, and a slice's first slot is the number of documents in the slices before it. A slice is the largest group a task
sees; it is chosen by id, size and content, so repeated ids with different texts are dealt out as well.

Defined cases: a null text has size 1 and no checksum; of a text of any length only its size and checksum travel; a null id
is a key like any other; repeated rows share a shard and get slots of their own; an empty table gives an empty result;
columns but doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfsift.llm.support import inputs, small_side, stored

SLICES = 1024
LAW = "key"


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a shard has a number and a weight, the others weigh what their children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def region(number: int, racks: list[list[int]], weights: dict[int, float] | None = None) -> Node:
    """A region of racks, each a list of shard numbers."""
    weights = weights or {}
    return Node(
        f"region{number}",
        tuple(
            Node(f"region{number}/rack{k}", tuple(Node(f"shard{s}", (), s, weights.get(s, 1.0)) for s in shards))
            for k, shards in enumerate(racks)
        ),
    )


def default_tree() -> Node:
    """Shards 0 to 7: two regions of two racks of two shards."""
    return Node("root", (region(0, [[0, 1], [2, 3]]), region(1, [[4, 5], [6, 7]])))


def shards_of(tree: Node) -> list[int]:
    return [tree.shard] if tree.shard is not None else [s for c in tree.children for s in shards_of(c)]


def grown(tree: Node) -> Node:
    """The tree with one more shard, as a region of its own: no other subtree's weight changes."""
    return replace(tree, children=(*tree.children, region(len(tree.children), [[max(shards_of(tree)) + 1]])))


def _draw(key: Column, child: Node) -> Column:
    """A child's draw: exponential with the child's weight as its rate."""
    # 52 bits of the hash: whole numbers that a double holds exactly, so u is never 0
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(child.name), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1) / F.lit(2.0**52)) / F.lit(float(child.weight))


def shard_for(key: Column, tree: Node) -> Column:
    """The shard that a key descends to."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return shard_for(key, tree.children[0])
    draws = [_draw(key, child) for child in tree.children]
    least = F.least(*draws)
    below = [shard_for(key, child) for child in tree.children]
    # a tie goes to the first child
    return reduce(lambda rest, k: F.when(draws[k] == least, below[k]).otherwise(rest), reversed(range(len(draws) - 1)), below[-1])


def assign(docs: DataFrame, tree: Node | None = None, larger: Node | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, and grown_shard (the shard in ``larger``, by default the tree with one
    more shard)."""
    tree = tree or default_tree()
    larger = larger or grown(tree)
    text = F.encode(F.col("text").cast("string"), "UTF-8")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = inputs(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("bigint"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_for(key, tree).alias("shard"),
        shard_for(key, larger).alias("grown_shard"),
    )
    spot = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32"))
    rows = stored(
        rows.withColumn("slice", F.conv(F.substring(spot, 1, 8), 16, 10).cast("bigint") % SLICES), "sharded"
    )
    # the slices of all shards: a few thousand rows, whatever the input
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(place) - 1)
    return numbered.join(small_side(first), ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("first") + F.col("place")).alias("slot"), "grown_shard",
    )
