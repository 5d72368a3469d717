"""Shards by a hierarchical weighted hash tree, in DataFrame expressions only.

A key descends from level to level: the regions draw for it, then the racks of the region that won, then the
shards of that rack. A draw is an exponential variate, from a hash of the node's name and the key, whose
rate is the weight of all shards below the node; the least draw wins. So each level deals by weight, and a key
costs as many hashes as nodes lie beside its path.

When a weight grows, only the draws on the path to that shard change, and only downwards: keys move into the
region on that path, inside it into the rack on the path, and inside that into the shard. No key moves between nodes
off the path. A shard added to a rack would so bring its siblings keys as well; therefore a new shard opens a
region of its own (``grown``), and takes keys into itself alone.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.session import materialize

#: Rows that one task numbers at a time, on average.
SLOT_ROWS = 100_000
#: Shards that racks and regions are laid out for.
BASE = 8


class Shard(NamedTuple):
    number: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """Equal shards, filling racks and regions in turn, so that another shard renames none."""
    return [Shard(n, f"region{n // (per_rack * racks)}", f"rack{n // per_rack}") for n in range(shards)]


def grown(tree: list[Shard]) -> list[Shard]:
    """One more shard, in a region of its own."""
    number = 1 + max((s.number for s in tree), default=-1)
    return [*tree, Shard(number, f"region-of-{number}", f"rack-of-{number}")]


def tree_for(shards: int) -> list[Shard]:
    """The tree of a number of shards: up to ``BASE`` laid out evenly, those beyond added one by one."""
    tree = even_tree(min(shards, BASE))
    for _ in range(shards - len(tree)):
        tree = grown(tree)
    return tree


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential with the weight as its rate, from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11)
    return -F.log((bits + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(float(weight))


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard number that the tree gives a key; shards of weight 0 or less get nothing."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    return descend(key, live, ["region", "rack", "number"], "")


def descend(key: Column, shards: list[Shard], levels: list[str], path: str) -> Column:
    """Draws among the nodes of the first level, and further down in the one that wins."""
    nodes: dict = defaultdict(list)
    for shard in shards:
        nodes[getattr(shard, levels[0])].append(shard)
    below = [own for _, own in sorted(nodes.items(), key=lambda n: min(s.number for s in n[1]))]
    name = lambda own: f"{path}/{getattr(own[0], levels[0])}"
    down = lambda own: F.lit(own[0].number).cast("int") if len(levels) == 1 else descend(key, own, levels[1:], name(own))
    if len(below) == 1:
        return down(below[0])
    won = F.least(*[F.struct(draw(key, name(own), sum(s.weight for s in own)).alias("draw"), F.lit(i).alias("node"))
                    for i, own in enumerate(below)])["node"]
    out = F.when(won == 0, down(below[0]))
    for i, own in enumerate(below[1:-1], 1):
        out = out.when(won == i, down(own))
    return out.otherwise(down(below[-1]))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    The law is ``key``: the id and the number of shards alone decide, so rows that repeat an id
    share a shard, and so do rows without one. A null text has size 1 and the checksum of
    nothing. Slots count from 0 without gaps in each shard: rows are numbered within many
    small buckets of a shard, dealt by a number written with each row, so that no id and no text makes a bucket
    large; the counts of earlier buckets are added. An empty table gives no rows; other columns are not read.
    """
    own = F.col(f"`{key}`")
    bytes_of = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    tree = tree_for(shards)
    rows = materialize(docs.select(
        own.alias("doc_id"), (F.octet_length(bytes_of) + 1).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32"),
        place(own, tree).alias("shard"), place(own, grown(tree)).alias("grown_shard"), F.monotonically_increasing_id().alias("row")), "placed")
    buckets = max(1, math.ceil(rows.count() / (shards * SLOT_ROWS)) * 8)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = rows.groupBy(F.col("shard").alias("at_shard"), F.col("bucket").alias("at_bucket")).count()
    before = Window.partitionBy("at_shard").orderBy("at_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("at_shard", "at_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy("row")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(firsts, (F.col("shard") == F.col("at_shard")) & (F.col("bucket") == F.col("at_bucket"))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"),
        "grown_shard")
