"""Shards of near equal bytes by a k-d tree over metadata dimensions, with DataFrame operations only.

The unit of placement is a group of equal texts, so copies share a shard.  Groups of over ``piece_share`` of a shard's bytes, of which
there are few, are placed first, the largest first, each in the emptiest shard; only one that finds no shard with so much room is cut into
pieces by its doc_ids.  The tree then fills the shards' remaining room: a node that stands for several shards is split at the
distributed weighted median (or the quantile that parts the room of its shards) of its widest dimension.  The quantile is found by histograms of bytes, each
over the one bin of the last that holds it, for all nodes of a level at once: what reaches the driver is bins, whose number
doesn't depend on the rows.  Below a dimension's value come bits of a hash of the text, so that a value that holds a third of all
rows can be split too.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored

_BINS = 2048
#: Groups that are placed as a whole before the tree, at most; they reach the driver as two numbers each.
MAX_LARGE = 500_000
_TIE_BITS = 32
_VALUE_BITS = 20


def category(column: str) -> Column:
    """A text column as a dimension: the place that its hash gives each value; null comes first."""
    return F.when(F.col(column).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(column)), F.lit(2**_VALUE_BITS)))


def magnitude(column: str) -> Column:
    """A non-negative number as a dimension, by its logarithm."""
    return F.least(F.floor(F.log2(F.coalesce(F.col(column), F.lit(0)) + 1) * 2**14), F.lit(2**_VALUE_BITS - 1))


def _leaf(splits: dict[int, tuple[str, int]], node: int = 1) -> Column:
    """The node of the tree, as far as it has been split, that a row belongs to."""
    if node not in splits:
        return F.lit(node)
    dimension, cut = splits[node]
    return F.when(F.col(dimension) <= cut, _leaf(splits, 2 * node)).otherwise(_leaf(splits, 2 * node + 1))


def place_large(groups: list[tuple[int, int]], shards: int, target: float, slack: float) -> tuple[dict[int, int], dict[int, int], list[float]]:
    """The shard of each (group, bytes) that fits into one, the pieces of the others, and the room that is left in each shard."""
    loads = [(0, k) for k in range(shards)]
    placed, cut = {}, {}
    for group, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        load, k = loads[0]
        if load + size <= target + slack:
            placed[group] = k
            heapq.heapreplace(loads, (load + size, k))
        else:
            cut[group] = math.ceil(size / slack)
    room = [0.0] * shards
    for load, k in loads:
        room[k] = max(0.0, target - load)
    return placed, cut, room


def split_tree(units: DataFrame, dimensions: list[str], room: list[float]) -> tuple[dict[int, tuple[str, int]], dict[int, int]]:
    """Splits by node, and the shard of each leaf, for ``units`` (weight, and a long coordinate for each dimension) by the room of the shards."""
    splits: dict[int, tuple[str, int]] = {}
    shards = len(room)
    leaves = {1: (0, shards)}  # the shards from the first to before the second
    whole, least = None, 0.0
    middle = lambda lo, hi: lo + (hi - lo) // 2
    while any(hi - lo > 1 for lo, hi in leaves.values()):
        at_node = units.withColumn("node", _leaf(splits))
        bounds = [f(c).alias(f"{f.__name__}_{c}") for c in dimensions for f in (F.min, F.max)]
        stats = {r["node"]: r for r in at_node.groupBy("node").agg(F.sum("weight").alias("weight"), *bounds).collect()}
        spread = lambda r, c: (r[f"max_{c}"] >> _TIE_BITS) - (r[f"min_{c}"] >> _TIE_BITS)
        if whole is None:
            if not stats:
                break
            whole = {c: max(1, spread(stats[1], c)) for c in dimensions}
            least = stats[1]["weight"] / shards / 2000
        search = {}
        for node, (lo, hi) in leaves.items():
            if hi - lo > 1 and node in stats:
                r = stats[node]
                c = max(dimensions, key=lambda c: spread(r, c) / whole[c])
                share = sum(room[lo : middle(lo, hi)]) / max(sum(room[lo:hi]), 1e-9)
                search[node] = {"by": c, "lo": r[f"min_{c}"], "hi": r[f"max_{c}"], "want": r["weight"] * share, "before": 0}
        while search:
            cases = None
            for node, s in search.items():
                s["width"] = -(-(s["hi"] - s["lo"] + 1) // _BINS)
                inside = (F.col("node") == node) & F.col(s["by"]).between(s["lo"], s["hi"])
                value = F.floor((F.col(s["by"]) - s["lo"]) / s["width"]) if s["width"] < 2**20 else F.expr(f"({s['by']} - {s['lo']}L) div {s['width']}L")
                cases = F.when(inside, value) if cases is None else cases.when(inside, value)
            bins = at_node.withColumn("bin", cases).filter("bin is not null").groupBy("node", "bin").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
            by_node: dict[int, list] = {}
            for r in bins.collect():
                by_node.setdefault(r["node"], []).append((r["bin"], r["weight"], r["n"]))
            for node, found in by_node.items():
                s = search[node]
                for b, weight, n in sorted(found):
                    if s["before"] + weight >= s["want"]:
                        break
                    s["before"] += weight
                low = s["lo"] + b * s["width"]
                if weight <= least or n == 1 or s["width"] == 1:
                    after = abs(s["before"] + weight - s["want"]) <= abs(s["before"] - s["want"])
                    splits[node] = (s["by"], low + s["width"] - 1 if after else low - 1)
                    del search[node]
                else:
                    s["lo"], s["hi"] = low, min(s["hi"], low + s["width"] - 1)
        grown = {}
        for node, (lo, hi) in leaves.items():
            if hi - lo > 1 and node in splits:
                grown |= {2 * node: (lo, middle(lo, hi)), 2 * node + 1: (middle(lo, hi), hi)}
            else:
                grown[node] = lo, lo + 1
        leaves = grown
    return splits, {leaf: lo for leaf, (lo, _) in leaves.items()}


def kd_shards(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, piece_share: float = 0.02) -> DataFrame:
    """Shards of ``docs`` (doc_id, text, lang, source; others are ignored), by the law of near equal bytes.

    A row's size is its text's UTF-8 bytes plus 16.  The tree has ``shards`` leaves, or as many as make leaves of about
    ``target_bytes``.  Returns doc_id, size, text_crc32, shard (from 0) and slot (gapless from 0 in each shard).  A null text counts
    as empty, a null lang or source as a value of its own; repeated rows are kept, beside each other; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        category("lang").alias("lang"),
        category("source").alias("source"),
    ).withColumn("length", magnitude("size"))
    rows = stored(rows, "rows")
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if target_bytes:
        shards = max(1, math.ceil((total["bytes"] or 0) / target_bytes))
    target = (total["bytes"] or 0) / shards
    slack = max(1.0, piece_share * target, (total["bytes"] or 0) / MAX_LARGE)

    # at most shards / piece_share groups are so large, and at most MAX_LARGE, whatever the rows: a bound for the driver and the broadcast
    large = rows.groupBy("group").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > slack).collect()
    whole, cut, room = place_large([(r["group"], r["bytes"]) for r in large], shards, target, slack)
    marks = [(g, k, None) for g, k in whole.items()] + [(g, None, n) for g, n in cut.items()]
    marks = docs.sparkSession.createDataFrame(marks, "group long, at int, pieces long")
    rows = rows.join(F.broadcast(marks), "group", "left")
    rows = rows.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "text_crc32"), "pieces"))).drop("pieces")
    large, rows = rows.filter("at is not null"), rows.filter("at is null")

    dimensions = ["source", "lang", "length"]
    tie = F.pmod(F.xxhash64("group", "piece"), F.lit(2**_TIE_BITS))
    units = rows.groupBy("group", "piece").agg(F.sum("size").alias("weight"), *[F.min(c).alias(c) for c in dimensions])
    units = stored(units.withColumns({c: F.col(c).cast("long") * 2**_TIE_BITS + tie for c in dimensions}), "units")

    splits, numbers = split_tree(units, dimensions, room)
    shard = F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), _leaf(splits))
    placed = units.select("group", "piece", shard.cast("int").alias("shard"))

    # slots: buckets of about the square root of a shard's rows, the rows of earlier buckets first
    buckets = max(1, math.isqrt(total["n"] // shards))
    columns = ["doc_id", "size", "text_crc32"]
    rows = rows.join(placed, ["group", "piece"]).select(*columns, "shard").unionByName(large.select(*columns, F.col("at").alias("shard")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    rows = stored(rows, "placed")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    counts = counts.select("shard", "bucket", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    out = rows.withColumn("number", number).join(counts, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"))
