"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

Points are groups of equal texts, weighed in bytes; a group that no shard can
hold is cut in pieces by a hash of the id.  Each level of the tree takes, for
all its nodes at once, the metadata dimension of the largest extent and finds
its weighted median (for an odd number of leaves: the matching quantile) from
exact weights of equal bins, then of bins inside the one that holds it, until
that bin is light or one point.  Ties along a dimension are told apart by a
hash of the text, so a dimension of few values can be cut anywhere.  Where the
point at the median is heavy and leaves the halves uneven, it goes whole to one
side, and lighter points get a cut of their own that evens them out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_most, looked_up, materialise, running, shielded

DIMENSIONS = ("length", "origin", "tongue")
#: Bins a node and round, and the part of a leaf's bytes under which a bin, or what a cut misses, is light.
BINS, LIGHT = 1024, 1 / 512
#: Cuts a node can have, each for lighter points than the one before.
TIERS = 5
#: Pieces that a leaf's bytes of a group too heavy for a leaf make.
PIECES = 64
#: Rows up to which nodes, values of a dimension and groups cut in pieces are broadcast (40 bytes or so each).
BROADCAST_ROWS = 50_000

_GROUP = ["_h", "_crc", "_size"]


def _described(docs: DataFrame) -> DataFrame:
    """``docs`` with the _-columns that place a row; absent metadata columns count as null."""
    text, has = F.coalesce(F.col("text"), F.lit("")), set(docs.columns)
    row = F.xxhash64(F.monotonically_increasing_id(), F.lit(11))
    return docs.withColumns({
        "_h": F.xxhash64(text),
        "_crc": F.crc32(text.cast("binary")),
        "_size": F.octet_length(text).cast("long") + 1,
        "_row": row,
        # without an id only the place in the table tells rows apart
        "_salt": F.when(F.col("doc_id").isNull(), row).otherwise(F.xxhash64("doc_id", F.lit(11))) if "doc_id" in has else row,
        "_source": F.col("source").cast("string") if "source" in has else F.lit(None).cast("string"),
        "_lang": F.col("lang").cast("string") if "lang" in has else F.lit(None).cast("string"),
    })


def _with_pieces(rows: DataFrame, hot: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the piece of its group that each belongs to."""
    out = looked_up(rows, hot, _GROUP, F.col("_salt"), few)
    salt = F.when(F.col("one_id"), F.col("_row")).otherwise(F.col("_salt"))
    return out.withColumn("_piece", F.coalesce(F.pmod(salt, F.col("pieces")), F.lit(0)).cast("int")).drop("pieces", "one_id")


def _ranked(points: DataFrame) -> DataFrame:
    """``points`` with the ranks of their source and lang among all that occur; null: 0."""
    kinds = {"_source": "origin", "_lang": "tongue"}
    pairs = F.array(*(F.struct(F.lit(d).alias("kind"), F.col(c).alias("value")) for c, d in kinds.items()))
    values = points.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()
    ranks = materialise(running(values, [F.col("kind"), F.col("value")], {"rank": F.lit(1)}, "values"), "ranks")
    few = at_most(ranks, BROADCAST_ROWS)
    for c, d in kinds.items():
        of = ranks.where(F.col("kind") == d).select(F.col("value").alias(c), (F.col("rank") + 1).cast("long").alias(d))
        points = looked_up(points, of, [c], F.col("_h"), few).withColumn(d, F.coalesce(d, F.lit(0).cast("long"))).drop(c)
    return points


def _points(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, bool]:
    """Groups of equal texts with weight and coordinates, the pieces of those that no
    shard can hold, and whether these are few."""
    weights = rows.groupBy(*_GROUP).agg((F.count("*") * F.col("_size")).alias("w"), (F.min("_salt") == F.max("_salt")).alias("one_id"))
    share = max(1, rows.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0] // shards)
    heavy = (F.col("w") > share) & (F.col("w") > F.col("_size"))
    hot = materialise(weights.where(heavy).select(*_GROUP, "one_id", F.ceil(F.col("w") * PIECES / share).cast("int").alias("pieces")), "hot")
    few = at_most(hot, BROADCAST_ROWS)
    points = _with_pieces(rows, hot, few).groupBy(*_GROUP, "_piece").agg(F.sum("_size").alias("w"), F.min("_source").alias("_source"), F.min("_lang").alias("_lang"))
    points = _ranked(materialise(points, "group"))
    points = points.withColumn("length", (F.log2(F.col("_size").cast("double")) * 2**24).cast("long"))
    # One sortable number a dimension: 31 bits of the coordinate, then 31 of the text's hash.
    tie = F.shiftrightunsigned(F.xxhash64("_h", "_piece"), 33)
    return points.select(*_GROUP, "_piece", "w", *((F.shiftleft(F.col(d), 31) + tie).alias(d) for d in DIMENSIONS)), hot, few


def _near(nodes: DataFrame, n_nodes: int) -> DataFrame:
    return F.broadcast(nodes) if n_nodes <= BROADCAST_ROWS else nodes


def _medians(points: DataFrame, nodes: DataFrame, n_nodes: int) -> DataFrame:
    """(node, cut, miss): where to cut ``points`` (node, w, at) so that ``goal`` of their
    weight lies below, and by how much the nearest cut misses it.

    ``nodes`` has node, goal, first and last (the range of ``at``) and light, the
    weight of a bin that is not looked into."""
    state, found = nodes.select("node", "goal", "light", "first", "last", F.lit(0).cast("long").alias("under")), None
    own = ["node", "goal", "light", "under"]
    width = (F.col("last") - F.col("first")).cast("double") / BINS + 1
    upto = F.col("under") + F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
    # of the bin that holds the goal (the last one, if none reaches it)
    low = F.col("upto") < F.col("goal")
    holds = F.min(F.struct(low, F.when(low, -F.col("bin")).otherwise(F.col("bin")), "w", "upto", "x0", "x1"))
    more = (F.col("w") > F.col("light")) & (F.col("x0") < F.col("x1"))
    over, short = F.abs(F.col("upto") - F.col("goal")), F.abs(F.col("goal") - F.col("upto") + F.col("w"))
    cut = F.when(over <= short, F.struct((F.col("x1") + 1).alias("cut"), over.alias("miss"))).otherwise(F.struct(F.col("x0").alias("cut"), short.alias("miss")))
    while True:
        inside = points.join(_near(state, n_nodes), "node").where("at between first and last")
        bins = inside.groupBy(*own, F.floor((F.col("at") - F.col("first")) / width).alias("bin")).agg(F.sum("w").alias("w"), F.min("at").alias("x0"), F.max("at").alias("x1"))
        out = bins.withColumn("upto", upto).groupBy("node", "goal", "light").agg(holds.alias("s")).select("node", "goal", "light", "s.*")
        out = materialise(out.withColumn("more", more), "level")
        ended = out.where("not more").select("node", cut.alias("c")).select("node", "c.*")
        found = ended if found is None else found.union(ended)
        state = out.where("more")
        if state.isEmpty():
            return found
        state = state.select("node", "goal", "light", F.col("x0").alias("first"), F.col("x1").alias("last"), (F.col("upto") - F.col("w")).alias("under"))


def _at() -> Column:
    return F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in DIMENSIONS))


def _right(tiers: str = "tiers") -> Column:
    """Whether a point lies above the cut for its weight."""
    cut = F.get(F.filter(tiers, lambda t: F.col("w") > t["above"]), F.lit(0))["cut"]
    return F.coalesce(_at() >= cut, F.lit(False))


def _cut_level(points: DataFrame, extent: dict[str, float], n_nodes: int) -> DataFrame:
    """(node, dim, left, tiers) of every node that still has leaves to part: the
    dimension, the leaves below the cut, and cuts for points above some weight."""
    split = points.where("leaves > 1")
    ends = [F.struct(F.lit(d).alias("dim"), F.min(d).alias("first"), F.max(d).alias("last")).alias(d) for d in DIMENSIONS]
    wide = split.groupBy("node", "leaves").agg(F.sum("w").alias("all"), *ends)
    extents = {d: (F.shiftright(F.col(d)["last"], 31) - F.shiftright(F.col(d)["first"], 31)) / max(extent[d], 1e-9) for d in DIMENSIONS}
    best = F.greatest(*(F.struct(x.alias("x"), F.lit(-i).alias("i"), F.col(d).alias("of")) for i, (d, x) in enumerate(extents.items())))["of"]
    left = F.floor(F.col("leaves") / 2).cast("int")
    wide = wide.select("node", left.alias("left"), best.alias("of"), (F.col("all") * left / F.col("leaves")).alias("goal"), (F.col("all") / F.col("leaves") * LIGHT).alias("light"))
    nodes = materialise(wide.select("node", "left", "goal", "light", "of.*"), "wide")
    placed = split.join(_near(nodes.select("node", "dim"), n_nodes), "node").select("node", "w", _at().alias("at"))
    cuts = _medians(placed, nodes, n_nodes)
    known = nodes.join(cuts, "node").withColumn("tiers", F.array(F.struct(F.lit(0.0).alias("above"), "cut"))).drop("cut")
    for _ in range(TIERS - 1):
        if known.where("miss > light").isEmpty():
            break
        known = materialise(known, "tiers")
        poor = known.where("miss > light")
        # What outweighs the miss stays where it is; the rest is cut anew, for what is then missing on the left.
        last = F.transform("tiers", lambda t, i: F.when(i == F.size("tiers") - 1, F.struct(F.col("miss").alias("above"), t["cut"].alias("cut"))).otherwise(t))
        poor = poor.withColumn("held", last)
        rows = split.join(_near(poor.select("node", "dim", "miss", "held"), n_nodes), "node").withColumn("at", _at())
        heavy = rows.where("w > miss").groupBy("node").agg(F.sum(F.when(~_right("held"), F.col("w")).otherwise(0)).alias("low"))
        loose = rows.where("w <= miss").select("node", "w", "at")
        ranges = loose.groupBy("node").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        again = poor.select("node", "goal", "light").join(heavy, "node", "left").join(ranges, "node").withColumn("goal", F.greatest(F.col("goal") - F.coalesce("low", F.lit(0)), F.lit(0.0)))
        finer = _medians(loose, again, n_nodes).select("node", F.col("cut").alias("cut2"), F.col("miss").alias("miss2"))
        known = known.join(poor.select("node", "held"), "node", "left").join(finer, "node", "left")
        better = F.col("miss2") < F.col("miss")
        known = known.withColumn("tiers", F.when(better, F.concat("held", F.array(F.struct(F.lit(0.0).alias("above"), F.col("cut2").alias("cut"))))).otherwise(F.col("tiers")))
        # a node that nothing improves is done
        known = known.withColumn("miss", F.when(better, F.col("miss2")).when(F.col("held").isNotNull(), 0.0).otherwise(F.col("miss"))).drop("held", "cut2", "miss2")
    return known.select("node", "dim", "left", "tiers")


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The described rows of ``docs``, without their texts, and a function that
    gives described rows their ``shard``.

    Needs text; see shard() for null and empty texts, ties and empty tables."""
    rows = _described(docs)
    kept = [c for c in ("doc_id",) if c in docs.columns]
    facts = materialise(rows.select(*kept, *_GROUP, "_salt", "_row", "_source", "_lang"), "fact")
    if shards is None:
        total = facts.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
        shards = max(1, -(-total // target_bytes))
    points, hot, few = _points(facts, shards)
    points = materialise(points.withColumns({"node": F.lit(0), "leaves": F.lit(shards)}), "point")
    ends = points.agg(*(F.shiftright(F.max(d), 31) - F.shiftright(F.min(d), 31) for d in DIMENSIONS)).first()
    extent, level = dict(zip(DIMENSIONS, (float(e or 0) for e in ends))), 0
    while 1 << level < shards:
        n_nodes = min(shards, 1 << level)
        joined = points.join(_near(_cut_level(points, extent, n_nodes), n_nodes), "node", "left").withColumn("up", _right().cast("int"))
        # A node's number is its first leaf, so the last level's nodes are the shards.
        leaves = F.when(F.col("left").isNull(), F.col("leaves")).when(F.col("up") == 1, F.col("leaves") - F.col("left")).otherwise(F.col("left"))
        node = F.col("node") + F.col("up") * F.coalesce("left", F.lit(0))
        # Written at every level: the next one's plan then starts from a scan.
        points, level = materialise(joined.select(*_GROUP, "_piece", "w", *DIMENSIONS, node.alias("node"), leaves.alias("leaves")), "point"), level + 1
    leaves = points.select(*_GROUP, "_piece", F.col("node").alias("shard"))
    return facts, lambda described: _with_pieces(described, hot, few).join(leaves, [*_GROUP, "_piece"])


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``shard``: k-d leaves of near equal bytes, as many as
    ``shards`` says or as ``target_bytes`` (of text, plus one a row) asks for.

    Needs text; doc_id, source and lang are used where present, further columns
    pass through, one named shard is replaced.  The dimensions are the logarithm
    of the size and the ranks of source and lang among the values that occur;
    nulls sort first.  Null and empty texts weigh one byte and form one group.
    Equal texts stay together unless their group outweighs a shard; the pieces
    of such a group part by the hash of doc_id, or by their place in the table
    where doc_id is null or the same in all of them.  Texts are never cut, so a
    shard misses its size by about half of the lightest documents of its node at
    each level, or by a 512th.  An empty table gives an empty result."""
    docs, own = shielded(docs.drop("shard"), "doc_id", "text", "source", "lang")
    _, placed = assign(docs, shards, target_bytes)
    return placed(_described(docs)).select(*own, "shard")


def with_slots(rows: DataFrame, order: list[Column], buckets: int = 1024) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each ``shard``.

    Rows are numbered in hashed buckets and each bucket starts where the counts
    of those before it end, so no task holds a whole shard."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*order)) - 1
    return rows.withColumn("slot", within).join(start, ["shard", "_bucket"]).withColumn("slot", (F.col("slot") + F.col("_start")).cast("long")).drop("_start", "_bucket")
