"""Mixing sources to target weights.

Every source's documents lie in blocks by a permuting hash, another one for
each pass over the source.  A source's target says how many whole passes it
makes and which blocks, with a cut inside the last one, a further pass takes.
The exact numbers of blocks are then split between the output shards by a tree
of multivariate hypergeometric draws.  Each shard draws that many of the
source's blocks from a random permutation, disjoint from the others', and
orders its rows by a hash of its own.  What no shard draws is not taken.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, running, shielded

#: All sources' blocks of one pass, in proportion to their words; a source has one at least and at most one a row.
BLOCKS = 1 << 16
#: Sources whose blocks are split by one tree; more are dealt to several, each even over all shards.
TREE_SOURCES = 4096
#: Source tables up to this many rows are broadcast (with BLOCKS and most as factors, some MB), larger ones joined with salt.
BROADCAST_SOURCES = 20_000
SALTS = 64


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``target``: the sources, by code point
    and null last, weigh ``weights``, repeating, and share ``share`` of all sizes;
    no target exceeds ``most`` times its source's size, and the excess is shared
    by weight until none does.  Without sources there are no targets.

    In closed form: sorted by limit over weight, the sources before some place
    stop at their limits and those after it get one level times their weight."""
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"k": F.lit(1)}, "ranked")
    ranked = ranked.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("limit", F.col("source_size") * float(most))
    ranked = running(ranked.withColumn("ratio", F.col("limit") / F.col("w")), [F.col("ratio"), F.col("k")], {"full": F.col("limit"), "used": F.col("w")}, "level")
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("w").alias("weight"))
    ranked = ranked.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("words") * float(share) - F.col("full")) / (F.col("weight") - F.col("used")))
    first = ranked.agg(F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct("ratio", "k", "level")))["level"].alias("common"))
    goal = F.coalesce(F.least(F.col("limit"), F.col("common") * F.col("w")), F.col("limit"))
    return ranked.crossJoin(F.broadcast(first)).select(*sizes.columns, goal.alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Sources x shards: a random split of the blocks into shards whose totals
    differ by one at most, by halving the range of shards recursively."""
    if shards == 1:
        return quotas[:, None]
    left = shards // 2
    total = int(quotas.sum())
    # of every source's blocks, as many go left as in a random draw of the left half's share
    draw = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals")
    return np.hstack([split_quotas(draw, left, rng), split_quotas(quotas - draw, shards - left, rng)])


def deal(source: str | None, quota: np.ndarray, seed: int) -> np.ndarray:
    """The shard that draws each of a source's blocks: a random permutation of
    the blocks, from which shard after shard takes its quota."""
    deck = np.empty(int(quota.sum()), np.int32)
    order = np.random.default_rng([seed, zlib.crc32(repr(source).encode())]).permutation(len(deck))
    deck[order] = np.repeat(np.arange(len(quota), dtype=np.int32), quota)
    return deck


def _placed(key: Column, turn: Column, seed: int) -> Column:
    """A document's place (63 bits) in the permuted order of a pass."""
    return F.shiftrightunsigned(F.xxhash64(key, turn, F.lit(seed)), 1)


def _block(place: Column, blocks: Column) -> Column:
    return F.shiftright(F.shiftright(place, 31) * blocks, 32)


def by_source(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``plan``, which has one row a ``source``.

    A plan of a checked size is broadcast; a larger one is repeated under salts,
    so that a source with a third of all rows is spread over many tasks.  Rows of
    a source that the plan lacks go; a null source meets a null source."""
    plan = plan.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(plan), same).drop("_source")
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("_s", F.pmod("_key", F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_s") == F.col("_salt"))).drop("_source", "_salt", "_s")


def plan_mixture(rows: DataFrame, shards: int = 16, seed: int = 1, **kinds) -> DataFrame:
    """One row a source: its size and target, whole passes, cut of the pass after
    them, number of blocks a pass, and ``deck``, the shard that draws each block.

    ``rows`` has source, _size and _key; ``kinds`` go to targets().  A source
    without words has an empty deck; no rows give no plan."""
    sizes = materialise(rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n")), "source")
    words, n_sources = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    blocks = F.greatest(F.lit(1), F.least(F.ceil(F.col("source_size") * (BLOCKS / max(1, words))), F.col("n"))).cast("long")
    goal = targets(sizes.withColumn("blocks", blocks), **kinds)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = materialise(goal.withColumn("part", F.col("target") - F.col("passes") * F.col("source_size")), "goal")
    partial = goal.where("part > 0").select("source", "passes", "part", "blocks")
    placed = by_source(rows, partial).withColumn("place", _placed(F.col("_key"), F.col("passes"), seed))
    filled = placed.groupBy("source", "part", _block(F.col("place"), F.col("blocks")).alias("block")).agg(F.sum("_size").alias("n"))
    in_order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = filled.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0))).where("before < part and before + n >= part").select("source", "block", "before")
    last = materialise(last.groupBy("source").agg(F.min(F.struct("block", "before")).alias("x")).select("source", "x.*"), "block")
    # Of each source's last block (a bounded part of all rows): its documents up to the one that comes nearest.
    inside = by_source(placed, last).where(_block(F.col("place"), F.col("blocks")) == F.col("block"))
    walk = Window.partitionBy("source").orderBy("place", "_size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.coalesce(F.sum("_size").over(walk), F.lit(0)) + F.col("before") + F.col("_size") / 2)
    cut = inside.groupBy(F.col("source").alias("_source")).agg(F.max(F.when(F.col("at") <= F.col("part"), F.col("place"))).alias("cut"), F.min("block").alias("b"))
    plan = goal.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
    # where the nearest cut is before the block's first document, no document of the block is taken
    cut, units = F.coalesce("cut", F.lit(-1)), F.col("passes") * F.col("blocks") + F.coalesce(F.col("b") + F.col("cut").isNotNull().cast("int"), F.lit(0))
    before = F.expr("shiftleft((shiftleft(b, 32) + blocks - 1) div blocks, 31) - 1")
    plan = plan.select("source", "source_size", "target", "passes", F.when(F.col("cut").isNull() & F.col("b").isNotNull(), before).otherwise(cut).alias("cut"), "blocks", units.alias("units"))
    trees = max(1, -(-n_sources // TREE_SOURCES))

    def dealt(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("source", na_position="last", ignore_index=True)
        tree = int(part.tree[0])
        quotas = split_quotas(part.units.to_numpy(np.int64), shards, np.random.default_rng([seed, tree]))
        quotas = np.roll(quotas, tree, axis=1)  # the odd blocks of many trees go round the shards
        return part.drop(columns=["tree", "units"]).assign(deck=[deal(s, q, seed) for s, q in zip(part.source, quotas)])

    # A group has one row a source, TREE_SOURCES or so of them: trees draw over sources and blocks, never over documents.
    plan = plan.withColumn("tree", F.pmod(F.xxhash64("source"), F.lit(trees)).cast("int"))
    kept = ", ".join(f"{n} {t}" for n, t in plan.dtypes if n not in ("tree", "units"))
    return materialise(plan.groupBy("tree").applyInPandas(dealt, f"{kept}, deck array<int>"), "mixture")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with _size (words of the text, null: 0) and _key (hash of a row)."""
    return docs.withColumns({"_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_key": F.xxhash64("doc_id", "text")})


def drawn(rows: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """``rows`` with their source's plan and ``draws``: (turn, mix_shard, mix_order) of
    every time that a shard draws the block the row lies in; none for most rows
    of a source that is taken in part.

    A row with a null source follows the plan of the null source; equal rows are
    drawn together; rows whose source the plan lacks go."""
    out = by_source(rows, plan)
    turns = F.transform(F.sequence(F.lit(0), F.col("passes")), lambda t: F.struct(t.alias("turn"), _placed(F.col("_key"), t, seed).alias("place")))
    lies = F.filter(turns, lambda x: (x["turn"] < F.col("passes")) | (x["place"] <= F.col("cut")))
    shards = F.transform(lies, lambda x: F.struct(x["turn"].alias("turn"), F.get("deck", (x["turn"] * F.col("blocks") + _block(x["place"], F.col("blocks"))).cast("int")).alias("mix_shard")))
    got = F.filter(shards, lambda x: x["mix_shard"].isNotNull())
    draws = F.transform(got, lambda x: F.struct(x["turn"].alias("turn"), x["mix_shard"].alias("mix_shard"), F.xxhash64("_key", x["turn"], x["mix_shard"]).alias("mix_order")))
    return out.withColumn("draws", draws)


def mix(docs: DataFrame, shards: int = 16, seed: int = 1, **kinds) -> DataFrame:
    """The mixture: the rows of ``docs`` (doc_id, text, source, ...), each as often
    as it is taken, with ``mix_shard`` and ``mix_order``, its place in the shard's
    local shuffle; rows lie by shard and in that order.

    Whole documents are taken, so a source comes within half a document of its
    target.  Null texts have size 0; a null source is a source of its own, after
    the others; equal rows fall together; an empty table gives an empty mixture.
    Columns named like the two added ones are replaced.  The same rows and seed
    give the same mixture in any order and partitioning."""
    docs, own = shielded(docs.drop("mix_shard", "mix_order"), "doc_id", "text", "source")
    columns = docs.columns
    # Only sizes and keys are written; the mixture itself reads the texts once more.
    rows = materialise(sized(docs).select("source", "_size", "_key"), "size")
    plan = plan_mixture(rows, shards, seed, **kinds).select("source", "passes", "cut", "blocks", "deck")
    taken = drawn(docs.withColumn("_key", F.xxhash64("doc_id", "text")), plan, seed).select(*columns, F.explode("draws").alias("d"))
    out = taken.select(*own, "d.mix_shard", "d.mix_order")
    return out.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")


def taken_words(docs: DataFrame, shards: int = 16, seed: int = 1, **kinds) -> DataFrame:
    """(doc_id, size, source_size, target, taken, mix_shards, mix_orders) for every row of
    ``docs``: ``taken`` are its words in the blocks that shards drew, and the two
    lists say which shards, and where in their order, one entry a copy.

    Nulls, ties and empty tables are as in mix(), whose draws these are."""
    rows = materialise(sized(docs).select("doc_id", "source", "_size", "_key"), "size")
    out = drawn(rows, plan_mixture(rows, shards, seed, **kinds), seed)
    lists = F.col("draws.mix_shard").alias("mix_shards"), F.col("draws.mix_order").alias("mix_orders")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.size("draws") * F.col("_size")).cast("long").alias("taken"), *lists)
