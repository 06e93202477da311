"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Two permutations make the whole signature: sigma scatters each shingle to a
position below ``UNIVERSE``, and pi, shifted circularly by k, gives coordinate
k as the least pi value over a document's positions.  As the shifts of one
position are neighbours in pi, all coordinates of a shingle are one contiguous
read.

How pairs stay few.  Texts with equal shingle sets are one class and take part
once.  A band's bucket compares its members with its smallest one only (a
star), not with one another.  Where a bucket then still holds several
components, the members outside its largest one are compared with all others,
as a pair within one component cannot change the result.  Before that, a set
too few of whose shingles occur in any other component's open sets is set
aside, by an exact count, and bounds on the common shingles drop most of the
pairs that are left, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, shingle_hashes, shingle_set, words_of
from .components import connected_components

BANDS, ROWS = 40, 5
UNIVERSE = 1 << 22
MAP_LONGS = 16
_MAP = [f"m{i}" for i in range(MAP_LONGS)]
_SKETCH = "doc_id long, n_shingles long, fp binary, bands array<long>"
_pi: np.ndarray | None = None


def _circulant() -> np.ndarray:
    """Row i: pi at i, i+1, ... i+K-1 (circularly), as a view of 16 MB."""
    global _pi
    if _pi is None:
        pi = np.random.default_rng(20210909).permutation(np.arange(UNIVERSE, dtype=np.uint32))
        _pi = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: BANDS * ROWS]]), BANDS * ROWS)
    return _pi


def signature(hashes: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS coordinates of a shingle set."""
    pi, out = _circulant(), np.full(BANDS * ROWS, UNIVERSE, np.uint32)
    at = (mix64(hashes) >> np.uint64(42)).astype(np.int64)  # sigma: 22 bits
    for i in range(0, len(at), 4096):
        np.minimum(out, np.minimum.reduce(pi[at[i : i + 4096]], axis=0), out=out)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key a band from signatures (documents x coordinates)."""
    parts = sigs.astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.broadcast_to(keys, parts.shape[:2]).copy()
    for r in range(ROWS):
        out = mix64(out + parts[:, :, r])
    return out.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, fp, sigs, full = [], [], [], []
        for text in batch.column(1):
            h = shingle_hashes(words_of(text.as_py()))
            n.append(len(h))
            fp.append(xxhash.xxh3_128_digest(h.tobytes()))
            full.append(len(h) > 0)
            if len(h):
                sigs.append(signature(h))
        keys = band_keys(np.stack(sigs)) if sigs else np.empty((0, BANDS), np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.array(full, np.int64) * BANDS)]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), bands], ["doc_id", "n_shingles", "fp", "bands"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those whose full sets reach the similarity."""
    last: tuple = (None, None)
    for batch in batches:
        a, b, keep = batch.column(0), batch.column(1), []
        for ta, tb, percent in zip(batch.column(2), batch.column(3), batch.column(4)):
            ta = ta.as_py()
            if last[0] != ta:
                last = ta, shingle_set(words_of(ta))
            other = shingle_set(words_of(tb.as_py()))
            both = len(last[1] & other)
            keep.append(100 * both >= percent.as_py() * (len(last[1]) + len(other) - both) > 0)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b) whose texts (doc_id, text) share enough shingles.

    Both joins are plain equi-joins on the id, which adaptive execution splits
    where one document has very many partners.  Pairs with a null end, or with an
    id that ``texts`` lacks, go; null and empty texts are like nothing; an id with
    several texts is linked if any of them is; no pairs give an empty result."""
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb", F.lit(percent).alias("p")).mapInArrow(_verify, "a long, b long").distinct()


def _maps(hashes: np.ndarray) -> np.ndarray:
    """Which of 64 * MAP_LONGS cells a set's hashes fall into, as longs."""
    cells = np.zeros(64 * MAP_LONGS, np.uint8)
    cells[(hashes & np.uint64(64 * MAP_LONGS - 1)).astype(np.int64)] = 1
    return np.packbits(cells).view(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_hashes(words_of(t.as_py())) for t in batch.column(2)]
        maps = np.stack([_maps(h) for h in found]) if found else np.empty((0, MAP_LONGS), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), *(pa.array(maps[:, i]) for i in range(MAP_LONGS))], ["rep", "root", "hs", *_MAP])


def _foreign(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, c, cell map): c is how many of a set's shingles sets of another root hold too."""
    sets = texts.join(reps, F.col("doc_id") == F.col("rep")).select("rep", "root", "text")
    sets = materialise(sets.mapInArrow(_hashes, f"rep long, root long, hs array<long>, {', '.join(f'{m} long' for m in _MAP)}"), "shingle")
    rows = sets.select("rep", "root", F.explode("hs").alias("h"))
    mixed = rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h")
    return rows.join(mixed, "h").groupBy("rep").agg(F.count("*").alias("c")).join(sets.select("rep", *_MAP), "rep")


def _may_link(percent: int) -> str:
    """Whether bounds allow sets (n, c, cells m0...) and (an, ac, a_m0...) to be similar.

    Common shingles are at most c of either, and at most a set's size less its
    cells that the other one leaves empty, each of which holds a shingle of its own."""
    only = " + ".join(f"bit_count({m} & ~a_{m})" for m in _MAP)
    other = " + ".join(f"bit_count(a_{m} & ~{m})" for m in _MAP)
    common = f"least(c, ac, n - ({only}), an - ({other}))"
    return f"root != ar and 100 * {common} >= {percent} * (n + an - {common})"


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents whose sets of distinct five-word shingles have a Jaccard
    similarity of ``percent`` hundredths or more are linked; component_id is
    the smallest doc_id that links reach, kept marks it.

    Needs doc_id and text; other columns are ignored.  Null and empty texts
    have no shingles and link with nothing.  Texts under five words are one
    shingle.  Rows that share a doc_id count as one document: their links add
    up, and n_shingles is each row's own.  Rows without a doc_id link nothing
    and keep a null component (kept is true, as nothing else stands for them).
    An empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialise(docs.mapInArrow(_sketch, _SKETCH), "sketch")
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    # One representative a set; partial minima collapse hot groups of copies before the shuffle.
    classes = usable.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.first("n_shingles").alias("n"))
    classes = materialise(classes, "class")
    buckets = classes.select(F.explode("bands").alias("bucket"), "rep")
    pivots = buckets.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    stars = buckets.join(pivots.select("bucket", "pivot"), "bucket").where("rep != pivot")
    tested = materialise(stars.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pair")
    sharing = materialise(tested.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "sharing")
    texts = materialise(docs.where("doc_id is not null").join(sharing, "doc_id", "left_semi"), "text")
    # Rows that share a doc_id are one node, so what one of their texts reaches the others reach.
    spread = usable.groupBy("doc_id").agg(F.min(F.xxhash64("fp")).alias("lo"), F.max(F.xxhash64("fp")).alias("hi")).where("lo != hi").select("doc_id")
    equal = usable.join(spread, "doc_id").join(classes, "fp").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = materialise(connected_components(materialise(verified(tested, texts, percent).union(equal), "link")), "root")

    # Each set's component with the component's size, then the buckets that hold more than one.
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    placed = classes.join(sharing.withColumnRenamed("doc_id", "rep"), "rep", "left_semi").join(roots.join(sizes, "root").withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("rep", "n", F.coalesce("root", "rep").alias("root"), F.coalesce("size", F.lit(1)).alias("size"), "bands")
    rows = placed.select(F.explode("bands").alias("bucket"), "rep", "n", "root", "size")
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by("root", F.struct("size", "root")).alias("main")).where("lo != hi")
    open_ = materialise(rows.drop("size").join(mixed.select("bucket", "main"), "bucket"), "open")
    members = materialise(open_.join(_foreign(open_.select("rep", "root").distinct(), texts), "rep").where(f"100 * c >= {percent} * n"), "open")
    one = F.struct(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("root").alias("ar"), F.col("c").alias("ac"), *(F.col(m).alias(f"a_{m}") for m in _MAP))
    outside = members.where("root != main").select("bucket", one.alias("x")).select("bucket", "x.*")
    todo = members.join(outside, "bucket").where(_may_link(percent)).select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    found = materialise(verified(todo.join(tested, ["a", "b"], "left_anti"), texts, percent), "link")
    if not found.isEmpty():
        stars = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
        roots = materialise(connected_components(stars.union(found)), "root")

    placed = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", F.when(F.expr("doc_id is not null and n_shingles > 0"), F.col("fp")).alias("fp")).join(placed, "fp", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that near_duplicates() keeps, with all their columns.

    Equal rows that share the kept doc_id stay as they are; rows without a
    doc_id stay too."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
