"""URL filter: stated rules, and a tree of path templates judged by labels.

For every host the tree is built from the root.  A position with many segments of
which none has much of the node's pages is variable, and those segments become
``*``; a segment that has much of them, or whose labels differ significantly from
those of the rest, is a branch.  Branches of similar labelled shares are merged.
A template's share of bad labels is smoothed towards that of the node above, up
to the host; where it is high, the template rejects its pages.

In a template ``*`` and ``|`` stand for any segment and for one or the other; where
a segment itself has them, or a backslash, a backslash goes before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most, looked_up, materialise
from .linededup import host_of

#: A segment with at most this part of its node's pages is rare, and a node with so many distinct rare segments is variable there.
DISTINCT = 5
#: Two-sided 5 % point of the normal distribution, for the comparison of two shares.
Z = 1.96
#: Classes of labelled shares, of equal width on the arcsine scale, within which branches are compared.
GRADES = 5
#: Nodes, or classes of branches, of a depth that are broadcast (some 100 bytes each).
BROADCAST_NODES = 100_000


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of the (verdict, rule) pairs that fits.

    A rule is a host and the start of a path; its host stands for all its
    subdomains.  ``rules`` is a stated list and becomes part of the plan."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r)):
        name, slash, start = rule.partition("/")
        of_host = (host == name) | host.endswith(f".{name}")
        fits.append(F.when(of_host & path.startswith(slash + start), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>")) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _differs(bad: Column, m: Column, all_bad: Column, all_m: Column) -> Column:
    """Whether the share of ``bad`` among ``m`` labels differs from that among the rest of ``all_m``."""
    rest, p = all_m - m, all_bad / all_m
    error = F.sqrt(p * (1 - p) * (1 / m + 1 / rest))
    return F.coalesce(F.when((m > 0) & (rest > 0), F.abs(bad / m - (all_bad - bad) / rest) > Z * error), F.lit(False))


def _with_totals(children: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """``children`` with ``sums`` over each of ``keys``, which may hold very many of them."""
    totals = materialise(children.groupBy(*keys).agg(*(F.sum(x).alias(n) for n, x in sums.items())), "totals")
    return looked_up(children, totals, keys, F.xxhash64("seg"), at_most(totals, BROADCAST_NODES))


def _literal(seg: Column) -> Column:
    """A segment in a template, told apart from wildcards and merged names."""
    return F.regexp_replace(seg, r"([\\*|])", r"\\$1")


def _branches(children: DataFrame) -> DataFrame:
    """(host, tmpl, seg, name) of the children (n, bad, good) of every node: ``*`` for the
    rare segments of a variable position, a common name for branches that are
    alike, else the segment.

    Rare segments are pooled but for those whose labels differ from the pool's.
    Branches with labels are alike if their smoothed shares are of one class and
    neither differs from the class's other labels; a branch without labels shows
    no likeness.  All are sums over children: no node is collected, and as rareness
    is a part of the node's pages, more data of the same kind give the same names."""
    m = F.col("m")
    children = _with_totals(children.withColumn("m", F.col("bad") + F.col("good")), ["host", "tmpl"], {"all_n": F.col("n")})
    rare = F.col("n") * DISTINCT <= F.col("all_n")
    pool = {"rare": rare.cast("int"), "rare_bad": F.when(rare, F.col("bad")), "rare_m": F.when(rare, m)}
    pooled = rare & (F.col("rare") >= DISTINCT) & ~_differs(F.col("bad"), m, F.col("rare_bad"), F.col("rare_m"))
    grade = F.floor(F.asin(F.sqrt((F.col("bad") + 1) / (m + 2))) * (2 * GRADES / math.pi))
    placed = _with_totals(children, ["host", "tmpl"], pool).withColumn("grade", F.when(~pooled & (m > 0), grade))
    placed = materialise(placed.select("host", "tmpl", "seg", "bad", "m", "grade", pooled.alias("pooled")), "branch")
    graded = _with_totals(placed.where("grade is not null"), ["host", "tmpl", "grade"], {"all_bad": F.col("bad"), "all_m": m})
    alike = materialise(graded.where(~_differs(F.col("bad"), m, F.col("all_bad"), F.col("all_m"))).select("host", "tmpl", "seg", "grade"), "alike")
    sets = alike.groupBy("host", "tmpl", "grade").agg(F.min("seg").alias("a"), F.max("seg").alias("z"), F.count("*").alias("of"))
    # two sets have no segment in common, so their first ones tell them apart
    first, last = _literal(F.col("a")), _literal(F.col("z"))
    name = F.when(F.col("of") == 1, first).when(F.col("of") == 2, F.concat_ws("|", first, last)).otherwise(F.concat_ws("|", first, F.concat(F.lit("…"), F.col("of") - 2), last))
    sets = materialise(sets.select("host", "tmpl", "grade", name.alias("name")), "sets")
    named = looked_up(alike, sets, ["host", "tmpl", "grade"], F.xxhash64("seg"), at_most(sets, BROADCAST_NODES)).select("host", "tmpl", "seg", "name")
    alone = placed.join(named.select("host", "tmpl", "seg"), ["host", "tmpl", "seg"], "left_anti")
    return named.union(alone.select("host", "tmpl", "seg", F.when(F.col("pooled"), "*").otherwise(_literal(F.col("seg")))))


def _smoothed(bad: Column, m: Column, above: Column) -> Column:
    """Share of bad labels with two more, one as undecided as can be and one like the node above.

    So a template without labels leans to its branch, but no other branch's labels reject it."""
    return (bad + 0.5 + above + 0.5) / (m + 3)


_PATH = ["host", "path", "n", "bad", "good"]
_NODE = ["segs", "tmpl", "p", "above"]


def _shared_steps(live: DataFrame) -> DataFrame:
    """``live`` behind the segments that all paths of their node share, however many: so
    rounds follow the branching, not the length of paths.

    The first and the last of a node's paths share what all of them share.  A path
    alone in its node is settled with all its segments."""
    size = F.size
    nodes = live.groupBy("host", "tmpl").agg(F.min("segs").alias("lo"), F.max("segs").alias("hi"), F.count("*").alias("paths"), F.sum("bad").alias("_bad"), F.sum(F.col("bad") + F.col("good")).alias("_m"))
    same = F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
    differ = F.array_position(same, False)
    nodes = materialise(nodes.select("host", "tmpl", F.when(differ > 0, differ - 1).otherwise(size(same)).cast("int").alias("steps"), (F.col("paths") == 1).alias("lone"), "_bad", "_m"), "nodes")
    rows = looked_up(live, nodes, ["host", "tmpl"], F.xxhash64("path"), at_most(nodes, BROADCAST_NODES))
    taken = F.transform(F.slice("segs", F.lit(1), F.col("steps")), _literal)
    # the purities of the nodes passed follow p -> a + b p
    a, b = (F.col("_bad") + 1) / (F.col("_m") + 3), 1 / (F.col("_m") + 3)
    at = lambda k: F.pow(b, k) * F.col("p") + a * (1 - F.pow(b, k)) / (1 - b)
    moved = (F.col("steps") > 0) & ~F.col("lone")
    return rows.select(
        *_PATH, F.slice("segs", F.col("steps") + 1, size("segs")).alias("segs"), F.when(F.col("steps") > 0, F.concat("tmpl", F.lit("/"), F.array_join(taken, "/"))).otherwise(F.col("tmpl")).alias("tmpl"),
        F.when(moved, at(F.col("steps"))).otherwise(F.col("p")).alias("p"), F.when(moved, at(F.col("steps") - 1)).when(F.col("lone"), F.col("p")).otherwise(F.col("above")).alias("above"),
    )


def path_templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, n, bad, good, purity) of every distinct host and path.

    ``urls`` has host, path and bad (1, 0, or null where no label is known).  n, bad
    and good are of the pages that end at the template; purity is their share of bad
    labels as smoothed by the node above: (bad + 1 + above) / (bad + good + 3), the
    same of all labels below each node, one half above the host.  Without labels it
    stays under 2/3.  Empty segments do not count.  Null hosts and paths are of no
    template.  An empty table gives an empty result."""
    paths = urls.where("host is not null and path is not null").groupBy("host", "path")
    paths = paths.agg(F.count("*").alias("n"), F.count(F.when(F.col("bad") == 1, 1)).alias("bad"), F.count(F.when(F.col("bad") == 0, 1)).alias("good"))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    root = _with_totals(materialise(paths.withColumn("seg", F.col("path")), "paths"), ["host"], {"_bad": F.col("bad"), "_m": F.col("bad") + F.col("good")})
    state = root.select(*_PATH, parts.alias("segs"), F.lit("").alias("tmpl"), _smoothed(F.col("_bad"), F.col("_m"), F.lit(0.5)).alias("p"), F.lit(0.5).alias("above"))
    state = materialise(state, "paths")
    ended = state.where(F.size("segs") == 0)
    while not (live := state.where(F.size("segs") > 0)).isEmpty():
        state = materialise(_shared_steps(live), "paths")
        ended, live = ended.union(state.where(F.size("segs") == 0)), state.where(F.size("segs") > 0)
        seg = F.get("segs", F.lit(0))
        children = live.select("host", "tmpl", seg.alias("seg"), "n", "bad", "good").groupBy("host", "tmpl", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "good")))
        named = _branches(materialise(children, "children"))
        below = live.withColumn("seg", seg).join(named, ["host", "tmpl", "seg"])
        below = materialise(below.select(*_PATH, F.slice("segs", 2, F.size("segs")).alias("segs"), F.concat("tmpl", F.lit("/"), "name").alias("tmpl"), F.col("p").alias("above"), "seg"), "below")
        sums = {"_bad": F.col("bad"), "_m": F.col("bad") + F.col("good")}
        state = _with_totals(below, ["host", "tmpl"], sums).withColumn("p", _smoothed(F.col("_bad"), F.col("_m"), F.col("above")))
        state = materialise(state.select(*_PATH, *_NODE), "paths")
        ended = ended.union(state.where(F.size("segs") == 0))
    sums = materialise(ended.groupBy("host", "tmpl").agg(*(F.sum(c).alias(f"t_{c}") for c in ("n", "bad", "good"))), "purity")
    judged = looked_up(ended, sums, ["host", "tmpl"], F.xxhash64("path"), at_most(sums, BROADCAST_NODES))
    purity = _smoothed(F.col("t_bad"), F.col("t_bad") + F.col("t_good"), F.col("above"))
    return judged.select("host", "path", F.col("tmpl").alias("template"), F.col("t_n").alias("n"), F.col("t_bad").alias("bad"), F.col("t_good").alias("good"), purity.alias("purity"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, max_purity: float = 0.7) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity.

    The verdict is that of the longest rule that fits, else the template's:
    block if its smoothed share of bad labels is ``max_purity`` or more.  Labels
    are (url, bad 0 or 1); where none are given, pages that a rule decides teach
    the templates of the others.  A null url, or one without ``://``, has an
    empty host and path; a path without segments has the empty template.  Every
    row gets a verdict; columns named like the added ones are replaced."""
    added = ("host", "path", "rule", "verdict", "template", "purity")
    keep = [c for c in pages.columns if c not in added]
    parsed = pages.select(*keep, host_of("url").alias("host"), path_of("url").alias("path"))
    fit = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("_fit", fit)
    bad = F.when(F.col("_fit.verdict") == "block", 1).when(F.col("_fit.verdict") == "allow", 0)
    if labels is not None:
        marks = labels.where("url is not null").groupBy(F.col("url").alias("_url")).agg(F.max("bad").alias("_bad"))
        learn = ruled.join(marks, F.col("url") == F.col("_url"), "left").select("host", "path", F.col("_bad").alias("bad"))
    else:
        learn = ruled.select("host", "path", bad.alias("bad"))
    judged = path_templates(learn).select("host", "path", "template", "purity")
    out = ruled.join(judged, ["host", "path"], "left")
    own = F.when(F.col("purity") >= max_purity, "block").otherwise("allow")
    return out.select(*keep, "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce("_fit.verdict", own).alias("verdict"), "template", "purity")
