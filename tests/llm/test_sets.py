"""Sharding, mixing, quality, licences, line dedup, URL filter, archives."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from papyra.llm import licenses, linededup, mixing, queries, quality, sharding, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string"


def some_docs(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = None if i % 97 == 0 else "" if i % 89 == 0 else "copy of one text " * 9 if i % 3 == 0 else "w " * rng.randrange(1, 400) + str(i)
        rows.append((i, text, rng.choice(["en", "de", None]), "hot" if i % 3 == 1 else rng.choice(["a", "b", "ä", None])))
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


def shard_sizes(rows):
    """Bytes of every shard, and the shards of every text."""
    size, by_text = Counter(), defaultdict(set)
    for r in rows:
        size[r.shard] += len((r.text or "").encode()) + 1
        by_text[r.text or ""].add(r.shard)
    return size, by_text


def test_shards_are_even_in_bytes_and_hold_all_rows(spark):
    docs, frame = some_docs(spark)
    got = sharding.shard(frame.withColumn("shard", F.lit("x")), shards=16).collect()
    assert sorted(r.doc_id for r in got) == [d[0] for d in docs]
    size, by_text = shard_sizes(got)
    mean = sum(size.values()) / 16
    assert sorted(size) == list(range(16)) and max(size.values()) < 1.01 * mean and min(size.values()) > 0.99 * mean
    # only the text that a third of all rows hold outweighs a shard
    assert {t for t, s in by_text.items() if len(s) > 1} <= {"copy of one text " * 9}


def test_groups_stay_whole_where_a_shard_can_hold_them(spark):
    rng = random.Random(3)
    rows = [(i, f"group {i % 12} " + "x" * 100, "en", "s") for i in range(12 * 30)]  # twelve groups of 0.6 shards and less
    rows += [(1000 + i, "y" * rng.randrange(5, 400) + str(i), "en", "s") for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), shards=40).collect()
    size, by_text = shard_sizes(got)
    mean = sum(size.values()) / 40
    assert max(len(s) for s in by_text.values()) == 1 and sum(len(t) + 1 for t in by_text) < sum(size.values())
    # groups of one length lie side by side: a leaf of nothing but groups misses by half a group at most
    assert max(size.values()) < 1.2 * mean and min(size.values()) > 0.8 * mean


@pytest.mark.parametrize("doc_id", [None, 7])
def test_a_hot_text_parts_also_without_different_ids(spark, doc_id):
    rows = [(doc_id, "the same text", "en", "s")] * 4000 + [(i, f"own {i}", "en", "s") for i in range(1000)]
    size, _ = shard_sizes(sharding.shard(spark.createDataFrame(rows, DOCS).repartition(3), shards=8).collect())
    mean = sum(size.values()) / 8
    assert sum(size.values()) == sum(len(r[1]) + 1 for r in rows) and max(size.values()) < 1.15 * mean and min(size.values()) > 0.85 * mean


def test_a_thousand_shards_are_even(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("a"), (F.xxhash64("id") % 20 + 40).cast("int")), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 30).alias("source"))
    size = {r.shard: r.b for r in sharding.shard(rows, shards=1024).groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("b")).collect()}
    mean = sum(size.values()) / 1024
    # a shard holds some 58 documents of 24 to 65 bytes
    assert len(size) == 1024 and max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean


def test_sources_are_ranked_as_they_sort(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 2)
    names = ["src10", "src0", "src7", None, "http://a/", "http://b/", "src1"]
    frame = spark.createDataFrame([(i, 0, n, "en") for i, n in enumerate(names)], "_h long, _crc long, _source string, _lang string")
    got = {r._h: r.origin for r in sharding._ranked(frame).collect()}
    order = sorted(n for n in names if n is not None)
    ranks = [got[i] for i, n in enumerate(names) if n is not None]
    assert got[3] == 0 and sorted(range(len(ranks)), key=lambda i: ranks[i]) == sorted(range(len(ranks)), key=lambda i: [n for n in names if n is not None][i]) and len(set(ranks)) == len(order)


@pytest.mark.parametrize("n_nodes", [1, 100_000])
def test_the_median_is_found_inside_a_heavy_bin(spark, n_nodes):
    n, heavy, each = 200_000, 150, 2000  # fewer heavy points than a bin has
    points = spark.range(n).select(F.lit(0).alias("node"), F.when(F.col("id") < n - heavy, 1).otherwise(each).cast("long").alias("w"), F.shiftleft("id", 31).alias("at"))
    total = n - heavy + heavy * each
    nodes = spark.createDataFrame([(0, total / 2, 1.0, 0, (n - 1) << 31)], "node int, goal double, light double, first long, last long")
    (cut,) = sharding._medians(points, nodes, n_nodes).collect()
    low = points.agg(F.sum(F.when(F.col("at") < cut.cut, F.col("w")))).first()[0]
    assert abs(low - total / 2) == cut.miss <= each / 2


def test_shards_by_target_bytes_and_of_nothing(spark):
    _, frame = some_docs(spark, 400)
    total = frame.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0]
    assert sharding.shard(frame, target_bytes=total // 5 + 1).select("shard").distinct().count() == 5
    assert sharding.shard(frame.where("false"), shards=4).count() == 0
    assert sharding.shard(frame.select("text"), shards=3).select("shard").distinct().count() == 3


def test_slots_are_gapless(spark, tmp_path):
    _, frame = some_docs(spark, 500)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op1_sharding(spark, str(tmp_path)).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: (r.text or "").encode() for r in frame.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in out)
    size, shards = Counter(), defaultdict(set)
    for r in out:
        size[r.shard] += r.size
        shards[texts[r.doc_id]].add(r.shard)
    mean = sum(size.values()) / 16
    assert {r.law for r in out} == {"bytes"} and max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
    weight = Counter({t: (len(t) + 1) * n for t, n in Counter(texts.values()).items()})
    assert all(len(shards[t]) == 1 for t, w in weight.items() if w <= mean)


def target_loop(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, stop at the limits, share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    goal, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            goal |= {s: level * weight[s] for s in free}
            break
        goal |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return goal


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, rng.randrange(1, 10_000)]) for s in ["a", "b", "Z", "é", "10", None, ""][: rng.randrange(1, 8)]}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(target_loop(sizes))


def test_mixture_meets_targets_and_reruns_agree(spark):
    docs, frame = some_docs(spark)
    got = {r.doc_id: r for r in mixing.taken_words(frame).collect()}
    words = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    sizes, taken = Counter(), Counter()
    for d in docs:
        sizes[d[3]] += words[d[0]]
        taken[d[3]] += got[d[0]].taken
    goal = target_loop(sizes)
    largest = max(words.values())
    for d in docs:
        r = got[d[0]]
        assert (r.size, r.source_size) == (words[d[0]], sizes[d[3]]) and 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(goal[d[3]])
    assert all(abs(taken[s] - goal[s]) <= largest for s in goal)
    again = {r.doc_id: r.taken for r in mixing.taken_words(frame.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    mixed = mixing.mix(frame.withColumn("mix_order", F.lit(1)), shards=4)
    assert Counter(r.doc_id for r in mixed.collect() if words[r.doc_id]) == Counter({i: r.taken // r.size for i, r in got.items() if r.taken})
    assert mixing.mix(frame.where("false")).count() == 0


def test_shards_hold_the_blocks_of_their_quotas(spark):
    _, frame = some_docs(spark, 1500)
    rows = mixing.sized(frame).select("doc_id", "source", "_size", "_key")
    plan = mixing.plan_mixture(rows, shards=5).cache()
    units = {r.source: (r.passes, r.blocks, r.deck) for r in plan.collect()}
    drawn_blocks = Counter(s for _, _, deck in units.values() for s in deck)
    assert set(drawn_blocks) == set(range(5)) and max(drawn_blocks.values()) - min(drawn_blocks.values()) <= 1
    assert all(passes * blocks <= len(deck) <= (passes + 1) * blocks for passes, blocks, deck in units.values())
    # every row's places, counted again from its key: a shard holds a row if, and only if, it drew the row's block
    turns = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda t: mixing._placed(F.col("_key"), t, 1))
    places = {r.doc_id: (r.source, r.turns) for r in rows.select("doc_id", "source", turns.alias("turns")).collect()}
    cuts = {r.source: r.cut for r in plan.collect()}
    want = Counter()
    for i, (source, at) in places.items():
        passes, blocks, deck = units[source]
        for turn in range(passes + 1):
            unit = turn * blocks + ((at[turn] >> 31) * blocks >> 32)
            if unit < len(deck) and (turn < passes or at[turn] <= cuts[source]):
                want[i, deck[unit]] += 1
    got = mixing.mix(frame, shards=5).select("doc_id", "mix_shard", "mix_order").collect()
    assert Counter((r.doc_id, r.mix_shard) for r in got) == want
    listed = mixing.taken_words(frame, shards=5).collect()
    assert Counter((r.doc_id, s) for r in listed for s in r.mix_shards) == want and all(r.taken == r.size * len(r.mix_shards) for r in listed)
    assert sorted((r.doc_id, o) for r in listed for o in r.mix_orders) == sorted((r.doc_id, r.mix_order) for r in got)


def test_mixed_rows_lie_by_shard_in_shuffled_order(spark):
    _, frame = some_docs(spark, 600)
    parts = mixing.mix(frame, shards=3).select("mix_shard", "mix_order", F.spark_partition_id().alias("p")).collect()
    assert [(r.mix_shard, r.mix_order) for r in parts] == sorted((r.mix_shard, r.mix_order) for r in parts)


def test_many_sources_are_split_by_several_trees(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TREE_SOURCES", 8)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    rows = [(i, "w " * (1 + i % 7), "en", None if i % 50 == 0 else f"s{i % 50:02d}") for i in range(1000)]
    frame = spark.createDataFrame(rows, DOCS)
    sizes, taken, goal = Counter(), Counter(), {}
    for r, d in zip(sorted(mixing.taken_words(frame, shards=4).collect()), rows):
        sizes[d[3]] += r.size
        taken[d[3]] += r.taken
        goal[d[3]] = r.target
    assert goal == pytest.approx(target_loop(sizes)) and all(abs(taken[s] - goal[s]) <= 7 for s in goal)


def test_quotas_split_exactly():
    import numpy as np

    quotas = np.array([0, 1, 4096, 777, 13])
    split = mixing.split_quotas(quotas, 7, np.random.default_rng(0))
    assert (split.sum(1) == quotas).all() and np.ptp(split.sum(0)) <= 1 and split.min() >= 0


def labelled(spark, n=900):
    rng = random.Random(8)
    good = ["the", "result", "follows", "from", "careful", "work", "and", "method", "because", "reason"]
    bad = ["buy", "now", "free", "click", "cheap", "$$$", "win", "offer", "best", "deal"]
    docs, labels = [], []
    for i in range(n):
        y = i % 3 > 0
        pool = (good if y else bad) * 2 + ["of", "a", "in", "it"] * 3
        docs.append((i, " ".join(rng.choice(pool) for _ in range(rng.randrange(15, 60)))))
        labels.append((i, int(y)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"), dict(labels)


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    model = quality.fit(docs, labels.where(~quality.is_held_out()))
    held = {r.doc_id: r.quality_score for r in quality.score(docs.where(quality.is_held_out()), model).collect()}
    assert {i for i in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum((s >= 0.3) == bool(truth[i]) for i, s in held.items())
    assert right >= 0.95 * len(held)
    again = quality.fit(docs.repartition(9), labels.where(~quality.is_held_out()))
    assert (again.weights == model.weights).all() and again.slope == model.slope


def test_quality_edge_cases(spark):
    docs, labels, _ = labelled(spark, 90)
    odd = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "x" * 200_000, 0.5), (2, "x", 0.5)], "doc_id long, text string, quality_score double")
    model = quality.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1), (4, None), (5, 7)], "doc_id long, label int")))
    scores = quality.score(odd, model)
    assert scores.columns == odd.columns and all(0 <= r.quality_score <= 1 for r in scores.collect())
    for part in (labels.where("label = 1"), labels.where("false")):
        assert all(0 < r.quality_score < 1 for r in quality.score(odd, quality.fit(docs, part)).collect())
    assert quality.score(odd.where("false"), model).count() == 0


def test_a_rare_class_is_there_in_full_strength_and_bounds_hold(spark, monkeypatch):
    docs, labels, truth = labelled(spark, 900)
    rare = labels.where("label = 1 or doc_id % 30 = 0")  # thirty of class 0
    taken = {}
    monkeypatch.setattr(quality, "dual_coordinate_descent", lambda rows, ratio, y, *a: taken.update(rows=rows, y=y) or (__import__("numpy").zeros(quality.FEATURES), 0.0))
    quality.fit(docs, rare, max_fit_rows=100, max_count_rows=200)
    assert 15 <= (taken["y"] < 0).sum() <= 30 and len(taken["y"]) <= 80
    # rows that repeat a doc_id stay within the bounds, and long texts within theirs
    quality.fit(docs.union(docs).union(docs), rare, max_fit_rows=60, max_fit_bytes=4000)
    assert 2 <= len(taken["y"]) <= 60


def test_descent_solves_its_problem():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(80)]
    ratio = np.zeros(quality.FEATURES)
    ratio[:40] = rng.standard_normal(40)
    x = np.zeros((80, 41))
    for k, r in enumerate(rows):
        x[k, r], x[k, 40] = ratio[r] / len(r) ** 0.5, 1
    y = np.sign(x[:, :40] @ rng.standard_normal(40) + 0.1 * rng.standard_normal(80))
    v, b = quality.dual_coordinate_descent(rows, ratio, y, np.full(80, 2.0), 400)
    w = np.append(np.divide(v[:40], ratio[:40]), b)
    loss = lambda w: w @ w / 2 + 2 * np.maximum(0, 1 - y * (x @ w)).sum()
    plain = np.zeros(41)
    for step in range(1, 4000):
        plain -= 0.5 / step**0.7 * 0.05 * (plain - 2 * ((1 - y * (x @ plain) > 0) * y) @ x)
    assert loss(w) <= loss(plain) + 1e-3


PROSE = "the work of a license and software in this or that public notice by copy".split()


def licence_words(line):
    return [w for w in (x.strip(".-") for x in re.split("[^a-z0-9\u00c0-\U0010ffff.-]+", line.lower())) if w]


def licence_paragraphs(text):
    """Lines, a line that ends within a sentence with the next one."""
    out, lines = [], (text or "").split("\n")
    for i, line in enumerate(lines):
        last = lines[i - 1].rstrip(" \t\r") if i else ""
        if i and last and last[-1] not in ".!?:;" and line.strip():
            out[-1] += " " + line
        else:
            out.append(line)
    return out


def licence_docs(seed=6):
    """Documents with templates as lines of their own, or wrapped over lines, among prose."""
    rng = random.Random(seed)
    prose = lambda: " ".join(rng.choice(PROSE + [f"w{rng.randrange(200)}"]) for _ in range(25)) + "."
    docs, planted = [], {}
    stated = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts]
    for i in range(240):
        lines = [prose() for _ in range(rng.randrange(1, 8))]
        if i % 6 == 0:
            family, text = stated[(i // 6) % len(stated)]
            at, words = rng.randrange(len(lines) + 1), text.split()
            if i % 12 == 0 and not any(w[-1] in ".:;" for w in words[:-1]):
                text = "\n".join(" ".join(words[k : k + 4]) for k in range(0, len(words), 4))
            lines.insert(at, text)
            planted[i, at] = family
        docs.append((i, "\n".join(lines)))
    return docs + [(900, None), (901, ""), (902, "\n\n"), (None, stated[0][1])], planted


def test_licences_are_found_and_prose_is_not(spark):
    docs, planted = licence_docs()
    found = licenses.license_scan(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, family int")).collect()
    got = {(r.doc_id, r.paragraph): r.family for r in found if r.confirmed}
    assert got == planted
    # prose of licence words is told from a licence by its probability alone
    assert all(0 <= r.probability <= 1 for r in found) and sum(not r.confirmed for r in found) <= 0.02 * len(planted)
    assert all(r.confirmed or r.probability >= 0.5 for r in found)


def test_licence_scores_match_brute_force(spark):
    docs, _ = licence_docs(7)
    frame = spark.createDataFrame(docs, DOCS.split(", lang")[0]).where("doc_id is not null")
    model, _ = licenses.train(frame, background=50)
    want = {}
    for i, text in docs:
        for k, p in enumerate(licence_paragraphs(text) if i is not None else []):
            w = licence_words(p)
            grams = {" ".join(w[j : j + n]) for n in (2, 3) for j in range(len(w) - n + 1)} & model.weights.keys()
            if grams:
                logits = [b + sum(model.weights[g][c] for g in grams) for c, b in enumerate(model.intercepts)]
                best = max(range(1, len(logits)), key=lambda c: logits[c])
                want[i, k] = (model.classes[best], logits[best] - logits[0], {" ".join(w[j : j + 5]) for j in range(len(w) - 4) if set(w[j : j + 5]) <= set(model.words)})
    got = {(r.doc_id, r.paragraph): r for r in licenses._scored(licenses.scan(frame, model), ["row", "doc_id", "paragraph"], model).collect()}
    assert got.keys() == want.keys()
    for key, (family, margin, has) in want.items():
        assert got[key].margin == pytest.approx(margin) and (got[key].family == family or abs(margin) < 1e-9) and set(got[key].has) == has


def test_licence_scan_without_licences_or_rows(spark):
    frame = spark.createDataFrame([(1, "plain words of no notice."), (2, None)], "doc_id long, text string")
    assert licenses.license_scan(frame).count() == 0 and licenses.license_scan(frame.where("false")).count() == 0
    own = licenses.license_scan(spark.createDataFrame([(1, "text.\nBeer ware.\nmore")], "doc_id long, text string"), {"Beer": ["Beer ware", ""], "Tea": ["tea ware for all of us here"]})
    assert [(r.paragraph, r.family, r.confirmed) for r in own.collect()] == [(1, "Beer", True)]


def plain_lines(html):
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "\n", html or "")
    return [x for x in (y.strip(" \t\n\v\f\r") for y in re.split("[\n\r]+", re.sub(r"<[^>]*>", "\n", text))) if x]


def test_line_dedup_matches_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    pages = []
    for i in range(200):
        host = rng.choice(["https://A.com/x", "http://b.org", "ftp://a.com?q", None, "no host"])
        body = [rng.choice(["menu", "footer", f"line {rng.randrange(30)}", f"own {i}"]) for _ in range(rng.randrange(0, 9))]
        pages.append((i if i % 50 else None, host, None if i % 40 == 0 else "<p>" + "</p>\n<p>".join(body) + "</p><script>x</script>", "extra"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, n_lines string")
    host = lambda u: (re.match(r"(?s)^.*?://([^/?#]*)", u or "") or [None, ""])[1].lower()
    total, holds = Counter(host(p[1]) for p in pages), Counter((host(p[1]), x) for p in pages for x in set(plain_lines(p[2])))
    drop = {k for k, n in holds.items() if n >= 3 and n > 0.3 * total[k[0]]}
    want = sorted((repr(p[0]), "\n".join(x for x in plain_lines(p[2]) if (host(p[1]), x) not in drop), len(plain_lines(p[2]))) for p in pages)
    for most in (100_000, 1):  # broadcast, and joined under salts
        monkeypatch.setattr(linededup, "BROADCAST_HOSTS", most)
        got = linededup.site_line_dedup(frame)
        assert sorted((repr(r.page_id), r.clean_text, r.n_lines) for r in got.collect()) == want
    assert drop and linededup.site_line_dedup(frame.where("false")).count() == 0


def test_url_rules(spark):
    urls = {
        "http://a.example.com/en/7x": ("example.com/en/7", "allow"), "http://EXAMPLE.com/en/8": ("com/en/", "block"), "http://x.net/de/1?q": ("net/de/", "allow"), "http://example.net/de/8#": ("example.net/de/8", "block"),
        "s://y.org/es/": ("org/es/", "block"), "http://net/de/": ("net/de/", "allow"), "http://subnet/de/": (None, "allow"), "http://a.com/fr/en/": (None, "allow"), "no url": (None, "allow"), "": (None, "allow"),
    }
    frame = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(99, None, 1)], "page_id long, url string, rule int")
    got = {r.url: (r.rule, r.verdict) for r in urlfilter.judge_urls(frame, queries.URL_RULES).collect()}
    assert got == urls | {None: (None, "allow")}
    assert urlfilter.judge_urls(frame.where("false"), queries.URL_RULES).count() == 0


def test_templates_generalise_and_reject(spark):
    rows = [(f"http://h.com/{kind}/{i}", int(kind == "ads")) for kind in ("ads", "news") for i in range(40)]
    pages = spark.createDataFrame([(u,) for u, _ in rows] + [("http://h.com/ads/new",), ("http://h.com/news/new",)], "url string")
    judged = {r.url: (r.template, r.verdict) for r in urlfilter.judge_urls(pages, [], spark.createDataFrame(rows, "url string, bad int")).collect()}
    assert judged["http://h.com/ads/new"] == ("/ads/*", "block") and judged["http://h.com/news/new"] == ("/news/*", "allow")


def test_similar_branches_merge_and_unlabelled_ones_stay(spark):
    rows = [(f"http://h.com/{kind}/{i}", int(kind in ("ads", "promo"))) for kind in ("ads", "promo", "news") for i in range(40)]
    pages = spark.createDataFrame([(u,) for u, _ in rows] + [(f"http://h.com/blog/{i}",) for i in range(40)], "url string")
    found = {(r.template, r.verdict) for r in urlfilter.judge_urls(pages, [], spark.createDataFrame(rows, "url string, bad int")).collect()}
    assert found == {("/ads|promo/*", "block"), ("/news/*", "allow"), ("/blog/*", "allow")}


def test_templates_reach_the_true_depth(spark):
    rows = [(f"http://h.com/a/b/c/d/e/f/{kind}/x/{i}", int(kind == "spam")) for kind in ("spam", "news") for i in range(20)]
    pages = spark.createDataFrame([(u,) for u, _ in rows] + [("http://alone.com/" + "s/1/" * 300,), ("http://h.com/a/b/c/d/e/f/spam/x/new",)], "url string")
    judged = {r.url: (r.template, r.verdict) for r in urlfilter.judge_urls(pages, [], spark.createDataFrame(rows, "url string, bad int")).collect()}
    assert all(judged[u] == (f"/a/b/c/d/e/f/{'spam' if bad else 'news'}/x/*", "block" if bad else "allow") for u, bad in rows)
    assert judged["http://h.com/a/b/c/d/e/f/spam/x/new"] == ("/a/b/c/d/e/f/spam/x/*", "block")
    assert judged["http://alone.com/" + "s/1/" * 300] == ("/s/1" * 300, "allow")


def brute_templates(paths, distinct=5):
    """(template, purity of the node above) of each path of a host ({path: [n, bad, good]}), node by node."""

    def differs(bad, m, all_bad, all_m):
        rest = all_m - m
        if not m or not rest:
            return False
        p = all_bad / all_m
        return abs(bad / m - (all_bad - bad) / rest) > 1.96 * (p * (1 - p) * (1 / m + 1 / rest)) ** 0.5

    literal = lambda s: s.replace("\\", "\\\\").replace("*", "\\*").replace("|", "\\|")
    out = {}

    def purity(node, above):
        bad, m = (sum(paths[p][1] for p, _ in node), sum(paths[p][1] + paths[p][2] for p, _ in node))
        return (bad + 1 + above) / (m + 3)

    def walk(node, prefix, above):
        own = purity(node, above)
        for path, _ in [x for x in node if not x[1]]:
            out[path] = (prefix, above)
        node = [x for x in node if x[1]]
        if len(node) == 1:
            path, segs = node[0]
            out[path] = (prefix + "".join("/" + literal(s) for s in segs), own)
            return
        kids = defaultdict(lambda: [0, 0, 0])
        for path, segs in node:
            for k in range(3):
                kids[segs[0]][k] += paths[path][k]
        total = sum(v[0] for v in kids.values())
        rare = {s: v for s, v in kids.items() if v[0] * distinct <= total}
        pool_bad, pool_m = sum(v[1] for v in rare.values()), sum(v[1] + v[2] for v in rare.values())
        name, grades = {}, defaultdict(list)
        for s, (_, bad, good) in kids.items():
            if s in rare and len(rare) >= distinct and not differs(bad, bad + good, pool_bad, pool_m):
                name[s] = "*"
            elif bad + good:
                grades[int(math.asin(((bad + 1) / (bad + good + 2)) ** 0.5) * 10 / math.pi)].append(s)
            else:
                name[s] = literal(s)
        for members in grades.values():
            all_bad, all_m = sum(kids[s][1] for s in members), sum(kids[s][1] + kids[s][2] for s in members)
            alike = sorted(s for s in members if not differs(kids[s][1], kids[s][1] + kids[s][2], all_bad, all_m))
            lits = [literal(s) for s in alike]
            joined = "|".join(lits) if len(alike) < 3 else f"{lits[0]}|…{len(alike) - 2}|{lits[-1]}"
            name |= {s: joined if s in alike else literal(s) for s in members}
        below = defaultdict(list)
        for path, segs in node:
            below[name[segs[0]]].append((path, segs[1:]))
        # a node that all share is no new set of pages, so its own purity follows from the whole node's
        for step, rest in below.items():
            walk(rest, f"{prefix}/{step}", own)

    walk([(p, [s for s in p.split("/") if s]) for p in paths], "", 0.5)
    return out


@pytest.mark.parametrize("most", [100_000, 1])
def test_templates_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "BROADCAST_NODES", most)
    rng = random.Random(17)
    section = {f"s{i}": rng.choice([0.0, 0.1, 0.5, 0.9, 1.0]) for i in range(9)} | {"v2": 1.0, "2024": 0.0}
    rows = []
    for _ in range(900):
        host, s = rng.choice(["a.com", "b.org"]), rng.choice([*section, f"rare{rng.randrange(40)}"])
        tail = rng.choice(["", f"/{rng.randrange(500)}", f"/list/{rng.randrange(4)}", f"/p{rng.randrange(3)}/q/{rng.randrange(9)}/"])
        rows.append((host, f"/{s}{tail}", rng.choice([None, int(rng.random() < section.get(s, 0.5))])))
    rows += [("c.com", f"/x/y/z/{i % 2}/w{'/deep' * 40}/{i}", i % 3 and 1) for i in range(12)] + [("d.org", f"/{s}/{i}", 1) for s in ("*", "a|b", "a", "b", "\\\\") for i in range(7)] + [("d.org", "/x/y", None)]
    frame = spark.createDataFrame([*rows, ("", "", None), ("c.com", "//x//", 1)], "host string, path string, bad int").repartition(3)
    got = {(r.host, r.path): (r.template, r.n, r.bad, r.good, r.purity) for r in urlfilter.path_templates(frame).collect()}
    counts = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for host, path, bad in [*rows, ("", "", None), ("c.com", "//x//", 1)]:
        for k, hit in enumerate((True, bad == 1, bad == 0)):
            counts[host][path][k] += hit
    want = {}
    for host, paths in counts.items():
        templates, sums = brute_templates(paths), defaultdict(lambda: [0, 0, 0])
        for path, (t, _) in templates.items():
            for k in range(3):
                sums[t][k] += paths[path][k]
        for path, (t, above) in templates.items():
            n, bad, good = sums[t]
            want[host, path] = (t, n, bad, good, pytest.approx((bad + 1 + above) / (bad + good + 3)))
    assert got == want and any("|" in t for t, *_ in want.values()) and any("v2" in t for t, *_ in want.values())


def test_a_literal_star_is_no_wildcard(spark):
    pages = [f"http://h.org/a/*/{i}" for i in range(6)] + [f"http://h.org/a/{i}" for i in range(6)] + ["http://h.org/x|y/1", "http://h.org/x|y/2"]
    judged = {r.url: (r.template, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame([(u,) for u in pages], "url string"), [("block", "h.org/a/*")]).collect()}
    assert all(judged[f"http://h.org/a/{i}"] == ("/a/*", "allow") and judged[f"http://h.org/a/*/{i}"] == (r"/a/\*/*", "block") for i in range(6))
    assert judged["http://h.org/x|y/1"] == (r"/x\|y/1", "allow")


@pytest.mark.parametrize("each", [2, 20])
def test_ids_are_variable_however_often_each_is_seen(spark, each):
    rows = [(f"http://h.org/u/{i}/p?{k}",) for i in range(50) for k in range(each)] + [(f"http://h.org/about?{k}",) for k in range(100)]
    found = {r.template for r in urlfilter.judge_urls(spark.createDataFrame(rows, "url string"), []).collect()}
    assert found == {"/u/*/p", "/about"}


def test_unlabelled_templates_lean_to_their_branch_and_are_not_rejected_for_it(spark):
    rows = [(f"http://{h}/x/{k}/{i}", None if k == "new" else b) for h, b in (("bad.org", 1), ("good.org", 0)) for k in ("old", "new") for i in range(30)]
    pages = spark.createDataFrame([(u,) for u, _ in rows], "url string")
    got = {(r.host, r.template): (r.purity, r.verdict) for r in urlfilter.judge_urls(pages, [], spark.createDataFrame([r for r in rows if r[1] is not None], "url string, bad int")).collect()}
    assert got["bad.org", "/x/new/*"][0] > 0.5 > got["good.org", "/x/new/*"][0]
    assert got["bad.org", "/x/new/*"][1] == "allow" and got["bad.org", "/x/old/*"][1] == "block" and got["good.org", "/x/old/*"][1] == "allow"


def test_twins_of_many_segments_take_few_rounds(spark):
    trap = "http://t.org/" + "loop/" * 300
    pages = spark.createDataFrame([(trap + "a",), (trap + "b",), (trap,)], "url string")
    began = time.time()
    got = {r.url: r.template for r in urlfilter.judge_urls(pages, []).collect()}
    assert got == {trap + x: "/loop" * 300 + (f"/{x}" if x else "") for x in ("a", "b", "")} and time.time() - began < 60


def test_few_rare_branches_stay_apart(spark):
    urls = ["en"] * 16 + ["fr"] * 3 + ["es"] * 2 + ["de"]
    rows = [(f"http://h.com/{s}/{i}", None if s in ("en", "fr", "de") else 1) for i, s in enumerate(urls)]
    judged = urlfilter.judge_urls(spark.createDataFrame([(u,) for u, _ in rows], "url string"), [], spark.createDataFrame(rows, "url string, bad int").where("bad is not null"))
    got = {r.url.split("/")[3]: r.verdict for r in judged.collect()}
    assert got == {"en": "allow", "fr": "allow", "es": "block", "de": "allow"}


def test_host_path_and_rule_are_plain_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    source = "/root/testdata/sf0.01/pages.parquet"
    if not __import__("os").path.exists(source):
        pytest.skip("test tables are not there")
    cases = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '/{start}') THEN '{h}/{start}'" for h, _, start in (r.partition("/") for _, r in sorted(queries.URL_RULES, key=lambda r: -len(r[1]))))
    parsed = "SELECT page_id, coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path"
    want = duckdb.sql(f"SELECT page_id, host, path, CASE {cases} END AS rule FROM ({parsed} FROM '{source}')").fetchall()
    judged = queries.op7_urlfilter(spark, "/root/testdata/sf0.01").select("page_id", "host", "path", "rule").collect()
    assert sorted(map(tuple, judged), key=repr) == sorted(want, key=repr)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(9)
    bodies = [None, "", "same é", "x" * 300_000] + [f"<p>{rng.random()}</p>" * rng.randrange(1, 40) for _ in range(40)]
    pages = [(i, rng.choice(["http://h/ä", None, "a\r\nb: c"]), rng.choice(bodies)) for i in range(300)] + [(None, "u", "same é"), (None, "u", "only null"), (5, "u", "same é"), (5, "u", "same é")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(6)
    manifest = warc.write_archives(frame, f"file://{tmp_path}/warc")
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in warc.read_archives(manifest).collect())
    first: dict = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = Counter()
    for i, _, html in pages:
        to = first.get(html or "")
        revisit = to is not None and i != to
        want[i, "revisit" if revisit else "response", to if revisit else None, digest(html), len((html or "").encode())] += 1
    assert got == want
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    assert warc.read_archives(warc.write_archives(frame.where("false"), f"file://{tmp_path}/none")).count() == 0


def test_archives_with_repeats_too_many_to_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 1)
    frame = spark.createDataFrame([(i, "u", None if i % 3 == 0 else f"body {i % 5}") for i in range(200)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(frame, f"file://{tmp_path}/warc", archives=3)).collect()}
    first = {b: min(i for i in range(200) if (None if i % 3 == 0 else i % 5) == b) for b in (None, 0, 1, 2, 3, 4)}
    want = {i: first[None if i % 3 == 0 else i % 5] for i in range(200)}
    assert got == {i: ("response", None) if i == f else ("revisit", f) for i, f in want.items()}


def test_the_dictionary_is_drawn_from_the_whole_table(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "u", f"<p>number {i}</p> same tail of every page", f"{i:04d}") for i in range(500)], "page_id long, url string, html string, digest string")
    monkeypatch.setattr(warc, "build_dictionary", lambda records: b"|".join(records))
    monkeypatch.setattr(warc, "SAMPLE_RECORDS", 60)
    drawn = {int(x) for x in re.findall(rb"number (\d+)", warc.sample_dictionary(rows.repartition(7)))}
    assert len(drawn) == 60 and min(drawn) < 60 and max(drawn) > 440
    assert drawn == {int(x) for x in re.findall(rb"number (\d+)", warc.sample_dictionary(rows))}
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 40)  # no record fits now: one of them
    assert len(re.findall(rb"number", warc.sample_dictionary(rows))) == 1
    assert warc.sample_dictionary(rows.where("false")) == b""


def test_archive_frames_stand_alone():
    sink = io.BytesIO()
    payloads = [f"<html>{i} common words in every page</html>".encode() * (i % 5) for i in range(400)]
    records = [warc.encode_record(i, "http://x", p, digest(p.decode()), None) for i, p in enumerate(payloads)]
    writer = warc.ArchiveWriter(sink, warc.build_dictionary(records))
    for record in records:
        writer.add(record)
    raw = sink.getvalue()
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and [p for _, p in warc.read_archive(io.BytesIO(raw), chunk=777)] == payloads
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-3])))


def test_clashing_columns_pass_through(spark):
    _, frame = some_docs(spark, 60)
    clash = frame.selectExpr("*", *(f"doc_id as {c}" for c in ("_h", "_size", "_piece", "pieces", "w", "node", "leaves", "passes", "cut", "units", "quota", "copies", "turn", "at", "_key", "place", "_lines", "_drop", "hs", "total")))
    for out in (sharding.shard(clash, shards=3), mixing.mix(clash, shards=3), linededup.site_line_dedup(clash.withColumnsRenamed({"source": "url", "text": "html"}))):
        extra = [c for c in clash.columns if c not in ("doc_id", "text", "lang", "source")]
        rows = out.collect()
        assert rows and all(r[c] == r.doc_id for r in rows for c in extra)
