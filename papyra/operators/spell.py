"""Diacritic and spelling repair against a dictionary table (term, count).

Lookups are joins: on the base form without accents, and, for edit distances,
on the strings that up to two deletions leave, checked by levenshtein().
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as t

MOST_CANDIDATES, COMPOUND_CANDIDATES, EDITS, PREFIX = 10, 5, 2, 7
#: Labels after which a token is left alone.
LABELS = ["số:", "ngày:", "tháng:", "năm:", "điều:", "khoản:", "mục:", "phần:"]
RARE, RATIO = 2000, 10
#: How often an accented token may occur, and how near after a label a token is left alone.
MOST_TIMES, LABEL_CHARS = 3, 30
#: Characters of which deletions are made to find near terms; what is found does not hang on it.
KEY_LETTERS = 12
#: Base forms and known words with accents that are sent to every task at most.
MOST_BASES = 500_000
#: Texts that are plain Python strings at once.
TEXTS = 64
#: White space of any kind, as (?U)\\s in Java's patterns.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def once(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """Each ``key`` of ``rows`` once, with the aggregates ``more``.

    The key is an aggregate as well, so no condition on it moves below the grouping: all
    branches that use the result share the rows dealt for it, and their conditions are
    met by distinct keys, not by every row."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max(key).alias(key), *more).drop("_key")


def dictionary(terms: DataFrame) -> DataFrame:
    """(term, freq): lower-cased, equal terms added up."""
    return once(terms.where("term is not null").withColumn("term", F.lower("term")), "term", F.sum("count").alias("freq"))


def base_forms(words: DataFrame) -> DataFrame:
    """(base, term, freq): terms with accents by their form without, đ also as d."""
    based = words.withColumn("base", t.strip_diacritics("term"))
    plain = based.where("base != term")
    alias = based.where(F.contains("base", F.lit("đ"))).withColumn("base", F.translate("base", "đ", "d"))
    return plain.unionByName(alias).select("base", "term", "freq")


def first_places(text: str, wanted: Callable[[str], object] | None = None) -> list[tuple[str, int]]:
    """The distinct words of a text, two characters or longer with a letter, and the first
    place of each in the text, be it inside a longer word; with ``wanted`` those it holds for.

    What holds a word is a word, and its first occurrence comes first, so a word is
    looked for among the distinct ones, not in the whole text."""
    words: dict[str, int] = {}
    for m in re.finditer(r"[^\W_]+", text):
        words.setdefault(m[0], m.start())
    row, starts = " ".join(words), []
    at = 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    places, out = list(words.values()), []
    for w in words:
        if (wanted is None or wanted(w)) and len(w) >= 2 and any(c.isalpha() for c in w):
            at = row.find(w)
            k = bisect_right(starts, at) - 1
            out.append((w, places[k] + at - starts[k]))
    return out


def tokens(texts: DataFrame) -> DataFrame:
    """(doc_id, token, position from 0) of each text's distinct words with a letter, two
    characters or longer, at their first place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                found = [first_places(x) for x in part.column("text").to_pylist()]
                ids = part.column("doc_id").take(pa.array([k for k, f in enumerate(found) for _ in f], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([w for f in found for w, _ in f], pa.string()), pa.array([at for f in found for _, at in f], pa.int32())], names=["doc_id", "token", "position"])

    return texts.where("text is not null").select("doc_id", "text").mapInArrow(find, f"doc_id {dict(texts.dtypes)['doc_id']}, token string, position int")


def _with_text(rows: DataFrame, texts: DataFrame, needs: list[str], find: Callable[..., list], kind: str, out: str) -> DataFrame:
    """``rows`` (doc_id, ...) with ``out``, of type ``kind``, that ``find`` gives a document's
    rows from its text and the lists of what it ``needs`` of them.

    A text meets all its rows at once, and is sent once."""

    def each(text: pd.Series, *lists: pd.Series) -> pd.Series:
        return pd.Series([find(*row) for row in zip(text, *lists)], dtype=object)

    names = [c for c in rows.columns if c != "doc_id"]
    docs = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("_rows")).join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id", "left")
    found = F.pandas_udf(each, f"array<{kind}>")("_text", *(F.col(f"_rows.{c}") for c in needs))  # type: ignore[call-overload]
    both = docs.withColumn("_found", found).select("doc_id", F.explode(F.arrays_zip("_rows", "_found")).alias("_z"))
    return both.select("doc_id", *(F.col(f"_z._rows.{c}").alias(c) for c in names), F.col("_z._found").alias(out))


def _best_bases(words: DataFrame) -> DataFrame:
    return base_forms(words).groupBy("base").agg(F.max_by("term", F.struct("freq", "term")).alias("top"), F.max("freq").alias("top_freq"), F.count("*").alias("n_terms"))


def _with_reasons(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (token, ...) that are suspicious, with base_form and reasons.

    Both joins are on plain keys: the token itself and its base form, of which
    only the most frequent term and the number of terms are needed."""
    names = rows.columns
    rows = rows.where(~t.is_proper_noun("token")).withColumn("low", F.lower("token")).withColumn("base_form", t.strip_diacritics("token"))
    rows = rows.join(words.select(F.col("term").alias("low"), "freq"), "low", "left").join(_best_bases(words).withColumnRenamed("base", "base_form"), "base_form", "left")
    accents, known, has_base = t.has_accents("token"), F.col("freq").isNotNull(), F.col("n_terms").isNotNull()
    checks = [
        ("NOT_IN_DICT", accents & ~known), ("OCR_NOISE", F.col("token").rlike(r"[a-zA-Z].*\d|\d.*[a-zA-Z]")), ("SINGLE_LETTER_DIACRITIC", (F.length("token") == 2) & accents & ~known),
        ("MISSING_DIACRITICS", ~accents & ~known & has_base), ("WRONG_DIACRITIC", accents & ~known & has_base),
    ]
    found = F.filter(F.array(*(F.when(test, name) for name, test in checks)), lambda x: x.isNotNull())
    doubtful = known & has_base & (F.col("freq") < RARE) & (F.col("top_freq") >= RATIO * F.col("freq")) & (F.col("top") != F.col("low"))
    reasons = F.when((F.size(found) == 0) & doubtful, F.array(F.lit("LIKELY_WRONG"))).otherwise(found)
    return rows.withColumn("reasons", reasons).where("size(reasons) > 0").select(*names, "base_form", "reasons")


def flag_errors(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, token, position, base_form, reasons) of suspicious tokens."""
    return _with_reasons(tokens(texts), words)


def stays(low: str | None, token: str, at: int, accented: bool) -> bool:
    """Whether in_context() leaves the lower-cased ``token`` at ``at`` of its lower-cased text."""
    if low is None:
        return False
    recent = low[max(0, at - LABEL_CHARS) : at].rpartition("\n")[2]
    return not any(x in recent for x in LABELS) and not (accented and low.count(token) > MOST_TIMES)


def in_context(flagged: DataFrame, texts: DataFrame) -> DataFrame:
    """``flagged`` without accented tokens that occur more than three times and tokens
    within 30 characters after a label on their line."""

    def stay(low: str | None, lows: list[str], positions: list[int], accents: list[bool]) -> list[bool]:
        return [stays(low, *x) for x in zip(lows, positions, accents)]

    rows = flagged.withColumns({"_low": F.lower("token"), "_accents": t.has_accents("token")})
    judged = _with_text(rows, texts.select("doc_id", F.lower("text").alias("text")), ["_low", "position", "_accents"], stay, "boolean", "_stays")
    return judged.where("_stays").select(*flagged.columns)


def _words_of(text: str, bases: set[str] | None, clean: set[str]) -> list[str]:
    """The text's distinct tokens without those that no check can flag: ``clean`` ones, and
    plain letters that are no accented term's base (``bases``, null if they are too many)."""
    words = [w for w in dict.fromkeys(re.findall(r"[^\W_]+", text)) if len(w) >= 2]
    if bases is not None:
        words = [w for w in words if not (w.isascii() and w.isalpha()) or w.lower() in bases]
    return [w for w in words if w.lower() not in clean and any(map(str.isalpha, w))]


def flagged_in_context(texts: DataFrame, words: DataFrame) -> DataFrame:
    """candidates() of the in_context() tokens of flag_errors(), in one step.

    A token's verdict and candidates hang on the token alone, so they are found once for
    each distinct one; its places are sent once, and texts not at all.  Texts without
    a doc_id are kept."""
    # few terms have accents; beyond that number every token is sent
    best = _best_bases(words)
    sure = words.select(F.col("term").alias("token")).where(F.col("token").rlike(r"[^\x00-\x7f]"))
    doubted = _with_reasons(sure, words).select("token")
    told = best.select("base", F.lit(True).alias("is_base")).unionByName(sure.join(doubted, "token", "left_anti").select(F.col("token").alias("base"), F.lit(False).alias("is_base")))
    few = told.limit(MOST_BASES + 1).collect()
    bases: set[str] | None = {r.base for r in few if r.is_base}
    clean = {r.base for r in few if not r.is_base}
    if len(few) > MOST_BASES:
        bases = None
    kind, accents = dict(texts.dtypes)["doc_id"], re.compile(f"[{t.LOWER.removeprefix('a-z')}]")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[str] = set()
            for i in range(0, batch.num_rows, TEXTS):
                for text in batch.slice(i, TEXTS).column("text").to_pylist():
                    found.update(_words_of(text, bases, clean))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["token"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part, out = batch.slice(i, TEXTS), []
                for k, (text, low) in enumerate(zip(part.column("text").to_pylist(), part.column("low").to_pylist())):
                    for w in _words_of(text, bases, clean):
                        at, token = text.find(w), w.lower()
                        if stays(low, token, at, not token.isascii() and accents.search(token) is not None):
                            out.append((k, w, at))
                if out:
                    of, names, at = zip(*out)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of, pa.int32())), pa.array(names, pa.string()), pa.array(at, pa.int32())], names=["doc_id", "token", "position"])

    known = texts.where("text is not null")
    vocabulary = once(known.select("text").mapInArrow(distinct, "token string"), "token")
    judged = candidates(_with_reasons(vocabulary, words), words)
    found = known.select("doc_id", "text", F.lower("text").alias("low")).mapInArrow(places, f"doc_id {kind}, token string, position int")
    return found.join(judged, "token").select("doc_id", "token", "position", "base_form", "reasons", "candidates")


def deletions(word: Column, edits: int = EDITS, letters: int = PREFIX) -> Column:
    """The word's first ``letters`` characters and what up to ``edits`` deletions leave of them."""
    found = F.array(F.substring(word, 1, letters))
    for _ in range(edits):
        shorter = F.flatten(F.transform(found, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        found = F.array_distinct(F.concat(found, shorter))
    return found


def near_terms(asked: DataFrame, words: DataFrame, edits: int = EDITS) -> DataFrame:
    """(token, term, distance, freq): the dictionary's terms at the smallest distance, ``edits`` at most.

    Who has a term at distance one is not asked for those at two.  Terms meet tokens by
    what deletions leave of KEY_LETTERS characters: keys as short as PREFIX hold ever
    more terms as the dictionary grows, most of them far from the token."""
    left = asked.select("token", F.lower("token").alias("low")).distinct()
    found = None
    for e in range(min(1, edits), edits + 1):
        keys = left.withColumn("key", F.explode(deletions(F.col("low"), e, KEY_LETTERS)))
        index = words.select("term", "freq", F.explode(deletions(F.col("term"), e, KEY_LETTERS)).alias("key"))
        alike = keys.join(index, "key").where(F.abs(F.length("low") - F.length("term")) <= e)
        near = alike.withColumn("distance", F.levenshtein("low", "term", e)).where("distance >= 0").select("token", "term", "distance", "freq").distinct()
        least = F.min("distance").over(Window.partitionBy("token"))
        near = near.withColumn("_least", least).where("distance = _least").drop("_least")
        found = near if found is None else found.unionByName(near)
        left = left.join(near.select("token").distinct(), "token", "left_anti")
    return found


def candidates(flagged: DataFrame, words: DataFrame) -> DataFrame:
    """``flagged`` with ``candidates``, most frequent first: terms of the same base form
    where accents are in doubt, else the nearest by edit distance."""
    rows = flagged.withColumn("_by_base", F.arrays_overlap("reasons", F.array(*(F.lit(x) for x in ("MISSING_DIACRITICS", "WRONG_DIACRITIC", "LIKELY_WRONG", "SINGLE_LETTER_DIACRITIC")))))

    def listed(term: str, order: list[Column]) -> Column:
        ranked = F.slice(F.array_sort(F.collect_list(F.struct(*order, F.col(term).alias("x")))), 1, MOST_CANDIDATES)
        return F.transform(ranked, lambda r: r["x"])

    bases = rows.where("_by_base").select("token", "base_form").distinct().join(base_forms(words).withColumnRenamed("base", "base_form"), "base_form").where(F.col("term") != F.lower("token"))
    by_base = bases.groupBy("token").agg(listed("term", [(-F.col("freq")).alias("f")]).alias("_a"))
    rest = rows.select("token", "_by_base").distinct().join(by_base, "token", "left").where("not _by_base or _a is null")
    by_edit = near_terms(rest, words).where(F.col("term") != F.col("token")).groupBy("token").agg(listed("term", [F.col("distance").alias("d"), (-F.col("freq")).alias("f")]).alias("_b"))
    out = rows.join(by_base, "token", "left").join(by_edit, "token", "left")
    own = F.when(F.col("_by_base"), F.coalesce("_a", "_b")).otherwise(F.col("_b"))
    return out.withColumn("candidates", F.coalesce(own, F.array().cast("array<string>"))).drop("_by_base", "_a", "_b")


def compounds(flagged: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, token, compound_with, compound_candidates): flagged tokens that form a
    known two-word term with the next flagged one beside them."""
    w = Window.partitionBy("doc_id").orderBy("position")
    pairs = flagged.select("doc_id", "token", "position", "base_form", F.lead("token").over(w).alias("compound_with"), F.lead("position").over(w).alias("_at"), F.lead("base_form").over(w).alias("_base"))
    pairs = pairs.where(F.col("_at") - F.col("position") - F.length("token") <= 1).withColumn("base", F.concat_ws(" ", "base_form", "_base"))
    hits = pairs.join(base_forms(words), "base").where("term != base")
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), F.col("term").alias("x")))), 1, COMPOUND_CANDIDATES)
    return hits.groupBy("doc_id", "token", "position", "compound_with").agg(F.transform(ranked, lambda r: r["x"]).alias("compound_candidates"))


#: White space that may stand between the words of a compound.
COMPOUND_GAP = 2


_BEYOND = re.compile(f"[{SPACES}]+([^{SPACES}]+)")


def neighbours(text: str | None, starts: list[int], ends: list[int]) -> list[dict]:
    """For tokens from ``starts`` to ``ends`` the words between white space around them: the
    next one and its place if the token ends its word, the one before if it begins it."""
    text = text or ""
    n, back, out = len(text), text[::-1], []
    for start, end in zip(starts, ends):
        a = _BEYOND.match(text, end) if end < n else None
        b = _BEYOND.match(back, n - start) if 0 < start < n else None
        out.append({"after": a and a[1], "after_at": a and a.start(1), "before": b and b[1][::-1], "before_at": b and n - b.end(1)})
    return out


#: Hashes of base forms that are sent to every task at most.
MOST_HASHES = 2_000_000
_NEIGHBOURS = "_next string, _next_at int, _nth int, _after string, _after_at long, _before string, _before_at long"


def compound_fixes(flagged: DataFrame, texts: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, token, position, compound_with, start, end, compound_candidates): flagged
    tokens (doc_id, token, position, base_form) that form a known term of two words
    with a neighbour in their text (doc_id, text), flagged or not.

    The next flagged token comes first, if one blank at most lies between; it is then
    part of the compound and forms none of its own.  Else the next word does, else the
    one before, if it has letters only.  ``start`` and ``end`` bound both words, so
    that one fix replaces them.  Candidates are the terms of ``words`` (term, freq)
    with that base form, most frequent first, five at most.  Null texts have no
    tokens; no flagged tokens give no rows."""
    # of two at one place, one begins the other
    w = Window.partitionBy("doc_id").orderBy("position", "token")
    rows = flagged.select("doc_id", "token", "position", "base_form", (F.col("position") + F.length("token")).alias("_end"))
    rows = rows.withColumns({"_next": F.lead("token").over(w), "_next_at": F.lead("position").over(w), "_next_base": F.lead("base_form").over(w), "_nth": F.row_number().over(w)})
    rows = _with_text(rows, texts, ["position", "_end"], neighbours, "struct<after:string,after_at:long,before:string,before_at:long>", "_n")
    return _fixed(rows.select("*", *(F.col(f"_n.{c}").alias(f"_{c}") for c in ("after", "after_at", "before", "before_at"))).drop("_n"), words)


def compound_fixes_of(texts: DataFrame, pattern: str, words: DataFrame) -> DataFrame:
    """compound_fixes() of the tokens of ``texts`` that match ``pattern`` as a whole.

    Tokens and their neighbours are found where the text is, so neither is sent."""
    wanted, kind = re.compile(pattern), dict(texts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, token string, position int, {_NEIGHBOURS}"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part, out = batch.slice(i, TEXTS), []
                for k, text in enumerate(part.column("text").to_pylist()):
                    own = sorted(first_places(text, wanted.fullmatch), key=lambda x: (x[1], x[0]))
                    near = neighbours(text, [at for _, at in own], [at + len(w) for w, at in own]) if own else []
                    for n, ((w, at), (following, next_at), x) in enumerate(zip(own, [*own[1:], (None, None)], near), 1):
                        out.append((k, w, at, following, next_at, n, x["after"], x["after_at"], x["before"], x["before_at"]))
                if out:
                    of, *columns = zip(*out)
                    ids = part.column("doc_id").take(pa.array(of, pa.int32()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, list(kinds)[1:]))], schema=kinds)

    rows = texts.where("text is not null").select("doc_id", "text").mapInArrow(find, schema)
    rows = rows.withColumns({"_end": F.col("position") + F.length("token"), "base_form": t.strip_diacritics("token"), "_next_base": t.strip_diacritics("_next")})
    return _fixed(rows, words)


def _fixed(rows: DataFrame, words: DataFrame) -> DataFrame:
    """compound_fixes() of flagged tokens with the next one and their neighbours."""
    following, leading = F.col("_after"), F.col("_before")
    gap_after, gap_before = F.col("_after_at") - F.col("_end"), F.col("position") - F.col("_before_at") - F.length(leading)
    # one blank between: the token ends its word, and the next one begins behind it
    touching = (F.col("_next_at") == F.col("_end")) | ((F.col("_next_at") == F.col("_end") + 1) & (F.col("_after_at") == F.col("_next_at")))
    letters = rf"^[{t.LETTER}]+$"

    def option(kind: int, test: Column, other: Column, base: Column, start: Column, stop: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("kind"), other.alias("with"), base.alias("base"), start.alias("start"), stop.alias("end")))

    pair = lambda a, b: F.concat_ws(" ", a, b)
    options = F.array(
        option(1, touching, F.col("_next"), pair("base_form", "_next_base"), F.col("position"), F.col("_next_at") + F.length("_next")),
        option(2, following.rlike(letters) & (gap_after <= COMPOUND_GAP), following, pair("base_form", t.strip_diacritics(following)), F.col("position"), F.col("_end") + gap_after + F.length(following)),
        option(3, leading.rlike(letters) & (gap_before <= COMPOUND_GAP), leading, pair(t.strip_diacritics(leading), "base_form"), F.col("position") - gap_before - F.length(leading), F.col("_end")),
    )
    offered = rows.select("doc_id", "token", "position", "_nth", F.explode(options).alias("o")).where("o is not null").select("doc_id", "token", "position", "_nth", "o.*")
    # most are no term's base, and go before they are sent; beyond so many bases all are sent
    bases = base_forms(words).where("term != base")
    hashes = bases.select(F.xxhash64("base").alias("_hash")).distinct()
    if hashes.limit(MOST_HASHES + 1).count() <= MOST_HASHES:
        offered = offered.withColumn("_hash", F.xxhash64("base")).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    hits = offered.join(bases, "base")
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), F.col("term").alias("x")))), 1, COMPOUND_CANDIDATES)
    found = hits.groupBy("doc_id", "token", "position", "_nth", "kind", "with", "start", "end").agg(F.transform(ranked, lambda r: r["x"]).alias("compound_candidates"))
    by_kind = {k: F.max(F.when(F.col("kind") == k, F.struct("with", "start", "end", "compound_candidates"))).alias(f"_{k}") for k in (1, 2, 3)}
    tokens_ = found.groupBy("doc_id", "token", "position", "_nth").agg(*by_kind.values())
    # in a run of tokens that could each take the next one, every other one does; windows tell, so hits are found once
    links, order = F.col("_1").isNotNull(), Window.partitionBy("doc_id").orderBy("_nth")
    tokens_ = tokens_.withColumn("_run", F.when(links, F.col("_nth") - F.sum(links.cast("int")).over(order)))
    tokens_ = tokens_.withColumn("_takes", links & (F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("_nth")) % 2 == 1))
    taken = F.lag(F.when(F.col("_takes"), F.col("_nth") + 1)).over(order)
    free = tokens_.withColumn("_taken", taken).where("_taken is null or _taken != _nth")
    best = F.coalesce(F.when(F.col("_takes"), F.col("_1")), F.col("_2"), F.col("_3"))
    out = free.withColumn("_b", best).where("_b is not null")
    return out.select("doc_id", "token", "position", F.col("_b.with").alias("compound_with"), "_b.start", "_b.end", "_b.compound_candidates")


def apply_compounds(texts: DataFrame, compounds: DataFrame) -> DataFrame:
    """apply_fixes() of the compounds that have one candidate, each a single fix over both
    words; of those that overlap, the first."""
    one = compounds.where("size(compound_candidates) = 1").join(texts.select("doc_id", "text"), "doc_id")
    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    apart = one.withColumn("_before", before).where("_before is null or start >= _before")
    both = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return apply_fixes(texts, apart.select("doc_id", both.alias("token"), F.col("start").alias("position"), F.col("compound_candidates").alias("candidates")))


def apply_fixes(texts: DataFrame, fixes: DataFrame) -> DataFrame:
    """(doc_id, text, n_fixes): unambiguous fixes (doc_id, token, position, candidates of
    size one) put in at their positions, in the case of what they replace.

    The text is cut at the fixes' places and joined again, so positions never shift."""
    one = fixes.where("size(candidates) = 1").join(texts.select("doc_id", "text"), "doc_id")
    here = F.substring(F.col("text"), F.col("position") + 1, F.length("token")) == F.col("token")
    safe = F.size(t.fix_breaks(F.col("token"), F.col("candidates")[0])) == 0
    good = one.where(here & safe).select("doc_id", F.struct(F.col("position").alias("at"), F.length("token").alias("n"), t.match_case(F.col("token"), F.col("candidates")[0]).alias("to")).alias("f"))
    listed = good.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    rows = texts.select("doc_id", "text").join(listed, "doc_id", "left").withColumn("fs", F.coalesce("fs", F.expr("cast(array() as array<struct<at:int,n:int,to:string>>)")))
    # piece i: the text from the end of fix i - 1 to fix i, then the fix
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("fs", i - 1)["at"] + F.get("fs", i - 1)["n"])
    pieces = F.transform("fs", lambda f, i: F.concat(F.substring(F.col("text"), start(i) + 1, f["at"] - start(i)), f["to"]))
    tail = F.substring(F.col("text"), start(F.size("fs")) + 1, F.length("text"))
    return rows.select("doc_id", F.concat(F.array_join(pieces, ""), tail).alias("text"), F.size("fs").alias("n_fixes"))


def reviewed_fixes(flagged: DataFrame, answers: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, token, position, candidates of size one): what a model's ``answers``
    (doc_id, ord, word, chosen, action) allow to be fixed, for apply_fixes().

    ``flagged`` has doc_id, token, position, candidates.  A word has to be a flagged
    token, or to have the base form of one; proper nouns are left.  To pick, the
    choice has to be among the token's candidates; to suggest, it has to be in the
    dictionary ``words`` (term, freq), or to have the base form of a term, of
    which the most frequent is taken; anything else, or an empty choice, skips.
    Where a token stands several times, answers go to its places in order."""
    chosen, word = F.regexp_replace(t.strip("chosen"), r"^\[|\]$", ""), t.strip("word")
    asked = answers.select("doc_id", "ord", word.alias("word"), chosen.alias("chosen"), F.coalesce(F.lower(t.strip("action")), F.lit("pick")).alias("action"))
    asked = asked.where((F.col("action") != "skip") & (F.col("word") != "") & (F.col("chosen") != "")).where(~t.is_proper_noun("word"))
    places = flagged.select("doc_id", "token", "position", "candidates", F.lower("token").alias("low"), t.strip_diacritics("token").alias("base"))
    names = places.groupBy("doc_id", "low", "base").agg(F.flatten(F.collect_set("candidates")).alias("allowed"), F.min("position").alias("at"))
    asked = asked.withColumn("low_word", F.lower("word")).withColumn("base", t.strip_diacritics("word"))
    hits = asked.join(names, ["doc_id", "base"])
    best = hits.groupBy("doc_id", "ord").agg(F.min_by(F.struct("low", "allowed", "chosen", "action"), F.struct(F.col("low") != F.col("low_word"), "at")).alias("b")).select("doc_id", "ord", "b.*")
    # a suggestion: the term itself, or the most frequent one of its base form
    terms = words.select(F.lower("term").alias("term"), "freq").groupBy("term").agg(F.max("freq").alias("freq"))
    bases = terms.groupBy(t.strip_diacritics("term").alias("chosen_base")).agg(F.max_by("term", F.struct("freq", "term")).alias("common"))
    best = best.withColumn("chosen_low", F.lower("chosen")).withColumn("chosen_base", t.strip_diacritics("chosen"))
    best = best.join(terms.select(F.col("term").alias("chosen_low"), F.lit(True).alias("known")), "chosen_low", "left").join(bases, "chosen_base", "left")
    picked = F.when(F.exists("allowed", lambda c: F.lower(c) == F.col("chosen_low")), F.col("chosen"))
    fix = F.when(F.col("action") == "suggest", F.when(F.col("known"), F.col("chosen")).otherwise(F.col("common"))).otherwise(picked)
    fixes = best.withColumn("fix", fix).where("fix is not null").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "low").orderBy("ord")))
    numbered = places.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "low").orderBy("position")))
    return numbered.join(fixes.select("doc_id", "low", "k", "fix"), ["doc_id", "low", "k"]).select("doc_id", "token", "position", F.array("fix").alias("candidates"))


def needs_review(text: Column, bases: list[str] | None = None) -> Column:
    """Whether a segment has three or more ASCII words of three letters or longer."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])[a-zA-Z]{3,}(?![\p{L}\p{N}])"), F.lit(0))
    if bases is not None:
        words = F.filter(words, lambda w: F.lower(w).isin(bases))
    return F.size(words) >= 3


def fixes_summary(fixes: DataFrame) -> DataFrame:
    return fixes.agg(F.count("*").alias("flagged"), F.count_if(F.size("candidates") == 1).alias("corrected"), F.count_if(F.size("candidates") > 1).alias("ambiguous"))
