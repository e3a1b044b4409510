"""Line deduplication by winnowing over line hashes.

A text is the sequence of its non-blank lines. A *window* is a shortest run of lines with ``least`` words
or more, once for each line it can start at and once for each line it can end at, so every run of that
many words is covered by the windows inside it.

1. *Winnow*: of each window the line with the smallest hash is its fingerprint. Two equal windows have the
   same fingerprint at the same place, so a run that repeats is guaranteed to share one.
2. *Join positions*: fingerprints that occur once are dropped; the positions of the others stay.
3. *Extend both ways*: a position is extended to the windows it is the fingerprint of, left and right.
   Windows are compared by content, and each with its first occurrence only, so a passage that a third of
   all documents share gives as many matches as it has occurrences. Matched windows overlap within a
   longer match, so their union is the whole common run.
4. *Delete*: the lines of every window whose content stands earlier, by document id and then by line. The
   first occurrence stays: where a later one overlaps it, in a text that repeats one line over and over, only
   the lines past the first go.

Lines are compared as written. Column expressions only; texts are read twice and moved once, and not at
all where few documents change.

A run that repeats inside longer lines, or with other line breaks, shares no whole line. :func:`dedup_runs`
winnows what is left once more with words for lines: the fingerprint of a window of ``least`` words is
``least`` / 4 neighbouring words, the leftmost that begin with an anchor (a word whose hash is 0 in a few bits), or
those with the smallest hash. The other steps are the same, but windows of one fingerprint are compared together first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import SPACE_CLASS, SPACES, WORD, let, row_key, stable, with_small

#: Least words of a run that is worth deleting.
LEAST = 50
_FEW = 500_000  # windows, of 8 bytes, that may be broadcast
_IDS = 2_000_000  # row ids that may be broadcast
_ANCHORS = 8  # one word in so many is a fingerprint of its own
_PRINTS = "array<struct<first:int,last:int,place:int,print:bigint>>"


def persist(df: DataFrame, tag: str) -> DataFrame:
    """Hashes and texts of the whole corpus are written in between: packed more tightly than others."""
    return common.persist(df, tag, compression="zstd")


def _with_lists(rows: DataFrame, lists: DataFrame, how: str, weight: Column, few: int = _FEW, most: int = _IDS) -> DataFrame:
    """``rows`` (texts) joined by ``_row`` with a table of few rows that was just written.

    It is broadcast up to ``few``, by the sum of ``weight``. Beyond, its row ids are, up to ``most``, so that only texts
    which have a partner are shuffled; beyond that all are.
    """
    n, size = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if size <= few:
        return rows.join(F.broadcast(lists), "_row", how)
    if n > most:
        return rows.join(lists, "_row", how)
    ids = F.broadcast(lists.select("_row"))
    met = rows.join(ids, "_row", "left_semi").join(lists, "_row")
    return met if how == "inner" else met.unionByName(rows.join(ids, "_row", "left_anti"), allowMissingColumns=True)


def _words(text: Column) -> Column:
    """The words of a text. Texts whose only white space is spaces and line ends, as most, are split without a pattern."""
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.array_remove(F.when(text.rlike(r"[\t\x0B\f\r]"), F.split(text, SPACES)).otherwise(plain), "")


def _part(x: Column, start: Column, n: Column) -> Column:
    """``n`` elements (1 or more) from place ``start``, counted from 0."""
    return F.slice(x, start + 1, n)


def _code(start: Column, lines: Column, offset: Column, least: int) -> Column:
    """A window as one number: arrays of numbers are told apart by hashing, arrays of structs pair by pair."""
    return ((start.cast("bigint") * (least + 1) + lines) * (least + 1) + offset).cast("bigint")


def _decoded(code: Column, least: int) -> tuple[Column, Column, Column]:
    """(start, lines, place of the least hash)."""
    start = F.floor(code / (least + 1) ** 2).cast("int")
    return start, (F.floor(code / (least + 1)) % (least + 1)).cast("int"), (start + code % (least + 1)).cast("int")


def _windows(words: Column, hashes: Column, least: int) -> Column:
    """Distinct windows as :func:`_code`. Every line has a word: none exceeds ``least`` lines."""
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))

    def reach(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            more = F.struct((acc["words"] + F.get(words, i)).alias("words"), (acc["lines"] + 1).alias("lines"))
            return F.when(acc["words"] >= least, acc).otherwise(more)

        return F.aggregate(places, none, step)

    def window(start: Column, lines: Column) -> Column:
        offset = let(_part(hashes, start, lines), lambda x: F.array_position(x, F.array_min(x)) - 1)
        return _code(start, lines, offset, least)

    def forward(i: Column) -> Column:
        places = F.sequence(i, F.least(i + (least - 1), F.size(words) - 1))
        return let(reach(places), lambda r: F.when(r["words"] >= least, window(i, r["lines"])))

    def backward(i: Column) -> Column:
        places = F.sequence(i, F.greatest(i - (least - 1), F.lit(0)))
        return let(reach(places), lambda r: F.when(r["words"] >= least, window(i - r["lines"] + 1, r["lines"])))

    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    both = F.concat(F.transform(places, forward), F.transform(places, backward))
    found = F.array_distinct(F.filter(both, lambda w: w.isNotNull()))
    return F.when(F.size(words) > 0, found).otherwise(F.array().cast("array<bigint>"))


def _flags(places: Column) -> Column:
    """1 at each of the ``places`` (distinct), 0 elsewhere, up to the last of them."""
    one = lambda sorted_: F.flatten(
        F.transform(sorted_, lambda p, i: F.concat(F.array_repeat(F.lit(0), p - F.coalesce(F.get(sorted_, i - 1), F.lit(-1)) - 1), F.array(F.lit(1))))
    )
    return let(F.sort_array(places), one)


def _later(df: DataFrame, least: int) -> DataFrame:
    """``(row, gone)``: runs of lines to delete, as (start, len) in non-blank lines."""
    lines = df.select("_id", "_row", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    hashed = lines.select(
        "_id", "_row",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(least), x)).alias("g"),
        F.transform("lines", lambda x: F.size(F.array_remove(F.split(x, SPACES), ""))).alias("words"),
    )
    hashed = hashed.withColumn("windows", _windows(F.col("words"), F.col("h"), least)).drop("words")
    # no filter here: pushed below, it would compute hashes and word counts anew for every window
    hashed = persist(hashed, "lines")

    places = F.array_distinct(F.transform("windows", lambda w: _decoded(w, least)[2]))
    prints = hashed.select("_row", F.inline(F.transform(places, lambda p: F.struct(p.alias("place"), F.get("h", p).alias("print")))))
    # written, so that the joins below stand alone in their stage and Spark can split hot keys
    shared = persist(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print"), "prints")
    met = prints.join(shared, "print").groupBy("_row").agg(F.collect_set("place").alias("places"))

    # extend each met position to its windows, and name these by their content
    def extended(flags: Column) -> Column:
        def named(w: Column) -> Column:
            start, n, _ = _decoded(w, least)
            return F.struct(start.alias("start"), n.alias("len"), F.xxhash64(_part(F.col("h"), start, n)).alias("c1"), F.xxhash64(_part(F.col("g"), start, n)).alias("c2"))

        return F.transform(F.filter("windows", lambda w: F.coalesce(F.get(flags, _decoded(w, least)[2]), F.lit(0)) == 1), named)

    found = hashed.join(met, "_row").select("_id", "_row", F.inline(let(_flags(F.col("places")), extended)))
    spot = F.struct(F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("start"))
    found = persist(found.select("_row", "start", "len", spot.alias("spot"), "c1", "c2"), "windows")
    first = found.groupBy("c1", "c2").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = found.join(persist(first.drop("n"), "first"), ["c1", "c2"]).filter("spot > first")
    # the first occurrence stays whole: a later one that overlaps it goes from where the first ends
    same = (F.col("_row") == F.col("first.row")) & (F.col("start") < F.col("first.start") + F.col("len"))
    begin = F.when(same, F.col("first.start") + F.col("len")).otherwise(F.col("start"))
    cut = F.struct(begin.alias("start"), (F.col("start") + F.col("len") - begin).alias("len"))
    return persist(later.groupBy("_row").agg(F.collect_set(cut).alias("gone")), "later")


def _cut_lines(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``_all`` (the other columns of ``df``), ``_text`` (without the runs), ``_row``, ``_lines``, ``_removed``."""
    df = stable(df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = _later(df.select(F.col(id_col).alias("_id"), text.alias("_text"), row_key().alias("_row")), least)
    others = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col))
    rows = df.select(others.alias("_all"), F.col(text_col).alias("_old"), text.alias("_text"), row_key().alias("_row"))
    both = _with_lists(rows, gone, "left", 1 + F.size("gone"))
    split = both.withColumn("_lines", F.split("_text", "\n")).withColumn(
        "_at", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.get("_lines", i).rlike(WORD))
    )
    cut = F.array_distinct(F.flatten(F.transform("gone", lambda w: _part(F.col("_at"), w["start"], w["len"]))))
    split = split.withColumn("_cut", F.when(F.col("gone").isNotNull(), cut))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_cut"))
    left = let(keep, lambda k: F.array_join(F.transform(k, lambda i: F.get("_lines", i)), "\n"))
    changed = F.when(F.col("_cut").isNull(), F.col("_old")).otherwise(left)
    removed = F.coalesce(F.size("_cut"), F.lit(0)).cast("bigint")
    return split.select("_all", changed.alias("_text"), "_row", F.size("_at").cast("bigint").alias("_lines"), removed.alias("_removed"))


def _with_counts(cut: DataFrame, columns: list[str], text_col: str, counts: dict[str, str]) -> DataFrame:
    """The columns in their order, and counts named with as many leading underscores as keep them apart."""
    lead = ""
    while {lead + name for name in counts} & set(columns):
        lead += "_"
    kept = [F.col("_text").alias(c) if c == text_col else F.col(f"_all.`{c}`") for c in columns]
    return cut.select(*kept, *(F.col(held).alias(lead + name) for name, held in counts.items()))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``df`` with later repeated runs deleted from ``text_col``, and ``n_lines``, ``n_removed``
    (non-blank lines) added as ``_n_lines``, ``_n_removed``, with more leading underscores while ``df`` has
    such a column itself.

    Blank lines stay. A null text stays null and has no lines. Null ids come first in the order; rows that
    repeat an id are ordered by their place in the input. Texts of fewer than ``least`` words never change.
    Other columns are kept as they are. An empty table gives an empty result.
    """
    cut = _cut_lines(df, id_col, text_col, least)
    return _with_counts(cut, df.columns, text_col, {"_n_lines": "_lines", "_n_removed": "_removed"})


def _offsets(n: int, held: int) -> list[int]:
    """Where joins of ``held`` elements start that together cover ``n``."""
    return [*range(0, n - held, held), n - held]


def _at(x: Column, i: Column, offsets: list[int], join: Callable[..., Column]) -> Column:
    parts = [F.get(x, i + by if by else i) for by in offsets]
    return join(*parts) if len(parts) > 1 else parts[0]


def _over(x: Column, n: int, join: Callable[..., Column]) -> Column:
    """At each place the join of ``n`` elements from there, in two passes; of no use where fewer than ``n`` are left."""
    half = math.isqrt(n - 1) + 1
    step = lambda offsets: lambda a: F.transform(a, lambda v, i: _at(a, i, offsets, join))
    for size, held in ((half, 1), (n, half)):
        if size > held:
            x = let(x, step(_offsets(size, held)))
    return x


def _gram_prints(words: Column, least: int) -> Column:
    """Fingerprints of all windows of ``words``: the least hash of grams, at its leftmost place (-1: it is not told)."""
    none = F.array().cast(_PRINTS)
    gram = max(least // 4, 1)

    def runs(x: Column) -> Column:
        # a fingerprint is a place, the leftmost of equal hashes: it changes with the least hash, or when it is left behind
        new = lambda i: (i == 0) | (F.get(x["least"], i) != F.get(x["least"], i - 1)) | (F.get(x["grams"], i - 1) == F.get(x["least"], i - 1))
        at = F.filter(F.sequence(F.lit(0), x["n"] - least), new)
        last = lambda a, j: F.coalesce(F.get(a, j + 1) - 1, x["n"] - least)
        return let(at, lambda a: F.transform(a, lambda i, j: F.struct(i.alias("first"), last(a, j).alias("last"), F.lit(-1).alias("place"), F.get(x["least"], i).alias("print"))))

    def prints(w: Column) -> Column:
        grams = _over(F.transform(w, lambda x: F.xxhash64(x)), gram, F.xxhash64)
        minima = lambda g: F.struct(F.size(w).alias("n"), g.alias("grams"), _over(g, least - gram + 1, F.least).alias("least"))
        return F.when(F.size(w) >= least, let(let(grams, minima), runs)).otherwise(none)

    return let(words, prints)


def _word_prints(words: Column, least: int) -> Column:
    """Fingerprints as ``array<struct<first, last, place, print>>``, with the windows (by first word) that have each.

    The hash that is minimised is 0 at one word in ``_ANCHORS``, so the leftmost such word of a window is its
    minimum and no minima need be taken; only stretches without such a word, of a window or more, take those of
    all their grams.
    """
    none = F.array().cast(_PRINTS)
    gram = max(least // 4, 1)
    reach = least - gram  # how far from a window's start a gram inside it can begin

    def all_prints(w: Column, at: Column) -> Column:
        n = F.size(w)
        before = lambda j: F.coalesce(F.get(at, j - 1), F.lit(-1)) + 1
        named = lambda p: F.xxhash64(*(F.get(w, p + k) for k in range(gram)))
        one = lambda p, j: F.struct(F.greatest(before(j), p - reach).alias("first"), F.least(p, n - least).alias("last"), p.alias("place"), named(p).alias("print"))
        held = F.filter(F.transform(at, one), lambda s: s["first"] <= s["last"])
        until = lambda j: F.coalesce(F.least(F.get(at, j) - reach - 1, n - least), n - least)
        gaps = F.transform(F.sequence(F.lit(0), F.size(at)), lambda _, j: F.struct(before(j).alias("first"), until(j).alias("last")))
        gaps = F.filter(gaps, lambda g: g["first"] <= g["last"])

        def inside(g: Column) -> Column:
            moved = lambda s: F.struct((s["first"] + g["first"]).alias("first"), (s["last"] + g["first"]).alias("last"), s["place"].alias("place"), s["print"].alias("print"))
            return F.transform(_gram_prints(_part(w, g["first"], g["last"] - g["first"] + least), least), moved)

        return F.concat(held, F.flatten(F.transform(gaps, inside)))

    def prints(w: Column) -> Column:
        anchors = F.filter(F.sequence(F.lit(0), F.size(w) - gram), lambda i: F.pmod(F.xxhash64(F.get(w, i)), F.lit(_ANCHORS)) == 0)
        return F.when(F.size(w) >= least, let(anchors, lambda at: all_prints(w, at))).otherwise(none)

    return let(words, prints)


def _content(words: Column, start: Column, n: Column, least: int) -> Column:
    """``n`` words from ``start`` as two independent hashes."""
    return let(_part(words, start, n), lambda x: F.struct(F.xxhash64(x).alias("c1"), F.xxhash64(F.lit(least), x).alias("c2")))


def _spans(words: Column, met: Column, least: int) -> Column:
    """Spans as ``array<struct<core, start, last, c>>``: the windows of a fingerprint, by how far before its place
    they start (in steps), with a hash of the words that all windows of that step hold (``core``) and of all words."""
    wide = max(least // 6, 1)
    struct = lambda core, first, last: F.struct(core.alias("core"), first.alias("start"), last.alias("last"), _content(words, first, last - first + least, least).alias("c"))

    def step(s: Column, k: Column) -> Column:
        top = s["place"] - k * wide
        core = F.xxhash64(k, _part(words, top, F.lit(least - wide + 1)))
        return struct(core, F.greatest(s["first"], top - (wide - 1)), F.least(s["last"], top))

    steps = lambda s: F.sequence(F.floor((s["place"] - s["last"]) / wide).cast("int"), F.floor((s["place"] - s["first"]) / wide).cast("int"))
    each = lambda s: F.when(s["place"] < 0, F.array(struct(s["print"], s["first"], s["last"]))).otherwise(F.transform(steps(s), lambda k: step(s, k)))
    return F.flatten(F.transform(met, each))


def _later_words(rows: DataFrame, least: int) -> DataFrame:
    """``(row, gone)``: runs of words to delete, as (start, end), in order and apart. ``rows(_id, _row, _text)``.

    Windows of one fingerprint make *spans*, cut so that those of a span share most words, its core. Spans are
    compared whole first: where an equal span stands in an earlier row, all its windows do. Single windows are
    compared only for the first row of each content, and there only where its core has other contents too, or the
    row repeats it: the first occurrence of any window lies in such a span, as those of one span differ from each other.
    """
    rows = rows.filter(F.length("_text") >= 2 * least - 1)
    prints = persist(rows.select("_row", F.inline(_word_prints(_words(F.col("_text")), least))), "word-prints")
    shared = persist(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print"), "prints")
    met = with_small(prints, shared, "print", most=_FEW).groupBy("_row").agg(F.collect_list(F.struct("first", "last", "place", "print")).alias("met"))

    close = _with_lists(rows, persist(met, "met"), "inner", F.size("met"))
    spans = close.select("_id", "_row", F.inline(let(_words(F.col("_text")), lambda w: _spans(w, F.col("met"), least))))
    spans = persist(spans.select("_id", "_row", "start", "last", "core", "c.c1", "c.c2"), "word-spans")

    key = ["core", "c1", "c2"]
    by_row = spans.groupBy(*key, "_id", "_row").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("own"))
    contents = by_row.groupBy(*key).agg(F.min(F.struct("_id", "_row", "own")).alias("first"), F.sum("own").alias("n"))
    contents = persist(contents.select(*key, F.col("first._row").alias("home"), F.col("first.own").alias("own"), "n"), "contents")
    mixed = contents.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("core", F.lit(True).alias("mixed"))
    told = contents.join(persist(mixed, "mixed"), "core", "left").filter("n > 1 or mixed")
    told = persist(told.select(*key, "home", (F.col("mixed").isNotNull() | (F.col("own") > 1)).alias("single")), "told")
    judged = persist(spans.join(told, key).filter("_row <> home or single"), "judged")
    whole = judged.filter("_row <> home").select("_row", "start", (F.col("last") + least).alias("end"))

    asked = judged.filter("_row = home").groupBy("_row").agg(F.collect_list(F.struct("start", "last")).alias("asked"))
    near = _with_lists(rows, persist(asked, "asked"), "inner", F.size("asked"))
    one = lambda w: lambda i: F.struct(i.alias("start"), _content(w, i, F.lit(least), least).alias("c"))
    windows = let(_words(F.col("_text")), lambda w: F.flatten(F.transform("asked", lambda s: F.transform(F.sequence(s["start"], s["last"]), one(w)))))
    found = persist(near.select("_id", "_row", F.inline(windows)).select("_id", "_row", "start", "c.c1", "c.c2"), "word-windows")
    spot = F.struct(F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("start"))
    first = found.groupBy("c1", "c2").agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = found.join(persist(first.drop("n"), "first"), ["c1", "c2"]).filter(spot > F.col("first"))
    # the first occurrence stays whole, as with lines
    same = (F.col("_row") == F.col("first.row")) & (F.col("start") < F.col("first.start") + least)
    begin = F.when(same, F.col("first.start") + least).otherwise(F.col("start"))
    later = later.select("_row", begin.alias("start"), (F.col("start") + least).alias("end")).unionByName(whole)
    # overlapping windows become one run
    w = Window.partitionBy("_row").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy("_row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return persist(runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone")), "later-words")


def dedup_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """:func:`dedup_lines`, then the same for runs of ``least`` words or more wherever their lines break.

    A deleted word goes with the white space after it; that before the first word stays. ``_n_words`` is added,
    the words deleted by the second step. Nulls, ties, repeated rows and clashing names are as in
    :func:`dedup_lines`.
    """
    cut = persist(_cut_lines(df, id_col, text_col, least), "cut-lines")
    gone = _later_words(cut.select(F.col(f"_all.`{id_col}`").alias("_id"), "_row", "_text"), least)
    both = _with_lists(cut, gone, "left", 1 + F.size("gone"))

    def left(words: Column) -> Column:
        bounds = F.sequence(F.lit(0), F.size("gone"))
        start = lambda j: F.coalesce(F.get("gone", j - 1)["end"], F.lit(0))
        end = lambda j: F.coalesce(F.get("gone", j)["start"], F.size(words))
        piece = lambda j: F.when(end(j) > start(j), F.array_join(_part(words, start(j), end(j) - start(j)), "")).otherwise("")
        return F.array_join(F.transform(bounds, piece), "")

    words = F.regexp_extract_all("_text", F.lit(f"{WORD}++{SPACE_CLASS}*+"), F.lit(0))
    rest = F.concat(F.regexp_extract("_text", f"^{SPACE_CLASS}*+", 0), let(words, left))
    n = F.aggregate(F.transform("gone", lambda r: (r["end"] - r["start"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    both = both.select("_all", F.when(F.col("gone").isNull(), F.col("_text")).otherwise(rest).alias("_text"), "_lines", "_removed", F.coalesce(n, F.lit(0)).alias("_words"))
    return _with_counts(both, df.columns, text_col, {"_n_lines": "_lines", "_n_removed": "_removed", "_n_words": "_words"})
