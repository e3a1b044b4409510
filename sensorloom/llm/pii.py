"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

The base patterns (e-mail, IP address, payment card, phone) give the seed entities. Then:

1. *Occurrences*: every token that could be an identifier (it has a digit or an ``@``, or spells an address
   out, ``name at host``). A lexical pattern is the word before it together with its exact shape; or the
   word before, the word after, or both, for all tokens that could be of a kind whatever their shape.
2. *Graph*: patterns and instances (token values) are the two sides, a narrow table of distinct edges.
3. *Rounds*: the confidence of a pattern for a kind is the mean score of its instances, less a margin that
   fades with support; the score of an instance is the noisy-or of its patterns. Seeds keep score 1. In a
   pattern of words alone, instances of other kinds speak against a kind, unknown ones by ``UNKNOWN`` each.
4. *Discovery*: occurrences outside base spans, in a pattern of high confidence, whose instance scores
   high, become spans of that kind.

Column expressions and joins only. Spark's regex functions give no positions, so spans are summed up from
the lengths of matches and of the texts between them, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD, let, persist, row_key, running, stable, with_small

KINDS = ("email", "ip", "card", "phone")
# The base patterns. The guards before them only spare searches that must fail: a match may start inside
# a run of its first class only where the match before it ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: A pattern needs this confidence, an instance this score, to extend what is marked; rounds of scoring.
CONFIDENT, ACCEPTED, ROUNDS = 0.9, 0.9, 3
#: What an instance of no known kind counts against a pattern of words: other formats are what these are to find.
UNKNOWN = 0.1
#: A token with a digit or an @, and groups of digits that follow it.
TOKEN = (
    rf"(?<!{WORD})(?=[^0-9@\x20\x09-\x0D]*+[0-9@]){WORD}++"
    rf"(?:\x20\(?[0-9][0-9().-]*+(?!{WORD}))*+"
)
_LEFT = "[\"'(\\[<{]"
_RIGHT = "[.,;:!?\"')\\]>}]"
#: An address spelled out, with a host of one label or more.
_AT, _DOT = (rf"(?:\x20(?i:{w})\x20|\x20?[\[(](?i:{w})[\])]\x20?)" for w in ("at", "dot"))
SPELLED = (
    rf"(?<![^\x20\x09-\x0D\"'(\[<{{]){_LOCAL}++{_AT}[A-Za-z][A-Za-z0-9-]*+(?:(?:\.|{_DOT})[A-Za-z0-9-]++)*+"
    rf"(?={_RIGHT}*+(?!{WORD}))"
)
#: One that says more than "name at host", which is mostly prose: that needs the words on both sides.
_PLAIN = rf"(?i)[\[(]at[\])]|\x20at\x20.*(?:\.|{_DOT})"
#: Tokens that could be of a kind, in whatever format, and the digits of the numbers among these.
LIKE = {
    "email": rf"^{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+$",
    "ip": r"^[0-9]++(?:\.[0-9]++){3}$|^(?=.*::|(?:[^:]*:){7})[0-9A-Fa-f:.]++$",
    "card": r"^[0-9](?:[\x20./-]*+[0-9])*+$",
    "phone": r"^\+?\(?[0-9](?:[\x20()./-]*+[0-9])*+$",
}
DIGITS = {"card": (12, 19), "phone": (7, 15)}


#: Characters looked at first for the word beside a token; a word that reaches further is read from the whole gap.
NEAR = 64


def _word_before(gap: Column) -> Column:
    """The whole word that ends a gap, blanks after it aside."""
    near, last = F.right(gap, F.lit(NEAR)), rf"(?<!{WORD})({WORD}++){SPACE_CLASS}*+$"
    further = (F.length(gap) > NEAR) & near.rlike(rf"^{WORD}*+{SPACE_CLASS}*+$")
    return F.when(further, F.regexp_extract(gap, last, 1)).otherwise(F.regexp_extract(near, last, 1))


def _word_after(gap: Column) -> Column:
    """The whole word after the punctuation and blanks that begin a gap."""
    near, first = F.left(gap, F.lit(NEAR)), rf"^{_RIGHT}*+{SPACE_CLASS}++({WORD}++)"
    further = (F.length(gap) > NEAR) & near.rlike(rf"^{_RIGHT}*+{SPACE_CLASS}*+{WORD}*+$")
    return F.when(further, F.regexp_extract(gap, first, 1)).otherwise(F.regexp_extract(near, first, 1))


def located(text: Column, pattern: str, words: bool = False) -> Column:
    """All matches in order as ``array<struct<start, end, value>>``; with ``words`` also the words ``before`` and ``after``."""

    def placed(x: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            end = F.get(x["ends"], i).cast("int")
            parts = [(end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")]
            if words:
                parts += [_word_before(F.get(x["gaps"], i)).alias("before"), _word_after(F.get(x["gaps"], i + 1)).alias("after")]
            return F.struct(*parts)

        return F.transform(x["found"], one)

    def measured(x: Column) -> Column:
        steps = F.transform(x["found"], lambda value, i: (F.length(value) + F.length(F.get(x["gaps"], i))).cast("bigint"))
        return let(F.struct(x["found"].alias("found"), x["gaps"].alias("gaps"), running(steps).alias("ends")), placed)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), measured)


def _luhn(digits: Column) -> Column:
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Valid base spans of a kind as (start, kind number, end); texts that cannot have any are passed by."""
    some = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": text.contains("+")}
    shaped = F.transform(
        F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")),
    )
    return F.when(some[kind], shaped).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def _like(kind: str, token: Column) -> Column:
    """Whether a token could be of a kind, by a class of shapes much coarser than its base pattern."""
    if kind not in DIGITS:
        return token.rlike(LIKE[kind])
    return token.rlike(LIKE[kind]) & F.length(F.regexp_replace(token, "[^0-9]", "")).between(*DIGITS[kind])


def _patterns() -> Column:
    """The patterns of an occurrence as ``array<struct<pattern, of>>``; of: the one kind it can extend, null for all."""
    shape = F.regexp_replace(F.regexp_replace("token", r"\p{L}+", "a"), "[0-9]", "9")
    one = lambda when, of, *parts: F.when(when, F.struct(F.concat_ws("\t", *parts).alias("pattern"), of.cast("int").alias("of")))
    before, after = F.col("left") != "", F.col("right") != ""
    out = [one(~F.col("spelled"), F.lit(None), F.lit("shape"), F.col("left"), shape)]
    for i, kind in enumerate(KINDS):
        like = F.when(F.col("spelled"), F.lit(kind == "email")).otherwise(_like(kind, F.col("token")))
        alone = like & (~F.col("spelled") | F.col("token").rlike(_PLAIN))
        out.append(one(alone & before, F.lit(i), F.lit(f"{kind} after"), F.col("left")))
        out.append(one(alone & after, F.lit(i), F.lit(f"{kind} before"), F.col("right")))
        out.append(one(like & before & after, F.lit(i), F.lit(f"{kind} between"), F.col("left"), F.col("right")))
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def _tokens(rows: DataFrame) -> DataFrame:
    """Tokens that could be identifiers: ``row, start, end, token, spelled, left, right``. ``rows(row, text)``."""
    some, spelled = F.col("text").rlike("[0-9@]"), F.col("text").rlike(rf"[A-Za-z0-9._%+-]{_AT}[A-Za-z]")
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    tokens = lambda when, pattern, flag: F.transform(
        F.when(when, located(F.col("text"), pattern, True)).otherwise(none), lambda t: F.struct(t.alias("t"), F.lit(flag).alias("spelled"))
    )
    both = F.concat(tokens(some, TOKEN, False), tokens(spelled, SPELLED, True))
    found = rows.filter(some | spelled).select("row", F.explode(both).alias("x")).select("row", "x.t", "x.spelled")
    # a bracket around the first group of a number is part of it
    lead = F.length(F.regexp_extract(F.col("t")["value"], rf"^(?!\([0-9]+\)[\x20-]?[0-9]){_LEFT}(?:(?!\([0-9]+\)[\x20-]?[0-9]){_LEFT})*", 0))
    tail = F.length(F.regexp_extract(F.col("t")["value"], rf"{_RIGHT}*$", 0))
    found = found.select(
        "row", "spelled", F.col("t")["before"].alias("before"), F.col("t")["after"].alias("after"), (F.col("t")["start"] + lead).alias("start"),
        (F.col("t")["end"] - tail).alias("end"),
        F.substring(F.col("t")["value"], lead + 1, F.greatest(F.length(F.col("t")["value"]) - lead - tail, F.lit(0))).alias("token"),
    ).filter("end > start")
    bare = lambda word: F.regexp_replace(F.lower(word), rf"^{_LEFT}+|{_RIGHT}+$", "")
    return found.select("row", "start", "end", "token", "spelled", bare(F.col("before")).alias("left"), bare(F.col("after")).alias("right"))


def _occurrences(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """The tokens with ``patterns`` and ``kind``, the first kind of which a base span overlaps them (null: none).

    A token meets a span of a kind if, of those that begin before its end, the furthest ends after its start:
    one pass over the tokens and spans of a text in order.
    """
    base = spans.select("row", F.inline("base"))
    mark = base.select("row", F.col("start").alias("at"), F.lit(0).alias("late"), F.col("kind").alias("of"), F.col("end").alias("until"), F.lit(None).cast(_token_type()).alias("t"))
    held = F.struct("start", "end", "token", "spelled", "left", "right").cast(_token_type())
    seen = tokens.select("row", (F.col("end") - 1).alias("at"), F.lit(1).alias("late"), F.lit(None).cast("int").alias("of"), F.lit(None).cast("int").alias("until"), held.alias("t"))
    w = Window.partitionBy("row").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    met = mark.unionByName(seen).select("row", "t", *(F.max(F.when(F.col("of") == k, F.col("until"))).over(w).alias(f"u{k}") for k in range(len(KINDS))))
    kind = F.coalesce(*(F.when(F.col(f"u{k}") > F.col("t")["start"], F.lit(k)) for k in range(len(KINDS))))
    found = met.filter("t is not null").select("row", "t.*", kind.alias("kind"))
    return found.select("row", "start", "end", "token", _patterns().alias("patterns"), "kind")


def _token_type() -> str:
    return "struct<start:int,end:int,token:string,spelled:boolean,left:string,right:string>"


def induced(occurrences: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``patterns(pattern, kind, confidence)`` and ``instances(token, kind, score)`` after all rounds."""
    edges = occurrences.select("token", "kind", F.inline("patterns"))
    edges = persist(edges.groupBy("pattern", "of", "token").agg(F.max("kind").alias("seed")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    seeds = edges.filter("seed is not null").groupBy("token").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0))
    seeds = persist(seeds, "seeds")
    scores, patterns = seeds, None
    for i in range(rounds):
        hits = edges.join(scores, "token").groupBy("pattern", "of")
        hits = hits.agg(F.sum("score").alias("all"), *(F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(f"s{k}") for k in range(len(KINDS))))
        kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("support")) for k in range(len(KINDS))))
        hits = hits.select("pattern", "of", "all", F.inline(kinds)).filter("support is not null and (of is null or of = kind)")
        against = F.when(F.col("of").isNull(), F.col("instances")).otherwise(F.col("all") + UNKNOWN * F.greatest(F.col("instances") - F.col("all"), F.lit(0)))
        patterns = hits.join(sizes, "pattern").select("pattern", "kind", (F.col("support") / (against + 1)).alias("confidence"))
        patterns = persist(patterns, f"patterns{i}")
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        found = edges.join(patterns.filter(F.col("confidence") >= CONFIDENT), "pattern").groupBy("token", "kind").agg((1 - doubt).alias("score"))
        scores = persist(found.join(seeds, "token", "left_anti").unionByName(seeds), f"instances{i}")
    return patterns, scores


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, counts and digest of the base spans, ``spans`` (all of them) and ``_row``.

    Null and empty texts have no spans. Null and repeated ids are rows like others. An empty table gives an
    empty result. Only the two named columns are read. Offsets count code points from 0, ends exclusive.
    """
    df = stable(df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), row_key().alias("row"), text.alias("text"))
    spans = rows.withColumns({k: _spans(F.col("text"), k) for k in KINDS})
    spans = spans.select("id", "row", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), F.concat(*KINDS).alias("base"))
    narrow = persist(spans, "base-spans")
    occurrences = persist(_occurrences(_tokens(rows.drop("id")), narrow.select("row", "base")), "occurrences")
    patterns, instances = induced(occurrences)
    sure = patterns.filter(F.col("confidence") >= CONFIDENT).select("pattern", F.col("kind").alias("found"))
    known = instances.filter(F.col("score") >= ACCEPTED).select("token", F.col("kind").alias("found"))
    new = occurrences.filter("kind is null").select("row", "start", "end", "token", F.inline("patterns")).join(sure, "pattern").join(known, ["token", "found"], "left_semi")
    # one kind for each place: the first, if several claim it
    new = new.groupBy("row", "start", "end").agg(F.min("found").alias("kind"))
    new = new.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    out = with_small(narrow, persist(new, "found"), "row", "left", weight=1 + F.size("new"))
    every = F.coalesce(F.concat("base", "new"), F.col("base"))
    return out.select(
        F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"), F.col("row").alias("_row"),
    )
