"""Quality rules: divergence of a document's histograms from references of its language.

Two histograms are taken of every whole text: characters by class, and words by common word of the
document's language (all others in one bin). The references are the pooled histograms of all documents
of that language that pass the base rules and are long enough. A document is rejected where the
Jensen-Shannon distance (base 2, 0 to 1) of either histogram passes its threshold; documents too short
for a stable histogram are not judged by it.

All of it is Column expressions. Histograms and base counts are written once (about 40 numbers a
document); references are sums over them, and there are never more than ``len(COMMON) + 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, ascii_lower, let, persist, row_key, stable, with_small

# Frequent function words of the languages that have a reference of their own.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "this", "are"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au"),
}
#: Character classes but the last, "anything else".
CLASSES = (r"[\p{L}&&[^\p{Lu}]]", r"\p{Lu}", r"\p{Nd}", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()\-]")
SYMBOLS = "#*$%&|<>"
BASE_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20

#: Greatest distances, and the least characters and words for which they are applied. Prose of mixed
#: languages with some digits stays below both; symbol noise and word tables lie above.
MOST_CHAR, LEAST_CHARS = 0.28, 300
MOST_WORD, LEAST_WORDS = 0.32, 100
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BINS = len(COMMON["en"]) + 1


def _repeated(hashes: Column) -> Column:
    """Words in windows of five that occur twice or more, from the hashes of all windows in order."""

    def marked(found: Column) -> Column:
        # (hash, place) in order of hash: a window is repeated if a neighbour has its hash
        def covered(places: Column) -> Column:
            step = lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
            )
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        def is_repeated(x: Column, i: Column) -> Column:
            before = F.get(found, i - 1)["h"]
            after = F.get(found, i + 1)["h"]
            return (F.coalesce(before == x["h"], F.lit(False))) | (F.coalesce(after == x["h"], F.lit(False)))

        return let(F.sort_array(F.transform(F.filter(found, is_repeated), lambda x: x["i"])), covered)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, let(F.sort_array(pairs), marked)).otherwise(F.lit(0))


def _window_hashes(words: Column) -> Column:
    one = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        last = F.size(h) - WINDOW
        at = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(one, windows)


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON), lang).otherwise(F.lit("other"))


def _word_bins(words: Column, lang: Column) -> Column:
    """Counts by common word of the language, and last of all other words. No list for other languages."""
    lists = {k: F.array(*map(F.lit, v)) for k, v in COMMON.items()}
    listed = F.when(lang == "de", lists["de"]).when(lang == "en", lists["en"]).when(lang == "es", lists["es"])
    listed = listed.when(lang == "fr", lists["fr"]).otherwise(F.array().cast("array<string>"))

    def count(own: Column) -> Column:
        letter = lambda w: F.substring(F.lit(" " + _LETTERS), F.array_position(own, w) + 1, F.lit(1))
        coded = F.array_join(F.transform(words, letter), "")
        return let(
            coded,
            lambda s: F.array(
                *((F.length(s) - F.length(F.replace(s, F.lit(c)))).cast("bigint") for c in _LETTERS[: _BINS - 1]),
                (F.length(s) - F.length(F.replace(s, F.lit(" ")))).cast("bigint"),
            ),
        )

    return let(listed, count)


def measured(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Per row: the base counts and both histograms; nothing else of the text. One narrow pass."""
    text = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        _language(F.col(lang_col)).alias("lang"), row_key().alias("row"),
    )
    split = text.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    lower = F.filter(F.split(F.concat(F.lit(" "), ascii_lower(F.col("text"))), SPACES), lambda w: w != "")
    of_class = [F.length(F.regexp_replace("text", c, "")) for c in CLASSES]
    chars = let(F.length("text"), lambda n: F.array(*((n - c).cast("bigint") for c in of_class)))
    return split.select(
        "id", "row", "lang",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(_window_hashes(F.col("words")), _repeated).cast("bigint").alias("n_repeat_words"),
        F.length("text").cast("bigint").alias("n_chars"),
        chars.alias("chars"),
        _word_bins(lower, F.col("lang")).alias("common"),
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as counts; null if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    term = lambda a, m: F.when(a > 0, a * (F.log(a / m) / F.log(F.lit(2.0)))).otherwise(F.lit(0.0))

    def mean(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return (term(a, m) + term(b, m)) / 2

    def of(np: Column) -> Column:
        parts = F.zip_with(p, q, lambda a, b: mean(a / np["p"], b / np["q"]))
        return F.sqrt(F.greatest(F.lit(0.0), total(parts)))

    sums = F.struct(total(p).alias("p"), total(q).alias("q"))
    return let(sums, lambda s: F.when((s["p"] > 0) & (s["q"] > 0), of(s)))


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``df``: its id, the base counts, ``base_failed``, ``char_distance``,
    ``word_distance``, ``kept``, ``_row``.

    Null and blank texts have no words and fail the base rules. A null or unknown language is judged by
    the characters of all such documents. Null and repeated ids are rows like others; an empty table gives
    an empty result. Only the three named columns are read.
    """
    df = stable(df)
    rows = persist(measured(df, id_col, text_col, lang_col), "measured")
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    other = (F.col("n_chars") - F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, v: a + v)).cast("bigint")
    rows = rows.withColumn("chars", F.concat("chars", F.array(other)))
    good = rows.filter(~F.col("base_failed") & (F.col("n_chars") >= LEAST_CHARS) & (F.col("n_words") >= LEAST_WORDS))
    sums = lambda c, n: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n)))
    refs = good.groupBy("lang").agg(sums("chars", len(CLASSES) + 1).alias("ref_chars"), sums("common", _BINS).alias("ref_common"))
    refs = persist(refs, "references")  # a row for each key of COMMON, and "other"
    both = rows.join(F.broadcast(refs), "lang", "left")
    both = both.withColumn("char_distance", _distance(F.col("chars"), F.col("ref_chars")))
    both = both.withColumn("word_distance", F.when(F.col("lang") != "other", _distance(F.col("common"), F.col("ref_common"))))
    strange = (F.col("n_chars") >= LEAST_CHARS) & (F.coalesce("char_distance", F.lit(0.0)) > MOST_CHAR)
    strange |= (F.col("n_words") >= LEAST_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD)
    return both.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~strange).alias("kept"), "char_distance", "word_distance", F.col("row").alias("_row"),
    )


def filtered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    df = stable(df)
    gone = scored(df, id_col, text_col, lang_col).filter("not kept").select(F.col("_row").alias("_this_row"))
    rows = df.select(F.struct("*").alias("_all")).withColumn("_this_row", row_key())
    return with_small(rows, persist(gone, "gone"), "_this_row", "left_anti").select("_all.*")
