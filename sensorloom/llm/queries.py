"""The registered query of each training-data operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, persist, table, word_count, words_of
from .decontaminate import contamination
from .exact_dedup import exact_groups
from .html_extract import extract
from .line_dedup import dedup_runs
from .minhash import Near, near_groups
from .mixing import mix, targets
from .packing import pack
from .pii import find
from .quality import scored
from .runs import periodic_runs
from .token_output import token_output
from .vector_codes import vector_codes
from .warc import archive


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies", "_row")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of op2, which SQL can express; the words taken are random."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    return targets(persist(sizes, "sums")).select("source", "source_size", F.round("target", 6).alias("target"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents")).drop("_row")
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).drop("_row")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("_row")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), near=Near(words=3, percent=85)).drop("_row")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (F.col(f"_{c}").alias(c) for c in ("n_lines", "n_removed", "n_words"))
    return out.select("doc_id", *counts, "text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; the texts of about a tenth of the ids, by checksum, get a periodic tail."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.slice(words, F.lit(1), a.cast("int")), tail)).otherwise(F.lit(""))

    text = F.when(h % 10 == 0, let(words_of(F.col("text")), planted)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # runs come by start, then period, so the first of equal exponents stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, r: F.when(more(r, acc), r).otherwise(acc))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_mixing, op3_quality, op4_token_output, op5_pii, op6_warc, op7_packing, op8_exact_dedup, op9_minhash,
        op10_line_dedup, op11_vector_codes, op12_periodic_runs, op13_decontamination, mixing_targets,
    )
}
