"""Identities of samples that have no key: JSON texts of what tells them apart, as Python prints them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import stable_hash
from .sampling import Shortage, ranked

# Fields of a window's and of an example's identity.
WINDOW = (
    "sample_id", "data_index", "epoch_id", "local_index", "start_index", "end_index", "window_start", "window_end", "window_start_sec", "window_end_sec",
)
EXAMPLE = ("sample_id", "data_index", "epoch_id", "local_index")


#: Control characters whose code has a letter: JSON by Python writes it in lower case.
_LETTERED = [0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)]


def _double(c: Column) -> Column:
    """A finite double by Python's rules: plain from 1e-4 to below 1e16, else with an exponent. Of some doubles with 16 digits
    or more, and of the least ones, the JVM prints a digit more than the shortest form has."""
    plain = F.rtrim(c.cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    raw = c.cast("string")
    digits, power = F.regexp_extract(raw, r"^(-?[0-9.]+?)(?:\.0)?E", 1), F.regexp_extract(raw, r"E(-?[0-9]+)$", 1).try_cast("int")
    size = F.abs(power).cast("string")
    far = F.concat(digits, F.when(power < 0, "e-").otherwise("e+"), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
    return F.when((c == 0) | ((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16)), plain).otherwise(far)


def _shown(c: Column, kind: str) -> Column:
    """A value as Python's JSON shows it; null stays null."""
    if kind in ("double", "float"):
        odd = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity")
        return F.when(c.isNotNull(), F.coalesce(odd, _double(c.cast("double"))))
    if kind in ("int", "bigint", "smallint", "tinyint", "boolean"):
        return c.cast("string")
    text = F.to_json(F.array(c.cast("string")))
    text = F.substring(text, F.lit(2), F.length(text) - 2)
    for code in _LETTERED:
        text = F.replace(text, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return F.when(c.isNotNull(), text)


def fingerprint(df: DataFrame, keys: tuple[str, ...] = WINDOW, text: str | None = None) -> Column:
    """``{"dataset": …, "label": …, "subject": …}``, as Python's JSON writes it, with the ``keys`` that ``df`` has and are not null, by name.

    ``text``: a column whose SHA-256 is a part as ``input_sha256``. A sample with none of the keys is told apart by
    the SHA-256 of its other columns, as ``signals_sha256``.
    """
    kinds = dict(df.dtypes)
    parts = {"dataset": F.col("dataset").cast("string") if "dataset" in kinds else F.lit(""), "subject": F.col("subject").cast("string"), "label": F.col("label").cast("bigint")}
    shown = {k: _shown(v, "bigint" if k == "label" else "string") for k, v in parts.items()}
    if text:
        shown["input_sha256"] = _shown(F.sha2(F.coalesce(text, F.lit("")), 256), "string")
    own = [k for k in keys if k in kinds]
    shown |= {k: _shown(F.col(k), kinds[k]) for k in own}
    if not text:
        rest = F.sha2(F.to_json(F.struct(*(c for c in df.columns if c not in own))), 256)
        some = F.lit(False)
        for k in own:
            some = some | F.col(k).isNotNull()
        shown["signals_sha256"] = F.when(~some, F.concat(F.lit('"'), rest, F.lit('"')))
    pairs = F.array_compact(F.array(*(F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(shown.items()))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def ranked_by_fingerprint(df: DataFrame, by: list[str], n: int, seed: int, tag: str, text: str | None = None) -> DataFrame:
    """The first ``n`` samples of each group by hash of (seed, tag, group, fingerprint); for samples without a key."""
    keyed = df.withColumn("_print", fingerprint(df, EXAMPLE if text else WINDOW, text))
    order = stable_hash(seed, tag, *(F.col(c) for c in by), F.col("_print"))
    return ranked(keyed, by, order, "_print").filter(F.col("rn") <= n).drop("rn", "_print")


def class_balanced(pool: DataFrame, label: str, labels: list[int], n: int, seed: int, text: str = "input_text") -> DataFrame:
    """Few-shot examples for all samples alike: ``n`` of each label by hash of the fingerprint, with ``place``, the order in
    which prompts show them. Too few of a label are an error. Samples need no key."""
    own = pool.filter(F.col(label).isin(labels))
    counts = {r[0]: r[1] for r in own.groupBy(label).count().collect()}
    short = [f"{v}: {counts.get(v, 0)}" for v in labels if counts.get(v, 0) < n]
    if short:
        raise Shortage(f"fewer than {n} examples for labels {', '.join(short)}")
    keyed = own.withColumn("_print", fingerprint(own, EXAMPLE, text))
    order = stable_hash(seed, "class-balanced", F.col(label), F.col("_print"))
    picked = ranked(keyed, [label], order, "_print").filter(F.col("rn") <= n).drop("rn")
    return picked.withColumn("place", F.struct(stable_hash(seed, "class-balanced-output", F.col("_print")), "_print")).drop("_print")


def leave_one_out(candidates: DataFrame, pool: DataFrame, subject: str, label: str, n: int, seed: int, text: str = "input_text") -> DataFrame:
    """Few-shot examples of each evaluated subject: of each of its ``candidates`` (of :func:`sampling.other_subjects`) and label
    the first ``n`` by hash of (evaluated subject, subject, label, fingerprint); ``rn`` from 1. Samples need no key.

    A candidate's samples are hashed once for each subject that has it, as the order depends on both. Samples
    with equal fingerprints, which tell the same, take places next to each other.
    """
    keyed = pool.select(subject, label, text, fingerprint(pool, EXAMPLE, text).alias("_print"))
    met = candidates.join(keyed, subject)
    order = stable_hash(seed, "few-shot-sample", F.col("eval_subject"), F.col(subject), F.col(label), F.col("_print"))
    return ranked(met, ["eval_subject", subject, label], order, "_print").filter(F.col("rn") <= n).drop("_print")
