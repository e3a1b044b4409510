"""From recordings to texts: windows with their signals, each way to put them into words, subsets, and caches of all these.

Every step is one lazy plan from the rows of the step before; what is written is a cache of :mod:`sources.store`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import sampling
from ..shared import persist
from ..sources import discovery, recordings, store
from . import channels, experiment, features, knowledge, render

#: Metadata that samples keep through every step.
META = (
    "input_type", "input_canonical_type", "data_path", "qa_path", "data_index", "source", "local_index", "start_index", "end_index", "sample_id",
    "true_label", "original_label", "original_state", "activity_label", "original_activity_id", "window_start", "window_end", "window_start_sec",
    "window_end_sec", "epoch_id",
)
_KEYS = ["dataset", "subject", "label", "sample_id"]


def _signal(name: str, x: Column, y: Column | None = None, z: Column | None = None) -> Column:
    none = F.lit(None).cast("array<double>")
    return F.struct(F.lit(name).alias("name"), x.alias("x"), (none if y is None else y).alias("y"), (none if z is None else z).alias("z"))


def _present(*signals: Column) -> Column:
    return F.filter(F.array(*signals), lambda s: F.size(s["x"]) > 0).cast(features.SIGNALS)


ACCELEROMETER, GYROSCOPE = "Phones_accelerometer.csv", "Phones_gyroscope.csv"


def motion_samples(spark: SparkSession, root: str, subjects: list[str] | None = None, **settings) -> DataFrame:
    """Windows of a motion log below ``root`` (accelerometer, and gyroscope if there): signals acc, acc_mag, gyro, gyro_mag.

    Units of time are those of the whole log, whichever subjects are asked for.
    """
    own = lambda df: df.filter(F.col("user_id").isin(subjects)) if subjects else df
    acc = own(recordings.read_motion(spark, discovery.find_file(spark, root, ACCELEROMETER)))
    try:
        gyro = own(recordings.read_motion(spark, discovery.find_file(spark, root, GYROSCOPE)))
    except FileNotFoundError:
        gyro = None
    w = recordings.motion_windows(acc, gyro, **settings)
    parts = [_signal("acc", *(F.col(c) for c in "xyz")), _signal("acc_mag", A.magnitude(*(F.col(c) for c in "xyz")))]
    if gyro is not None:
        g = [F.col(f"g{c}") for c in "xyz"]
        parts += [_signal("gyro", *g), _signal("gyro_mag", A.magnitude(*g))]
    key = F.concat_ws("_", F.lit("HHAR"), *recordings.GROUP, "segment_id", "window_id")
    return w.select(
        F.lit("HHAR").alias("dataset"), F.col("user_id").alias("subject"), "label", key.alias("sample_id"), "activity_label",
        F.col("window_start").alias("window_start_sec"), F.col("window_end").alias("window_end_sec"), _present(*parts).alias("signals"),
    )


def sleep_samples(spark: SparkSession, root: str, rate: int = 64, subjects: list[str] | None = None, skip_artifacts: bool = False, **settings) -> DataFrame:
    """Epochs of overnight recordings below ``root``: filtered and clipped channels, acc where its axes are of one length."""
    chosen = discovery.select_files(spark, discovery.overnight_files(spark, root, rate), subjects)
    files = [f for found in chosen.values() for f in found]
    if not files:
        raise FileNotFoundError(f"no overnight recordings below {root}")
    w = recordings.overnight_windows(recordings.filtered(recordings.read_overnight(spark, files, rate), rate), rate, **settings)
    if skip_artifacts:
        w = w.filter(~F.col("artifact"))
    names = ("bvp", "bvp_filt", "ibi", "eda", "eda_lowpass", "hr", "skin_temp", "temp", "actigraphy")
    parts = [_signal(n, A.clean(F.col(n))) for n in names if n in w.columns]
    if {"acc_x", "acc_y", "acc_z"} <= set(w.columns):
        x, y, z = (A.clean(F.col(f"acc_{a}")) for a in "xyz")
        level = (F.size(x) == F.size(y)) & (F.size(y) == F.size(z))
        parts.append(_signal("acc", F.when(level, x), y, z))
    key = F.concat_ws("_", F.lit("DREAMT"), "subject", "window_id")
    return w.select(
        F.lit("DREAMT").alias("dataset"), "subject", "label", key.alias("sample_id"), F.col("window_id").alias("epoch_id"), F.col("label").alias("true_label"),
        F.col("window_start").alias("window_start_sec"), F.col("window_end").alias("window_end_sec"), "artifact", _present(*parts).alias("signals"),
    ).filter(F.size("signals") > 0)


def stress_samples(spark: SparkSession, root: str, subjects: list[str] | None = None, **settings) -> DataFrame:
    """Windows of stress recordings below ``root``. The unpickled long form is written once, by channel, and each channel
    reads its own."""
    signals, labels = recordings.read_stress(spark, root, subjects)
    w = recordings.stress_windows(persist(signals, "stress-signals", by=["channel"]), persist(labels, "stress-labels"), **settings)
    axis = lambda a: F.first(F.when(F.coalesce("axis", F.lit("x")) == a, F.col("values")), True).alias(a)
    by = w.groupBy("subject", "label", "centre", "channel").agg(*(axis(a) for a in "xyz"))
    signal = F.struct(F.col("channel").alias("name"), "x", "y", "z")
    out = by.groupBy("subject", "label", "centre").agg(F.array_sort(F.collect_list(signal)).alias("signals"))
    key = F.concat_ws("_", F.lit("WESAD"), "subject", "centre")
    return out.select(F.lit("WESAD").alias("dataset"), "subject", "label", key.alias("sample_id"), F.col("centre").alias("data_index"), F.col("signals").cast(features.SIGNALS))


SAMPLES = {"WESAD": stress_samples, "HHAR": motion_samples, "DREAMT": sleep_samples}


def _encoded(samples: DataFrame, dataset: str, strict: bool, out: str = "input_text") -> DataFrame:
    """``out``: the encoded time series, a block for each axis of each known channel; a strict call allows none without."""
    names = [c for c in samples.columns if c != out]
    rows = samples.withColumn("_channels", A.kept(channels.axes(F.col("signals"), dataset))).withColumn("_stats", render.supporting(F.col("_channels")))
    none = F.array().cast("array<string>")
    if strict:
        none = F.raise_error(F.concat(F.lit("no numeric channel in sample "), "sample_id")).cast("array<string>")
    blocks = F.when(F.size("_channels") > 0, F.zip_with("_channels", "_stats", render.encoded_channel)).otherwise(none)
    return rows.withColumn("_blocks", blocks).select(*names, render.encoded_text(F.col("_blocks")).alias(out))


def texts(samples: DataFrame, dataset: str, input_type: str, strict: bool = False, **extra) -> DataFrame:
    """``samples`` without their signals and with ``input_text`` and ``input_type``. ``extra``: settings of added knowledge."""
    kind = experiment.INPUTS.get(input_type.strip().lower().replace("-", "_"))
    if kind is None:
        raise ValueError(f"unknown input: {input_type!r}")
    if kind == "raw_data":
        out = samples.withColumn("input_text", render.raw_block(F.col("signals"), F.col("dataset")))
    elif kind == "encoded_time_series":
        out = _encoded(samples, dataset, strict)
    else:
        out = features.with_feature_text(samples, dataset)
        if kind == "extra_knowledge":
            out = out.withColumn("input_text", knowledge.knowledge_text(F.col("input_text"), dataset, **extra))
    return out.withColumn("input_type", F.lit(kind)).drop("signals")


def views(samples: DataFrame, dataset: str, input_types: list[str], **extra) -> DataFrame:
    """All ways to put a sample into words in one row, ``input_views map<string,string>``; each way once, in the order given.

    The ways are columns of the sample's own row, so no view is joined; texts with knowledge start from the same
    feature text as the plain one.
    """
    kinds = list(dict.fromkeys(experiment.INPUTS[k.strip().lower().replace("-", "_")] for k in input_types))
    out, names = samples, [c for c in samples.columns if c != "signals"]
    if {"feature_description", "extra_knowledge"} & {*kinds}:
        out = features.with_feature_text(out, dataset, out="_feature_description")
    if "extra_knowledge" in kinds:
        out = out.withColumn("_extra_knowledge", knowledge.knowledge_text(F.col("_feature_description"), dataset, **extra))
    if "raw_data" in kinds:
        out = out.withColumn("_raw_data", render.raw_block(F.col("signals"), F.lit(dataset)))
    if "encoded_time_series" in kinds:
        out = _encoded(out, dataset, False, "_encoded_time_series")
    pairs = [c for k in kinds for c in (F.lit(k), F.col(f"_{k}"))]
    return out.select(*names, F.create_map(*pairs).alias("input_views"))


def subjects_of(spark: SparkSession, dataset: str, root: str, rate: int = 64) -> list[str]:
    """The subjects that have recordings below ``root``."""
    if dataset == "WESAD":
        return discovery.stress_subjects(spark, root)
    if dataset == "DREAMT":
        return list(discovery.select_files(spark, discovery.overnight_files(spark, root, rate)))
    return [r[0] for r in discovery.motion_subjects(spark, discovery.find_file(spark, root, ACCELEROMETER)).collect()]


def from_raw(
    spark: SparkSession, dataset: str, root: str, out: str, input_types: list[str] = (), overwrite: bool = False, shards: bool = False, group: int = store.GROUP, **settings
) -> dict[str, store.Manifest]:
    """Recordings to a cache of windows, ``<out>/windows``, and from it one of texts for each way, ``<out>/<input>``.

    ``shards``: windows are built by subject, ``group`` at a time, and a build that stopped goes on (:func:`store.build`).
    """
    name = experiment.prompts.normal_dataset(dataset)
    manifest = store.Manifest(name, loader_kwargs=settings)
    if shards:
        asked = settings.get("subjects") or subjects_of(spark, name, root, settings.get("rate", 64))
        rest = {k: v for k, v in settings.items() if k != "subjects"}
        manifest.loader_kwargs = rest
        made = {"windows": store.build(spark, f"{out}/windows", manifest, asked, lambda part: SAMPLES[name](spark, root, subjects=part, **rest), overwrite, group)}
    else:
        made = {"windows": store.save(SAMPLES[name](spark, root, **settings), f"{out}/windows", manifest, overwrite)}
    for kind in input_types:
        made[kind] = from_caches(spark, [f"{out}/windows"], kind, f"{out}/{kind}", overwrite)
    return made


def union(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, store.Manifest]:
    """The samples of several caches as one, and the manifest of the first. Missing and different caches are errors."""
    missing = [r for r in roots if not spark._jvm.org.apache.hadoop.fs.Path(f"{r}/manifest").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{r}/manifest"))]
    if missing or not roots:
        raise FileNotFoundError(f"incomplete caches: {', '.join(missing[:5])}" if missing else "no cache was named")
    made = [store.load_manifest(spark, r) for r in roots]
    for m in made[1:]:
        store.validate(m, made[0].dataset, made[0].input_type, made[0].loader_settings())
    out = store.load(spark, roots[0])
    for r in roots[1:]:
        out = out.unionByName(store.load(spark, r), allowMissingColumns=True)
    return out, made[0]


def from_caches(spark: SparkSession, roots: list[str], input_type: str, out: str, overwrite: bool = False, **extra) -> store.Manifest:
    """Windows of one or more caches to a cache of texts."""
    samples, made = union(spark, roots)
    rows = texts(samples, made.dataset, input_type, **extra)
    keep = [c for c in rows.columns if c in (*_KEYS, "input_text", *META)]
    kind = rows.select("input_type").first()
    source = {"source_processed": {"roots": roots, "loader_kwargs": made.loader_settings()}}
    return store.save(rows.select(*keep), out, store.Manifest(made.dataset, kind[0] if kind else "", loader_kwargs=made.loader_settings(), source=source), overwrite)


def subset(samples: DataFrame, dataset: str, level: str, labels: list[int] | None = None, seed: int = 42) -> DataFrame:
    """The samples of a subset level: so many of each label, or of chosen subjects and their labels. Too few are an error."""
    spec = experiment.SUBSETS[level][dataset]
    labels = labels or experiment.DATASETS[dataset]["labels"]
    if "per_label" in spec:
        out = sampling.label_balanced(samples.filter(F.col("label").isin(labels)), "label", spec["per_label"], seed, "sample_id")
        sampling.assert_balanced(out, "label", labels, spec["per_label"])
        return out
    n, k = spec["per_subject_label"], spec["subjects"]
    chosen = sampling.selected_subjects(samples, "subject", "label", labels, n, k, seed)
    if chosen.count() < k:
        raise sampling.Shortage(f"fewer than {k} subjects with {n} samples of every label")
    own = samples.filter(F.col("label").isin(labels)).join(chosen.select("subject"), "subject", "left_semi")
    return sampling.subject_label_balanced(own, "subject", "label", n, seed, "sample_id")


def save_subset(spark: SparkSession, roots: list[str], level: str, out: str, seed: int = 42, overwrite: bool = False) -> store.Manifest:
    """A subset as a cache at ``<out>/<dataset>/<level>``, built twice: differing digests are an error; the digest is kept."""
    samples, made = union(spark, roots)
    digests = [sampling.digest(subset(samples, made.dataset, level, seed=seed), ["dataset", "subject", "label", "sample_id"]).first()[0] for _ in range(2)]
    if digests[0] != digests[1]:
        raise RuntimeError("two builds of the subset differ")
    spec = {"level": level, "seed": seed, **experiment.SUBSETS[level][made.dataset], "digest": digests[0]}
    source = {"source_processed": {"roots": roots, "loader_kwargs": made.loader_settings()}, "subset": spec}
    return store.save(subset(samples, made.dataset, level, seed=seed), f"{out}/{made.dataset.lower()}/{level}", store.Manifest(made.dataset, made.input_type, loader_kwargs=made.loader_settings(), source=source), overwrite)
