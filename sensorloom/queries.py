"""The catalogue: every relational operator over the supplied tables, seen as sensor recordings.

``events`` is a motion log (subject = user, label = event type), ``embeddings`` one-channel windows, ``labels``
true and predicted classes, ``conversations`` a call log, ``customer`` subjects with labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import cleaning as C
from .operators import align, answers, metrics, sampling, segments
from .plans import prompts
from .ship import ensure

GAP, WINDOW, STRIDE = 20_000.0, 72_000.0, 36_000.0
DAY = 86_400.0
TYPES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 1e6D")


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject"), seconds().alias("t"), F.col("event_type").alias("activity"), "value")


def windows1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", A.clean(F.col("embedding")).alias("x"))


def r6(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, as in the SQL."""
    return df.select(*(F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with subject (nation) and label (account in credit)."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("subject"), (F.col("c_acctbal") > 4500).cast("int").alias("label"))


def q_label_distribution(spark, sf):
    return metrics.label_distribution(imu(spark, sf), "activity")


def q_subject_label_pivot(spark, sf):
    p = imu(spark, sf).groupBy("subject").pivot("activity", list(TYPES)).agg(F.count(F.lit(1)))
    return p.select("subject", *(F.coalesce(k, F.lit(0).cast("bigint")).alias(f"n_{k}") for k in TYPES))


def q_rollup_totals(spark, sf):
    return customers(spark, sf).rollup("subject", "label").agg(F.count(F.lit(1)).alias("n"))


def q_activity_normalise(spark, sf):
    raw = F.concat(F.lit(" "), F.upper("activity"), F.when(F.col("event_id") % 3 == 0, F.lit("_")).otherwise(F.lit("-")))
    named = F.when(F.col("activity") == "click", F.lit(" Stairs-Up ")).when(F.col("activity") == "view", F.lit("walking_downstairs")).when(F.col("activity") == "error", F.lit("NaN")).otherwise(raw)
    rows = imu(spark, sf).select("event_id", C.activity(named).alias("activity"))
    return rows.withColumn("label", C.lookup(C.STAIR_LABELS, F.col("activity")))


def q_numeric_coercion(spark, sf):
    raw = F.regexp_replace("props", '[{}"k: ]', "")
    cell = F.when(F.col("event_id") % 5 == 0, F.concat(raw, F.lit("x"))).when(F.col("event_id") % 11 == 0, F.lit("Infinity")).otherwise(raw)
    return read(spark, sf, "events").select("event_id", C.number(cell).alias("number"), C.finite(F.col("value")).alias("value"))


def q_time_unit_inference(spark, sf):
    rows = imu(spark, sf).select((F.col("t") * 1000).alias("ms"), (F.col("t") * 1e9).alias("ns"), (F.col("t") / 1000).alias("ks"))
    units = {c: C.seconds_divisor(rows, c) for c in ("ms", "ns", "ks")}
    return spark.range(1).select(*(F.lit(v).alias(f"divisor_{c}") for c, v in units.items()))


def q_rebase_clip(spark, sf):
    rows = imu(spark, sf).select("event_id", C.rebased(F.col("t"), "subject").alias("t_rel"), C.clipped(F.col("value"), 31.0, 40.0).alias("clipped"))
    return r6(rows)


def q_overnight_columns(spark, sf):
    """Two sets of overnight recordings whose columns differ in order, names and unit of time, read together."""
    from .shared import new_path
    from .sources import recordings

    e = imu(spark, sf).withColumn("recording", F.format_string("S%03d", F.col("subject") % 16))
    stage = F.when(F.col("activity") == "click", "W").when(F.col("activity") == "view", "N2").when(F.col("activity") == "error", "?").otherwise("REM")
    first = e.filter("subject % 2 = 0").select("recording", F.col("t").alias("TIMESTAMP"), F.col("value").alias("BVP"), (F.col("event_id") % 40).alias("TEMP"), stage.alias("Sleep_Stage"))
    other = e.filter("subject % 2 = 1").select("recording", stage.alias("Sleep - _Stage"), (F.col("event_id") % 40).alias("skin temp"), (F.col("t") * 1e9).alias("time"), F.col("value").alias("Blood Volume"))
    paths = []
    for part in (first, other):
        paths.append(new_path(spark, "overnight"))
        part.write.partitionBy("recording").option("header", True).csv(paths[-1])
    rows = recordings.read_overnight(spark, paths)
    out = rows.groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"), F.sum("bvp").alias("bvp"), F.sum("temp").alias("temp"), F.max("skin_temp").alias("skin_temp"))
    return out.select("subject", "label", "n", *(F.round(c, 3).alias(c) for c in ("t", "bvp", "temp", "skin_temp")))


def q_gap_segments(spark, sf):
    return segments.gap_segments(imu(spark, sf), ["subject"], "t", GAP).groupBy("subject", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


def q_session_window(spark, sf):
    ts = F.col("ts").cast("timestamp")
    e = read(spark, sf, "events").select("user_id", ts.alias("ts"), "value")
    out = e.groupBy("user_id", F.session_window("ts", f"{int(GAP)} seconds")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select("user_id", "n", "total")


def q_label_islands(spark, sf):
    rows = _indexed(spark, sf)
    return segments.label_islands(rows, ["subject"], "idx", "activity").select("subject", "activity", "start", "end", "rows")


def _indexed(spark, sf):
    return segments.numbered(imu(spark, sf), ["subject"], "t", "event_id", "idx", DAY)


def _halves(spark, sf):
    rows = _indexed(spark, sf).withColumn("half", F.when(F.col("idx") % 40 != 39, (F.col("idx") / 80).cast("bigint")))
    return segments.label_islands(rows, ["subject"], "idx", "half")


def q_centred_windows(spark, sf):
    out = segments.centred_windows(_halves(spark, sf), 5, 4)
    return out.select("subject", "start", "end", "window_no", "centre", "first", "last")


def q_window_count_closed_form(spark, sf):
    n = segments.centred_window_count(_halves(spark, sf), 5, 4)
    return _halves(spark, sf).groupBy("subject").agg(F.sum(n).cast("bigint").alias("windows"))


def q_downsample_bins(spark, sf):
    out = segments.downsampled_bins(imu(spark, sf), ["subject"], "t", 1 / 50_000, ["value"], ["activity"])
    return r6(out.select("subject", "bin", "value", "activity", "t"))


def _sliding(spark, sf):
    rows = segments.gap_segments(imu(spark, sf), ["subject"], "t", GAP * 5)
    return segments.anchored_windows(rows, ["subject", "segment_id"], "t", WINDOW, STRIDE)


def q_sliding_windows_stats(spark, sf):
    out = _sliding(spark, sf).groupBy("subject", "segment_id", "window_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.percentile("value", 0.25).alias("p25"), F.percentile("value", 0.75).alias("p75"),
    )
    return r6(out.filter("n >= 3"))


def q_sliding_bucket_count(spark, sf):
    return _sliding(spark, sf).groupBy("subject", "segment_id", "window_id").agg(F.count(F.lit(1)).alias("n"))


def q_tumbling(spark, sf):
    out = segments.anchored_windows(imu(spark, sf), ["subject"], "t", WINDOW, WINDOW, 1e-9)
    return out.groupBy("subject", "window_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def q_window_mode_label(spark, sf):
    rows = _sliding(spark, sf).withColumn("label", C.lookup(TYPES, F.col("activity")))
    return segments.mode_label(rows, ["subject", "segment_id", "window_id"], "label")


def q_window_rf_features(spark, sf):
    v, u = F.col("value"), F.sin("value")
    # Spark divides by a power of the squares' sum: of values this near to 0 it is 0 by underflow, an error
    near = F.when(F.abs(v) < 1e-30, 0.0).otherwise(v)
    out = _sliding(spark, sf).groupBy("subject", "segment_id", "window_id").agg(
        F.count(F.lit(1)).alias("n"), F.median("value").alias("median"), (F.max("value") - F.min("value")).alias("range"),
        (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"), F.sqrt(F.avg(v * v)).alias("rms"), F.sum(v * v).alias("energy"),
        F.skewness(near).alias("skew"), F.kurtosis(near).alias("kurtosis"), F.stddev_pop("value").alias("sd"), F.stddev_pop(u).alias("su"), F.covar_pop(v, u).alias("both"),
    ).filter("n >= 5")
    # corr() divides by 0 where all values are equal
    out = out.withColumn("corr", F.when(F.col("su") == 0, float("nan")).otherwise(F.try_divide("both", F.col("sd") * F.col("su"))))
    zero = (F.col("n") < 3) | (F.col("sd") < 1e-9)
    out = out.withColumns({c: F.when(zero, 0.0).otherwise(F.col(c)) for c in ("skew", "kurtosis", "corr")}).drop("sd", "su", "both")
    return r6(out)


def q_two_stream_range_left_join(spark, sf):
    e = imu(spark, sf)
    w = segments.anchored_windows(e.filter("activity = 'click'"), ["subject"], "t", WINDOW * 4, STRIDE * 4)
    w = w.select("subject", "window_id", "window_start", "window_end").distinct()
    out = segments.second_stream(w, e.filter("activity = 'view'"), ["subject"], "t", "value", WINDOW * 4, 2)
    return r6(out.select("subject", "window_id", "n", F.col("m").alias("mean")))


def q_ordinal_segment_join(spark, sf):
    e = imu(spark, sf)
    a = segments.gap_segments(e.filter("activity = 'click'"), ["subject"], "t", GAP * 8)
    other = F.when(F.col("subject") % 5 == 0, -1 - F.col("subject")).otherwise(F.col("subject"))  # groups that the left side lacks
    b = segments.gap_segments(e.filter("activity = 'view'").withColumn("subject", other), ["subject"], "t", GAP * 8)
    return segments.matched_segments(a, b, ["subject"], "segment_id")


def q_multi_rate_gather(spark, sf):
    rows = _indexed(spark, sf)
    centres = rows.filter("idx % 20 = 10").select("subject", F.col("idx").alias("centre"))
    parts = []
    for rate, half in ((1, 4), (2, 8), (4, 16)):
        w = centres.select("subject", "centre", (F.col("centre") * rate - half).alias("first"), (F.col("centre") * rate + half).alias("last"))
        sig = rows.select("subject", F.explode(F.sequence(F.lit(0), F.lit(rate - 1))).alias("k"), "idx", "value")
        sig = sig.select("subject", (F.col("idx") * rate + F.col("k")).alias("i"), "value")
        got = segments.gathered(w, sig, ["subject"], "i", "value", 32)
        parts.append(got.select("subject", "centre", F.lit(rate).alias("rate"), F.size("values").alias("n"), F.round(A.mean(F.col("values")), 6).alias("mean"), F.round(F.get("values", F.lit(0)), 6).alias("v0")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_view_alignment(spark, sf):
    d = read(spark, sf, "documents")
    base = d.select(F.lit("D").alias("dataset"), F.col("source").alias("subject"), (F.col("doc_id") % 2).alias("label"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("s"), F.col("doc_id"))).alias("sample_id"), F.col("doc_id").alias("position"), "lang")
    has = {"a": F.col("lang").isin("en", "es"), "b": F.coalesce(F.col("lang") != "es", F.lit(True))}
    text = lambda tag: base.filter(has[tag]).withColumn("input_text", F.concat(F.lit(tag), F.col("position")))
    out = align.with_views(base.drop("lang"), {"a": text("a").drop("lang"), "b": text("b").drop("lang")})
    return out.select("position", F.try_element_at("input_views", F.lit("a")).alias("view_a"), F.try_element_at("input_views", F.lit("b")).alias("view_b"), F.size("missing_views").cast("bigint").alias("missing"))


def q_train_test_anti(spark, sf):
    c = customers(spark, sf)
    train = c.filter("subject < 5").select("subject").distinct()
    return c.join(train, "subject", "left_anti").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


def q_train_test_intersect(spark, sf):
    s = read(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("subject"))
    return customers(spark, sf).filter("label = 1").select("subject").intersect(s)


def q_train_test_except(spark, sf):
    s = read(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("subject"))
    return customers(spark, sf).select("subject").distinct().exceptAll(s.distinct())


def q_union_shards(spark, sf):
    e = imu(spark, sf)
    shards = [e.filter(F.col("activity") == k).withColumn("shard", F.lit(v)) for k, v in TYPES.items()]
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("subjects"), F.round(F.sum("value"), 4).alias("total"))


def q_stable_topn_per_label(spark, sf):
    return sampling.top_per_group(read(spark, sf, "labels"), ["quality"], 20, 42, "balanced-per-label", "doc_id")


def q_subject_label_balanced(spark, sf):
    return sampling.subject_label_balanced(customers(spark, sf), "subject", "label", 3, 42, "sample_id")


def q_select_subjects_topk(spark, sf):
    return sampling.selected_subjects(customers(spark, sf), "subject", "label", [0, 1], 10, 9, 42)


def _loo(spark, sf):
    c = customers(spark, sf)
    pool = sampling.complete_subjects(c, "subject", "label", [0, 1], 2)
    return c, sampling.other_subjects(c.select("subject").distinct(), pool, "subject", 3, 42)


def q_loo_candidates(spark, sf):
    return _loo(spark, sf)[1]


def q_loo_examples(spark, sf):
    c, found = _loo(spark, sf)
    return sampling.examples(found, c, "subject", "label", "sample_id", 2, 42).drop("rn")


def q_per_subject_cap(spark, sf):
    out = sampling.per_subject_cap(read(spark, sf, "events"), "user_id", 5, 42, "event_id")
    return out.select("event_id", "user_id")


def q_balanced_limit(spark, sf):
    return sampling.balanced_limit(customers(spark, sf), "label", "subject", "sample_id", 100, 3, 60)


def q_natural_sort(spark, sf):
    s = read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("name"))
    return sampling.placed(s, [C.natural_key(F.col("name")), F.col("name")], "place")


def q_reproducibility_digest(spark, sf):
    return sampling.digest(read(spark, sf, "labels"), ["doc_id", "quality", "toxic"])


def q_array_zscore_stats(spark, sf):
    z = windows1(spark, sf).select("vec_id", "x", A.zscore(F.col("x")).alias("z"))
    out = z.select("vec_id", A.described(F.col("x")).alias("d"), A.mean(F.col("z")).alias("z_mean"), A.std(F.col("z")).alias("z_std"), F.array_max("z").alias("z_max"))
    return r6(out.select("vec_id", "d.*", "z_mean", "z_std", "z_max"))


def q_array_downsample(spark, sf):
    out = windows1(spark, sf).select("vec_id", A.downsampled(F.col("x"), 20).alias("y"))
    return out.select("vec_id", F.size("y").cast("bigint").alias("n"), F.round(A.total(F.col("y")), 5).alias("total"), F.round(F.get("y", F.lit(7)), 6).alias("y7"), F.round(F.get("y", F.lit(19)), 6).alias("y19"))


def q_vector_magnitude(spark, sf):
    part = lambda a: F.slice("x", a, 20)
    out = windows1(spark, sf).select("vec_id", A.magnitude(part(1), part(21), part(41)).alias("m"))
    return r6(out.select("vec_id", A.mean(F.col("m")).alias("mean"), F.array_max("m").alias("max"), A.std(F.col("m")).alias("std")))


def q_slope_corr_rmssd(spark, sf):
    x = F.col("x")
    return r6(windows1(spark, sf).select("vec_id", A.slope(x).alias("slope"), A.correlation_with_time(x).alias("corr"), A.rmssd(x).alias("rmssd"), A.absolute_integral(x, 4.0).alias("integral")))


def q_trend_segments(spark, sf):
    z = windows1(spark, sf).select("vec_id", A.zscore(F.col("x"), True).alias("z"))
    return z.select("vec_id", A.edge_trend(F.col("z")).alias("trend"), F.array_join(A.segment_trends(F.col("z")), ",").alias("segments"))


def q_fluctuation_peaks(spark, sf):
    z = windows1(spark, sf).select("vec_id", "x", A.zscore(F.col("x"), True).alias("z"))
    e = z.select("vec_id", A.fluctuation(F.col("z")).alias("fluctuation"), A.event_counts(F.col("z"), 1.5).alias("e"), A.peak_count(F.col("x")).alias("p"))
    return e.select("vec_id", "fluctuation", F.col("e.peaks").cast("bigint").alias("peaks"), F.col("e.changes").cast("bigint").alias("changes"), F.col("p").cast("bigint").alias("high_peaks"))


def q_movement_stillness(spark, sf):
    w = Window.partitionBy("subject").orderBy("t", "event_id")
    steps = imu(spark, sf).select("subject", F.abs(F.col("value") - F.lag("value").over(w)).alias("d"))
    limits = steps.groupBy("subject").agg((F.median("d") + F.stddev_pop("d")).alias("limit"))
    limits = limits.select("subject", F.when(F.col("limit") > 0, F.col("limit")).otherwise(F.lit(A.EPS)).alias("limit"))
    far = F.count_if(F.col("d") > F.col("limit"))
    still = F.when(F.count("d") > 0, 1 - far / F.count("d")).otherwise(F.lit(1.0))
    return r6(steps.join(limits, "subject").groupBy("subject").agg(far.alias("movements"), still.alias("stillness")))


def q_moving_average(spark, sf):
    out = windows1(spark, sf).select("vec_id", A.moving_average(F.col("x"), 5).alias("y"), A.centre_crop(F.col("x"), 10).alias("c"))
    return r6(out.select("vec_id", F.get("y", F.lit(0)).alias("y0"), F.get("y", F.lit(30)).alias("y30"), F.get("y", F.lit(63)).alias("y63"), A.total(F.col("c")).alias("crop_total")))


def q_periodicity(spark, sf):
    return windows1(spark, sf).select("vec_id", A.periodicity(A.zscore(F.col("x"), True)).alias("periodicity"))


def q_psd_peak(spark, sf):
    from .functions import dsp

    @F.pandas_udf("double")
    def peak(x):
        return x.map(lambda v: dsp.peak_frequency(v, 64.0))

    return windows1(spark, sf).select("vec_id", peak("x").alias("peak_hz"))


def q_render_features(spark, sf):
    from .plans import render

    rows = windows1(spark, sf).select("vec_id", A.described(F.col("x")).alias("stats"))
    return rows.select("vec_id", render.feature_line("acc", F.col("stats")).alias("line"))


def q_feature_text(spark, sf):
    from .plans import features

    part = lambda a: F.slice("x", a, 20)
    acc = F.struct(F.lit("acc").alias("name"), part(1).alias("x"), part(21).alias("y"), part(41).alias("z"))
    none = F.lit(None).cast("array<double>")
    other = lambda name, a: F.struct(F.lit(name).alias("name"), F.slice("x", a, 4).alias("x"), none.alias("y"), none.alias("z"))
    rows = windows1(spark, sf).select("vec_id", F.array(other("gyro_mag", 61), acc, other("light", 1)).cast(features.SIGNALS).alias("signals"))
    return features.with_feature_text(rows, "HHAR").select("vec_id", "input_text")


def q_question_files(spark, sf):
    """Question files of all vectors: half with nested signals of their own, half with an index into a data file."""
    from .shared import new_path
    from .sources import questions

    v = windows1(spark, sf)
    base = {"subject": F.lit("S1"), "index": F.col("vec_id"), "majority_label": F.col("label") % 2}
    part = lambda a, n: F.slice("x", a, n)
    rows = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.slice("x", 21 + 3 * i, 3))
    wrist = F.struct(rows.alias("ACC"))
    nested = F.struct(F.struct(F.struct(part(1, 20).alias("EDA")).alias("Chest"), wrist.alias("wrist"), F.struct(part(61, 4).alias("odd")).alias("features")).alias("signal"))
    with_own = F.struct(*(c.alias(k) for k, c in base.items()), nested.alias("data"))
    without = F.struct(*(c.alias(k) for k, c in base.items()), F.struct(F.concat(F.lit("of "), F.col("vec_id")).alias("Q"), F.lit("0").alias("A")).alias("qa_pair"))
    found = F.struct(F.col("vec_id").alias("index"), F.struct(part(1, 32).alias("bvp"), part(33, 32).alias("temp")).alias("signals"))
    even = F.col("vec_id") % 2 == 0
    items, data = (f"{new_path(spark, tag)}/{tag}.jsonl" for tag in ("items", "data"))
    v.select(F.when(even, F.to_json(with_own)).otherwise(F.to_json(without)).alias("value")).write.text(items)
    v.filter(~even).select(F.to_json(found)).write.text(data)
    out = questions.question_samples(spark, items, data)
    s = F.get("signals", F.lit(1))
    return out.select(
        F.col("data_index").alias("vec_id"), "label", F.array_join(F.transform("signals", lambda c: c["name"]), ",").alias("channels"),
        F.round(A.total(F.get("signals", F.lit(0))["x"]), 4).alias("first_total"), F.round(A.total(s["y"]), 4).alias("y_total"), "question",
    )


def q_channel_metadata(spark, sf):
    from .plans import channels

    names = ("Chest_EDA", "skin temp", "ACC-X", "wrist_foo_x", "gyro_y", "hr", "bvp filt", "nothing")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 8 + 1).cast("int"))
    rows = read(spark, sf, "supplier").select("s_suppkey", name.alias("name")).select("s_suppkey", "name", channels.described(channels.channel_key(F.col("name")), "DREAMT").alias("m"))
    return rows.select("s_suppkey", "name", F.col("m.channel").alias("channel"), F.col("m.sensor").alias("sensor"), F.col("m.place").alias("place"), F.col("m.rate").alias("rate"))


def q_fingerprint(spark, sf):
    from .operators import fingerprints

    c = customers(spark, sf).withColumns({"dataset": F.lit('a "b"'), "window_start_sec": F.col("sample_id") * 30.0, "epoch_id": F.when(F.col("label") == 1, F.col("sample_id"))})
    return c.select(F.col("sample_id").alias("id"), fingerprints.fingerprint(c).alias("fingerprint"))


def q_knowledge_text(spark, sf):
    from .plans import knowledge

    text = knowledge.knowledge_text(F.coalesce("text", F.lit("")), "HHAR", "More is known.")
    return read(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("sha256"))


def q_prompt_direct(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("text").alias("input_text"))
    text = prompts.direct("HHAR", [0, 1], "raw_data", F.col("input_text"))
    return d.select("doc_id", F.sha2(text, 256).alias("prompt_sha256"), F.length(text).cast("bigint").alias("chars"))


def q_prompt_few_shot(spark, sf):
    c, found = _loo(spark, sf)
    shots = sampling.examples(found, c, "subject", "label", "sample_id", 2, 42).withColumn("input_text", F.concat(F.lit("customer "), F.col("sample_id"), F.lit(" of nation "), F.col("subject")))
    blocks = prompts.example_blocks(shots, "eval_subject", ["subject_rank", "label", "rn"], "input_text", "label", "WESAD", 800)
    return blocks.select("eval_subject", F.sha2("examples", 256).alias("sha256"), F.col("example_count"))


def q_parse_json_label(spark, sf):
    e = read(spark, sf, "events")
    n = F.regexp_extract("props", r"(\d+)", 1)
    body = F.concat(F.lit('{"predicted_state": '), n, F.lit("}"))
    k = F.col("event_id") % 7
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Answer: "), body, F.lit(" ok")))
    text = text.when(k == 3, F.lit("  ")).when(k == 4, F.concat(F.lit("["), n, F.lit("]"))).when(k == 5, F.lit('{"state": 1}')).otherwise(F.concat(F.lit('{"predicted_state": "x'), n, F.lit('"}')))
    p = e.select("event_id", answers.parsed(text, [0, 1, 2, 3]).alias("p"))
    return p.select("event_id", F.col("p.label").alias("label"), F.col("p.valid").alias("valid"), F.col("p.parse_error").alias("parse_error"))


def q_majority_vote(spark, sf):
    e = read(spark, sf, "events").withColumn("vote", C.lookup(TYPES, F.col("event_type")))
    return metrics.majority(e, "user_id", "vote", [0, 1, 2, 4])


def q_confusion(spark, sf):
    return metrics.confusion(read(spark, sf, "labels"), "quality", "toxic", [0, 1])


def q_f1_valid_only(spark, sf):
    return r6(metrics.scores(read(spark, sf, "labels"), "quality", "toxic", [0, 1]))


def q_f1_invalid_as_wrong(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("truth"))
    j = d.join(read(spark, sf, "labels").select("doc_id", F.col("quality").alias("raw")), "doc_id", "left")
    return r6(metrics.scores(j.withColumn("pred", metrics.invalid_as_wrong(F.col("truth"), F.col("raw"), [0, 1])), "truth", "pred", [0, 1]))


def q_validity(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return r6(metrics.validity(d, F.col("quality").isNotNull()))


def _calls(spark, sf):
    c = read(spark, sf, "conversations")
    n = F.length("text").cast("bigint")
    tok = F.when(F.col("conv_id") % 5 != 0, F.ceil(n / 4).cast("bigint"))
    out = F.when(F.col("turn") % 2 == 1, n).otherwise(0)
    return c.select("conv_id", n.alias("prompt_chars"), out.alias("completion_chars"), (n + out).alias("total_chars"), tok.alias("prompt_tokens"), (tok % 50).alias("completion_tokens"), (tok + tok % 50).alias("total_tokens"), (n / 1000.0).alias("elapsed_time_sec"))


def q_usage_per_sample(spark, sf):
    return r6(metrics.folded_usage(_calls(spark, sf), "conv_id"))


def q_usage_summary(spark, sf):
    return r6(metrics.usage_summary(metrics.folded_usage(_calls(spark, sf), "conv_id")))


def q_cost_scaling(spark, sf):
    s = metrics.usage_summary(metrics.folded_usage(_calls(spark, sf), "conv_id"))
    s = metrics.with_scaling(metrics.with_cost(s, "total_prompt_tokens", "total_completion_tokens", 0.5, 1.5), 2220)
    return r6(s.select("estimated_input_cost", "estimated_output_cost", "estimated_total_cost", "estimated_total_tokens_for_full_experiment", "estimated_total_cost_for_full_experiment"))


def q_latency_percentiles(spark, sf):
    return r6(metrics.latency(read(spark, sf, "events"), ["event_type"], "value"))


def q_numeric_from_text(spark, sf):
    d = read(spark, sf, "documents").select("source", C.first_number(F.col("text")).alias("v"))
    return r6(d.groupBy("source").agg(F.count("v").alias("n"), F.avg("v").alias("avg"), F.max("v").alias("max")))


def q_revenue_by_nation(spark, sf):
    """A join and aggregate at volume: sample counts and sums per subject over the largest table."""
    li, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
