"""DuckDB SQL for the catalogue of :mod:`sensorloom.queries`, written from the definitions of the operators."""

from __future__ import annotations

_IMU = """imu AS (SELECT event_id, user_id AS subject, epoch_us(ts) / 1e6 AS t, event_type AS activity, value FROM events)"""
_CUST = """cust AS (SELECT c_custkey AS sample_id, c_nationkey AS subject, CAST(c_acctbal > 4500 AS INT) AS label FROM customer)"""
_IDX = _IMU + """, idx AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t, event_id) - 1 AS idx FROM imu)"""
_X = """w AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"""
_SEG = """steps AS (SELECT *, t - lag(t) OVER (PARTITION BY subject ORDER BY t) AS d FROM {src}),
segs AS (SELECT *, sum(CASE WHEN d > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment_id FROM steps)"""
_SLIDE = f"""WITH {_IMU}, {_SEG.format(src="imu", gap=100000)},
spans AS (SELECT subject, segment_id, min(t) AS t0, max(t) AS t1 FROM segs GROUP BY 1, 2),
slots AS (SELECT *, unnest(generate_series(0, CAST(floor((t1 - t0 - 72000) / 36000) AS BIGINT))) AS window_id FROM spans WHERE t1 - t0 >= 72000),
sl AS (SELECT s.subject, CAST(s.segment_id AS BIGINT) AS segment_id, s.window_id, e.t, e.value, e.activity FROM slots s JOIN segs e
  ON e.subject = s.subject AND e.segment_id = s.segment_id AND e.t >= t0 + window_id * 36000 AND e.t < t0 + window_id * 36000 + 72000)"""
_TYPE = "CASE activity WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"
_LOO = f"""WITH {_CUST}, pool AS (SELECT subject FROM cust GROUP BY 1 HAVING count(*) FILTER (label = 0) >= 2 AND count(*) FILTER (label = 1) >= 2),
cand AS (SELECT e.subject AS eval_subject, p.subject,
  row_number() OVER (PARTITION BY e.subject ORDER BY sha256(concat('42:few-shot-subject:', e.subject, ':', p.subject)), p.subject) AS subject_rank
  FROM (SELECT DISTINCT subject FROM cust) e JOIN pool p ON e.subject <> p.subject),
loo AS (SELECT eval_subject, subject, subject_rank FROM cand WHERE subject_rank <= 3),
picked AS (SELECT *, row_number() OVER (PARTITION BY subject, label ORDER BY sha256(concat('42:few-shot-sample:', subject, ':', label, ':', sample_id)), sample_id) AS rn FROM cust)"""
_CALLS = """calls AS (SELECT conv_id, length(text) AS prompt_chars, CASE WHEN turn % 2 = 1 THEN length(text) ELSE 0 END AS completion_chars,
  CASE WHEN conv_id % 5 <> 0 THEN CAST(ceil(length(text) / 4) AS BIGINT) END AS prompt_tokens, length(text) / 1000.0 AS elapsed FROM conversations),
calls2 AS (SELECT *, prompt_chars + completion_chars AS total_chars, prompt_tokens % 50 AS completion_tokens, prompt_tokens + prompt_tokens % 50 AS total_tokens FROM calls),
folded AS (SELECT conv_id, count(*) AS llm_call_count, sum(prompt_chars) AS prompt_chars, sum(completion_chars) AS completion_chars, sum(total_chars) AS total_chars,
  sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, sum(total_tokens) AS total_tokens, round(sum(elapsed), 6) AS elapsed_time_sec,
  count(total_tokens) AS llm_token_usage_available_count, count(*) - count(total_tokens) AS llm_token_usage_missing_count FROM calls2 GROUP BY 1)"""
_SUMMARY = """summary AS (SELECT CAST(sum(llm_call_count) AS BIGINT) AS total_llm_calls, CAST(sum(prompt_chars) AS BIGINT) AS total_prompt_chars, CAST(sum(completion_chars) AS BIGINT) AS total_completion_chars,
  CAST(sum(total_chars) AS BIGINT) AS total_chars, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  round(sum(elapsed_time_sec), 6) AS total_elapsed_time_sec, round(sum(prompt_chars) / count(*), 6) AS average_prompt_chars_per_sample, round(sum(completion_chars) / count(*), 6) AS average_completion_chars_per_sample,
  round(sum(total_chars) / count(*), 6) AS average_total_chars_per_sample, round(sum(prompt_tokens) / count(total_tokens), 6) AS average_prompt_tokens_per_sample,
  round(sum(completion_tokens) / count(total_tokens), 6) AS average_completion_tokens_per_sample, round(sum(total_tokens) / count(total_tokens), 6) AS average_total_tokens_per_sample,
  round(sum(elapsed_time_sec) / count(*), 6) AS average_elapsed_time_sec_per_sample, CAST(sum(llm_token_usage_available_count) AS BIGINT) AS token_usage_available_count,
  CAST(sum(llm_token_usage_missing_count) AS BIGINT) AS token_usage_missing_count, count(total_tokens) AS sample_token_usage_available_count, count(*) - count(total_tokens) AS sample_token_usage_missing_count FROM folded)"""


def _scores(rows: str) -> str:
    parts = []
    for v in (0, 1):
        parts.append(
            f"count(*) FILTER (t = {v} AND p = {v}) AS tp{v}, count(*) FILTER (p = {v}) AS pp{v}, count(*) FILTER (t = {v}) AS support_{v}"
        )
    f1 = [f"coalesce(2.0 * tp{v} / nullif(pp{v} + support_{v}, 0), 0)" for v in (0, 1)]
    per = ", ".join(
        f"round(coalesce(tp{v} / nullif(pp{v}, 0), 0), 6) AS precision_{v}, round(coalesce(tp{v} / nullif(support_{v}, 0), 0), 6) AS recall_{v}, round({f1[v]}, 6) AS f1_{v}, support_{v}"
        for v in (0, 1)
    )
    return f"""WITH r AS ({rows}), s AS (SELECT count(*) AS n, count(*) FILTER (t = p) AS hits, {', '.join(parts)} FROM r)
SELECT n, round(coalesce(hits / nullif(n, 0), 0), 6) AS accuracy, round(({f1[0]} + {f1[1]}) / 2, 6) AS macro_f1,
  round(coalesce(({f1[0]} * support_0 + {f1[1]} * support_1) / nullif(support_0 + support_1, 0), 0), 6) AS weighted_f1, {per} FROM s"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The texts that a direct prompt and a text with knowledge must be, with {} for the sample's.
_DIRECT = """You are given one time-series sample for classification.

Task:
Classify the state of this sample using the selected input representation: raw_data.

Labels:
- 0 = walking downstairs
- 1 = walking upstairs

Dataset-specific label rules:
- Label 0 is walking downstairs.
- Label 1 is walking upstairs.
- Use temporal acceleration and gyroscope patterns rather than a single large magnitude value.
- Do not treat downstairs as the default stair label; compare upstairs and downstairs motion evidence symmetrically.
- Choose label 0 when the temporal motion pattern is more consistent with downstairs than upstairs.

Decision calibration:
- Treat all allowed labels symmetrically; neither label 0 nor label 1 is a default or safer answer.
- Compare the strongest evidence for label 0 against the strongest evidence for label 1 before deciding.
- Do not predict either label from one isolated extreme value alone.
- Choose label 1 only when label 1 support clearly outweighs label 0 support in the provided input.
- Choose label 0 when label 0 support clearly outweighs label 1 support, or when apparent label 1 cues are isolated or better explained by artifacts, movement, noise, or subject variation.
- If evidence is mixed, choose the label with the stronger overall support in the provided input.
- For upstairs vs downstairs, focus on directional and temporal motion structure rather than a generic activity intensity.
- Predict label 1 only when the motion pattern better matches upstairs than downstairs; do not require unusually large magnitudes.

Important constraints:
- Use only the information provided in this prompt.
- Do not use knowledge outside the provided prompt.
- Apply the dataset-specific label rules exactly.
- Consider evidence for both labels before choosing the final label.
- Do not add extra explanation outside JSON.
- Process this sample independently.

{}

Output format:
Return STRICT JSON only.

{
  "predicted_state": 0 or 1
}"""
_KNOWN = """[Current Sample Feature Description]
{}

[Dataset Context]
This dataset contains wearable or smartphone motion time-series for human activity recognition.

[Dataset / Channel Knowledge]
- Accelerometer channels describe linear acceleration and motion intensity.
- Gyroscope channels describe rotational movement.
- Activity patterns should be inferred from temporal movement patterns, not from a single timestamp.
- Device placement, user differences, and orientation may affect signal magnitude.

[External Knowledge]
More is known.

[Decision Guidance]
- Use the current sample features as the primary evidence.
- Use the dataset knowledge only as supporting context.
- Interpret multiple channels jointly.
- Do not infer the label from one isolated feature.
- Predict only one label from the allowed label set provided by the main prompt.
- Motion intensity alone may not uniquely identify the activity.
- Interpret accelerometer and gyroscope information jointly.
- Prefer temporal pattern evidence over isolated values.
- Consider user and device variation when interpreting signal magnitude."""


def _direct() -> str:
    head, tail = map(_quoted, _DIRECT.split("{}"))
    text = f"concat({head}, text, {tail})"
    return f"SELECT doc_id, sha256({text}) AS prompt_sha256, length({text}) AS chars FROM documents"


def _known() -> str:
    head, tail = map(_quoted, _KNOWN.split("{}"))
    return f"SELECT doc_id, sha256(concat({head}, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), {tail})) AS sha256 FROM documents"


_STAT = "SELECT vec_id, x, len(x) AS n, list_avg(x) AS m, sqrt(list_avg(list_transform(x, lambda v: (v - list_avg(x)) * (v - list_avg(x))))) AS s FROM w"
_Z = f"z AS (SELECT vec_id, x, CASE WHEN s < 1e-8 THEN list_transform(x, lambda v: 0.0) ELSE list_transform(x, lambda v: (v - m) / s) END AS z FROM ({_STAT}))"


def _pstd(x: str) -> str:
    return f"sqrt(list_avg(list_transform({x}, lambda v: (v - list_avg({x})) * (v - list_avg({x})))))"


_DIFF = "list_transform(generate_series(2, len({x})), lambda i: {x}[i] - {x}[i - 1])"

def _feature_line(name: str, x: str) -> str:
    """``- name: mean=…`` of a list, as a string expression."""
    at = lambda q: f"(list_sort({x})[1 + CAST(floor({q} * (len({x}) - 1)) AS INT)] * (1 - ({q} * (len({x}) - 1) - floor({q} * (len({x}) - 1)))) + list_sort({x})[least(len({x}), 2 + CAST(floor({q} * (len({x}) - 1)) AS INT))] * ({q} * (len({x}) - 1) - floor({q} * (len({x}) - 1))))"
    values = {"mean": f"list_avg({x})", "std": _pstd(x), "min": f"list_min({x})", "max": f"list_max({x})", "p25": at(0.25), "p75": at(0.75)}
    shown = ", ', ', ".join(f"'{k}=', printf('%.3f', CAST({v} AS DOUBLE))" for k, v in values.items())
    step, far = f"({x}[len({x})] - {x}[1])", f"greatest({_pstd(x)} * 0.25, 1e-6)"
    trend = f"CASE WHEN {step} > {far} THEN 'increasing' WHEN {step} < -{far} THEN 'decreasing' ELSE 'relatively stable' END"
    return f"concat('- {name}: ', {shown}, ', trend=', {trend})"


ORACLES = {
    "q_label_distribution": f"WITH {_IMU} SELECT activity, count(*) AS n FROM imu GROUP BY 1",
    "q_subject_label_pivot": f"WITH {_IMU} SELECT subject, " + ", ".join(f"count(*) FILTER (activity = '{k}') AS n_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM imu GROUP BY 1",
    "q_rollup_totals": f"WITH {_CUST} SELECT subject, label, count(*) AS n FROM cust GROUP BY ROLLUP (subject, label)",
    "q_activity_normalise": f"""WITH {_IMU}, raw AS (SELECT event_id, CASE activity WHEN 'click' THEN ' Stairs-Up ' WHEN 'view' THEN 'walking_downstairs' WHEN 'error' THEN 'NaN'
  ELSE concat(' ', upper(activity), CASE WHEN event_id % 3 = 0 THEN '_' ELSE '-' END) END AS a FROM imu),
k AS (SELECT event_id, regexp_replace(lower(trim(a)), '[ _-]', '', 'g') AS a FROM raw),
m AS (SELECT event_id, CASE a WHEN 'nan' THEN NULL WHEN 'walkingdownstairs' THEN 'stairsdown' ELSE a END AS activity FROM k)
SELECT event_id, activity, CASE activity WHEN 'stairsup' THEN 1 WHEN 'stairsdown' THEN 0 END AS label FROM m""",
    "q_numeric_coercion": r"""WITH r AS (SELECT event_id, value, regexp_replace(props, '[{}"k: ]', '', 'g') AS raw FROM events),
c AS (SELECT event_id, value, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN concat(raw, 'x') WHEN event_id % 11 = 0 THEN 'Infinity' ELSE raw END AS DOUBLE) AS v FROM r)
SELECT event_id, CASE WHEN isfinite(v) THEN v END AS number, value FROM c""",
    "q_time_unit_inference": f"""WITH {_IMU}, u AS (SELECT unnest(['ms', 'ns', 'ks']) AS unit, unnest([t * 1000, t * 1e9, t / 1000]) AS v FROM imu),
d AS (SELECT unit, v - lag(v) OVER (PARTITION BY unit ORDER BY v) AS d FROM u), m AS (SELECT unit, median(d) AS m FROM d WHERE d > 0 GROUP BY 1),
f AS (SELECT unit, CASE WHEN m > 1e6 THEN 1e9 WHEN m > 1 THEN 1e3 ELSE 1.0 END AS f FROM m)
SELECT max(CASE WHEN unit = 'ms' THEN f END) AS divisor_ms, max(CASE WHEN unit = 'ns' THEN f END) AS divisor_ns, max(CASE WHEN unit = 'ks' THEN f END) AS divisor_ks FROM f""",
    "q_rebase_clip": f"WITH {_IMU} SELECT event_id, round(t - min(t) OVER (PARTITION BY subject), 6) AS t_rel, round(greatest(31.0, least(40.0, value)), 6) AS clipped FROM imu",
    "q_gap_segments": f"WITH {_IMU}, {_SEG.format(src='imu', gap=20000)} SELECT subject, CAST(segment_id AS BIGINT) AS segment_id, count(*) AS n, min(t) AS t_first, max(t) AS t_last FROM segs GROUP BY 1, 2",
    "q_session_window": f"WITH {_IMU}, {_SEG.format(src='imu', gap=20000)} SELECT subject AS user_id, count(*) AS n, round(sum(value), 6) AS total FROM segs GROUP BY subject, segment_id",
    "q_overnight_columns": f"""WITH {_IMU}, r AS (SELECT format('S{{:03d}}', subject % 16) AS subject, CASE activity WHEN 'click' THEN 0 WHEN 'error' THEN NULL ELSE 1 END AS label,
  CASE WHEN subject % 2 = 0 THEN t ELSE t * 1e9 END AS t, value, event_id % 40 AS temp FROM imu),
d AS (SELECT subject, t - lag(t) OVER (PARTITION BY subject ORDER BY t) AS d FROM r), u AS (SELECT subject, median(d) AS m FROM d WHERE d > 0 GROUP BY 1),
s AS (SELECT r.*, (t - min(t) OVER (PARTITION BY subject)) / CASE WHEN m > 1e6 THEN 1e9 WHEN m > 1 THEN 1e3 ELSE 1 END AS sec FROM r JOIN u USING (subject))
SELECT subject, label, count(*) AS n, round(max(sec), 3) AS t, round(sum(value), 3) AS bvp, CAST(sum(temp) AS DOUBLE) AS temp, CAST(max(greatest(31, least(40, temp))) AS DOUBLE) AS skin_temp FROM s GROUP BY 1, 2""",
    "q_label_islands": f"""WITH {_IDX}, g AS (SELECT *, idx - row_number() OVER (PARTITION BY subject, activity ORDER BY idx) AS g FROM idx)
SELECT subject, activity, min(idx) AS start, max(idx) + 1 AS "end", count(*) AS rows FROM g GROUP BY subject, activity, g""",
    "q_centred_windows": f"""WITH {_IDX}, runs AS (SELECT subject, idx // 80 AS half, idx // 40 AS part, min(idx) AS start, max(idx) + 1 AS "end" FROM idx WHERE idx % 40 <> 39 GROUP BY 1, 2, 3),
n AS (SELECT *, CAST(ceil(("end" - start - 10) / 4) AS BIGINT) AS n FROM runs), k AS (SELECT subject, start, "end", unnest(generate_series(0, n - 1)) AS window_no FROM n WHERE n > 0)
SELECT *, start + 5 + window_no * 4 AS centre, start + window_no * 4 AS first, start + 10 + window_no * 4 AS last FROM k""",
    "q_window_count_closed_form": f"""WITH {_IDX}, runs AS (SELECT subject, idx // 40 AS part, min(idx) AS a, max(idx) + 1 AS b FROM idx WHERE idx % 40 <> 39 GROUP BY 1, 2)
SELECT subject, CAST(sum(greatest(0, ceil((b - a - 10) / 4))) AS BIGINT) AS windows FROM runs GROUP BY 1""",
    "q_downsample_bins": f"""WITH {_IMU}, b AS (SELECT *, min(t) OVER (PARTITION BY subject) AS t0 FROM imu), c AS (SELECT *, CAST(floor((t - t0) * 0.00002) AS BIGINT) AS bin FROM b)
SELECT subject, bin, round(avg(value), 6) AS value, arg_min(activity, t) AS activity, round(min(t0) + bin / 0.00002, 6) AS t FROM c GROUP BY subject, bin""",
    "q_sliding_windows_stats": _SLIDE + """ SELECT subject, segment_id, window_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75 FROM sl GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    "q_sliding_bucket_count": _SLIDE + " SELECT subject, segment_id, window_id, count(*) AS n FROM sl GROUP BY 1, 2, 3",
    "q_tumbling": f"""WITH {_IMU}, s AS (SELECT subject, min(t) AS t0, max(t) AS t1 FROM imu GROUP BY 1),
k AS (SELECT *, unnest(generate_series(0, CAST(floor((t1 - t0 - 72000 + 1e-9) / 72000) AS BIGINT))) AS window_id FROM s WHERE t1 - t0 + 1e-9 >= 72000)
SELECT k.subject, window_id, count(*) AS n, round(avg(value), 6) AS mean FROM k JOIN imu e ON e.subject = k.subject AND e.t >= t0 + window_id * 72000 AND e.t < t0 + window_id * 72000 + 72000 GROUP BY 1, 2""",
    "q_window_mode_label": _SLIDE + f""", c AS (SELECT subject, segment_id, window_id, {_TYPE} AS l, count(*) AS n FROM sl GROUP BY 1, 2, 3, 4)
SELECT subject, segment_id, window_id, l AS label FROM c QUALIFY row_number() OVER (PARTITION BY subject, segment_id, window_id ORDER BY n DESC, l) = 1""",
    "q_window_rf_features": _SLIDE + """, g AS (SELECT subject, segment_id, window_id, count(*) AS n, median(value) AS median, max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
  sqrt(avg(value * value)) AS rms, sum(value * value) AS energy, stddev_pop(value) AS sd, avg(value) AS m, corr(value, sin(value)) AS corr, list(value) AS v FROM sl GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT subject, segment_id, window_id, n, round(median, 6) AS median, round(range, 6) AS range, round(iqr, 6) AS iqr, round(rms, 6) AS rms, round(energy, 6) AS energy,
  CASE WHEN sd < 1e-9 THEN 0 ELSE round(list_avg(list_transform(v, lambda a: pow((a - m) / sd, 3))), 6) END AS skew,
  CASE WHEN sd < 1e-9 THEN 0 ELSE round(list_avg(list_transform(v, lambda a: pow((a - m) / sd, 4))) - 3, 6) END AS kurtosis, CASE WHEN sd < 1e-9 THEN 0 ELSE round(corr, 6) END AS corr FROM g""",
    "q_two_stream_range_left_join": f"""WITH {_IMU}, s AS (SELECT subject, min(t) AS t0, max(t) AS t1 FROM imu WHERE activity = 'click' GROUP BY 1),
k AS (SELECT *, unnest(generate_series(0, CAST(floor((t1 - t0 - 288000) / 144000) AS BIGINT))) AS window_id FROM s WHERE t1 - t0 >= 288000),
f AS (SELECT DISTINCT k.subject, window_id, t0 FROM k JOIN imu e ON e.subject = k.subject AND e.activity = 'click' AND e.t >= t0 + window_id * 144000 AND e.t < t0 + window_id * 144000 + 288000)
SELECT f.subject, window_id, count(v.t) AS n, CASE WHEN count(v.t) >= 2 THEN round(avg(v.value), 6) END AS mean FROM f LEFT JOIN imu v ON v.subject = f.subject AND v.activity = 'view'
  AND v.t >= t0 + window_id * 144000 AND v.t < t0 + window_id * 144000 + 288000 GROUP BY 1, 2""",
    "q_ordinal_segment_join": f"""WITH {_IMU}, v AS (SELECT CASE WHEN subject % 5 = 0 THEN -1 - subject ELSE subject END AS subject, t FROM imu WHERE activity = 'view'), a0 AS (SELECT *, t - lag(t) OVER (PARTITION BY subject ORDER BY t) AS d FROM imu WHERE activity = 'click'),
a AS (SELECT DISTINCT subject, CAST(sum(CASE WHEN d > 160000 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY t) AS BIGINT) AS segment_id FROM a0),
b0 AS (SELECT *, t - lag(t) OVER (PARTITION BY subject ORDER BY t) AS d FROM v),
b AS (SELECT DISTINCT subject, CAST(sum(CASE WHEN d > 160000 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY t) AS BIGINT) AS segment_id FROM b0)
SELECT a.subject, a.segment_id, CASE WHEN b.segment_id IS NOT NULL THEN b.segment_id WHEN a.subject IN (SELECT subject FROM b) THEN -1 END AS right_segment FROM a LEFT JOIN b USING (subject, segment_id)""",
    "q_multi_rate_gather": f"""WITH {_IDX}, c AS (SELECT subject, idx AS centre FROM idx WHERE idx % 20 = 10), r AS (SELECT unnest([1, 2, 4]) AS rate, unnest([4, 8, 16]) AS half),
s AS (SELECT subject, rate, idx * rate + k AS i, value FROM idx, r, generate_series(0, 3) g(k) WHERE k < rate)
SELECT c.subject, c.centre, r.rate, CAST(count(*) AS INT) AS n, round(avg(value), 6) AS mean, round(arg_min(value, i), 6) AS v0 FROM c, r JOIN s ON s.rate = r.rate
WHERE s.subject = c.subject AND i >= centre * r.rate - half AND i < centre * r.rate + half GROUP BY 1, 2, 3""",
    "q_view_alignment": """SELECT doc_id AS position, CASE WHEN lang IN ('en', 'es') THEN concat('a', doc_id) END AS view_a, CASE WHEN lang <> 'es' OR lang IS NULL THEN concat('b', doc_id) END AS view_b,
  CAST(CAST(lang IS NULL OR lang NOT IN ('en', 'es') AS INT) + CAST(coalesce(lang = 'es', FALSE) AS INT) AS BIGINT) AS missing FROM documents""",
    "q_train_test_anti": f"WITH {_CUST} SELECT subject, count(*) AS n FROM cust WHERE subject NOT IN (SELECT subject FROM cust WHERE subject < 5) GROUP BY 1",
    "q_train_test_intersect": f"WITH {_CUST} SELECT subject FROM cust WHERE label = 1 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0",
    "q_train_test_except": f"WITH {_CUST} SELECT subject FROM cust EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "q_union_shards": f"WITH {_IMU} SELECT {_TYPE} AS shard, count(*) AS n, count(DISTINCT subject) AS subjects, round(sum(value), 4) AS total FROM imu GROUP BY 1",
    "q_stable_topn_per_label": "SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY sha256(concat('42:balanced-per-label:', quality, ':', doc_id)), doc_id) <= 20",
    "q_subject_label_balanced": f"WITH {_CUST} SELECT * FROM cust QUALIFY row_number() OVER (PARTITION BY subject, label ORDER BY sha256(concat('42:subject-label-balanced:', subject, ':', label, ':', sample_id)), sample_id) <= 3",
    "q_select_subjects_topk": f"""WITH {_CUST} SELECT subject FROM cust GROUP BY 1 HAVING count(*) FILTER (label = 0) >= 10 AND count(*) FILTER (label = 1) >= 10 ORDER BY sha256(concat('42:subject:', subject)), subject LIMIT 9""",
    "q_loo_candidates": _LOO + " SELECT * FROM loo",
    "q_loo_examples": _LOO + " SELECT loo.subject, eval_subject, subject_rank, label, sample_id FROM loo JOIN picked p ON p.subject = loo.subject AND rn <= 2",
    "q_per_subject_cap": "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sha256(concat('42:per-subject-limit:', event_id)), event_id) <= 5",
    "q_balanced_limit": f"""WITH {_CUST}, a AS (SELECT * FROM cust QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256(concat('42:balanced-per-label:', label, ':', sample_id)), sample_id) <= 100),
b AS (SELECT *, sha256(concat('42:per-subject-limit:', sample_id)) AS h FROM a), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY subject ORDER BY h, sample_id) <= 3)
SELECT sample_id, subject, label FROM c ORDER BY h, sample_id LIMIT 60""",
    "q_natural_sort": "SELECT concat('S', s_suppkey) AS name, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier",
    "q_reproducibility_digest": """WITH h AS (SELECT sha256(concat_ws(':', doc_id, quality, toxic)) AS h FROM labels), p AS (SELECT h[1:3] AS p, sha256(string_agg(h, ',' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1)
SELECT sha256(string_agg(d, ',' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM p""",
    "q_question_files": f"""WITH {_X}, q AS (SELECT vec_id, label % 2 AS label, x FROM w)
SELECT vec_id, label, 'chest_eda,wrist_acc,odd' AS channels, round(list_sum(x[1:20]), 4) AS first_total, round(list_sum(list_transform(generate_series(0, 5), lambda i: x[22 + 3 * i])), 4) AS y_total, '' AS question FROM q WHERE vec_id % 2 = 0
UNION ALL SELECT vec_id, label, 'bvp,temp', round(list_sum(x[1:32]), 4), NULL, concat('of ', vec_id) FROM q WHERE vec_id % 2 = 1""",
    "q_array_zscore_stats": f"""WITH {_X}, s AS ({_STAT}), o AS (SELECT *, list_sort(x) AS o, x[n] - x[1] AS d, list_transform(x, lambda v: CASE WHEN s < 1e-8 THEN v - m ELSE (v - m) / s END) AS z FROM s)
SELECT vec_id, round(m, 6) AS mean, round(s, 6) AS std, round(o[1], 6) AS min, round(o[n], 6) AS max,
  round(o[1 + CAST(floor(0.25 * (n - 1)) AS INT)] + (o[2 + CAST(floor(0.25 * (n - 1)) AS INT)] - o[1 + CAST(floor(0.25 * (n - 1)) AS INT)]) * (0.25 * (n - 1) - floor(0.25 * (n - 1))), 6) AS p25,
  round(o[1 + CAST(floor(0.75 * (n - 1)) AS INT)] + (o[2 + CAST(floor(0.75 * (n - 1)) AS INT)] - o[1 + CAST(floor(0.75 * (n - 1)) AS INT)]) * (0.75 * (n - 1) - floor(0.75 * (n - 1))), 6) AS p75,
  CASE WHEN abs(d) > greatest(0.25 * s, 1e-6) THEN CASE WHEN d > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'relatively stable' END AS trend,
  round(list_avg(z), 6) + 0e0 AS z_mean, round({_pstd('z')}, 6) AS z_std, round(list_max(z), 6) AS z_max FROM o""",
    "q_array_downsample": f"""WITH {_X}, y AS (SELECT vec_id, list_transform(generate_series(0, 19), lambda i: x[1 + CASE WHEN i = 19 THEN len(x) - 1 ELSE CAST(floor(i * ((len(x) - 1) / 19)) AS INT) END]) AS y FROM w)
SELECT vec_id, len(y) AS n, round(list_sum(y), 5) AS total, round(y[8], 6) AS y7, round(y[20], 6) AS y19 FROM y""",
    "q_vector_magnitude": f"""WITH {_X}, m AS (SELECT vec_id, list_transform(generate_series(1, 20), lambda i: sqrt(x[i] * x[i] + x[i + 20] * x[i + 20] + x[i + 40] * x[i + 40])) AS m FROM w)
SELECT vec_id, round(list_avg(m), 6) AS mean, round(list_max(m), 6) AS max, round({_pstd('m')}, 6) AS std FROM m""",
    "q_slope_corr_rmssd": f"""WITH {_X}, u AS (SELECT vec_id, unnest(x) AS v, unnest(generate_series(0, len(x) - 1)) AS i FROM w), d AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM u)
SELECT vec_id, round(regr_slope(v, i), 6) AS slope, round(corr(v, i), 6) AS corr, round(sqrt(avg(d * d)), 6) AS rmssd, round((sum(abs(v)) - (arg_min(abs(v), i) + arg_max(abs(v), i)) / 2) / 4, 6) AS integral FROM d GROUP BY 1""",
    "q_trend_segments": f"""WITH {_X}, {_Z}, u AS (SELECT vec_id, unnest(z) AS v, unnest(generate_series(0, len(z) - 1)) AS i FROM z),
p AS (SELECT vec_id, i // 16 AS k, i % 16 AS j, 16 AS n, 3 AS edge, v FROM u UNION ALL SELECT vec_id, -1, i, 64, 12, v FROM u),
d AS (SELECT vec_id, k, stddev_pop(v) AS s, avg(v) FILTER (j >= n - edge) - avg(v) FILTER (j < edge) AS d FROM p GROUP BY 1, 2),
t AS (SELECT vec_id, k, CASE WHEN s < 1e-8 THEN 'stable' WHEN d > 0.25 THEN 'increasing' WHEN d < -0.25 THEN 'decreasing' ELSE 'stable' END AS t FROM d)
SELECT vec_id, max(t) FILTER (k = -1) AS trend, string_agg(t, ',' ORDER BY k) FILTER (k >= 0) AS segments FROM t GROUP BY 1""",
    "q_fluctuation_peaks": f"""WITH {_X}, {_Z}, d AS (SELECT vec_id, x, z, {_DIFF.format(x='z')} AS d, list_avg(x) + {_pstd('x')} AS lim FROM z),
e AS (SELECT *, list_avg(d) AS dm, {_pstd('d')} AS ds FROM d)
SELECT vec_id, CASE WHEN ds < 0.08 THEN 'low' WHEN ds > 0.35 THEN 'high' ELSE 'moderate' END AS fluctuation,
  len(list_filter(generate_series(2, len(z) - 1), lambda i: (z[i] > z[i-1] AND z[i] > z[i+1] AND z[i] > 1.5) OR (z[i] < z[i-1] AND z[i] < z[i+1] AND z[i] < -1.5))) AS peaks,
  len(list_filter(d, lambda v: abs((v - dm) / ds) > 1.5)) AS changes, len(list_filter(generate_series(2, len(x) - 1), lambda i: x[i] > x[i-1] AND x[i] > x[i+1] AND x[i] > lim)) AS high_peaks FROM e""",
    "q_movement_stillness": f"""WITH {_IMU}, d AS (SELECT subject, abs(value - lag(value) OVER (PARTITION BY subject ORDER BY t, event_id)) AS d FROM imu),
l AS (SELECT subject, median(d) + stddev_pop(d) AS lim, count(d) AS n FROM d GROUP BY 1)
SELECT l.subject, count(*) FILTER (d > CASE WHEN lim > 0 THEN lim ELSE 1e-8 END) AS movements, round(CASE WHEN max(n) = 0 THEN 1 ELSE 1 - count(*) FILTER (d > CASE WHEN lim > 0 THEN lim ELSE 1e-8 END) / max(n) END, 6) AS stillness
FROM l JOIN d ON l.subject = d.subject GROUP BY 1""",
    "q_moving_average": f"""WITH {_X} SELECT vec_id, round((x[1] + x[2] + x[3]) / 5, 6) AS y0, round((x[29] + x[30] + x[31] + x[32] + x[33]) / 5, 6) AS y30, round((x[62] + x[63] + x[64]) / 5, 6) AS y63, round(list_sum(x[28:37]), 6) AS crop_total FROM w""",
    "q_periodicity": f"""WITH {_X}, {_Z}, u AS (SELECT vec_id, unnest(z) AS v, unnest(generate_series(0, len(z) - 1)) AS i FROM z),
f AS (SELECT vec_id, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM u GROUP BY 1), r AS (SELECT u.vec_id, i, v - (a + b * i) AS r FROM u JOIN f ON u.vec_id = f.vec_id),
c AS (SELECT p.vec_id, q.i - p.i AS lag, sum(p.r * q.r) AS c FROM r p JOIN r q ON p.vec_id = q.vec_id AND q.i >= p.i AND (q.i - p.i = 0 OR q.i - p.i BETWEEN 2 AND 31) GROUP BY 1, 2),
s AS (SELECT vec_id, max(c) FILTER (lag > 0) / max(c) FILTER (lag = 0) AS s FROM c GROUP BY 1)
SELECT vec_id, CASE WHEN s >= 0.6 THEN 'strong' WHEN s >= 0.35 THEN 'moderate' ELSE 'weak or unclear' END AS periodicity FROM s""",
    "q_prompt_direct": _direct(),
    "q_prompt_few_shot": _LOO + """, s AS (SELECT eval_subject, subject_rank, label, rn, concat('customer ', sample_id, ' of nation ', p.subject, chr(10), chr(10), 'Correct answer JSON:', chr(10), '{"predicted_state": ', label, '}') AS body
  FROM loo JOIN picked p ON p.subject = loo.subject AND rn <= 2), o AS (SELECT *, row_number() OVER (PARTITION BY eval_subject ORDER BY subject_rank, label, rn) AS k FROM s)
SELECT eval_subject, sha256(string_agg(concat('Example ', k, chr(10), body), chr(10) ORDER BY k)) AS sha256, count(*) AS example_count FROM o GROUP BY 1""",
    "q_parse_json_label": r"""WITH e AS (SELECT event_id, event_id % 7 AS k, regexp_extract(props, '(\d+)', 1) AS n FROM events), p AS (SELECT event_id, k, n, CAST(n AS INT) AS v FROM e)
SELECT event_id, CASE WHEN k IN (0, 1, 2) AND v IN (0, 1, 2, 3) THEN v END AS label, k IN (0, 1, 2) AND v IN (0, 1, 2, 3) AS valid,
  CASE WHEN k IN (0, 1, 2) AND v IN (0, 1, 2, 3) THEN '' WHEN k IN (0, 1, 2) THEN concat('out_of_label_space:', v) WHEN k = 3 THEN 'empty_response' WHEN k = 4 THEN 'json_not_object'
    WHEN k = 5 THEN 'missing_predicted_state' ELSE 'non_integer_predicted_state' END AS parse_error FROM p""",
    "q_majority_vote": f"""WITH {_IMU}, v AS (SELECT subject AS user_id, {_TYPE} AS vote, count(*) AS n FROM imu WHERE activity <> 'signup' GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM v)
SELECT user_id, CASE WHEN count(*) = 1 THEN min(vote) END AS majority_vote FROM r WHERE r = 1 GROUP BY 1""",
    "q_confusion": "SELECT q AS quality, t AS toxic, count(l.doc_id) AS n FROM (SELECT unnest([0, 1]) AS q) a CROSS JOIN (SELECT unnest([0, 1]) AS t) b LEFT JOIN labels l ON l.quality = q AND l.toxic = t GROUP BY 1, 2",
    "q_f1_valid_only": _scores("SELECT quality AS t, toxic AS p FROM labels"),
    "q_f1_invalid_as_wrong": _scores("SELECT CAST(d.doc_id % 2 AS INT) AS t, coalesce(l.quality, 1 - CAST(d.doc_id % 2 AS INT)) AS p FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "q_validity": "SELECT count(*) AS n, count(l.doc_id) AS valid_n, count(*) - count(l.doc_id) AS invalid_n, round((count(*) - count(l.doc_id)) / count(*), 6) AS invalid_rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "q_usage_per_sample": f"""WITH {_CALLS} SELECT conv_id, llm_call_count, CAST(prompt_chars AS BIGINT) AS prompt_chars, CAST(completion_chars AS BIGINT) AS completion_chars, CAST(total_chars AS BIGINT) AS total_chars,
  CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens, CAST(total_tokens AS BIGINT) AS total_tokens, elapsed_time_sec, llm_token_usage_available_count, llm_token_usage_missing_count FROM folded""",
    "q_usage_summary": f"WITH {_CALLS}, {_SUMMARY} SELECT * FROM summary",
    "q_cost_scaling": f"""WITH {_CALLS}, s AS (SELECT sum(prompt_tokens) / 1e6 * 0.5 AS a, sum(completion_tokens) / 1e6 * 1.5 AS b, sum(total_tokens) / count(total_tokens) AS t, count(total_tokens) AS n FROM folded)
SELECT round(a, 6) AS estimated_input_cost, round(b, 6) AS estimated_output_cost, round(a + b, 6) AS estimated_total_cost, round(t * 2220, 6) AS estimated_total_tokens_for_full_experiment, round((a + b) / n * 2220, 6) AS estimated_total_cost_for_full_experiment FROM s""",
    "q_latency_percentiles": """SELECT event_type, count(*) AS requests, round(avg(value), 6) AS latency_mean, round(quantile_cont(value, 0.5), 6) AS latency_p50, round(quantile_cont(value, 0.9), 6) AS latency_p90,
  round(quantile_cont(value, 0.99), 6) AS latency_p99 FROM events GROUP BY 1""",
    "q_numeric_from_text": r"""WITH v AS (SELECT source, TRY_CAST(nullif(regexp_extract(text, '-?\d+(?:\.\d+)?'), '') AS DOUBLE) AS v FROM documents)
SELECT source, count(v) AS n, round(avg(v), 6) AS avg, round(max(v), 6) AS max FROM v GROUP BY 1""",
    "q_revenue_by_nation": """SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "q_render_features": f"WITH {_X} SELECT vec_id, {_feature_line('acc', 'x')} AS line FROM w",
    "q_feature_text": f"""WITH {_X}, s AS (SELECT vec_id, x[1:20] AS a, x[21:40] AS b, x[41:60] AS c, x[61:64] AS g,
  list_transform(generate_series(1, 20), lambda i: sqrt(x[i] * x[i] + x[i + 20] * x[i + 20] + x[i + 40] * x[i + 40])) AS m FROM w)
SELECT vec_id, concat_ws(chr(10), 'Input feature description for HHAR:', '', 'Accelerometer:', {_feature_line('acc_x', 'a')}, {_feature_line('acc_y', 'b')}, {_feature_line('acc_z', 'c')},
  {_feature_line('acc_magnitude', 'm')}, '', 'Gyroscope:', {_feature_line('gyro_mag', 'g')}) AS input_text FROM s""",
    "q_psd_peak": f"""WITH {_X}, u AS (SELECT vec_id, unnest(list_transform(x, lambda v: v - list_avg(x))) AS v, unnest(generate_series(0, 63)) AS n FROM w),
h AS (SELECT vec_id, n, v * (0.5 - 0.5 * cos(2 * pi() * n / 64)) AS v FROM u),
f AS (SELECT vec_id, k, (pow(sum(v * cos(2 * pi() * k * n / 64)), 2) + pow(sum(v * sin(2 * pi() * k * n / 64)), 2)) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM h, generate_series(0, 32) g(k) GROUP BY 1, 2)
SELECT vec_id, CAST(arg_max(k, p) AS DOUBLE) AS peak_hz FROM f GROUP BY 1""",
    "q_channel_metadata": """WITH m(i, name, channel, sensor, place, rate) AS (VALUES (0, 'Chest_EDA', 'EDA', 'electrodermal activity', 'chest', NULL), (1, 'skin temp', 'TEMP', 'skin temperature', 'wrist', 64.0e0),
  (2, 'ACC-X', 'ACC_X', 'accelerometer', 'wrist', 64.0e0), (3, 'wrist_foo_x', 'ACC_X', 'accelerometer', 'wrist', NULL), (4, 'gyro_y', 'GYRO_Y', 'gyroscope', 'unknown', NULL),
  (5, 'hr', 'HR', 'heart rate', 'wrist', 64.0e0), (6, 'bvp filt', 'BVP', 'filtered blood volume pulse', 'wrist', 64.0e0), (7, 'nothing', NULL, NULL, NULL, NULL))
SELECT s_suppkey, name, channel, sensor, place, rate FROM supplier JOIN m ON s_suppkey % 8 = i""",
    "q_fingerprint": f"""WITH {_CUST} SELECT sample_id AS id, concat('{{"dataset": "a \\"b\\""', CASE WHEN label = 1 THEN concat(', "epoch_id": ', sample_id) END, ', "label": ', label, ', "sample_id": ', sample_id,
  ', "subject": "', subject, '", "window_start_sec": ', sample_id * 30, '.0}}') AS fingerprint FROM cust""",
    "q_knowledge_text": _known(),
}
