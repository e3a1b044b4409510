"""The pipeline's stages: each on its own input, decisions against brute force."""

import collections
import re

import corpus_pipeline
from sensorloom.llm import minhash, mixing, quality
from tests.llm.test_operators import EDGE, LOWER, brute_components, docs, ids_of, small


def test_stages(spark, sf):
    df, columns, kept = spark.read.parquet(f"{sf}/documents.parquet"), None, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, df, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == df.columns
        kept.append((df, after))
        df = after
    before, after = kept[0]
    assert after.count() == quality.scored(before).filter("kept").count()
    before, after = kept[1]
    last = {}
    for r in before.collect():
        t = (r.text or "").translate(LOWER)
        last[t] = max(last.get(t, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(last.values())
    before, after = kept[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {c for _, _, c in brute_components(rows, 5, 80)}
    assert {r.doc_id for r in after.collect()} == want
    before, after = kept[3]
    assert after.exceptAll(before.unionAll(before)).count() == 0
    goals = {(r.source_size, r.target) for r in mixing.mix(before).collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for df_, out in ((before, sizes), (after, taken)):
        for r in df_.collect():
            out[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    longest = {r.source: r.m for r in before.selectExpr("source", "size(split(text, ' ')) m").groupBy("source").max("m").withColumnRenamed("max(m)", "m").collect()}
    targets = {s: next(t for n, t in goals if n == sizes[s]) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= max(longest[s], 0.02 * targets[s]) for s in sizes)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 0.05 * sum(sizes.values())
    before, after = kept[4]
    whole = after.groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] != 1024 for r in whole) <= 1
    texts = collections.Counter((r.doc_id, len(ids_of(r.text))) for r in before.collect())
    pieces = collections.Counter()
    for r in after.collect():
        pieces[(r.doc_id, r.doc_tokens)] += r.length
    assert pieces == {k: n * k[1] for k, n in texts.items()}


def test_run_names_pieces(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_take_edges(spark):
    df = docs(spark, EDGE + small(30)).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
    assert df.count() > 0
    assert minhash.near_dedup(docs(spark, EDGE)).count() > 0
