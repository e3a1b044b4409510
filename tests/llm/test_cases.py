"""Cases of the operators that random texts seldom hold: long texts, hot keys, overlaps, names that clash."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import common, html_extract, line_dedup, mixing, perfect_hash, pii, token_output, warc
from tests.llm.test_operators import base_spans, docs, ids_of


@pytest.mark.parametrize("source,want", [
    ("<p>" + "İ" * 40 + "</p><script>var a;</script><p>lost text one</p><p>kept two</p>", "İ" * 40 + " lost text one kept two"),
    ("<p>x</p><script src=/a/b/>var a=1;</script><p>y</p>", "x y"), ("<p>x<textarea/>no</textarea>y", "xy"), ("<p>x<SCRIPT>no</Script >y", "xy"),
    ("<p>x<svg><svg>a</svg>b</svg>y", "xy"), ("<p>x<svg/>y", "xy"), ("<p>x<script>no</scripts>no</script>y", "xy"), ("<p>x<style>no", "x"),
    ("<article><p class='related'>in the article</p><div class='related'>links</div><p>z</p></article>", "in the article z"),
])
def test_raw_elements_and_weak_words(source, want):
    assert html_extract.main_text(source) == want


def test_equal_shares_keep_words_and_expectations():
    sizes = sorted((random.Random(1).randint(1, 400) for _ in range(40)), reverse=True) + [0]
    runs = [mixing.settle_equal(0.3, sizes, list(range(41)), seed) for seed in range(1, 3001)]
    for out in runs[:200]:
        assert abs(sum(o * s for o, s in zip(out, sizes)) - 0.3 * sum(sizes)) < 1e-6
        assert sum(o not in (0.0, 1.0) for o in out) <= 1
    for i in (0, 7, 39):
        assert abs(np.mean([o[i] for o in runs]) - 0.3) < 0.04
    assert mixing.settle_equal(0.5, [5], [1]) == [0.5] and mixing.settle_equal(0.0, [5, 3], [1, 2]) == [0.0, 0.0]
    big = mixing.settle_equal(0.4, [1000, 2, 1], [1, 2, 3])
    assert abs(1000 * big[0] + 2 * big[1] + big[2] - 401.2) < 1e-9 and big[1] in (0.0, 1.0) and big[2] in (0.0, 1.0)


def test_sources_come_near_their_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * (5000 if i % 97 == 0 else rng.randint(1, 300))), "abcd"[i % 4]) for i in range(600)] + [(None, "same text " * 20, "e")] * 700
    got = mixing.mix(docs(spark, rows).repartition(5), leaf=100)
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in per) == len(rows) and len(per) == 5
    assert all(abs(r.taken - r.target) <= 0.01 * r.target for r in per)
    assert got.filter("taken > 2 * size").count() == 0


def test_perfect_hash_by_blocks():
    keys = np.random.default_rng(5).integers(0, 2**64, 3000, dtype=np.uint64)
    h = perfect_hash.PerfectHash.build(keys)
    ranks, n = h.block_ranks(), perfect_hash.BLOCK
    one = lambda k: perfect_hash.probe(int(k), h.sizes, lambda b: h.words[b * n : b * n + n], lambda b: int(ranks[b]))
    assert [one(k) for k in keys] == h(keys).tolist()
    others = np.random.default_rng(6).integers(0, 2**64, 300, dtype=np.uint64)
    assert [one(k) for k in others] == h(others).tolist()


def test_ids_lead_to_their_shards(spark, tmp_path):
    rows = [(i, f"text number {i}") for i in range(300)] + [(77, f"hot {i}") for i in range(400)] + [(None, f"none {i}") for i in range(150)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = token_output.write_shards(docs(spark, rows).repartition(3), f"file://{tmp_path}/s")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.filter("least <= 77 and most >= 77").count() > 1
    index = token_output.Index(shards)
    assert index.get(5).tolist() == ids_of("text number 5").tolist() and index.get(1000) is None and index.get(-1) is None
    hot = [index.get(77, k) for k in range(401)]
    assert sorted(x.tolist() for x in hot) == sorted(ids_of(t).tolist() for d, t in rows if d == 77) and index.get(77, 401) is None
    assert sorted(index.get(None, k).tolist() for k in range(150)) == sorted(ids_of(t).tolist() for d, t in rows if d is None)
    got = {r.doc_id: r.ids for r in token_output.lookup(shards, spark.createDataFrame([(3,), (250,), (999,)], "doc_id long")).collect()}
    assert got == {3: ids_of("text number 3").tolist(), 250: ids_of("text number 250").tolist(), 999: None}
    assert token_output.read_shards(shards).count() == len(rows)


def test_running_sums(spark):
    for n in (0, 1, 2, 5, 64, 1000):
        x = [random.Random(n).randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(x,)], "x array<bigint>").select(common.running(F.col("x"))).first()[0]
        assert got == np.cumsum(x).tolist()


def test_personal_data_in_long_texts(spark):
    text = " ".join(f"wörd{i} 10.0.{i % 300}.{i % 256}, me{i}@host{i}.com +1 (555) 010-{1000 + i}" for i in range(6000))
    r = pii.find(docs(spark, [(1, text)])).collect()[0]
    want = base_spans(text).split(",")
    assert r.n_email == 6000 and r.n_ip + r.n_email + r.n_card + r.n_phone == len(want)
    assert set(want) <= set(r.spans.split(","))


def brute_scores(edges, rounds=pii.ROUNDS):
    """The pattern graph scored with dictionaries. ``edges``: {(pattern, of, token): seed kind or None}."""
    kinds = range(len(pii.KINDS))
    seed_of = {}
    for (_, _, token), k in edges.items():
        if k is not None:
            seed_of[token] = max(k, seed_of.get(token, -1))
    scores, confident = {(t, k): 1.0 for t, k in seed_of.items()}, {}
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for p, of, t in edges:
            members[(p, of)].append(t)
        size = collections.Counter(p for p, _, _ in edges)
        confident = {}
        for (p, of), tokens in members.items():
            total = sum(s for (t, _), s in scores.items() if t in tokens)
            for k in kinds:
                support = [scores[(t, k)] for t in tokens if (t, k) in scores]
                if support and of in (None, k):
                    against = size[p] if of is None else total + pii.UNKNOWN * max(size[p] - total, 0)
                    confident[(p, k)] = sum(support) / (against + 1)
        found = collections.defaultdict(float)
        for p, _, t in edges:
            for k in kinds:
                if confident.get((p, k), 0) >= pii.CONFIDENT and t not in seed_of:
                    found[(t, k)] += math.log1p(-min(confident[(p, k)], 0.999))
        scores = {(t, k): 1.0 for t, k in seed_of.items()} | {key: 1 - math.exp(v) for key, v in found.items()}
    return confident, scores


def test_graph_scores_equal_brute_force(spark):
    rng = random.Random(8)
    edges = {}
    for i in range(330):
        kind = i % 3 if i < 315 else None
        for _ in range(rng.randint(1, 4)):
            p = rng.randrange(6)
            own = p % 3 if kind is None or rng.random() < 0.01 else kind
            edges[(f"p{own}{p // 3}", own if p < 4 else None, f"t{i}")] = kind
    by_token = collections.defaultdict(list)
    for (p, of, t), k in edges.items():
        by_token[(t, k)].append((p + ("s" if of is None else ""), of))
    edges = {(p + ("s" if of is None else ""), of, t): k for (p, of, t), k in edges.items()}
    rows = [(t, k, ps) for (t, k), ps in by_token.items()]
    patterns, instances = pii.induced(spark.createDataFrame(rows, "token string, kind int, patterns array<struct<pattern:string,of:int>>"))
    confident, scores = brute_scores(edges)
    got = {(r.pattern, r.kind): r.confidence for r in patterns.collect()}
    assert got.keys() == confident.keys() and all(abs(got[k] - confident[k]) < 1e-9 for k in got)
    got = {(r.token, r.kind): r.score for r in instances.collect()}
    assert got.keys() == scores.keys() and all(abs(got[k] - scores[k]) < 1e-9 for k in got)
    assert len(got) > 315


def test_first_of_overlapping_runs_stays(spark):
    line = " ".join("w%d" % i for i in range(10))
    rows = [(1, "\n".join([line] * 12)), (2, "\n".join(["x", line, line, line, line, line, "y"]))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[1].text == "\n".join([line] * 5) and got[1]._n_removed == 7
    assert got[2].text == "x\ny"


def test_line_dedup_of_long_texts_and_clashing_names(spark):
    lines = [f"line {i} of a text that has very many of them" for i in range(8000)]
    df = spark.createDataFrame([(1, "\n".join(lines), 7), (2, "\n".join(["own"] + lines[100:7000] + ["end"]), 8)], "doc_id long, text string, _n_lines int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_n_lines", "__n_lines", "__n_removed"]
    texts = {r.doc_id: (r.text, r._n_lines, r["__n_lines"]) for r in got.collect()}
    assert texts[1] == ("\n".join(lines), 7, 8000) and texts[2] == ("own\nend", 8, 6902)


def brute_words(rows, least):
    """Texts without the words of every ``least``-word window that stands earlier; a first occurrence stays whole."""
    seen, out = {}, {}
    for d, t in sorted(rows):
        tokens = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)
        words, gone = [x.strip(" \t\n\x0b\x0c\r") for x in tokens], set()
        for i in range(len(words) - least + 1):
            at, begin = seen.setdefault(tuple(words[i : i + least]), (d, i)), i
            if at != (d, i):
                gone |= set(range(max(begin, at[1] + least) if at[0] == d else begin, i + least))
        lead = re.match(r"[\x20\x09-\x0D]*", t)[0]
        out[d] = (lead + "".join(x for i, x in enumerate(tokens) if i not in gone), len(gone))
    return out


@pytest.mark.parametrize("least", [1, 2, 7, 12])
def test_runs_of_words_equal_brute_force(spark, least):
    rng = random.Random(least)
    shared = [[f"s{i}_{j}" for j in range(rng.randint(6, 20))] for i in range(8)] + [["r"] * 15, ["a", "b"] * 12]
    rows = []
    for d in range(80):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"o{d}_{rng.randrange(99)}" for _ in range(rng.randint(0, 9))] + rng.choice(shared)
        # one line, so that no whole line repeats by chance
        rows.append((d, rng.choice(["", " ", "\t"]) + f"own{d}" + "".join(rng.choice(" \t") * rng.randint(1, 2) + w for w in words)))
    got = {r.doc_id: (r.text, r._n_words) for r in line_dedup.dedup_runs(docs(spark, rows).repartition(3), least=least).collect()}
    assert got == brute_words(rows, least)


def test_passages_inside_lines(spark):
    passage = ["p%d" % i for i in range(51)]
    long = " ".join("q%d" % i for i in range(60_000))
    rows = [
        (1, "own start " + " ".join(passage) + " own end"), (2, "another\nline " + "\n".join(passage) + "\nand more"), (3, " ".join(passage[:49]) + " other"), (3, None),
        (None, "before " + " ".join(passage)), (4, long), (5, "x " + long + " y"), (6, ""), (7, "z " * 20_000),
    ]
    got = line_dedup.dedup_runs(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns + ["_n_lines", "_n_removed", "_n_words"]
    got = sorted(((r.doc_id or 0, r.text, r._n_words) for r in got.collect()), key=lambda r: (r[0], r[1] or ""))
    texts = {d: (t, n) for d, t, n in got if t is not None}
    assert texts[0] == (rows[4][1], 0) and texts[1] == ("own start own end", 51) and texts[2] == ("another\nline and more", 51)
    assert texts[3] == (rows[2][1], 0) and (3, None, 0) in got and texts[4] == (long, 0) and texts[5] == ("x y", 60_000)
    assert texts[6] == ("", 0) and texts[7] == ("z " * 50, 19_950)
    clash = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, _n_words int, _row int")
    assert line_dedup.dedup_runs(clash).columns == ["doc_id", "text", "_n_words", "_row", "__n_lines", "__n_removed", "__n_words"]
    assert line_dedup.dedup_runs(clash.limit(0)).count() == 0


def test_rows_are_pinned_unless_a_plan_holds_them(spark, sf):
    nodes = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    table = spark.read.parquet(f"{sf}/labels.parquet")
    for df in (table.withColumn("r", F.rand()), table.repartition(3), spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")):
        assert common.stable(df) is not df
    same = table.filter("doc_id > 3")
    assert common.stable(same) is same


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="shared folder"):
        common.shared_dir(Session())


def test_pages_of_one_payload(spark, tmp_path):
    rows = [(i, None, "") for i in range(5, 300)] + [(None, "u", ""), (3, "u", None), (3, "v", ""), (1, "u", "own")]
    got = warc.read_bundles(warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), f"file://{tmp_path}/w")).collect()
    assert len(got) == len(rows) and sum(r.record_type == "response" for r in got) == 2
    assert all(r.refers_to == 3 for r in got if r.record_type == "revisit") and sum(r.page_id == 3 for r in got) == 2


@pytest.mark.parametrize("few, most", [(100, 100), (3, 100), (3, 1)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_texts_without_partner_are_not_moved(spark, tmp_path, few, most, how):
    spark.range(40).selectExpr("id as _row", "repeat('x', int(id)) as _text").write.parquet(str(tmp_path / "rows"))
    spark.range(0, 50, 7).selectExpr("id as _row", "array(id) as gone").write.parquet(str(tmp_path / "lists"))
    rows, lists = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "lists"))
    got = line_dedup._with_lists(rows, lists, how, F.size("gone"), few, most)
    want = [(i, "x" * i, None if i % 7 else [i]) for i in range(40) if how == "left" or not i % 7]
    assert sorted(map(tuple, got.select("_row", "_text", "gone").collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") + plan.count("LeftAnti") == (0 if few == 100 or most == 1 else 1 if how == "inner" else 2)


def test_words_split_with_and_without_a_pattern(spark):
    texts = ["", " ", "a", " a  b\nc\n", "a\tb \x0b\x0c\rc", "  x y z\n\n\n", "a\\b [ ] \x1f \x00 \x85"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(line_dedup._words(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [[w for w in re.split(r"[\x20\x09-\x0D]+", t) if w] for t in texts]
