"""The ten operators against brute force, round trips and defined edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import components, exact_dedup, html_extract, line_dedup, minhash, mixing, packing, perfect_hash, pii, quality, token_output, tokens, warc
from sensorloom.llm.oracles import ORACLES
from sensorloom.llm.queries import QUERIES
from tests.compare import assert_same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: More columns, with names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, key string, kept int, size int, _row int"


def docs(spark, rows):
    """Rows are (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 1, "x", "k", 2, 3, 4) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGE = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "Same text here now"), (5, "same TEXT here now"), (5, "same TEXT here now"), (None, "same text here now"), (None, None),
    (6, "word"), (7, "wörd Ünïcode ß " * 40), (8, "\x00odd\x1c controls\x85 " + "x" * 50_000), (9, "a b c " * 30_000), (10, "é" * 20),
]


def small(sf_rows=60, seed=1):
    """Random texts with exact and near copies."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(sf_rows)]
    for i in range(sf_rows // 2):
        t = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t).upper() if i % 5 == 0 else " ".join(t))
    return list(enumerate(texts, 200))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_same(spark, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("run", [
    exact_dedup.exact_groups, exact_dedup.exact_dedup, minhash.near_groups, minhash.near_dedup, mixing.mix, mixing.mixed, packing.pack, pii.find, quality.scored,
    quality.filtered, line_dedup.dedup_lines, token_output.token_output,
])
def test_empty_tables(spark, run):
    assert run(docs(spark, [(1, "x")]).limit(0)).count() == 0


def test_empty_pages(spark):
    p = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(p).count() == 0 and warc.archive(p).count() == 0


def test_exact_groups(spark):
    rows = EDGE + small()
    got = exact_dedup.exact_groups(docs(spark, rows).repartition(5)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}
    left = exact_dedup.exact_dedup(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns and left.count() == len(groups)


def test_exact_groups_survive_colliding_digests(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    got = exact_dedup.exact_groups(docs(spark, [(1, "a"), (2, "b"), (3, "A")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("near", [minhash.Near(3, 85), minhash.Near(), minhash.Near(3, 85, block=4)])
def test_near_groups(spark, near):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here now".split() * 3
    chain = [(1000 + k, " ".join(["n%d" % i if i < 3 * k else w for i, w in enumerate(base * 2)])) for k in range(12)]
    rows = EDGE + small() + chain
    got = minhash.near_groups(docs(spark, rows).repartition(5), near=near).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, near.words, near.percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    left = minhash.near_dedup(docs(spark, rows), near=near)
    assert left.columns == docs(spark, rows).columns
    assert left.filter("doc_id is not null").select("doc_id").distinct().count() == len({c for _, _, c in brute_components(rows, near.words, near.percent) if c is not None})


def test_near_dedup_goes_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (None, a), (None, c), (None, c + " more"), (7, c[::-1]), (7, c[::-1]), (8, ""), (8, ""), (None, None)]
    for df in (docs(spark, rows), docs(spark, rows).repartition(3)):
        left = sorted((str(r.doc_id), r.text or "") for r in minhash.near_dedup(df).collect())
        assert [x for x in left if x[1] not in (c, c + " more")] == sorted([("1", a), ("2", b), ("7", c[::-1]), ("8", ""), ("8", ""), ("None", "")])
        assert sum(x[1] in (c, c + " more") for x in left) == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r.u: r.v for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_shingle_hashes_tell_words_apart():
    s = minhash.Shingler(3)
    assert len(s.shingles(b"ab c d")) == 1 and s.shingles(b"ab c d")[0] != s.shingles(b"a bc d")[0]
    assert list(s.shingles(b"A b")) == list(s.shingles(b" a  B ")) and len(s.shingles(b" \n")) == 0
    words = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    assert len(set(s.word_hashes(" ".join(words).encode()))) == len(words)


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(w for s, w in weight.items() if s not in full)
        level = (total - sum(2 * sizes[s] for s in full)) / rest if rest else 0
        more = {s for s in sizes if s not in full and 2 * sizes[s] < weight[s] * level}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in sizes}
        full |= more


def test_mixing(spark):
    rng = random.Random(5)
    names = ["b", "a", "é", "z", None, "Z", "aa"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(names[: 3 + i % 5])) for i in range(1500)] + [(None, None, "a"), (7, "x y", "a"), (7, "x y", "a")]
    df = docs(spark, rows)
    got = mixing.mix(df, leaf=64).withColumn("source", F.lit(None)).collect()
    by_row = df.select("doc_id", "source", F.monotonically_increasing_id().alias("_r")).collect()
    source = {r._r: r.source for r in by_row}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        s = source[r._row]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = waterfill(dict(sizes))
    assert all(target[s] == pytest.approx(want[s]) for s in want)
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = mixing.mix(df.repartition(9), leaf=64)
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(again.collect()) == key(got)
    copies = mixing.mixed(df)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in mixing.mix(df).collect())


def test_settle_keeps_words_and_expectations():
    hits = np.zeros(4)
    for seed in range(4000):
        out = mixing.settle([0.3, 0.5, 0.6, 0.2], [10, 20, 30, 40], [1, 2, 3, 4], seed)
        assert sum(0 < p < 1 for p in out) <= 1
        assert np.dot(out, [10, 20, 30, 40]) == pytest.approx(39)
        hits += out
    assert np.allclose(hits / 4000, [0.3, 0.5, 0.6, 0.2], atol=0.03)
    assert mixing.settle([0.5, 1.0, 0.0], [0, 3, 4], [1, 2, 3]) == [0.0, 1.0, 0.0]


def test_quality_edges(spark):
    junk = " ".join("th%s***&&&" % i for i in range(200))
    prose = [(100 + i, "the cat sat on the mat and it was a good day for all of them by the sea number%d " % i * 8) for i in range(3)]
    rows = EDGE + [(50, junk), (51, "a b c d e " * 10), (52, "x y\nx y\n\nx y\n" + " ".join("u%d" % i for i in range(12)))] + prose
    got = {r.doc_id: r for r in quality.scored(docs(spark, rows)).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False)
    assert got[51].n_repeat_words == 50 and got[51].base_failed
    assert (got[52].n_dup_lines, got[52].n_words) == (2, 18)
    assert got[50].n_symbols == 1200
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        if d is not None:
            assert (got[d].n_words, got[d].word_chars, got[d].n_repeat_words) == (len(w), sum(map(len, w)), len(hit))


def test_junk_goes_and_prose_stays(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.scored(df).join(df, "doc_id")
    noisy = F.length(F.regexp_replace("text", r"[^#*$%&]+", "")) / F.length("text")
    worded = got.filter("n_words >= 100 and not base_failed").withColumn("noise", noisy)
    assert worded.filter("noise > 0.25 and kept").count() == 0
    assert worded.filter("noise < 0.002 and instr(text, '|') = 0 and not kept").count() == 0


def test_pieces_equal_the_library():
    enc = tokens.encoder()
    rng = random.Random(2)
    alphabet = list(" \n\t\r  abcDEéßñβγ漢字123²½Ⅷ.,!?'\"-_<>|#@\x1c\x1f\xa0　́😀") + ["<|endoftext|>", "'s", "'ll", "   ", "\r\n", " foo", "x" * 100]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(5000)]
    want = [e.ids + [0] for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode(texts)] == want


def ids_of(text):
    return np.array(tokens.encoder().tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_added_tokens_equal_a_fresh_library(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    rng = random.Random(3)
    alphabet = list(" \n\tabcDEé漢1½.,'<|>\x1c") + ["<|endoftext|>", "<|endoftext", "endoftext|>", " foo", "'s", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>", "a<|endoftext|>b", "one <|endoftext|>\ntwo"]
    want = [e.ids + [0] for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u2").tolist() for b in tokens.encoder().encode(texts)] == want
    assert want[-2] == [64, 50256, 65, 0]
    rows = list(enumerate(texts[-3:]))
    at = 0
    for r in sorted(token_output.token_output(docs(spark, rows)).collect(), key=lambda r: r.start):
        ids = np.array(want[r.doc_id - 3], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(docs(spark, rows)).collect()} == {
        d: zlib.crc32(np.array(want[d - 3], "<u4").tobytes()) for d, _ in rows
    }


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    h = perfect_hash.PerfectHash.build(keys)
    assert sorted(h(keys)) == list(range(n))


def test_token_shards(spark, tmp_path):
    rows = EDGE + small(20)
    shards = token_output.write_shards(docs(spark, rows).repartition(4), f"file://{tmp_path}/shards")
    got = token_output.read_shards(shards).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (d, t) in zip(got, order, strict=True):
        ids = ids_of(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = [token_output.Shard(p.path) for p in shards.collect()]
    hits = [x for s in found if (x := s.get(6)) is not None]
    assert len(hits) == 1 and hits[0].tolist() == ids_of("word").tolist()
    assert sum(s.get(5, 1) is not None for s in found) == 1 and all(s.get(5, 2) is None and s.get(123456) is None for s in found)


def test_packing(spark):
    rows = EDGE + small(20)
    df = docs(spark, rows).repartition(3)
    got = packing.pack(df, length=64).collect()
    by_seq = collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
    last = max(by_seq)
    for s, ps in by_seq.items():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 64 or s == last
    assert sorted(by_seq) == list(range(last + 1))
    texts = collections.Counter((d, ids_of(t).tobytes()) for d, t in rows)
    whole = collections.Counter()
    for d in {r.doc_id for r in got}:
        ps = sorted((r for r in got if r.doc_id == d), key=lambda r: (r.sequence_id, r.offset))
        buf, end = b"", 0
        for r in ps:
            assert r.ids_crc32 == zlib.crc32(r.ids) and r.start == end
            buf, end = buf + r.ids, end + r.length
            if end == r.doc_tokens:
                whole[(d, buf)] += 1
                buf, end = b"", 0
        assert end == 0
    assert whole == texts


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


HARD = [
    "a@b.c_d@e.f x@y z@@q.com .@a.b", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 1.2.3", "+1 (555) 123-4567) +12 call +999 +49 30 1234567 8",
    "4111 1111 1111 1111 4111-1111-1111-1112 " + "9" * 3000, "\U0001f600 é a@b.co \U0001f600 10.0.0.1", "@" * 2000, "a" * 100_000 + "@b.cc", " 1" * 2000, "+" * 500 + "1 23",
]


def test_personal_data_base(spark, sf):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = EDGE + [(5000 + i, t) for i, t in enumerate(HARD)] + [(9000 + d, t) for d, t in real]
    texts = {d: t or "" for d, t in rows if d is not None}
    for r in pii.find(docs(spark, rows)).collect():
        if r.doc_id is None:
            continue
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in pii.KINDS]
        assert set(want.split(",")) <= set(r.spans.split(",")) or not want


def test_context_finds_what_patterns_miss(spark):
    rng = random.Random(4)
    cards = ["4" + "".join(str(rng.randrange(10)) for _ in range(14)) for _ in range(40)]
    cards = [c + str(next(d for d in range(10) if luhn(c + str(d)))) for c in cards]
    rows = [(i, f"her account: {c} was charged") for i, c in enumerate(cards)]
    rows += [(100, "her account: 4111111111111119 was charged"), (101, "in the year 4111111111111119 nothing"), (102, "an account: 12 here")]
    got = {r.doc_id: r.spans for r in pii.find(docs(spark, rows)).collect()}
    assert got[100] == "card:13:29" and got[102] == "" and got[101] == ""
    assert all(got[i] == "card:13:29" for i in range(40))


def test_context_finds_other_formats(spark):
    rows = [(i, f"please ring +1 (555) 123-{4000 + i} for details") for i in range(20)]
    rows += [(100 + i, f"please write to user{i}@mail.example.com with questions") for i in range(20)]
    rows += [(200 + i, f"blocked host 10.0.{i}.7 since monday") for i in range(20)]
    new = {
        300: ("please ring (555) 123-4567 for details", "phone"), 301: ("please ring 0044 20 7946 0958 for details", "phone"), 302: ("please ring 555-123-9999 today", "phone"),
        303: ("please write to root@localhost with questions", "email"), 304: ("please write to name at host with questions", "email"),
        305: ("please write to ann (at) example dot org today", "email"), 306: ("blocked host 2001:db8::17 since monday", "ip"),
    }
    want = {300: "(555) 123-4567", 301: "0044 20 7946 0958", 302: "555-123-9999", 303: "root@localhost", 304: "name at host", 305: "ann (at) example dot org", 306: "2001:db8::17"}
    not_any = {400: "parcel 5551234567 arrived", 401: "we meet at noon", 402: "please ring 12 times", 403: "please write to him at noon today", 404: "gate 12:30:45 since monday"}
    rows += [(k, t) for k, (t, _) in new.items()] + list(not_any.items())
    got = {r.doc_id: r.spans for r in pii.find(docs(spark, rows)).collect()}
    for k, (t, kind) in new.items():
        assert got[k] == f"{kind}:{t.index(want[k])}:{t.index(want[k]) + len(want[k])}", (k, got[k])
    assert all(got[k] == "" for k in not_any)


def test_words_that_more_kinds_follow_find_nothing(spark):
    rows = [(i, f"see +1 (555) 123-{4000 + i} now") for i in range(20)] + [(50 + i, f"see {5550001000 + i} now") for i in range(60)]
    assert all(r.spans == "" for r in pii.find(docs(spark, rows)).collect() if r.doc_id >= 50)


def test_archives(spark, tmp_path):
    import base64

    import zstandard

    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://b", ""), (5, "u r\nl", "x" * 400_000), (7, "v", "<p>é</p>"), (7, "v", "<p>é</p>")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, row string").repartition(2)
    made = warc.write_bundles(df, f"file://{tmp_path}/w")
    got = warc.read_bundles(made).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault((h or ""), i)
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = first[h or ""] != i
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    for path in [r.path for r in made.collect()]:
        reader = warc.BundleReader(path)
        heads = [h for h, _ in reader.records()]
        for h in heads:
            assert reader.get(h["WARC-Record-ID"].strip("<>"))[0] == h
        assert reader.get("urn:uuid:00000000-0000-0000-0000-000000000000") is None
        raw = open(path.removeprefix("file://"), "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1") == len(heads)


def test_archives_respect_a_least_size(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = warc.read_bundles(warc.write_bundles(df, f"file://{tmp_path}/w", least_bytes=3)).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: None, 4: 3}


def brute_lines(rows, least):
    """Lines that lie in a run of ``least`` words or more which stands earlier: all runs, longest form."""
    parts = []
    for d, t in rows:
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        parts.append((d, lines, [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]))
    parts.sort(key=lambda p: p[0])
    seen, gone = {}, collections.defaultdict(set)
    runs = [(d, i, j, tuple(lines[i:j])) for d, lines, n in parts for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if sum(n[i:j]) >= least]
    for d, i, _, c in runs:
        seen[c] = min(seen.get(c, (d, i)), (d, i))
    for d, i, j, c in runs:
        if seen[c] < (d, i):
            gone[d] |= set(range(i, j))
    return {d: len(gone[d]) for d, _, _ in parts}


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(9)
    lines = ["line %d %s" % (i, " ".join(["w"] * rng.randint(0, 6))) for i in range(12)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for i in range(60)]
    got = line_dedup.dedup_lines(docs(spark, rows).repartition(4), least=12)
    assert {r.doc_id: r._n_removed for r in got.collect()} == brute_lines(rows, 12)


def test_line_dedup_edges(spark):
    passage = " ".join("p%d" % i for i in range(60))
    rows = EDGE + [(20, f"own one\n{passage}\n\nown end"), (21, f"{passage}"), (22, f"x\n{passage}\n{passage}\ny")]
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns + ["_n_lines", "_n_removed"]
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[20] == rows[-3][1] and texts[21] == "" and texts[22] == "x\ny" and texts[1] is None and texts[4] == "Same text here now"


CASES = [
    ("<p>a<b>b</b>c<br>d<p>e", "abc d e"),
    ("<article><p>x &lt;3 &amp;amp; y</p><aside>no</aside><div class='comments'>bad<p>worse</p></div><form>f</form><p>z", "x <3 &amp; y z"),
    ("<body><header>h</header><div id=cookie-notice>c</div><p>text</p><script>if(a<b){'</p>'}</script><footer>f", "text"),
    ("<main><header><h1>T</h1></header><p>in</p></main><p>out</p>", "T in"), ("<article>a</article><article>b</article><p>c", "a b"),
    ("<div><b><p>one</b> two</p></div><i>three", "one two three"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"), ("a < b and <c", "a < b and"),
    ("<p>x<!-- no <p> --><style>p{}</style><textarea>t</textarea>y", "xy"), ("<p hidden>a<p style='display: none'>b<p role=navigation>c<p>d", "d"),
    ("<div class=adapter>a</div><div class='top-ad'>b</div><div class=sideBar>c</div><div class=readerComments>d</div>", "a c"), ("", ""), (None, ""), ("<p>n&nbsp;b&#233;&eacute;</p>", "n béé"),
    ("<p title='a > b'>q</p><p x=\"1'2\">r", "q r"), ("<div>" * 3000 + "deep", "deep"), ("<" * 5000, "<" * 5000), ("<p" + " a='" * 300, ""),
]


@pytest.mark.parametrize("source,want", CASES)
def test_main_text(source, want):
    assert html_extract.main_text(source) == want


def test_style_tree_removes_what_pages_share(spark):
    shell = "<body><div class='x1'><span>Site name and the same slogan</span></div><div class='c'><p>{}</p><p>{}</p></div><div class='y'>All rights go here</div></body>"
    rows = [(i, f"http://h/{i}", shell.format(f"story {i} is told", f"and part {i} ends"), "e") for i in range(30)]
    rows += [(100, "http://other/1", shell.format("alone", "here"), "e"), (101, None, "<p>no host</p>", "e"), (102, "http://h/x", None, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, removed string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[3] == "story 3 is told and part 3 ends"
    assert got[100] == "Site name and the same slogan alone here All rights go here" and got[101] == "no host" and got[102] == ""


def test_repeated_articles_stay(spark):
    rows = [(i, f"http://h/{i}", "<body><article><h1>T</h1><p>one and the same text</p></article></body>") for i in range(30)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"T one and the same text"}


WRAPPED = [
    *((f"<div {a}><p>menu</p><article><p>story</p></article></div>", "story") for a in (
        "class='layout has-sidebar'", "class='no-sidebar'", "class='with-comments'", "class='share-enabled'", "id='skip-target'", "class='hasSidebar'",
        "class='sidebar-layout'", "class='page widget'", "id='banner-page'", "class='x' role='presentation'")),
    ("<div class='sidebar-layout'><main><p>story</p></main></div><footer>f</footer>", "story"),
    ("<div class='no-sidebar'><p>story</p></div>", "story"), ("<div class='sidebar'><p>side</p></div><p>story</p>", "story"),
    ("<article><p>story</p></article><div class='related'><article>teaser</article></div>", "story"),
    ("<main><p>story</p><div class='related'><article>teaser</article></div></main>", "story"),
    ("<p>a longer story</p><div class='related'><article>teaser</article></div>", "a longer story"),
    ("<p>story</p><div class='comments'><article>a comment that is long</article></div>", "story"),
    ("<p>story</p><aside><article>one more that is long</article></aside>", "story"),
    ("<article><p>story</p><div class='share'><p>tell</p></div><p>ends</p></article>", "story ends"),
]


@pytest.mark.parametrize("source,want", WRAPPED)
def test_wrappers_do_not_take_the_article(source, want):
    assert html_extract.main_text(source) == want


def test_repeated_wrappers_do_not_take_the_article(spark):
    rows = [(i, f"http://h/{i}", "<body><div class='wrap'><article><p>the same</p></article></div></body>") for i in range(9)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"the same"}


@pytest.mark.parametrize("part", ["article", "main", "div role='main'"])
def test_style_tree_removes_what_articles_share(spark, part):
    shell = (
        "<body><{0}><h1>Title {1}</h1><span class='x0'>By our desk</span><p class='x1'>Read also our guide</p><div class='c'><p>story {1} of <b class='x3'>the UN</b> goes on</p></div>"
        "<div class='x2'><p>Tell a friend</p></div></{2}></body>"
    )
    rows = [(i, f"http://h/{i}", shell.format(part, i, part.split()[0])) for i in range(30)]
    rows += [(50 + i, f"http://copies/{i}", f"<body><{part}><h1>T</h1><p>the same</p><i>{i}</i></{part.split()[0]}></body>") for i in range(2)]
    rows += [(60 + i, f"http://again/{i}", f"<body><{part}><h1>T</h1><p>the same</p></{part.split()[0]}></body>") for i in range(9)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} story {i} of the UN goes on" for i in range(30))
    assert got[51] == "T the same 1" and got[61] == "T the same"


def test_pages_of_the_table(spark, sf):
    out = html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    texts = {" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text}
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in out:
        title = html_extract.main_text(re.search(r"<article>(<h1>.*?</h1>)", html[r.page_id], re.S)[1])
        assert r.text.startswith(title) and r.text[len(title) :].strip() in texts and r.n_chars == len(r.text)
