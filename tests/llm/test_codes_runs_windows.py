"""Vector codes, periodic runs and decontamination against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import decontaminate, queries, runs, vector_codes
from tests.llm.test_operators import EDGE, docs

VECTORS = "vec_id long, embedding array<float>, label int, id long, code string, error int, _vec string, _part int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], VECTORS)


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Every distance of every round, in Python's whole numbers."""
    kept = sorted(((i, v) for i, v, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v in kept]
    w = len(whole[0]) // parts
    cut = [[v[p * w : p * w + w] for v in whole] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            codes = [near(x, books[p])[1] for x in cut[p]]
            for k in range(len(books[p])):
                mine = [x for x, c in zip(cut[p], codes) if c == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [[near(x, books[p]) for x in cut[p]] for p in range(parts)]
    out = [(kept[i][0], bytes(final[p][i][1] for p in range(parts)), sum(final[p][i][0] for p in range(parts))) for i in range(len(kept))]
    return out, books


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.002), (3, 30.0)])
def test_codes_equal_lloyd(spark, seed, spread):
    """Small spreads give many equal distances: ties between entries and equal entries."""
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) if rng.random() < 0.9 else 0.0 for _ in range(32)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(7, rows[7][1], 5), (None, rows[8][1], None), (None, rows[9][1], 1)]
    got = vector_codes.fit_codes(vectors(spark, rows).repartition(3))
    want, books = lloyd(rows)
    assert got.books == books
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.id, bytes(r.code), r.error) for r in got.rows.collect()), key=key) == sorted(want, key=key)


def test_bounds_save_distances_and_lose_nothing():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-9, 9, (400, 4)) + c for c in rng.integers(-900, 900, (16, 4))]).astype(np.int64)
    book = x[rng.permutation(len(x))[:16]].copy()
    group = vector_codes.grouped(book)
    assert set(group) == set(range(vector_codes.GROUPS))
    code, upper, lower = np.zeros(len(x), np.uint8), np.full(len(x), np.inf, np.float32), np.zeros((len(x), group.max() + 1), np.float32)
    spent = []
    for _ in range(8):
        spent.append(vector_codes.assign(x, book, group, code, upper, lower))
        assert (code == ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
        new = np.stack([x[code == k].sum(0) // max(1, (code == k).sum()) if (code == k).any() else book[k] for k in range(16)])
        drift = np.nextafter(np.sqrt(((new - book) ** 2).sum(1)), np.inf)
        upper[:] = vector_codes._up(upper.astype(float) + drift[code])
        for g in range(lower.shape[1]):
            lower[:, g] = vector_codes._down(lower[:, g].astype(float) - drift[group == g].max())
        book = new
    assert spent[0] >= 16 * len(x) and spent[-1] < 4 * len(x)


def test_vector_cases(spark):
    ok = [0.5] * 16
    rows = [
        (1, ok, 1), (2, None, 1), (3, [0.5] * 15 + [None], 1), (4, [float("nan")] * 16, None), (5, [float("inf")] + ok[1:], 2), (6, ok, None), (6, ok, None),
        (7, [1.0] * 8, 3), (8, [], 3), (9, [3e38] * 16, 4), (10, [0.25] * 16, None),
    ]
    got = {}
    for r in vector_codes.vector_codes(vectors(spark, rows)).collect():
        got.setdefault(r.vec_id, []).append((r.label, None if r.code is None else r.code.hex(), r.error, r.label_error))
    assert set(got) == {1, 6, 7, 8, 9, 10}
    assert got[6] == [(None, "00" * 8, 0, 0)] * 2 and got[10] == [(None, "03" * 8, 0, 0)]  # equal entries: the lowest index
    assert got[7] == [(3, None, None, None)] and got[8] == [(3, None, None, None)] and got[9] == [(4, None, None, None)]
    for none in (vectors(spark, rows).limit(0), vectors(spark, [(1, None, 1)])):
        assert vector_codes.vector_codes(none).count() == 0
    assert vector_codes.fit_codes(vectors(spark, [(1, [1.0, 2.0, 3.0], 1)]), parts=3, entries=4).books == [[[4096]], [[8192]], [[12288]]]


def all_runs(w, least=6, exponent=4):
    """Each period by itself; of equal stretches the smallest period."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def random_words(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randint(0, 80))]
    for _ in range(rng.randint(0, 3)):
        if w:
            a, p = rng.randrange(len(w)), rng.randint(1, 7)
            w[a : a + rng.randint(0, 20)] = (w[a : a + p] * 20)[: rng.randint(4, 40)]
    if rng.random() < 0.3:
        w = w[: rng.randint(0, 30)] * rng.randint(1, 6)
    return w + w[: rng.randint(0, len(w))] if rng.random() < 0.3 else w


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (3, 3), (9, 2), (1, 5)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(exponent)
    for _ in range(400):
        w = random_words(rng)
        want = all_runs(w, least, exponent)
        assert sorted((s, e - s, q) for s, e, q in runs.runs(w, least, exponent)) == want
        assert runs.text_runs([b"%d" % x for x in w], least, exponent) == sorted(want, key=lambda r: (r[0], r[2]))


def test_factors_occur_earlier():
    rng = random.Random(9)
    for _ in range(100):
        w, at = random_words(rng), 0
        for (b, earlier), nxt in zip(cuts := runs.factors(w), [*(c[0] for c in cuts[1:]), len(w)] if cuts else []):
            size = nxt - b
            if earlier < 0:
                assert size == 1 and w[b] not in w[:b]
            else:
                assert earlier < b and w[earlier : earlier + size] == w[b:nxt]
                assert nxt == len(w) or not any(w[s : s + size + 1] == w[b : nxt + 1] for s in range(b))
            assert b == at
            at = nxt


def test_periodic_runs_of_a_table(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in random_words(rng))) for i in range(120)] + [(1, "x " * 7), (None, "a b " * 6 + "\n\t a c")] + EDGE
    got = runs.periodic_runs(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = all_runs(w) if len(w) < 2000 else [(0, len(w), 3)] if i == 9 else []
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        want.append((i, len(w), sorted(found, key=lambda r: (r[0], r[2])), " ".join(x for k, x in enumerate(w) if k not in gone)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert runs.periodic_runs(docs(spark, rows).limit(0)).count() == 0


def test_nested_runs_collapse():
    """A run inside the first period of another loses its own repeats."""
    w = (["a"] * 6 + ["b", "c"]) * 5
    found = runs.text_runs([x.encode() for x in w])
    assert (0, 40, 8) in found and (0, 6, 1) in found and (32, 6, 1) in found


def test_long_periodic_text():
    w = [b"%d" % (i % 700) for i in range(60_000)]
    assert runs.text_runs(w) == [(0, 60_000, 700)]
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 3000:
        fib = fib[1], fib[1] + fib[0]
    assert runs.text_runs(fib[1], 2, 2) == [(s, m, q) for s, m, q in sorted(all_runs(fib[1], 2, 2), key=lambda r: (r[0], r[2]))]


def test_planted_tails(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "one two three")]
    got = {r.doc_id: r.text for r in queries.with_planted_runs(docs(spark, rows)).collect()}
    for i, text in rows:
        w, h = text.split(), 0 if i is None else zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        assert (got[i] or "").split() == w


def brute_hits(texts, items, window=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    cuts = [(str(k) if k is not None else "", w[i : i + window]) for k, t in items if (w := low(t)) for i in range(max(1, len(w) - window + 1))]
    out = []
    for i, t in texts:
        w, hit, ids = low(t), set(), set()
        for k, c in cuts:
            for at in range(len(w) - len(c) + 1):
                if w[at : at + len(c)] == c:
                    hit |= set(range(at, at + len(c)))
                    ids.add(k)
        out.append((i, len(w), len(hit), sorted(ids), sorted(hit)))
    return out


ITEMS = "item_id long, text string, doc_id long, words string, row int, hash long"


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 2, 3) for r in rows], ITEMS)


def contaminated_rows(seed=2, n=80):
    rng = random.Random(seed)
    v = ["Wörd", "it's", "a-b", "x9", "THE"] + [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([1, 3, 4, 7, 10, 12, 25])))) for i in range(30)]
    items = [(i, t) for i, t in items if len(t.split()) > 2] + [(3, items[4][1]), (900, items[4][1]), (None, items[5][1] + " q"), (901, None), (902, "--"), (903, "z " * 14), (904, "solo")]
    texts = []
    for i in range(n):
        t = " ".join(rng.choices(v, k=rng.randint(0, 60))).split()
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or "").lower().split()
            at, cut = rng.randint(0, len(t)), rng.choice([0, 0, 1])
            t[at:at] = own[cut:]
        texts.append((i, "  \n".join(t) if i % 3 else " ".join(t).upper()))
    return items, texts + [(5, None), (None, "z " * 30), (None, ""), (77, "Solo z" * 3)]


def test_contamination_equals_brute_force(spark):
    items, texts = contaminated_rows()
    got = decontaminate.contamination(docs(spark, texts).repartition(3), items_of(spark, items)).collect()
    shown = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), [k for s in r.spans for k in range(s.start, s.end)]) for r in got]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(shown, key=key) == sorted(brute_hits(texts, items), key=key)
    assert sum(r[2] > 0 for r in shown) > 20 and sum(r[2] == 0 for r in shown) > 10


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    """Beyond the broadcast bound, and with a bitmap that lets everything through."""
    items, texts = contaminated_rows(3, 50)
    want = sorted(map(str, decontaminate.contamination(docs(spark, texts), items_of(spark, items)).collect()))
    monkeypatch.setattr(decontaminate, "with_small", lambda df, small, on, how="inner", **k: df.join(small, on, how))
    monkeypatch.setattr(decontaminate, "_bitmap", lambda tokens, bits: np.full(bits // 8, 255, np.uint8))
    assert sorted(map(str, decontaminate.contamination(docs(spark, texts), items_of(spark, items)).collect())) == want


def test_share_of_shingles(spark):
    rng = random.Random(6)
    item = [f"u{i}" for i in range(30)]
    texts = []
    for i in range(60):
        t = [f"n{rng.randrange(50)}" for _ in range(40)]
        own = list(item[(a := rng.randrange(20)) : a + 10])
        for _ in range(i % 4):
            own[rng.randrange(10)] = "new"
        t[12:12] = own
        texts.append((i, " ".join(t)))
    got = {r.doc_id: [k for s in r.spans for k in range(s.start, s.end)] for r in decontaminate.contamination(docs(spark, texts), items_of(spark, [(1, " ".join(item))]), shingle=3, share=0.5).collect()}
    cuts = [item[i : i + 10] for i in range(21)]
    for i, t in texts:
        w, hit = t.split(), set()
        for c in cuts:
            for at in range(len(w) - 9):
                if sum(w[at + k : at + k + 3] == c[k : k + 3] for k in range(8)) >= 4:
                    hit |= set(range(at, at + 10))
        assert got[i] == sorted(hit), i


def test_decontamination_cases(spark):
    items, texts = contaminated_rows(4, 30)
    hit = [r[2] > 0 for r in brute_hits(texts, items)]
    left = decontaminate.decontaminated(docs(spark, texts), items_of(spark, items))
    assert left.columns == docs(spark, texts).columns and left.count() == hit.count(False)
    assert decontaminate.contamination(docs(spark, texts), items_of(spark, items).limit(0)).filter("n_hit > 0 or size(items) > 0").count() == 0
    assert decontaminate.contamination(docs(spark, texts).limit(0), items_of(spark, items)).count() == 0
    assert decontaminate.contamination(docs(spark, EDGE), items_of(spark, [(1, "A b C")])).filter("n_hit = 90000").count() == 1


def test_hashes_of_shingles_depend_on_order():
    h = np.array([1, 2, 3, 1, 2], np.uint64)
    got = decontaminate.shingle_hashes(h, 2)
    assert got[0] == got[3] and len(set(got.tolist())) == 3 and len(decontaminate.shingle_hashes(h, 6)) == 0


@pytest.mark.parametrize("name,columns", [
    ("op11_vector_codes", ["vec_id", "code", "error", "label_error", "codebooks_sha256"]),
    ("op12_periodic_runs", ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]),
    ("op13_decontamination", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
])
def test_query_columns(spark, sf, name, columns):
    out = queries.QUERIES[name](spark, sf)
    assert out.columns == columns and all(t != "string" or len(v) in (16, 64) for (c, t), v in zip(out.dtypes, out.first()))


def test_digests_of_runs(spark, tmp_path):
    docs(spark, [(2, "x y " * 5), (4, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {zlib.crc32(b"2") % 10, zlib.crc32(b"4") % 10} & {0} == set()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert tuple(got[2])[1:] == (1, 0, 10, 2, 5000, sha("0,10,2\n"), sha("x y")) and tuple(got[4])[1:] == (0, None, None, None, None, sha(""), sha(""))
