"""Periodic runs of a text's words, by factorisation.

A run of period ``q`` is a stretch of words, each equal to the word ``q`` places before it, that no neighbouring
word extends, and that has no smaller period. Per document:

1. A run repeats its words within ``q`` places, so a stretch whose gaps to the word's last occurrence are too
   wide for its length holds none. Such words split the text (:func:`stretches`); prose mostly falls apart.
2. Each stretch is cut into Lempel-Ziv factors: the longest part that begins earlier as well, found with a
   suffix automaton that knows where each of its states first ends.
3. Runs that cross or touch a border of factors come from common extensions on both sides of the border, one
   pair per period (Main). A run of exponent ``e`` reaches less than one period beyond the factor before the
   border, as that factor would have been longer otherwise; so periods are bounded by the two factors.
4. All other runs lie inside a factor and are copied from its earlier occurrence (Kolpakov and Kucherov).

Everything is linear in the words of a stretch, but for the sorting of words.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAST_WORDS, EXPONENT = 6, 4
PASSES = 64


def factors(w: list[int]) -> list[tuple[int, int]]:
    """``(start, earlier)`` of each factor; ``earlier`` is where it first occurs, -1 for a new word alone."""
    n = len(w)
    go: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        state = len(go)
        go.append({})
        length.append(i + 1)
        end.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = state
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 != length[q]:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                end.append(end[q])
                link.append(link[q])
                link[q] = twin
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                q = twin
            link[state] = q
        last = state
    out, b = [], 0
    while b < n:
        state, size, earlier = 0, 0, -1
        while b + size < n:
            state = go[state][w[b + size]]
            first = end[state] - size
            if first >= b:
                break
            earlier, size = first, size + 1
        out.append((b, earlier))
        b += max(size, 1)
    return out


def _prefixes(x: list[int]) -> list[int]:
    """For each place, how many words from there on equal the beginning."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(w: list[int], at: int, before: int, after: int, least: int, exponent: int):
    """Stretches of one period around the border ``at``; the factors around it begin and end at ``before`` and ``after``."""
    most = (after - before - 1) // (exponent - 1)
    low = max(0, before - most)
    left, right = w[low:at][::-1], w[at:after]
    n_left, n_right = len(left), len(right)
    ahead = _prefixes(right + [-1] + w[low:after])  # words after any place that equal those after the border
    back = _prefixes(left + [-1] + w[low:after][::-1])  # words before any place that equal those before the border
    for q in range(1, most + 1):
        need = max(least, exponent * q)
        for place in (at + q, at - q):  # the border meets the place one period on, or one period back
            if not low <= place <= after:
                continue
            on = ahead[n_right + 1 + place - low] if place < after else 0
            off = back[n_left + 1 + after - place] if place > low else 0
            start, end = min(at, place) - off, max(at, place) + on
            if end - start >= need:
                yield start, end, q


def runs(w: list[int], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of ``w`` as (start, end, period), end exclusive, of ``max(least, exponent * period)`` words or more."""
    n = len(w)
    if n < least:
        return []
    cuts = factors(w)
    borders = [b for b, _ in cuts] + [n]
    found: dict[tuple[int, int], int] = {}
    for i in range(1, len(borders)):
        at, after = borders[i], borders[i + 1] if i + 1 < len(borders) else n
        if after - borders[i - 1] < min(least, 2 * exponent) - 1:
            continue
        for start, end, q in _crossing(w, at, borders[i - 1], after, least, exponent):
            whole = (start == 0 or w[start - 1] != w[start - 1 + q]) and (end == n or w[end] != w[end - q])
            if whole and q < found.get((start, end), n):
                found[start, end] = q
    known = sorted((s, e, q) for (s, e), q in found.items())
    for i, (b, earlier) in enumerate(cuts):
        stop = borders[i + 1]
        if earlier < 0 or stop - b < least + 2:
            continue
        shift, at = b - earlier, bisect_left(known, (earlier + 1,))
        while at < len(known) and known[at][0] < stop - shift:  # copies join the list and are met in turn
            s, e, q = known[at]
            if e < stop - shift and (s + shift, e + shift) not in found:
                found[s + shift, e + shift] = q
                insort(known, (s + shift, e + shift, q))
            at += 1
    return known


def stretches(ids, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Where runs can be at all, as disjoint (start, end).

    In a run of ``m`` words and period ``q`` all words but the first ``q`` stand at most ``q`` places after
    their last occurrence, and these are ``m - q >= (exponent - 1) * q`` words. So a word whose gap times
    ``exponent - 1`` exceeds the length of its stretch is in no run's later words, and splits the stretch.
    Parts are looked at again until ``PASSES`` times all words have been read; what is left then stays whole.
    """
    import numpy as np

    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    gap = np.full(n, n + 1, np.int64)
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    share, least_rest = exponent - 1, min(least - 1, 2 * exponent - 2)
    out, todo, read = [], [(0, n)], 0
    while todo:
        a, b = todo.pop()
        if b - a < least_rest:
            continue
        wide = np.flatnonzero(gap[a:b] * share > b - a) if read <= PASSES * n else ()
        read += b - a
        if not len(wide):
            out.append((max(0, a - (b - a) // share), b))
            continue
        edges = np.concatenate(([-1], wide, [b - a])) + a
        long = np.flatnonzero(np.diff(edges) - 1 >= least_rest)
        todo += [(int(edges[i]) + 1, int(edges[i + 1])) for i in long]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def text_runs(words: list[bytes], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """The runs of a text as (start, length, period), by start and period."""
    import numpy as np

    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    out, n = [], len(ids)
    for a, b in stretches(np.array(ids, np.int64), least, exponent):
        for s, e, q in runs(ids[a:b], least, exponent):
            s, e = s + a, e + a
            if (s == 0 or ids[s - 1] != ids[s - 1 + q]) and (e == n or ids[e] != ids[e - q]):
                out.append((s, e - s, q))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, exponent: int = EXPONENT
) -> DataFrame:
    """One row per row: the id, ``n_words``, ``runs`` by start and then period, and ``collapsed``.

    ``collapsed`` holds the words outside all runs and the first period of each run, unless another run takes
    them, joined by one space. Runs have at least ``max(least, exponent * period)`` words; ``exponent`` is a
    whole number from 2 on. Null, empty and blank texts have no words, no runs and an empty ``collapsed``.
    Null and repeated ids are treated row by row; ties cannot arise, as no two runs share start and period.
    An empty table gives an empty result. Only the two named columns are read; no row is shuffled. A text is
    handled whole in one task, in memory in proportion to its longest stretch that can hold a run.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches):
        for batch in batches:
            counts, found, kept = [], [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()  # at space and U+0009 to U+000D
                got = text_runs(words, least, exponent)
                counts.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in got])
                rest, at = [], 0
                for gone, end in sorted((s + q, s + m) for s, m, q in got):
                    rest += words[at:gone]
                    at = max(at, end)
                kept.append(b" ".join(rest + words[at:]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )

    small_batches(df.sparkSession)
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(narrow.dtypes)['id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return narrow.mapInArrow(find, schema).withColumnRenamed("id", id_col)
