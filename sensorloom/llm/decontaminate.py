"""Benchmark decontamination: a prefix-filtered set join of item windows with texts.

An item is cut into windows of consecutive words (an item of fewer words is one window), a window into shingles.
Windows and texts share a shingle wherever the text holds the window, so it is enough to join some of them:

1. *Tokens*: the hashes of all windows' shingles. A bitmap of fixed size, built by Spark's bitmap aggregate, lets
   a task that reads texts pass over shingles no item has. What may be one leaves the task once, with the words
   around it: a text's marked places and its snippets, never the text.
2. *Rarity*: places are joined with the tokens and counted. A token no text has ends its window there and then.
3. *Prefixes*: a window of ``n`` shingles, ``c`` of which must stand in the text, needs its ``n - c + 1`` rarest
   only; any text that holds ``c`` holds one of these. With ``share = 1`` that is the rarest alone.
4. *Bounds*: a shingle at ``offset`` puts the window at one place of the text; it must begin and end inside it.
5. *Verification*: the words of the snippet at that place against those of the window.

Equal windows of several items are joined once; items come in after verification.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persist, row_key, small_batches, stable, with_small

WINDOW, SHINGLE, SHARE = 10, 5, 1.0
#: Bits of the bitmap: 4 MB, whatever the items are.
BITS = 2**25
#: Everything but 0-9, a-z and what is not ASCII separates words, after A-Z went to lower case.
_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_STEP = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class _Hashes(dict):
    """64-bit hashes of words; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(hashes, size: int):
    """The hash of each ``size`` neighbouring words, from the words' hashes (uint64)."""
    import numpy as np

    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out ^ hashes[i : i + n]) * np.uint64(_STEP)
        out ^= out >> np.uint64(29)
    return out


def _hashed(list_of_words, memory: _Hashes):
    import numpy as np

    return np.fromiter(map(memory.__getitem__, list_of_words), np.uint64, len(list_of_words))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Per row of ``items`` and window in it: ``item`` and the window's ``words``, ``size`` (words of a shingle), ``hashes``."""
    import pyarrow as pa

    def cut(batches):
        memory = _Hashes()
        for batch in batches:
            rows: list[int] = []
            texts, sizes, hashes = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                w = words(text)
                if not w:
                    continue
                k = min(shingle, len(w), window)
                h, many = shingle_hashes(_hashed(w, memory), k).view("int64"), min(window, len(w)) - k + 1
                for at in range(max(1, len(w) - window + 1)):
                    rows.append(i)
                    texts.append(b" ".join(w[at : at + window]).decode("utf-8", "surrogatepass"))
                    sizes.append(k)
                    hashes.append(h[at : at + many].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
                ["item", "words", "size", "hashes"],
            )

    narrow = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(cut, "item string, words string, size int, hashes array<long>")


def _bitmap(tokens: DataFrame, bits: int):
    """Which hashes, modulo ``bits``, the tokens have: 4 KB from each of ``bits / 32768`` groups."""
    import numpy as np

    place = F.pmod(F.col("hash"), F.lit(bits))
    parts = tokens.groupBy(F.floor(place / 32768).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("set"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = np.frombuffer(r["set"], np.uint8)
    return out


def marked_places(df: DataFrame, id_col: str, text_col: str, window: int, sizes: list[int], bitmap) -> DataFrame:
    """Per row: ``row``, its id, ``n_words`` and ``snippets``: ``first`` (a word's number), ``words`` and the ``places``
    (``at`` from the snippet's first word, ``hash``) of shingles that may be tokens."""
    import pyarrow as pa

    place = pa.struct([("at", pa.int32()), ("hash", pa.int64())])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.list_(pa.string())), ("places", pa.list_(place))]))
    shared = df.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    bits = len(bitmap) * 8

    def mark(batches):
        import numpy as np

        memory, known = _Hashes(), np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            counts, found = [], []
            for text in batch.column("text").to_pylist():
                w = words(text)
                hashes, at, own = _hashed(w, memory), [], []
                for size in sizes:
                    h = shingle_hashes(hashes, size)
                    slot = h & np.uint64(bits - 1)
                    hit = np.flatnonzero(known[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    at.append(hit)
                    own.append(h[hit])
                at, own = np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(own or [np.zeros(0, np.uint64)])
                order = np.argsort(at, kind="stable")
                at, own = at[order], own[order].view(np.int64)
                snippets = []
                if len(at):
                    for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * window) + 1):
                        low, high = max(0, int(at[run[0]]) - window), min(len(w), int(at[run[-1]]) + window)
                        text_words = [x.decode("utf-8", "surrogatepass") for x in w[low:high]]
                        places = [{"at": int(at[i]) - low, "hash": int(own[i])} for i in run]
                        snippets.append({"first": low, "words": text_words, "places": places})
                counts.append(len(w))
                found.append(snippets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(counts, pa.int64()), pa.array(found, kind)], ["row", "id", "n_words", "snippets"]
            )

    narrow = df.select(row_key().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    snippets = "array<struct<first:int,words:array<string>,places:array<struct<at:int,hash:long>>>>"
    return narrow.mapInArrow(mark, f"row long, id {dict(df.dtypes)[id_col]}, n_words long, snippets {snippets}")


def found_windows(places: DataFrame, windows: DataFrame, window: int, share: float = SHARE) -> DataFrame:
    """``row``, ``start``, ``n`` (words) and ``window`` of every occurrence.

    ``places``: what :func:`marked_places` gives; ``windows``: one row per distinct window of at most ``window``
    words: its number ``window``, ``words``, ``size`` and ``hashes``.
    """
    each = places.select("row", "n_words", F.explode("snippets").alias("s"))
    each = each.select("row", "n_words", "s.first", "s.words", F.explode("s.places").alias("p"))
    tokens = windows.select("window", F.posexplode("hashes").alias("offset", "hash"))
    counts = with_small(each.select("p.hash"), persist(tokens.select("hash").distinct(), "tokens"), "hash")
    counts = persist(counts.groupBy("hash").agg(F.count(F.lit(1)).alias("seen")), "rarity")

    # the tokens of a window, at most as many as it has words, rarest first
    weighed = with_small(tokens, counts, "hash", "left").select("window", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "hash", "offset").alias("t"))
    rare = weighed.groupBy("window").agg(F.array_sort(F.collect_list("t")).alias("rare"))
    need = F.ceil(F.size("hashes") * F.lit(float(share)) - F.lit(1e-9)).cast("int")
    whole = windows.select("window", "size", need.alias("need"), F.split("words", " ").alias("text")).join(rare, "window")
    prefix = F.slice("rare", F.lit(1), F.size("rare") - F.col("need") + 1)
    whole = whole.select("window", "size", "need", "text", F.explode(prefix).alias("t")).filter("t.seen > 0")
    prefixes = persist(whole.select("window", "size", "need", "text", "t.hash", "t.offset"), "prefixes")

    # a place takes along the words around it, as far as a window reaches
    low = F.greatest(F.col("p.at") - window, F.lit(0))
    near = each.select(
        "row", "n_words", "p.hash", (F.col("first") + F.col("p.at")).alias("place"), (F.col("p.at") - low).alias("at"),
        F.slice("words", low + 1, F.lit(2 * window)).alias("words"),
    )
    n = F.size("text")
    met = with_small(near, prefixes, "hash", weight=n).withColumn("start", F.col("place") - F.col("offset"))
    met = met.filter((F.col("start") >= 0) & (F.col("start") + n <= F.col("n_words")))
    there = F.slice("words", F.col("at") - F.col("offset") + 1, n)
    if share >= 1:
        return met.filter(there == F.col("text")).select("row", "start", n.alias("n"), "window")
    same = lambda i: F.slice(there, i + 1, F.col("size")) == F.slice("text", i + 1, F.col("size"))
    shared = F.size(F.filter(F.sequence(F.lit(0), n - F.col("size")), same))
    return met.filter(shared >= F.col("need")).select("row", "start", n.alias("n"), "window").distinct()


def _spans(found: DataFrame) -> DataFrame:
    """Per row the stretches of words that occurrences cover, and their words. A row's occurrences meet in one
    group; they are bounded by the text's words."""
    w = Window.partitionBy("row").orderBy("start", "end")
    covered = found.select("row", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    covered = covered.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    covered = covered.withColumn("span", F.sum((F.coalesce("before", F.lit(-1)) < F.col("start")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = covered.groupBy("row", "span").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    return spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _contaminated(df, items, id_col, text_col, item_col, item_text_col, window, shingle, share) -> DataFrame:
    if not (1 <= shingle <= window and 0 < share <= 1):
        raise ValueError("a shingle has 1 word at least and fits into a window; a share lies above 0 and reaches 1")
    small_batches(df.sparkSession)
    all_windows = persist(item_windows(items, item_col, item_text_col, window, shingle), "item-windows")
    distinct = all_windows.groupBy("words").agg(F.first("size").alias("size"), F.first("hashes").alias("hashes"))
    windows = persist(distinct.select(F.monotonically_increasing_id().alias("window"), "words", "size", "hashes"), "windows")
    members = all_windows.select(F.coalesce("item", F.lit("")).alias("item"), "words").distinct().join(windows.select("window", "words"), "words")
    members = persist(members.select("item", "window"), "members")

    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most one per word of a shingle
    bitmap = _bitmap(windows.select(F.explode("hashes").alias("hash")), BITS)
    marked = persist(marked_places(df, id_col, text_col, window, sizes, bitmap), "marked", "zstd")
    found = persist(found_windows(marked, windows, window, share), "found")
    pairs = with_small(found.select("row", "window").distinct(), members, "window").select("row", "item").distinct()
    items_of = pairs.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = persist(_spans(found).join(items_of, "row"), "hit")
    out = with_small(marked.select("row", "id", "n_words"), hit, "row", "left", weight=1 + F.size("spans") + F.size("items"))
    none = F.array()
    return out.select(
        "row", "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("spans", none.cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"),
    )


def contamination(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, share: float = SHARE,
) -> DataFrame:
    """One row per row of ``df``: its id, ``n_words``, ``n_hit`` (words inside occurrences of windows), ``spans``
    (their stretches: number of the first word, and end) and ``items`` (ids as strings, sorted, once each).

    Words are stretches of 0-9, a-z and characters beyond ASCII, after A-Z went to lower case. A text holds a
    window if ``share`` of its shingles stand where they stand in the window; at 1 if all its words do. Null
    and empty texts have no words; items without words have no windows. Null and repeated ids of ``df`` are
    treated row by row; rows of ``items`` with equal ids are one item, null ids are the item ''. Equal windows
    of several items count for each. Either table may be empty. Other columns are not read.
    """
    out = _contaminated(df, items, id_col, text_col, item_col, item_text_col, window, shingle, share)
    return out.drop("row").withColumnRenamed("id", id_col)


def decontaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 0, **settings) -> DataFrame:
    """The rows of ``df``, with all their columns, of whose words at most ``most`` are hit. Settings and cases as for
    :func:`contamination`."""
    df = stable(df)
    args = {"item_col": "item_id", "item_text_col": "text", "window": WINDOW, "shingle": SHINGLE, "share": SHARE} | settings
    out = _contaminated(df, items, id_col, text_col, **args)
    gone = persist(out.filter(F.col("n_hit") > most).select(F.col("row").alias("_this_row")), "contaminated")
    rows = df.select(F.struct("*").alias("_all")).withColumn("_this_row", row_key())
    return with_small(rows, gone, "_this_row", "left_anti").select("_all.*")
