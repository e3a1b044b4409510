"""MinHash near-deduplication.

1. *Signatures*: every whole text becomes its set of word shingles (64-bit hashes) and the minima of
   many universal hash functions over that set. Rows with equal sets form a class at once.
2. *Banding*: classes whose signatures agree in a band share a bucket. Every class is compared with
   the first class of each of its buckets, so a bucket gives as many candidates as it has members.
3. *Verification*: the signature first (a byte of each minimum, a bound six standard deviations wide),
   then the full sets.
4. *Components* of the verified links, by alternating large-star and small-star.
5. *The rest of the buckets*: a bucket whose members lie in several components may hide links that
   avoid its first member. All members of such buckets are compared on their full sets, in blocks, by
   counting shared shingles with matrix products; a block pair returns no more than a spanning forest
   of the links it finds. The components over these links are final.

So no bucket is capped, no link between members of one bucket is missed, and neither buckets nor groups
are expanded into pairs of rows. What is left to chance is that two similar texts share no bucket: at
the threshold itself about 2e-8 with 30 bands of 5, less above it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, by_key, persist, row_key, small_batches, stable, with_small
from .components import connected_components

_SEED = 20240229
_FEW = 1_000_000  # ids of rows, 8 bytes each, that may be broadcast
_CHUNK = 2048  # shingles hashed at a time: the work area stays in the cache
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Near:
    """``percent``: least similarity, in hundredths; ``words``: words of a shingle."""

    words: int = 5
    percent: int = 80
    bands: int = 30
    block: int = 512

    @property
    def rows(self) -> int:
        """The most rows of a band for which a pair at the threshold is missed once in 10 million."""
        s = self.percent / 100
        fits = [r for r in range(1, 11) if (1 - s**r) ** self.bands <= 2e-7]
        return max(fits, default=1)

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def agree(self) -> int:
        """Equal minima below which a pair cannot reach the threshold, by six standard deviations."""
        s = self.percent / 100
        return math.floor(self.hashes * s - 6 * math.sqrt(self.hashes * s * (1 - s)))


class Shingler:
    """Shingle sets of texts: word hashes from prefix sums over all bytes of a batch, in NumPy."""

    def __init__(self, words: int) -> None:
        rng = np.random.default_rng(_SEED)
        self.words = words
        self.bytes = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.places = rng.integers(0, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 1 << 16)
            for name, b in (("power", self.base), ("inverse", pow(self.base, -1, 2**64))):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x

    def word_hashes(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text.translate(ASCII_LOWER), np.uint8)
        edge = np.flatnonzero(np.diff(_SPACES[raw], prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        self._powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.bytes[raw] * self.power[: len(raw)], out=sums[1:])
        return self._mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingle hashes; a text of fewer words is one shingle, without words none."""
        h = self.word_hashes(text)
        k = min(self.words, len(h))
        if not k:
            return h
        out = np.full(len(h) - k + 1, np.uint64(k) if k < self.words else np.uint64(0))
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * self.places[i]
        return np.unique(self._mix(out))


class Minima:
    """Minima of the universal hash functions a * x + b over 32 bits."""

    def __init__(self, hashes: int) -> None:
        rng = np.random.default_rng(_SEED + 1)
        self.a = rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, hashes, dtype=np.uint32)
        self.work = np.empty((_CHUNK, hashes), np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), _CHUNK):
            part = x[at : at + _CHUNK, None]
            work = self.work[: len(part)]
            np.multiply(part, self.a, out=work)
            work += self.b
            np.minimum(out, work.min(axis=0), out=out)
        return out


def _signed(df: DataFrame, id_col: str, text_col: str, near: Near) -> DataFrame:
    """Per row: ``row, id, n, key`` (of the set), ``bands`` (a 64-bit key each), ``check`` (the low byte of
    each minimum) and the compressed text. Written once."""
    import pyarrow as pa

    schema = f"row long, id {dict(df.dtypes)[id_col]}, n long, key binary, bands binary, check binary, packed binary"

    def sign(batches):
        import hashlib

        import zstandard
        from pyspark import TaskContext

        shingler, minima, press = Shingler(near.words), Minima(near.hashes), zstandard.ZstdCompressor(level=3)
        rng = np.random.default_rng(_SEED + 2)
        mult = rng.integers(0, 2**63, near.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offset = rng.integers(0, 2**64, near.bands, dtype=np.uint64)
        names = ("row", "n", "key", "bands", "check", "packed")
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = {k: [] for k in names}
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingler.shingles(text or b"")
                values = (row, 0, None, None, None, None)
                if len(s):
                    m = minima(s)
                    bands = (m.reshape(near.bands, near.rows).astype(np.uint64) * mult).sum(axis=1, dtype=np.uint64)
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    bands = Shingler._mix(bands + offset).tobytes()
                    values = (row, len(s), key, bands, m.astype(np.uint8).tobytes(), press.compress(text))
                for k, v in zip(names, values):
                    out[k].append(v)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["row"], pa.int64()),
                    batch.column("id"),
                    pa.array(out["n"], pa.int64()),
                    *(pa.array(out[k], pa.binary()) for k in names[2:]),
                ],
                ["row", "id", *names[1:]],
            )

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return persist(narrow.mapInArrow(sign, schema), "signed")


def _bands(classes: DataFrame, near: Near) -> DataFrame:
    """``(bucket, row)`` for each band of each class."""
    import pyarrow as pa

    def band(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            rows = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), near.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows)], ["bucket", "row"])

    return classes.select("row", "bands").mapInArrow(band, "bucket long, row long")


def _checked(pairs: DataFrame, near: Near) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets reach the threshold."""
    import pyarrow as pa

    def check(batches):
        import zstandard

        shingler, unpress = Shingler(near.words), zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def shingles(row, packed):
            if row not in known:
                if len(known) > 256:
                    known.clear()
                known[row] = shingler.shingles(unpress.decompress(packed))
            return known[row]

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("u", "v", "mu", "mv", "pu", "pv")]
            good = []
            for u, v, mu, mv, pu, pv in zip(*cols):
                if np.count_nonzero(np.frombuffer(mu, np.uint8) == np.frombuffer(mv, np.uint8)) < near.agree:
                    continue
                a, b = shingles(u, pu), shingles(v, pv)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= near.percent * (len(a) + len(b) - both):
                    good.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], ["u", "v"])

    return pairs.mapInArrow(check, "u long, v long")


def _links_in_blocks(members: DataFrame, near: Near) -> DataFrame:
    """Links between components, as pairs of component ids, from all members of each bucket.

    ``members``: bucket, x, y (the pair of blocks), side (0: block x, 1: block y), row, part
    (the component), packed. Each (bucket, x, y) is compared as a whole in one task and holds two blocks.
    """
    import pyarrow as pa

    def compare(batches):
        import zstandard

        shingler, unpress = Shingler(near.words), zstandard.ZstdDecompressor()
        us, vs = [], []
        for (_, x, y), t in by_key(batches, ["bucket", "x", "y"]):
            side = np.array(t.column("side").to_pylist())
            part = np.array(t.column("part").to_pylist(), np.int64)
            if (part == part[0]).all():
                continue
            sets = [shingler.shingles(unpress.decompress(p)) for p in t.column("packed").to_pylist()]
            left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == (0 if x == y else 1)))
            for u, v in _forest(sets, part, left, right, near):
                us.append(u)
                vs.append(v)
            if len(us) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return members.mapInArrow(compare, "u long, v long")


def _forest(sets: list, part: np.ndarray, left: np.ndarray, right: np.ndarray, near: Near):
    """A spanning forest, over components, of the links between two blocks of sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[token] > 1
    owner, token = owner[shared], token[shared]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    width = max(1, (16 << 20) // (4 * len(sets)))  # tokens at a time: about 16 MB
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        lo, hi = np.searchsorted(token, (at, at + width))
        grid = np.zeros((len(sets), min(width, int(token[-1]) + 1 - at)), np.float32)
        grid[owner[lo:hi], token[lo:hi] - at] = 1
        both += grid[left] @ grid[right].T
    joint = both.astype(np.int64)
    total = sizes[left][:, None] + sizes[right][None, :] - joint
    linked = (100 * joint >= near.percent * total) & (part[left][:, None] != part[right][None, :])
    parent: dict[int, int] = {}

    def root(p):
        while (q := parent.get(p, p)) != p:
            parent[p] = parent.get(q, q)
            p = q
        return p

    for i, j in np.argwhere(linked):
        u, v = int(part[left[i]]), int(part[right[j]])
        if (ru := root(u)) != (rv := root(v)):
            parent[max(ru, rv)] = min(ru, rv)
            yield u, v


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near = Near()) -> DataFrame:
    """One row per row of ``df``: its id, ``n_shingles``, ``component_id``, ``kept``, ``_row``.

    ``component_id`` is the smallest id reachable over links, itself included. Null, empty and blank
    texts have no shingles and are linked with nothing. Null ids are passed over in the minimum; a
    component without any id has none, and its first row is kept. Rows that repeat an id share its
    verdict. Only the two named columns are read. An empty table gives an empty result.
    """
    return _grouped(df, id_col, text_col, near).drop("_group")


def _grouped(df: DataFrame, id_col: str, text_col: str, near: Near) -> DataFrame:
    """The rows of :func:`near_groups`, with ``_group``: the same for all rows of a component, null without shingles."""
    spark = df.sparkSession
    small_batches(spark)
    signed = _signed(df, id_col, text_col, near)
    narrow = signed.select("row", "id", "n", "key")
    sets = persist(
        narrow.filter("key is not null").groupBy("key").agg(F.min("row").alias("row"), F.min("id").alias("first_id")), "sets"
    )
    bands = _bands(with_small(signed.select("row", "bands"), sets.select("row"), "row", "left_semi", _FEW), near)
    buckets = bands.groupBy("bucket").agg(F.min("row").alias("v"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = persist(bands.join(buckets, "bucket"), "buckets")
    shared = persist(members.select("row").distinct(), "shared")
    held = persist(with_small(signed.select("row", "check", "packed"), shared, "row", "left_semi", _FEW), "held")

    pairs = members.filter("row <> v").select(F.col("row").alias("u"), "v").distinct()
    u = held.select(F.col("row").alias("u"), F.col("check").alias("mu"), F.col("packed").alias("pu"))
    v = held.select(F.col("row").alias("v"), F.col("check").alias("mv"), F.col("packed").alias("pv"))
    first = connected_components(_checked(pairs.join(u, "u").join(v, "v"), near))

    placed = persist(
        members.select("bucket", "row", "size").join(first.withColumnRenamed("u", "row"), "row", "left")
        .select("bucket", "row", "size", F.coalesce("v", "row").alias("part")), "placed"
    )
    # buckets with the same members, as one text pair shares many bands, are compared once
    mixed = (
        placed.groupBy("bucket")
        .agg(
            F.min("part").alias("p"), F.max("part").alias("q"), F.max("size").alias("size"),
            F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("t"),
        )
        .filter("p <> q").groupBy("size", "s", "t").agg(F.min("bucket").alias("bucket")).select("bucket")
    )
    blocks = F.ceil(F.col("size") / near.block).cast("int")
    own = F.pmod(F.xxhash64("row", F.lit(2)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    spread = (
        placed.join(mixed, "bucket", "left_semi")
        .select("bucket", "row", "part", own.alias("own"), other.alias("other"))
        .select(
            "bucket", "row", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    )
    packed = spread.join(held.select("row", "packed"), "row")
    keys = ["bucket", "x", "y"]
    dealt = packed.repartition(*keys).sortWithinPartitions(*keys)
    second = connected_components(_links_in_blocks(dealt, near))

    firsts = first.select(F.col("u").alias("row"), F.col("v").alias("part"))
    seconds = second.select(F.col("u").alias("part"), F.col("v").alias("whole"))
    lead = sets.join(firsts, "row", "left").withColumn("part", F.coalesce("part", "row"))
    lead = persist(
        lead.join(seconds, "part", "left").select("key", "first_id", F.coalesce("whole", "part").alias("whole")), "whole"
    )
    least = lead.groupBy("whole").agg(F.min("first_id").alias("component_id"))
    named = lead.join(least, "whole").select("key", "component_id", F.col("whole").alias("first_row"))
    out = narrow.join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    same = F.when(component.isNull(), F.col("row") == F.coalesce("first_row", "row")).otherwise(
        F.coalesce(F.col("id") == component, F.lit(False))
    )
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), same.alias("kept"), F.col("row").alias("_row"),
        F.col("first_row").alias("_group"),
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near = Near()) -> DataFrame:
    """The rows of ``df`` that stay, one of each group, with all their columns.

    Of a group the row with the smallest id stays, of several the first; rows without an id come last. Rows
    without shingles stay.
    """
    df = stable(df)
    groups = persist(_grouped(df, id_col, text_col, near).filter("_group is not null").select(F.col(id_col).alias("_id"), "_row", "_group"), "groups")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    firsts = groups.groupBy("_group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = persist(firsts.select("_group", F.col("first")["row"].alias("first")), "firsts")
    gone = with_small(groups, firsts, "_group").filter("_row <> first").select("_row")
    rows = df.select(F.struct("*").alias("_all"), row_key().alias("_row"))
    return with_small(rows, persist(gone, "gone"), "_row", "left_anti").select("_all.*")
