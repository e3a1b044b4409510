"""Vector code compression: product codes by Yinyang Lloyd, in whole numbers.

A vector of whole numbers is cut into equal parts; each part position has a codebook, and a part is coded as
the index of its nearest entry. Codebooks are fitted by Lloyd rounds. A part keeps an upper bound of the
distance to its entry and one lower bound for each group of other entries. When entries move, the bounds move
by their drifts; only parts whose bounds meet are measured again, and of those only the groups whose bound
fails (Ding et al., Yinyang k-means). Bounds are floats rounded away from the decision; every decision a bound
does not settle strictly compares exact squared distances of whole numbers, ties going to the lower index.

The rows of a round, with their codes and bounds, are one table in the shared folder. A task writes its sums
per entry into the same table, so a round reads and writes each row once, and what reaches the driver is one
row per part and entry. The table before is deleted when the next one is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, persist, small_batches, with_small

PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 8, 16, 6, 4096, 4


@dataclass(frozen=True)
class Codes:
    """Coded rows (``id``, ``label``, ``code``, ``error``) and the codebooks by part, entry and position."""

    rows: DataFrame
    books: list[list[list[int]]]


def grouped(entries, groups: int = GROUPS):
    """The group of each codebook entry: a few Lloyd steps over the entries of one part."""
    import numpy as np

    e = np.asarray(entries, np.float64)
    k = max(1, min(groups, len(e)))
    centres = e[np.linspace(0, len(e) - 1, k).astype(int)]
    group = np.zeros(len(e), np.int64)
    for _ in range(5):
        group = ((e[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([e[group == g].mean(0) if (group == g).any() else centres[g] for g in range(k)])
    return group


def _up(x):
    import numpy as np

    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x):
    import numpy as np

    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def assign(x, book, group, code, upper, lower):
    """Codes of parts ``x`` (n x width) in one codebook, in place: ``code`` (n), ``upper`` (n), ``lower`` (n x groups).

    Bounds hold for ``book`` as it is now. Returns the number of distances measured.
    """
    import numpy as np

    measured = 0
    open_ = np.flatnonzero(lower.min(1) <= upper)
    if not len(open_):
        return measured
    own = ((x[open_] - book[code[open_]]) ** 2).sum(1)
    measured += len(open_)
    upper[open_] = _up(np.sqrt(own))
    still = lower[open_].min(1) <= upper[open_]
    open_, own = open_[still], own[still]
    if not len(open_):
        return measured
    best, best_d, old = code[open_].astype(np.int64), own.copy(), code[open_].astype(np.int64)
    failed = lower[open_] <= upper[open_][:, None]
    seen = []
    for g in range(lower.shape[1]):
        rows, members = np.flatnonzero(failed[:, g]), np.flatnonzero(group == g)
        if not len(members):
            lower[:, g] = np.inf
            continue
        if not len(rows):
            continue
        d = ((x[open_[rows]][:, None, :] - book[members][None]) ** 2).sum(2)
        measured += d.size
        first = d.argmin(1)  # the lowest index of the least distance, as members ascend
        near, near_d = members[first], d[np.arange(len(rows)), first]
        better = (near_d < best_d[rows]) | ((near_d == best_d[rows]) & (near < best[rows]))
        best[rows[better]], best_d[rows[better]] = near[better], near_d[better]
        seen.append((g, rows, members, d))
    # an entry that a part has left bounds its group; measured groups are bounded by all but the new entry
    left = best != old
    held = group[old[left]]
    lower[open_[left], held] = np.minimum(lower[open_[left], held], _down(np.sqrt(own[left])))
    for g, rows, members, d in seen:
        rest = np.where(members[None] == best[rows][:, None], np.inf, d)
        lower[open_[rows], g] = _down(np.sqrt(rest.min(1)))
    code[open_] = best
    upper[open_] = _up(np.sqrt(best_d))
    return measured


def _components(vector: Column, scale: int) -> Column:
    """The vector in whole numbers."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * float(scale)).cast("long"))


def _in_range(vector: Column, scale: int) -> Column:
    """Whether any squared distance of two such vectors, in whole numbers, stays within 64 bits."""
    most = (F.sqrt(F.lit(float(2**62)) / F.size(vector)) / 2 - 1) / float(scale)
    return F.forall(vector, lambda v: F.abs(v.cast("double")) <= most)


def _finite(vector: Column) -> Column:
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _round(df: DataFrame, books, groups, before, path: str) -> tuple[DataFrame, DataFrame]:
    """One assignment of all rows to ``books``, written to ``path``: the rows, and the sums per part and entry.

    ``before``: the codebooks that the bounds of ``df`` belong to; None at first.
    """
    import numpy as np
    import pyarrow as pa

    parts = len(books)
    now = [np.asarray(b, np.int64) for b in books]
    n_groups = max((int(g.max()) + 1 for g in groups), default=1)
    drift = None
    if before is not None:
        drift = [np.sqrt(((b - np.asarray(a, np.int64)) ** 2).sum(1).astype(np.float64)) for a, b in zip(before, now)]
        drift = [np.nextafter(d, np.inf) * (d > 0) for d in drift]

    def step(batches):
        width = now[0].shape[1]
        counts = np.zeros((parts, len(now[0])), np.int64)
        sums = np.zeros((parts, len(now[0]), width), np.int64)
        schema = None
        for batch in batches:
            schema = schema or batch.schema
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column("_vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            x = flat.reshape(n, parts, width)
            if drift is None:
                code = np.zeros((n, parts), np.uint8)
                upper, lower = np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, n_groups), np.float32)
            else:
                code = np.frombuffer(b"".join(batch.column("_code").to_pylist()), np.uint8).reshape(n, parts).copy()
                bounds = np.frombuffer(b"".join(batch.column("_bounds").to_pylist()), "<f4").reshape(n, parts, 1 + n_groups)
                upper, lower = bounds[:, :, 0].copy(), bounds[:, :, 1:].copy()
            error = np.zeros(n, np.int64)
            for p in range(parts):
                c, u, low = code[:, p], upper[:, p], lower[:, p]
                if drift is not None:
                    u[:] = _up(u.astype(np.float64) + drift[p][c])
                    for g in range(n_groups):
                        moved = drift[p][groups[p] == g]
                        low[:, g] = _down(low[:, g].astype(np.float64) - (moved.max() if len(moved) else 0.0))
                assign(x[:, p], now[p], groups[p], c, u, low)
                counts[p] += np.bincount(c, minlength=len(now[p]))
                np.add.at(sums[p], c, x[:, p])
                error += ((x[:, p] - now[p][c]) ** 2).sum(1)
            bounds = np.concatenate([upper[:, :, None], lower], 2).astype("<f4")
            none = pa.nulls(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("label"), batch.column("_vec"), pa.array([r.tobytes() for r in code], pa.binary()),
                    pa.array([r.tobytes() for r in bounds], pa.binary()), pa.array(error), none.cast(pa.int32()), none.cast(pa.int32()),
                    none.cast(pa.int64()), none.cast(pa.list_(pa.int64())),
                ],
                ["id", "label", "_vec", "_code", "_bounds", "error", "_part", "_entry", "_n", "_sums"],
            )
        where = np.argwhere(counts > 0)
        if len(where):
            n = len(where)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, schema.field("id").type), pa.nulls(n, schema.field("label").type), pa.nulls(n, pa.list_(pa.int32())),
                    pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(where[:, 0], pa.int32()),
                    pa.array(where[:, 1], pa.int32()), pa.array([int(counts[p, e]) for p, e in where], pa.int64()),
                    pa.array([sums[p, e].tolist() for p, e in where], pa.list_(pa.int64())),
                ],
                ["id", "label", "_vec", "_code", "_bounds", "error", "_part", "_entry", "_n", "_sums"],
            )

    kinds = dict(df.dtypes)
    schema = (
        f"id {kinds['id']}, label {kinds['label']}, _vec array<int>, _code binary, _bounds binary, error long, "
        "_part int, _entry int, _n long, _sums array<long>"
    )
    out = df.select("id", "label", "_vec", "_code", "_bounds").mapInArrow(step, schema)
    out.write.parquet(path, compression="zstd")
    made = df.sparkSession.read.schema(out.schema).parquet(path)
    return made.filter("_part is null"), made.filter("_part is not null").select("_part", "_entry", "_n", "_sums")


def _moved(books, sums: DataFrame):
    """Each entry at the floor of the mean of its parts; entries without parts stay."""
    width = len(books[0][0])
    wide = "decimal(38,0)"
    each = [F.sum(F.get("_sums", F.lit(i)).cast(wide)).alias(f"s{i}") for i in range(width)]
    out = [[list(e) for e in b] for b in books]
    for r in sums.groupBy("_part", "_entry").agg(F.sum(F.col("_n").cast(wide)).alias("n"), *each).collect():
        out[r["_part"]][r["_entry"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(width)]
    return out


def _drop(spark, path: str) -> None:
    """Delete a table of a round that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fit_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, groups: int = GROUPS,
) -> Codes:
    """Codebooks fitted to all vectors of ``df``, and its rows coded.

    Rows whose vector is null or holds a null, NaN or infinite component are left out. The codebooks start at
    the parts of the ``entries`` smallest ids (at most 256), ascending; equal ids in the order of their
    vectors, null ids last, so reruns agree. With fewer rows there are fewer entries; without rows there are
    no codebooks and no rows. Vectors whose length is not the commonest that ``parts`` divides (of equally
    common ones the longest), or with components so large that squared distances leave 64 bits (2^27 of 64
    components, after scaling), keep their row with null ``code`` and ``error`` and move no entry. Repeated rows count each time. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_raw")).filter(_finite(F.col("_raw")))
    fits = (F.size("_raw") > 0) & (F.size("_raw") % parts == 0) & _in_range(F.col("_raw"), scale)
    common = rows.filter(fits).groupBy(F.size("_raw").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else -1
    fits = fits & (F.size("_raw") == width)
    whole = _components(F.col("_raw"), scale).cast("array<int>")
    coded = rows.filter(fits).select("id", "label", whole.alias("_vec"), F.lit(None).cast("binary").alias("_code"), F.lit(None).cast("binary").alias("_bounds"))
    odd = rows.filter(~fits).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not common:
        return Codes(odd, [])

    seeds = [r["_vec"] for r in coded.select("id", "_vec").orderBy(F.asc_nulls_last("id"), "_vec").limit(entries).collect()]
    step = width // parts
    books = [[v[p * step : (p + 1) * step] for v in seeds] for p in range(parts)]
    group = [grouped(b, groups) for b in books]
    before, last = None, None
    for turn in range(rounds + 1):
        path = new_path(spark, f"codes{turn}")
        coded, sums = _round(coded, books, group, before, path)
        if last is not None:
            _drop(spark, last)
        last = path
        if turn < rounds:
            before, books = books, _moved(books, sums)
    return Codes(coded.select("id", "label", F.col("_code").alias("code"), "error").unionByName(odd), books)


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings
) -> DataFrame:
    """One row per row that :func:`fit_codes` keeps: the id, ``label``, ``code`` (binary, a byte a part), ``error``,
    ``label_error`` (errors of equal labels, nulls together; null where no row of the label has one) and
    ``codebooks`` (decimal components by part, entry and position, comma-joined).
    """
    fitted = fit_codes(df, id_col, vector_col, label_col, **settings)
    books = ",".join(str(v) for b in fitted.books for e in b for v in e)
    sums = persist(fitted.rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.select(F.struct("label").alias("_label"), "label_error")  # structs of nulls are equal
    out = with_small(fitted.rows.withColumn("_label", F.struct("label")), sums, "_label")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(books).alias("codebooks"))
