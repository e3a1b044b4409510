"""Packing: concatenate and cut.

1. Each partition encodes its documents, in the order it reads them, and notes for each where it starts
   among the partition's ids. The ids are written once, to the shared folder.
2. Prefix sums over the partitions' totals (one row a partition) give each partition its place in the
   concatenation of all ids.
3. With that, each document knows its global range and is cut at multiples of the sequence length. A
   document that crosses a boundary gives a record on either side. No row is shuffled or sorted.

Every sequence but the last is full, so the last one alone is padded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partition_offsets, persist, small_batches, with_small
from .tokens import VOCABULARY, encoder

LENGTH = 1024


def encoded(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: ``part``, ``at`` (ids of the partition before it), ``id``, ``n``, ``ids``. Written once."""
    import pyarrow as pa

    def encode(batches):
        from pyspark import TaskContext

        enc, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        width = enc.width
        for batch in batches:
            ids = enc.encode([t or "" for t in batch.column("text").to_pylist()])
            n = [len(x) // width for x in ids]
            starts = []
            for x in n:
                starts.append(at)
                at += x
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column("id"),
                    pa.array(n, pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary()),
                ],
                ["part", "at", "id", "n", "width", "ids"],
            )

    small_batches(df.sparkSession)
    schema = f"part int, at long, id {dict(df.dtypes)[id_col]}, n long, width int, ids binary"
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return persist(narrow.mapInArrow(encode, schema), "encoded")


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    vocabulary: str = VOCABULARY, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and, if asked for, ``ids``.

    Null texts count as empty and give the end id alone. Null and repeated ids are packed like others. An
    empty table gives an empty result; a table with rows leaves no sequence empty. Only the two named
    columns are read.
    """
    import pyarrow as pa

    rows = encoded(df, id_col, text_col, vocabulary)
    totals = persist(rows.groupBy("part").agg(F.sum("n").alias("total")), "totals")
    offsets = persist(partition_offsets(totals, "part", "total"), "offsets")
    placed = with_small(rows, offsets, "part")

    def cut(batches):
        import zlib

        import numpy as np

        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "total", "sequence", "offset", "ids")}
            cols = [batch.column(c).to_pylist() for c in ("at", "first", "n", "width", "ids")]
            for row, (at, first, n, width, raw) in enumerate(zip(*cols)):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                at, start = at + first, 0
                while start < n:
                    offset = (at + start) % length
                    take = min(n - start, length - offset)
                    piece = ids[start : start + take].tobytes()
                    for k, v in zip(out, (row, start, take, zlib.crc32(piece), n, (at + start) // length, offset, piece)):
                        out[k].append(v)
                    start += take
            piece_ids = pa.array(out["ids"], pa.binary()) if with_ids else None
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [batch.column("id").take(pa.array(out["row"], pa.int64()))]
            arrays += [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "total", "sequence", "offset")]
            yield pa.RecordBatch.from_arrays(arrays + [piece_ids] * with_ids, names + ["ids"] * with_ids)

    schema = f"{id_col} {dict(df.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, schema + ", ids binary" * with_ids)
