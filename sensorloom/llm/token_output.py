"""Token ids as binary shards, with keyed access through a minimal perfect hash.

Documents are range-partitioned and sorted by id; each partition is a shard::

    payload   ids of all documents, in order, 16 or 32 bits each, little-endian
    index     per slot: document's first id in the payload (u64), number of ids (u32), fingerprint (u32)
    hash      level sizes (u64), bit arrays (u64), bits set before each block of them (u64)
    keys      document ids in order (i64), null flags (u8), ordinals among equal ids (u32)
    footer    magic, and the counts that locate all of these

A key's shard comes from the ranges in the table of shards, its slot from the hash; the stored fingerprint
rejects keys the shard does not have. Opening a shard reads its footer and level sizes, a lookup one bit block
and rank a level, one slot and the ids. Nothing of a shard but its index is held in memory while it is written.
"""

from __future__ import annotations

import bisect
import struct
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partition_offsets, persist, row_key, small_batches, stable
from .files import attempt_path, opened
from .perfect_hash import BLOCK, PerfectHash, mix, probe
from .tokens import VOCABULARY, encoder

MAGIC = b"TOKSHRD2"
_FOOTER = "<8sQQQQQ"  # magic, width, ids, documents, levels, words
_SLOT = np.dtype([("first", "<u8"), ("count", "<u4"), ("print", "<u4")])


def _keys(ids: np.ndarray, nulls: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys, and 32-bit fingerprints drawn independently of them."""
    key = mix(ids.view(np.uint64), 101) + mix(ordinals.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64), 102)
    check = mix(ids.view(np.uint64) ^ (ordinals.astype(np.uint64) << np.uint64(1)), 103) + nulls.astype(np.uint64)
    return mix(key, 104), (check >> np.uint64(32)).astype(np.uint32)


class Shard:
    """A shard read through its footer; the ids of one document cost a few short reads."""

    def __init__(self, path: str) -> None:
        self.file = opened(path, "rb")
        size = self.file.size()
        magic, self.width, ids, self.docs, levels, self.words = struct.unpack(_FOOTER, self.file.read_at(48, size - 48))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.at_slots = ids * self.width
        at_sizes = self.at_slots + _SLOT.itemsize * self.docs
        self.at_words = at_sizes + 8 * levels
        self.at_ranks = self.at_words + 8 * self.words
        self.at_keys = self.at_ranks + 8 * -(-self.words // BLOCK)
        self.sizes = self._take("<u8", levels, at_sizes)

    def _take(self, dtype, n: int, at: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(np.dtype(dtype).itemsize * n, at), dtype)

    def _block(self, b: int) -> np.ndarray:
        return self._take("<u8", min(BLOCK, self.words - b * BLOCK), self.at_words + 8 * BLOCK * b)

    def _ids(self, slot: np.void) -> np.ndarray:
        raw = self.file.read_at(int(slot["count"]) * self.width, int(slot["first"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """The ids of a document, end id included; None if the shard does not hold it."""
        key, check = _keys(np.array([doc_id or 0], np.int64), np.array([doc_id is None]), np.array([ordinal]))
        at = probe(int(key[0]), self.sizes, self._block, lambda b: int(self._take("<u8", 1, self.at_ranks + 8 * b)[0]))
        if at < 0:
            return None
        slot = self._take(_SLOT, 1, self.at_slots + _SLOT.itemsize * at)[0]
        return self._ids(slot) if slot["print"] == check[0] else None

    def documents(self):
        """Every document, looked up by its key, in order: (id, null or not, ids). Loads the index, not the payload."""
        keys, nulls = self._take("<i8", self.docs, self.at_keys), self._take("<u1", self.docs, self.at_keys + 8 * self.docs)
        ordinals = self._take("<u4", self.docs, self.at_keys + 9 * self.docs)
        key, check = _keys(keys, nulls, ordinals)
        at = PerfectHash(self.sizes, self._take("<u8", self.words, self.at_words))(key)
        slots = self._take(_SLOT, self.docs, self.at_slots)
        if (at < 0).any() or len(np.unique(at)) != len(at) or (slots["print"][at] != check).any():
            raise ValueError("a key of the shard is not found")
        for k, z, slot in zip(keys.tolist(), nulls.tolist(), slots[at]):
            yield k, bool(z), self._ids(slot)


class Index:
    """Keyed access over all shards: ranges lead to the shard, its hash to the ids. One row a shard is held."""

    def __init__(self, shards: DataFrame) -> None:
        rows = sorted(shards.collect(), key=lambda r: r["shard"])
        self.nulls = [(r["path"], r["nulls"]) for r in rows if r["nulls"]]
        rows = [r for r in rows if r["least"] is not None]
        self.paths, self.most = [r["path"] for r in rows], [r["most"] for r in rows]
        self.least, self.last = [r["least"] for r in rows], [r["n_most"] for r in rows]

    def holders(self, doc_id: int | None) -> list[tuple[str, int]]:
        """(shard, rows of the id in it) in order: one shard, or several where an id repeats across a border."""
        if doc_id is None:
            return self.nulls
        out, i = [], bisect.bisect_left(self.most, doc_id)
        while i < len(self.paths) and self.least[i] <= doc_id:
            out.append((self.paths[i], self.last[i]))
            i += 1
        return out

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """The ids of the row with ``ordinal`` among those of the id; None if there is none."""
        for path, n in self.holders(doc_id):
            found = Shard(path).get(doc_id, ordinal)
            if found is not None:
                return found
            ordinal -= n
        return None


def lookup(shards: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``keys(doc_id)`` with ``ids array<int>`` (null: no such document), of the first row of a repeated id.

    Keys meet their shards by range, so each task opens the shards its keys lie in and no other. The ranges,
    a row for each shard, go to every task.
    """
    import pyarrow as pa

    index = Index(shards)

    def read(batches):
        opened_: dict[str, Shard] = {}
        for batch in batches:
            out = []
            for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path is not None and path not in opened_:
                    opened_ = {path: Shard(path)}
                found = opened_[path].get(key) if path is not None else None
                out.append(None if found is None else found.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], [id_col, "ids"])

    def placed(batches):
        for batch in batches:
            paths = [next((p for p, _ in index.holders(k)), None) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], [id_col, "path"])

    small_batches(keys.sparkSession)
    named = keys.select(F.col(id_col).cast("long")).mapInArrow(placed, f"{id_col} long, path string")
    dealt = named.repartition("path", id_col).sortWithinPartitions("path")
    return dealt.mapInArrow(read, f"{id_col} long, ids array<int>")


def write_shards(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Write shards below ``folder``; returns their table: ``shard, path, docs, ids, nulls, least, most, n_most``.

    ``nulls``: rows without an id; ``n_most``: rows of the id ``most``. Null texts count as empty and give the
    end id alone. A null id sorts first; rows that repeat an id are ordered by a hash of the text (null first),
    then by place, told apart by an ordinal within the shard, and may lie in several shards. An empty table gives no
    shards.
    """
    import pyarrow as pa

    def write(batches):
        from pyspark import TaskContext

        part, file, path = TaskContext.get().partitionId(), None, ""
        ids, nulls, counts = array("q"), array("B"), array("q")
        enc = encoder(vocabulary)
        width = enc.width
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                path = attempt_path(folder, "tok")
                file = opened(path, "wb")
            encoded = enc.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, raw in zip(batch.column("id").to_pylist(), encoded):
                file.write(raw)
                ids.append(doc_id or 0)
                nulls.append(doc_id is None)
                counts.append(len(raw) // width)
        if file is None:
            return
        keys, flags, n = np.array(ids, "<i8"), np.array(nulls, "<u1"), np.array(counts, "<i8")
        del ids, nulls, counts
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (flags[1:] != flags[:-1])])
        where = np.arange(len(keys))
        ordinals = (where - np.maximum.accumulate(np.where(new, where, 0))).astype("<u4")
        key, check = _keys(keys, flags, ordinals)
        table = PerfectHash.build(key)
        slots = np.zeros(len(keys), _SLOT)
        at = table(key)
        slots["first"][at], slots["count"][at], slots["print"][at] = np.cumsum(n) - n, n, check
        for section in (slots, table.sizes.astype("<u8"), table.words, table.block_ranks(), keys, flags, ordinals):
            file.write(section.tobytes())
        file.write(struct.pack(_FOOTER, MAGIC, width, int(n.sum()), len(keys), len(table.sizes), len(table.words)))
        file.close()
        some = keys[flags == 0]
        least, most = (int(some[0]), int(some[-1])) if len(some) else (None, None)
        row = [part, path, len(keys), int(n.sum()), int(flags.sum()), least, most, int((some == most).sum()) if len(some) else 0]
        kinds = [pa.int32(), pa.string()] + [pa.int64()] * 6
        names = ["shard", "path", "docs", "ids", "nulls", "least", "most", "n_most"]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    df = stable(df)
    small_batches(df.sparkSession)
    text = F.col(text_col).cast("string")
    narrow = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), text.isNotNull().alias("there"), F.xxhash64(text).alias("mark"), row_key().alias("row"))
    ordered = narrow.repartitionByRange("id", "there", "mark", "row").sortWithinPartitions("id", "there", "mark", "row")
    schema = "shard int, path string, docs long, ids long, nulls long, least long, most long, n_most long"
    return persist(ordered.select("id", "text").mapInArrow(write, schema), "shards")


def read_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document, looked up by its key: the id, ``start``, ``n_tokens``, ``ids_crc32``."""
    import pyarrow as pa

    def read(batches):
        import zlib

        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                keys, starts, n, crc, start = [], [], [], [], first
                for key, null, ids in Shard(path).documents():
                    keys.append(None if null else key)
                    starts.append(start)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
                    if len(keys) == 4096:
                        yield columns(keys, starts, n, crc)
                        keys, starts, n, crc = [], [], [], []
                if keys:
                    yield columns(keys, starts, n, crc)

    def columns(*lists):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in lists], [id_col, "start", "n_tokens", "ids_crc32"])

    firsts = partition_offsets(shards, "shard", "ids")
    placed = shards.select("shard", "path").join(firsts, "shard").repartition(max(1, shards.count()), "shard")
    return placed.select("path", "first").mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def token_output(df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards (below the shared folder unless told otherwise) and read every document back from them."""
    folder = folder or new_path(df.sparkSession, "token-shards")
    return read_shards(write_shards(df, folder, id_col, text_col), id_col)
