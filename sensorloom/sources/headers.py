"""Delimited files whose columns differ from file to file, read by what the columns are called.

A scan of many files takes the header of one and reads the others by place. Here each file's header is read
first (the first line, one small read a file), files with equal headers make a group, and each group is scanned
with its own mapping to canonical names. The groups meet by name; what a group lacks is null there.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import detect_column
from ..shared import persist, with_small

#: Files whose headers are read at once.
READERS = 16


def files_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that paths, folders and patterns name, sorted; hidden ones and those of Spark's own are passed by."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: set[str] = set()
    todo = [(p, True) for p in paths]
    while todo:
        name, given = todo.pop()
        path = jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(conf)
        for s in (system.globStatus(path) or []) if given else system.listStatus(path):
            if not given and s.getPath().getName()[0] in "._":
                continue
            found = s.getPath().toString()
            if s.isDirectory():
                todo.append((found, False))
            else:
                out.add(found)
    return sorted(out)


def headers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """The column names of each file, from its first line; packed files are unpacked as Spark does."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(name: str) -> list[str]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            source = codec.createInputStream(stream) if codec is not None else stream
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8")).readLine()
        finally:
            stream.close()
        return next(csv.reader([(line or "").removeprefix("\ufeff")]), [])

    with ThreadPoolExecutor(READERS) as pool:
        return dict(zip(files, pool.map(first_line, files)))


def by_header(spark: SparkSession, files: list[str], patterns: dict[str, list[str]], needed: tuple[str, ...] = ()) -> list[tuple[set[str], DataFrame]]:
    """For each different header the canonical names found in it, and the scan of its files.

    ``patterns``: regular expressions on normal names, by canonical name, in order of preference. A scan has the
    columns found, as text, ``_path`` and ``_line`` (see :func:`line_numbers`). A file without a ``needed`` column
    is an error that names it.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, header in headers(spark, files).items():
        groups.setdefault(tuple(header), []).append(name)
    out = []
    for header, names in groups.items():
        found = {k: header.index(c) for k, p in patterns.items() if (c := detect_column(list(header), p)) is not None}
        for k in needed:
            if k not in found:
                raise ValueError(f"no {k} column among {list(header)} of {names[0]}")
        schema = ", ".join(f"_c{i} string" for i in range(len(header)))
        raw = spark.read.schema(schema).option("header", True).csv(names)
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), _in_task().alias("at"))
        scan = raw.select(*(F.col(f"_c{i}").alias(k) for k, i in found.items()), F.col("_metadata.file_path").alias("_path"), place.alias("_line"))
        out.append((set(found), scan))
    return out


def _in_task() -> Column:
    """The row's number in its task. Tasks read whole blocks, and the rows of a block in order."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def line_numbers(scan: DataFrame, out: str) -> DataFrame:
    """``scan`` with the number of each row in its file, from 0.

    Rows are counted by block of the file; blocks get their start from the sizes of those before. So a long file
    is as many tasks as it has blocks, and nothing is sorted.
    """
    blocks = scan.groupBy("_path", F.col("_line.block").alias("_block")).agg(F.min("_line.at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    first = persist(blocks.select("_path", "_block", (F.coalesce(before, F.lit(0)) - F.col("_lo")).alias("_shift")), "blocks")
    rows = with_small(scan.withColumn("_block", F.col("_line.block")), first, ["_path", "_block"])
    return rows.withColumn(out, F.col("_line.at") + F.col("_shift")).drop("_block", "_shift")
