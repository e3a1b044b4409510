"""Files and subjects of raw recordings, found through Spark's own file listing: any file system Spark knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from .recordings import latest

# Names of overnight files by sampling rate, and the folders of each rate.
OVERNIGHT_NAMES = {100: ("*_PSG_df_updated.csv",), 64: ("*_whole_df.csv",)}
OVERNIGHT_FOLDERS = {100: "data_100Hz", 64: "data_64Hz"}


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern finds, sorted; a folder that is not there finds none."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []))


def _below(spark: SparkSession, root: str, name: str) -> list[str]:
    """Files below ``root`` at any depth whose name matches, sorted."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    except Exception as e:  # a folder that is not there
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted(r[0] for r in files.select("path").collect())


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path names one file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isFile()


def find_file(spark: SparkSession, root: str, name: str) -> str:
    """``root`` if it is a file, the file of that name in it, or the first below it; none is an error."""
    if is_file(spark, root):
        return root
    found = _matches(spark, f"{root.rstrip('/')}/{name}") or _below(spark, root, name)
    if not found:
        raise FileNotFoundError(f"no {name} below {root}")
    return found[0]


def overnight_files(spark: SparkSession, root: str, rate: int = 64) -> list[str]:
    """Overnight recordings of a sampling rate: in the folder of the rate and in ``root``, or else at any depth."""
    if is_file(spark, root):
        return [root]
    names = OVERNIGHT_NAMES.get(rate, tuple(n for v in OVERNIGHT_NAMES.values() for n in v))
    folders = [f"{root}/{OVERNIGHT_FOLDERS[rate]}", root] if rate in OVERNIGHT_FOLDERS else [root]
    found = {p for f in folders for n in names for p in _matches(spark, f"{f}/{n}")}
    return sorted(found or {p for v in OVERNIGHT_NAMES.values() for n in v for p in _below(spark, root, n)})


def select_files(spark: SparkSession, paths: list[str], subjects: list[str] | None = None) -> dict[str, list[str]]:
    """The files of each subject's last recording by path, in the order asked for; unknown subjects are passed by."""
    last = latest(spark, paths)
    return {s: last[s] for s in (subjects or last) if s in last}


def stress_subjects(spark: SparkSession, root: str, subjects: list[str] | None = None) -> list[str]:
    """Folders ``S*`` of ``root`` that hold a recording of their own name. A subject asked for that has none is an error."""
    names = [p.rsplit("/", 2)[-2:] for p in _matches(spark, f"{root.rstrip('/')}/S*/S*.pkl")]
    found = sorted(folder for folder, file in names if file == f"{folder}.pkl")
    missing = sorted(set(subjects or ()) - set(found))
    if missing:
        raise FileNotFoundError(f"no recording of {', '.join(missing)} below {root}")
    return [s for s in found if not subjects or s in subjects]


def motion_subjects(spark: SparkSession, path: str, targets: dict[str, int] = C.STAIR_LABELS) -> DataFrame:
    """The users of a motion log with a row of a target activity; two columns are read."""
    log = spark.read.option("header", True).csv(path).select(F.col("User").alias("subject"), C.activity(F.col("gt")).alias("a"))
    return log.dropna().filter(F.col("a").isin(*targets)).select("subject").distinct().orderBy("subject")
