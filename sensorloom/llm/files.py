"""Files that tasks write and read themselves, in the folder all executors share.

A task writes to a name of its own attempt and returns it; the table of names that the job commits is the
only directory of the files. A retried or speculative attempt thus leaves at most a file nobody names.
"""

from __future__ import annotations


def opened(path: str, mode: str):
    """A file of any file system that Arrow knows (local, HDFS, S3, GCS), for ``wb`` or ``rb``."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    if mode == "rb":
        return system.open_input_file(place)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    return system.open_output_stream(place, compression=None)


def attempt_path(folder: str, suffix: str) -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.{suffix}"
