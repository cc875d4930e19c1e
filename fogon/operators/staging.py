"""Written tables in the cluster's shared folder.

Iterative jobs and the distributed key need a result that is computed once and
survives the loss of any executor. A Parquet table in ``spark.checkpoint.dir`` is
both, is read back with column pruning, and gives the optimizer real sizes.

Whoever stages a table removes it: :func:`drop_staged` for one that no later step reads,
:func:`staged_here` around a job that has written its results elsewhere.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from fogon.sources.files import delete_folder

#: Path behind each staged frame that is still referenced.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Paths staged within the open :func:`staged_here` blocks.
_OPEN: list[list[str]] = []


def staging_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates, taken from the session: the checkpoint
    folder, or the warehouse where none is named."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A folder name under the staging root that no other run uses."""
    path = f"{staging_root(spark)}/fogon-{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back; the result has no lineage behind it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later step reads (the previous round of a loop)."""
    path = _PATHS.pop(df, None)
    if path is None:
        raise ValueError("not a staged table")
    delete_folder(path)


@contextmanager
def staged_here() -> Iterator[None]:
    """Remove, at the end, what was staged inside. For jobs whose results are written."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete_folder(path)
