"""The ledger on shared storage: every save is a new version, readers take the newest complete one.

A save is optimistic: it writes aside, and its folder becomes the next version by a rename that fails where that version is there already. What
was merged into a version that is no longer the newest is merged anew. A saver that dies leaves a folder aside, which is in nobody's way and
goes with a later save.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.operators.ledger import ledger_upsert
from voxloom.schemas import RUN_RECORD

#: Error class of a file that cannot be read.
_DAMAGED = "FAILED_READ_FILE"
#: Times a save is merged anew, and the age at which what a saver left aside counts as dead.
TRIES, DEAD_SECONDS = 30, 24 * 3600


class StaleLedger(RuntimeError):
    """Another saver was first: the ledger has a newer version than the one that was loaded."""


def _folder(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, root, root.getFileSystem(conf)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(version, complete) of every version folder."""
    jvm, _, root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            done = fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            found.append((int(name[1:]), done))
    return sorted(found)


def load_version(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(newest complete version, its records); 0 and no records if there is none yet.

    A damaged version falls back to the one before it, so the history is never lost; the number stays that of the newest one.
    """
    complete = [version for version, done in _versions(spark, path) if done]
    for version in reversed(complete):
        ledger = spark.read.schema(RUN_RECORD).parquet(f"{path}/v{version:08d}")
        try:
            ledger.agg(F.max("update_seq")).first()
            return complete[-1], ledger
        except (PySparkException, Py4JJavaError) as failure:
            # Only a damaged file falls back; any other failure must not hide the ledger.
            if not _damaged(failure):
                raise
    return max(complete, default=0), spark.createDataFrame([], RUN_RECORD)


def _damaged(failure: PySparkException | Py4JJavaError) -> bool:
    """Whether Spark's error class, of the failure or of what caused it, is that of a file that cannot be read."""
    if isinstance(failure, PySparkException) and (failure.getCondition() or "").startswith(_DAMAGED):
        return True
    cause = failure.java_exception if isinstance(failure, Py4JJavaError) else getattr(failure, "_origin", None)
    while cause is not None:
        if cause.getClass().getSimpleName() == "SparkException" and (cause.getCondition() or "").startswith(_DAMAGED):
            return True
        cause = cause.getCause()
    return False


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version that can be read; an absent ledger counts as empty."""
    return load_version(spark, path)[1]


def save_ledger(ledger: DataFrame, path: str, base: int) -> int:
    """Write the version after `base`, the one that `ledger` was made from; `StaleLedger` if that is no longer the newest."""
    spark = ledger.sparkSession
    jvm, conf, root, fs = _folder(spark, path)
    aside = f"{path}/.aside-{int(time.time())}-{uuid.uuid4().hex}"
    ledger.select(*RUN_RECORD.names).write.mode("errorifexists").parquet(aside)
    try:
        found = _versions(spark, path)
        if max((v for v, done in found if done), default=0) != base:
            raise StaleLedger(f"{path} has a version after {base}")
        version = max((v for v, _ in found), default=0) + 1
        plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # without the option to overwrite it fails if the version is there
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf).rename(
                jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(f"{path}/v{version:08d}"), plain)
        except Py4JJavaError as failure:
            if failure.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            raise StaleLedger(f"{path} has a version {version} already") from failure
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
    return version


def save_records(spark: SparkSession, path: str, records: DataFrame) -> int:
    """Merge records into the stored ledger, last write wins; if another saver was first, into what that one wrote."""
    _clear(spark, path)
    for turn in range(TRIES):
        base, known = load_version(spark, path)
        try:
            return save_ledger(ledger_upsert(known, records), path, base)
        except StaleLedger:
            if turn == TRIES - 1:
                raise
            time.sleep(0.05 * (turn + 1))
    raise AssertionError


def _clear(spark: SparkSession, path: str) -> None:
    """Delete what savers left aside that died long ago."""
    _, _, root, fs = _folder(spark, path)
    if fs.exists(root):
        for status in fs.listStatus(root):
            parts = status.getPath().getName().split("-")
            if parts[0] == ".aside" and time.time() - int(parts[1]) > DEAD_SECONDS:
                fs.delete(status.getPath(), True)
