"""Numbered versions of a folder: small JSON files, each put in place whole, and only if its number is free.

A version names data that was written before it, so readers see all of it or nothing. The newest one is found by names, and
only that one is read. On a file system whose rename fails where the target exists (HDFS and the like), and on
a local disk, of two writers of one number exactly one succeeds.
"""

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Somebody else has written this version."""


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list:
    fs, p = _at(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, base: str) -> list[int]:
    names = [s.getPath().getName() for s in _listed(spark, f"{base}/manifest")]
    return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))


def read(spark: SparkSession, base: str, version: int) -> dict:
    fs, p = _at(spark, f"{base}/manifest/v={version:08d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, base: str) -> tuple[int, dict] | None:
    """Number and contents of the newest version; None if there is none."""
    found = versions(spark, base)
    return (found[-1], read(spark, base, found[-1])) if found else None


def put(spark: SparkSession, base: str, version: int, body: dict) -> int:
    """Write a version; Conflict if it is there already."""
    name = f"{base}/manifest/v={version:08d}.json"
    fs, target = _at(spark, name)
    if fs.exists(target):
        raise Conflict(f"{name} already exists")
    _, draft = _at(spark, f"{base}/manifest/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(body).encode())
    out.close()
    try:
        if fs.getScheme() == "file":  # whose rename would overwrite
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            options = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
            context.rename(draft, target, options[:1])  # NONE: an error where the target exists
    except Exception as e:
        if fs.exists(target):
            raise Conflict(f"{name} already exists") from e
        raise
    finally:
        fs.delete(draft, False)
    return version


def commit(spark: SparkSession, base: str, change: Callable[[dict | None], dict], tries: int = 50) -> int:
    """Write what `change` makes of the newest version as the next one, again from the then newest if somebody was faster."""
    for k in range(tries):
        found = newest(spark, base)
        try:
            return put(spark, base, found[0] + 1 if found else 1, change(found[1] if found else None))
        except Conflict:
            if k + 1 == tries:
                raise
            time.sleep(0.01 * min(k, 10))
    raise AssertionError


def vacuum(spark: SparkSession, base: str, keep: int, older_than: float) -> tuple[int, int]:
    """Delete all versions but the newest `keep`, and folders of data that none of these names and that are `older_than`
    seconds old (younger ones may belong to a writer that has not committed yet). Gives the numbers of both."""
    found = versions(spark, base)
    named = "".join(json.dumps(read(spark, base, v)) for v in found[-keep:])
    gone = found[:-keep]
    for v in gone:
        fs, p = _at(spark, f"{base}/manifest/v={v:08d}.json")
        fs.delete(p, False)
    folders = 0
    for s in _listed(spark, f"{base}/data"):
        if s.getPath().getName() not in named and time.time() - s.getModificationTime() / 1000 >= older_than:
            fs, _ = _at(spark, base)
            fs.delete(s.getPath(), True)
            folders += 1
    return len(gone), folders
