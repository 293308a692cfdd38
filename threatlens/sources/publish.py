"""Atomic publication of versions (S16, S17, T2, T3) by an ordered commit log.

A version's data is written first, under names of its own; then one small file
``commits/<number>`` publishes it.  The file is written elsewhere and put in
place by an operation that fails if the name is taken (a hard link on a local
file system, a rename elsewhere, which HDFS refuses when the target exists), so
of two writers one wins and the other sees that it lost.  Readers take the
highest number; they never see part of a version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Commits that stay in a log (and versions whose folders stay) by default.
KEEP = 20


class Conflict(RuntimeError):
    """Another writer has published since the state was read."""


@dataclass(frozen=True)
class Commit:
    number: int
    version: str
    data: dict = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _place(spark: SparkSession, text: str, root: str, name: str) -> bool:
    """``root/name`` with this content, unless the name is taken."""
    fs, target = _fs(spark, f"{root}/{name}")
    _, temporary = _fs(spark, f"{root}/_tmp-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            nio = spark._jvm.java.nio.file
            local = lambda p: spark._jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
            from py4j.protocol import Py4JJavaError

            try:
                nio.Files.createLink(local(target), local(temporary))
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                    return False
                raise
        return bool(fs.rename(temporary, target))
    finally:
        fs.delete(temporary, False)


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers in the log, ascending (the log is trimmed, so they are few)."""
    fs, p = _fs(spark, f"{root}/commits")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit())


def commit_at(spark: SparkSession, root: str, number: int) -> Commit:
    row = json.loads(_read(spark, f"{root}/commits/{number:020d}"))
    return Commit(number, row["version"], row["data"])


def latest(spark: SparkSession, root: str) -> Commit | None:
    """What is published now, or None before the first commit."""
    have = numbers(spark, root)
    return commit_at(spark, root, have[-1]) if have else None


def publish(spark: SparkSession, root: str, version: str, data: dict | None = None, after: Commit | None | str = "any",
            attempts: int = 50) -> Commit:
    """Publish a version.  With ``after`` (the commit that the writer built on,
    None for none) it succeeds only if nothing was published since, and raises
    :class:`Conflict` otherwise; without it the version goes after whatever is
    there."""
    text = json.dumps({"version": version, "data": data or {}})
    for _ in range(attempts):
        if after == "any":
            have = numbers(spark, root)
            number = have[-1] + 1 if have else 1
        else:
            number = after.number + 1 if after else 1
            if any(n >= number for n in numbers(spark, root)):
                raise Conflict(f"{root}: commit {number} is taken")
        if _place(spark, text, root, f"commits/{number:020d}"):
            return Commit(number, version, data or {})
        if after != "any":
            raise Conflict(f"{root}: commit {number} is taken")
    raise Conflict(f"{root}: no number won in {attempts} attempts")


def retried(change, attempts: int = 10):
    """``change()`` again from the start whenever another writer won."""
    for k in range(attempts):
        try:
            return change()
        except Conflict:
            if k + 1 == attempts:
                raise


def commit_version(spark: SparkSession, root: str, version: str) -> None:
    """Publish a finished version folder after whatever is published."""
    publish(spark, root, version)


def current_version(spark: SparkSession, root: str) -> str | None:
    last = latest(spark, root)
    return last.version if last else None


def is_committed(spark: SparkSession, root: str, version: str) -> bool:
    return any(commit_at(spark, root, n).version == version for n in reversed(numbers(spark, root)))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def trim(spark: SparkSession, root: str, keep: int = KEEP, folders=lambda commit: [commit.version]) -> list[str]:
    """Drop all but the newest ``keep`` commits and the folders (under ``root``)
    that only the dropped ones name; returns those folders."""
    have = [commit_at(spark, root, n) for n in numbers(spark, root)]
    old, kept = have[:-keep], have[-keep:]
    live = {f for c in kept for f in folders(c)}
    gone = sorted({f for c in old for f in folders(c)} - live)
    for f in gone:
        delete(spark, f"{root}/{f}")
    for c in old:
        delete(spark, f"{root}/commits/{c.number:020d}")
    return gone
