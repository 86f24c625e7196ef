"""Versioned folders: data files that are never changed, and a log that names them.

A commit is one numbered JSON file under ``_versions``.  It is written aside
and renamed to its number, which fails if the number is taken, so of two
writers that start from one version only the first commits.  Readers take the
highest number; until it appears, data written for it is not seen, and a
writer lost in between leaves the version before as it was.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from vouch.session import path_exists

_NUMBER = re.compile(r"^(\d{12})\.json$")


class ConcurrentChange(RuntimeError):
    """Another writer has committed the version this one was to become."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly in a folder (none when it is not there)."""
    if not path_exists(spark, path):
        return []
    p, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)]


def list_lengths(spark: SparkSession, path: str) -> dict[str, int]:
    """All files under a folder by path relative to it, with their lengths."""
    if not path_exists(spark, path):
        return {}
    p, fs = _fs(spark, path)
    root = str(fs.getFileStatus(p).getPath().toString()).rstrip("/") + "/"
    out, found = {}, fs.listFiles(p, True)
    while found.hasNext():
        s = found.next()
        out[str(s.getPath().toString())[len(root):]] = int(s.getLen())
    return out


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename that fails (False) where the target exists."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    src, dst = hadoop.Path(source), hadoop.Path(target)
    context = hadoop.FileContext.getFileContext(src.toUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(src, dst, sc._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:  # noqa: BLE001 - only "it exists" is an answer
        if "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)) or path_exists(spark, target):
            return False
        raise
    return True


class VersionLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = f"{self.path}/_versions"

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in map(_NUMBER.match, list_names(self.spark, self._folder)) if m)

    def latest(self) -> tuple[int, dict]:
        """(number, entry) of the newest version; (0, {}) where there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.entry(numbers[-1])) if numbers else (0, {})

    def entry(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self._folder}/{number:012d}.json"))

    def commit(self, base: int, entry: dict) -> int:
        """Publish ``entry`` as the version after ``base``."""
        aside = f"{self._folder}/.{uuid.uuid4().hex}"
        write_text(self.spark, aside, json.dumps(entry))
        if not rename_new(self.spark, aside, f"{self._folder}/{base + 1:012d}.json"):
            delete(self.spark, aside)
            raise ConcurrentChange(f"{self.path}: version {base + 1} is already there")
        return base + 1

    def fresh_data(self) -> str:
        """A new folder name for the data of one change, relative to the path."""
        return f"data/{uuid.uuid4().hex}"

    def vacuum(self, keep: int, used: Callable[[dict], list[str]]) -> int:
        """Forget all but the last ``keep`` versions and delete the data folders
        that none of these uses (``used`` lists an entry's data folders); also
        what a lost writer left.  No writer may be at work.  Returns their number."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            delete(self.spark, f"{self._folder}/{n:012d}.json")
        wanted = {f for n in numbers[-keep:] for f in used(self.entry(n))}
        stale = [n for n in list_names(self.spark, f"{self.path}/data") if f"data/{n}" not in wanted]
        for n in stale:
            delete(self.spark, f"{self.path}/data/{n}")
        return len(stale)
