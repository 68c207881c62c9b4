"""Snapshots of an archive: numbered commits over folders of Parquet files that never change.

A commit is a small file that names, for each table, the folders that make it up.  It is staged and
then renamed to the next number, which fails if that number is there: of two writers that start from one
snapshot, one commits and the other is refused, whatever the order of their steps.  Readers see one
snapshot or another; what a writer leaves behind when it dies is never named by a commit.
A table is replaced (new folder only) or appended to (the old folders and a new one): what does not change
is never written again."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from cairn.model import Conflict, NotFound

TABLES = ("entries", "entry_chunks", "chunks", "blocks", "shards", "settings")
#: Tables whose files may hold more columns than these.
COLUMNS = {"blocks": "id string, block binary"}


class Store:
    """An archive under ``root`` on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _commit_file(self, version: int) -> str:
        return f"{self.root}/commits/{version:010d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int | None:
        """The number of the current snapshot."""
        found = self.versions()
        return found[-1] if found else None

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table in a snapshot."""
        version = self.current() if version is None else version
        if version is None:
            return {}
        text = "\n".join(r[0] for r in self.spark.read.text(self._commit_file(version)).collect())
        return json.loads(text)["tables"]

    def has(self, name: str, version: int | None = None) -> bool:
        return name in self.folders(version)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        found = self.folders(version).get(name)
        if not found:
            raise NotFound(f"no table {name}")
        read = self.spark.read.schema(COLUMNS[name]) if name in COLUMNS else self.spark.read
        return read.parquet(*(f"{self.root}/{f}" for f in found))

    def put(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        """A folder that :meth:`commit` may add to a table as it is, and the frame read again from it: bytes are written once."""
        folder = f"data/{uuid.uuid4().hex}/{name}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")

    def commit(self, tables: dict[str, DataFrame], base: int | None, append: dict[str, DataFrame | str] | None = None) -> int:
        """Replace ``tables``, add to those in ``append`` (frames, or folders that :meth:`put` has made), keep the rest.  base: the snapshot that all of them were made from."""
        append = append or {}
        if unknown := (set(tables) | set(append)) - set(TABLES):
            raise ValueError(f"unknown tables {sorted(unknown)}")
        if set(tables) & set(append):
            raise ValueError("a table is replaced or appended to, not both")
        found = {} if base is None else self.folders(base)
        name = uuid.uuid4().hex
        at = {t: df if isinstance(df, str) else f"data/{name}/{t}" for t, df in (tables | append).items()}
        for t, df in (tables | append).items():
            if not isinstance(df, str):
                df.write.parquet(f"{self.root}/{at[t]}")
        new = found | {t: [at[t]] for t in tables} | {t: [*found.get(t, []), at[t]] for t in append}
        version = 0 if base is None else base + 1
        self._publish(version, json.dumps({"tables": new}))
        return version

    def _publish(self, version: int, text: str) -> None:
        staged, final = self._path(f"{self.root}/staged/{uuid.uuid4().hex}"), self._path(self._commit_file(version))
        out = self._fs.create(staged, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(kind, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(staged, final, none)
        except Py4JJavaError as e:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"another writer has made snapshot {version}") from None
            raise

    def merge(self, name: str) -> int:
        """The same snapshot with the folders of a table written as one."""
        base = self.current()
        return self.commit({name: self.table(name, base)}, base)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete commits but the last ``keep``, and folders that no commit left names; only while nobody writes."""
        found = self.versions()
        old, left = found[:-keep], found[-keep:]
        used = {f.split("/")[1] for v in left for fs in self.folders(v).values() for f in fs}
        gone = []
        for v in old:
            self._fs.delete(self._path(self._commit_file(v)), False)
        data = self._path(f"{self.root}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
                gone.append(status.getPath().getName())
        return sorted(gone)
