"""Archive entries from tables of rows and from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.model import MAX_DEPTH, MAX_ENTRIES, ArchiveError

#: Path and content of each row of the tables that can be archived.
LAYOUT = {
    "documents": ("concat('docs/', lang, '/', source, '/', doc_id, '.txt')", "text"),
    "pages": ("concat('pages/', page_id, '.html')", "html"),
    "conversations": ("concat('conv/', conv_id, '/', turn, '-', role, '.txt')", "text"),
    "benchmark": ("concat('bench/', item_id, '.txt')", "text"),
}


def files_of_rows(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """(path, content, size): every row a file; null content is empty."""
    data = F.coalesce(content.cast("binary"), F.lit(b""))
    return rows.select(path.alias("path"), data.alias("content")).withColumn("size", F.octet_length("content").cast("bigint"))


def table_files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path, content = LAYOUT[name]
    return files_of_rows(spark.read.parquet(f"{sf_dir}/{name}.parquet"), F.expr(path), F.col(content))


def directory_files(spark: SparkSession, root: str, prefix: str = "", content: bool = True) -> DataFrame:
    """(path, content, size, modified) of all files under a directory, paths relative to it.

    Without ``content`` only names and sizes are read.  More than MAX_ENTRIES files, or a depth beyond
    MAX_DEPTH, is an error, not a truncation."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_extract(F.col("path"), r"(?s)^" + _pattern(found, root) + r"/?(.*)$", 1)
    path = F.concat(F.lit(prefix.rstrip("/") + "/" if prefix else ""), tail)
    rows = found.select(path.alias("path"), *(["content"] if content else []), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    guard = rows.select("path").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("path", "/"))).alias("d")).first()
    if guard["n"] > MAX_ENTRIES or (guard["d"] or 0) > MAX_DEPTH:
        raise ArchiveError(f"{guard['n']} entries of depth {guard['d']} are too many")
    return rows


def directory_tree(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(path): all directories under a directory, empty ones too, relative to it; parents before children.

    Listed on the driver level by level, by names alone; links are not followed.  More than MAX_ENTRIES, or a depth beyond MAX_DEPTH, is an error."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    head = prefix.strip("/")
    found, level = [], [(top, head)]
    for depth in range(MAX_DEPTH + 1):
        below = []
        for folder, name in level:
            for status in fs.listStatus(folder):
                if status.isDirectory() and not status.isSymlink():
                    child = status.getPath().getName()
                    below.append((status.getPath(), f"{name}/{child}" if name else child))
        found += [name for _, name in below]
        if len(found) > MAX_ENTRIES or below and depth == MAX_DEPTH:
            raise ArchiveError(f"{len(found)} directories of depth {depth + 1} are too many")
        level = below
        if not level:
            break
    return spark.createDataFrame([(f,) for f in ([head] if head else []) + found], "path string")


def _pattern(found: DataFrame, root: str) -> str:
    """The root as the reader spells it."""
    import re

    path = found.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(found.sparkSession.sparkContext._jsc.hadoopConfiguration())
    return re.escape(fs.makeQualified(path).toString().rstrip("/"))
