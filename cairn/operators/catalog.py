"""The catalogue of an archive as relations, and what changes it.

entries: path, size, is_dir (and more columns, which stay with their rows); entry_chunks: path,
pos, chunk_id; chunks: id and lengths.  All steps are joins and windows: subtree tests
become equi-joins on exploded ancestors, so nothing compares every path with every other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import paths
from cairn.functions.numbers import long
from cairn.model import MAX_ENTRIES, PREFIX, ArchiveError, Conflict, InvalidPath, NotFound
from cairn.scratch import written


def directories(entries: DataFrame) -> DataFrame:
    """(path): directories that entries imply, whether or not they have rows of their own."""
    return entries.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()


def with_directories(entries: DataFrame) -> DataFrame:
    """(path, size, is_dir): entries and the directories that they imply."""
    own = entries.select("path", "size", "is_dir")
    implied = directories(entries).join(own.select("path"), "path", "left_anti")
    return own.unionByName(implied.select("path", long(0).alias("size"), F.lit(True).alias("is_dir")))


def listing(entries: DataFrame, entry_chunks: DataFrame) -> DataFrame:
    """(path, name, parent, depth, size, is_dir, chunk_count) of all entries."""
    count = entry_chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"))
    rows = entries.join(count, "path", "left")
    p = F.col("path")
    return rows.select("path", paths.basename(p).alias("name"), paths.parent(p).alias("parent"), paths.depth(p).alias("depth"), "size", "is_dir", F.coalesce("chunk_count", long(0)).alias("chunk_count"))


def kinds(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, kind) of the paths asked for: file, directory, implicit (only descendants) or none."""
    own = entries.select("path", F.when(F.col("is_dir"), "directory").otherwise("file").alias("own"))
    rows = asked.select("path").join(own, "path", "left").join(directories(entries).withColumn("above", F.lit(True)), "path", "left")
    return rows.select("path", F.coalesce("own", F.when(F.col("above"), "implicit"), F.lit("none")).alias("kind"))


def summary(entries: DataFrame, entry_chunks: DataFrame) -> DataFrame:
    """One row: files, logical and physical chunks, dedup_chunks, bytes and distinct bytes."""
    chunks = entry_chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("refs"), F.max("len").alias("len"))
    c = chunks.agg(
        F.coalesce(F.sum("refs"), long(0)).alias("logical"),
        F.count(F.lit(1)).alias("physical"),
        F.coalesce(F.sum(F.col("refs") * F.col("len")), long(0)).alias("logical_bytes"),
        F.coalesce(F.sum("len"), long(0)).alias("physical_bytes"),
    )
    files = entries.agg(F.count_if(~F.col("is_dir")).alias("files"))
    # Both sides are one row.
    return files.join(c, F.lit(True)).select("files", "logical", "physical", F.greatest(F.col("logical") - F.col("physical"), long(0)).alias("dedup_chunks"), "logical_bytes", "physical_bytes")


# Running sums over a whole table, without one task that sees all rows.

#: Ranges, and the rows sampled (by hash) to cut text into them.
SPREAD, SAMPLED = 256, 1 << 14


def running(rows: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds, for each name in ``sums``, the sum of that column over all rows with a smaller ``order`` (distinct whole numbers or text).

    The rows are written once, as the steps that follow read them several times.  Quantiles of the order cut them into
    SPREAD ranges; sums of the ranges, one row each, are added up first, and then each range by itself."""
    rows = written(rows, "running")
    kind = rows.schema[order].dataType.simpleString()
    if kind in ("bigint", "int"):
        found = rows.agg(F.percentile_approx(order, [i / SPREAD for i in range(1, SPREAD)], 10_000)).first()[0] or []
        bounds = sorted(set(found))
    else:
        sample = sorted(r[0] for r in rows.select(order).orderBy(F.xxhash64(order)).limit(SAMPLED).collect())
        bounds = sorted(set(sample[:: max(1, len(sample) // SPREAD)]))
    at = F.size(F.filter(F.lit(bounds), lambda b: b < F.col(order))) if bounds else F.lit(0)
    placed = rows.withColumn("_range", at)
    totals = placed.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()])
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # SPREAD + 1 rows at most
    base = totals.select("_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), long(0)).alias(f"_base_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(base), "_range")
    added = {n: F.col(f"_base_{n}") + F.coalesce(F.sum(v).over(inside), long(0)) for n, v in sums.items()}
    return out.select(*rows.columns, *[c.alias(n) for n, c in added.items()])


def chunk_index(entry_chunks: DataFrame) -> DataFrame:
    """(id, plaintext_len, first_path, first_pos, block_index, data_offset): each distinct chunk once.

    The first occurrence by (path, pos) gives the chunk its place; blocks follow each other, each
    behind a length of PREFIX bytes."""
    first = entry_chunks.groupBy("chunk_id").agg(F.min(F.struct("path", "pos")).alias("at"), F.max("len").alias("plaintext_len"))
    rows = first.select(F.col("chunk_id").alias("id"), "plaintext_len", F.col("at.path").alias("first_path"), F.col("at.pos").alias("first_pos"))
    rows = rows.withColumn("_order", F.concat("first_path", F.lit("\0"), F.lpad(F.col("first_pos").cast("string"), 10, "0"))).withColumn("_one", long(1)).withColumn("_block", F.col("plaintext_len") + PREFIX)
    return running(rows, "_order", {"block_index": "_one", "data_offset": "_block"}).drop("_order", "_one", "_block")


def next_block_index(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(F.max("block_index") + 1, long(0)).alias("next_block_index"))


def reoffset(chunks: DataFrame) -> DataFrame:
    """Chunks with data_offset anew, in order of the block_index that they keep."""
    rows = chunks.drop("data_offset").withColumn("_block", F.col("block_len") + PREFIX)
    return running(rows, "block_index", {"data_offset": "_block"}).drop("_block")


def fresh_chunks(new: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks to add: each id once, the first in order of arrival, and only ids not yet there."""
    w = Window.partitionBy("id").orderBy("arrival")
    once = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.join(chunks.select("id"), "id", "left_anti")


def live_chunks(chunks: DataFrame, entry_chunks: DataFrame) -> DataFrame:
    """Chunks that some entry refers to, with new offsets and their old block_index."""
    live = entry_chunks.select(F.col("chunk_id").alias("id")).distinct()
    return reoffset(chunks.join(live, "id", "left_semi"))


# Changes of the tree: each returns new entries; chunks are referred to by path.


def _targets(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "target string")


def under(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Entries at or under any of (target)."""
    spots = entries.select("path", F.explode(F.array_append(paths.ancestors(F.col("path")), F.col("path"))).alias("target"))
    hit = spots.join(targets.distinct(), "target", "left_semi").select("path").distinct()
    return entries.join(hit, "path", "left_semi")


def delete(entries: DataFrame, names: list[str], recursive: bool = False) -> DataFrame:
    """Without the named entries and, if recursive, all under them.  Missing names, and directories
    with anything in them when not recursive, are errors."""
    targets = _targets(entries.sparkSession, names)
    found = kinds(entries, targets.select(F.col("target").alias("path"))).collect()
    if missing := sorted(r["path"] for r in found if r["kind"] == "none"):
        raise NotFound(", ".join(missing))
    gone = under(entries, targets)
    if not recursive:
        inside = gone.join(targets, F.col("path") == F.col("target"), "left_anti")
        if not inside.isEmpty():
            raise Conflict("a directory is not empty")
    return entries.join(gone.select("path"), "path", "left_anti")


def delete_lenient(entries: DataFrame, names: list[str]) -> DataFrame:
    """Subtrees gone, names that are missing ignored."""
    return entries.join(under(entries, _targets(entries.sparkSession, names)).select("path"), "path", "left_anti")


def make_directory(entries: DataFrame, path: str) -> DataFrame:
    """The directory and its missing ancestors added; an error if one of them is a file."""
    _check(path)
    parts = path.split("/")
    wanted = entries.sparkSession.createDataFrame([("/".join(parts[: i + 1]),) for i in range(len(parts))], "path string")
    if not entries.where(~F.col("is_dir")).join(wanted, "path", "left_semi").isEmpty():
        raise Conflict(f"{path} is or is under a file")
    new = wanted.join(entries.select("path"), "path", "left_anti").select("path", long(0).alias("size"), F.lit(True).alias("is_dir"))
    return entries.unionByName(new, allowMissingColumns=True)


def _check(path: str) -> None:
    parts = path.split("/")
    if not path or path[0] == "/" or "\\" in path or "\0" in path or path[1:2] == ":" or any(p in ("", ".", "..") for p in parts):
        raise InvalidPath(path)


def relocate(entries: DataFrame, old: str, new: str) -> DataFrame:
    """Rows at or under ``old`` with their paths under ``new``."""
    gone = under(entries, _targets(entries.sparkSession, [old]))
    return gone.withColumn("path", paths.remap(F.col("path"), old, new))


def _prepare(entries: DataFrame, old: str, new: str) -> DataFrame:
    _check(new)
    if new.startswith(old + "/"):
        raise Conflict(f"{new} is inside {old}")
    asked = entries.sparkSession.createDataFrame([(old,), (new,)], "path string")
    found = {r["path"]: r["kind"] for r in kinds(entries, asked).collect()}
    if found[old] == "none":
        raise NotFound(old)
    if found[new] != "none":
        raise Conflict(f"{new} exists")
    above = new.rpartition("/")[0]
    return make_directory(entries, above) if above else entries


def move(entries: DataFrame, old: str, new: str) -> DataFrame:
    """A file or subtree under another path; parents are made, the target must not exist."""
    if old == new:
        return entries
    ready = _prepare(entries, old, new)
    rest = ready.join(under(ready, _targets(ready.sparkSession, [old])).select("path"), "path", "left_anti")
    return rest.unionByName(relocate(entries, old, new))


def relocated_chunks(entry_chunks: DataFrame, old: str, new: str) -> DataFrame:
    """Chunk lists after a move: those at or under ``old`` under ``new``, the others as they are."""
    p = F.col("path")
    inside = (p == old) | paths.is_descendant(p, F.lit(old))
    return entry_chunks.withColumn("path", F.when(inside, paths.remap(p, old, new)).otherwise(p))


def renamed(old: str, name: str) -> str:
    """The path of ``old`` under another name in its directory."""
    if "/" in name or ".." in name:
        raise InvalidPath(name)
    above = old.rpartition("/")[0]
    return f"{above}/{name}" if above else name


def rename(entries: DataFrame, old: str, name: str) -> DataFrame:
    return move(entries, old, renamed(old, name))


def copy(entries: DataFrame, old: str, new: str) -> DataFrame:
    """A subtree twice, by its rows alone: chunks are shared."""
    if old == new:
        return entries
    return _prepare(entries, old, new).unionByName(relocate(entries, old, new))


def upsert(entries: DataFrame, new: DataFrame, replace: bool = True) -> DataFrame:
    """Entries and new ones; of equal paths the new replaces the old, or is skipped.

    New files whose path is a directory, or lies under a file, are an error."""
    tree = with_directories(entries)
    if not new.where(~F.col("is_dir")).join(tree.where("is_dir"), "path", "left_semi").isEmpty():
        raise Conflict("a new file is a directory already")
    if not orphans(new, entries).isEmpty():
        raise Conflict("a new entry lies under a file")
    if replace:
        return entries.join(new.select("path"), "path", "left_anti").unionByName(new, allowMissingColumns=True)
    return entries.unionByName(new.join(entries.select("path"), "path", "left_anti"), allowMissingColumns=True)


def orphans(new: DataFrame, entries: DataFrame) -> DataFrame:
    """(path): new entries that have a file among their ancestors."""
    above = new.select("path", F.explode(paths.ancestors(F.col("path"))).alias("above"))
    files = entries.where(~F.col("is_dir")).select(F.col("path").alias("above"))
    return above.join(files, "above", "left_semi").select("path").distinct()


def bounded(entries: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """The entries, or an error if there are more than ``most``; at most one row more is counted."""
    if entries.limit(most + 1).count() > most:
        raise ArchiveError(f"more than {most} entries")
    return entries
