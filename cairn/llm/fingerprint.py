"""Document fingerprints: a canonical exact digest.

``canonical`` brings a text to NFKC, folds case by Unicode's full folding, normalises again and
turns each run of white space into one space, without any at the ends.  ICU (part of Spark, which
uses it for collations) is called through Spark's own ``java_method`` SQL function, so no Python
runs on executors.  The fingerprint is two XXH64 values of the canonical text under different
seeds, 128 bits in 32 hexadecimal digits.

Texts belong together only if their canonical texts are equal byte for byte: ``with_groups``
finds the fingerprints that occur more than once, and compares the texts of those buckets by
grouping on the canonical text itself.  Likeness of two fingerprints is 1.0 if they are equal and the
texts behind them too, else 0.0: an exact digest has nothing in between.

Defined results: null texts count as empty ones; empty texts share one fingerprint; repeated rows
are kept; of rows with one id or none, the one whose text has the smaller XXH64 value comes first, and equal rows stand together;
an empty table gives no rows; other columns of the input are ignored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import table, written

#: Quantiles of the id that split it into ranges, and the most parts that each range is split into.
RANGES, MOST_PARTS, ROWS_PER_PART = 255, 1024, 50_000
#: Bits of the filter of repeated fingerprints for each of them, and at most (8 MB): a fuller one lets more texts pass.
FILTER_SHARE, FILTER_BITS = 16, 1 << 26


def _icu(cls: str, method: str, *args: Column) -> Column:
    return F.call_function("java_method", F.lit(f"com.ibm.icu.{cls}"), F.lit(method), *args)


def canonical(text: Column) -> Column:
    """NFKC, case folded, white space folded; null becomes empty."""
    yes = F.lit(True)
    once = _icu("text.Normalizer", "compose", F.coalesce(text, F.lit("")), yes)
    folded = _icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", once, yes), yes)
    return F.btrim(F.regexp_replace(folded, r"(?U)\s+", " "))


def _hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def digest(canon: Column) -> Column:
    """32 hexadecimal digits: XXH64 with seed 42, then with a seed made from 1."""
    return F.concat(_hex(F.xxhash64(canon)), _hex(F.xxhash64(F.lit(1), canon)))


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` and a column with the fingerprint of each whole text."""
    return docs.withColumn(name, digest(canonical(F.col(text_col))))


def may_be_in(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``keys``, and few others until the filter fills up.

    The filter is one bit for each key, in bitmaps of 32,768 bits that are broadcast, so no row of ``df`` is shuffled."""
    bits = min(FILTER_BITS, max(1 << 15, 1 << (FILTER_SHARE * keys.count()).bit_length()))
    slot = F.xxhash64(column).bitwiseAND(F.lit(bits - 1).cast("bigint"))
    maps = keys.select(F.shiftright(slot, 15).alias("_map"), slot.bitwiseAND(F.lit(32767).cast("bigint")).alias("_at")).repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(slot, 3).bitwiseAND(F.lit(4095).cast("bigint")).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, slot.bitwiseAND(F.lit(7).cast("bigint")).cast("int")) == 1
    return df.join(F.broadcast(maps), (F.shiftright(slot, 15) == F.col("_map")) & is_set, "left_semi")


def with_groups(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rows`` (with id and fingerprint of each row of ``docs``) and group_id, the smallest id with an equal canonical text.

    Fingerprints that occur once are their own group and, but for the few that a filter of the others lets pass, move no text,
    whatever the size of the tables.  Texts of fingerprints that
    occur more than once are grouped on (fingerprint, canonical text): that is the comparison of bytes.  Both
    groupings combine before they shuffle, so a text with a third of all rows costs one row a task, and what
    is joined afterwards has no text, unless unequal texts share a fingerprint.  A group without ids has none."""
    keyed = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    repeated = written(rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"), "repeated")
    classes = written(may_be_in(keyed, repeated, "fingerprint").groupBy("fingerprint", "canon").agg(F.min("id").alias("group_id")), "classes")
    one = written(classes.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("classes"), F.min("group_id").alias("group_id")), "groups")
    unequal = one.where("classes > 1").select("fingerprint")
    out = rows.join(one.where("classes = 1").select("fingerprint", F.col("group_id").alias("_group")), "fingerprint", "left")
    if unequal.isEmpty():
        return out.withColumn("group_id", F.coalesce("_group", id_col)).drop("_group")
    apart = keyed.join(unequal, "fingerprint", "left_semi").join(classes, ["fingerprint", "canon"]).select(F.col("id").alias("_id"), F.col("fingerprint").alias("_fp"), F.col("group_id").alias("_apart")).distinct()
    out = out.join(apart, (F.col("fingerprint") == F.col("_fp")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return out.withColumn("group_id", F.coalesce("_group", "_apart", id_col)).drop("_group", "_apart", "_id", "_fp")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, group_id) of each row."""
    rows = written(with_fingerprint(docs.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, "fingerprint"), "prints")
    return with_groups(rows, docs, id_col, text_col)


def with_next(rows: DataFrame, id_col: str, columns: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows by ascending id; the last gets the first's.

    ``derive`` adds those of the columns that are costly; it runs once a row, and not on what only
    the search for neighbours reads.  Null ids come first; equal ids are ordered by a hash of ``own``, the columns
    that are there, and then by these.  Quantiles of the id cut the rows into many ranges, and rows without an id, or with one that is
    found very often, are cut further by that hash; a window inside a range finds the followers, and a copy of the first row of
    the next range that has rows closes each range.  So the rows shuffle once and never meet in
    one task, but for equal rows.  What the driver sees is one id for each range, of which there are at most
    2 * (RANGES + 1) * MOST_PARTS."""
    own = [c for c in columns if c in rows.columns]
    spark = rows.sparkSession
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(id_col, [i / (RANGES + 1) for i in range(1, RANGES + 1)], 10_000).alias("q"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    parts = max(1, min(MOST_PARTS, -(-stats["n"] // (ROWS_PER_PART * (RANGES + 1)))))
    pieces = max(1, min(MOST_PARTS, -(-stats["n"] // ROWS_PER_PART)))
    found = stats["q"] or []
    bounds = sorted(set(found))
    often = sorted({a for a, b in zip(found, found[1:]) if a == b})  # ids with more than a range's share of the rows
    edges = F.lit([stats["lo"], *bounds, stats["hi"]]) if bounds else F.lit([0, 0])
    at = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b < F.col(id_col)))
    low, high = F.get(edges, at), F.get(edges, at + 1)
    within = F.when(high > low, F.least(F.lit(parts - 1), F.floor((F.col(id_col) - low) / (high - low) * parts))).otherwise(0)
    piece = F.floor((F.col("_hash") / F.lit(2.0**64) + 0.5) * pieces)  # of the rows of one id or none, in order of their hash
    piece = F.greatest(F.lit(0), F.least(F.lit(pieces - 1), piece))
    bucket = F.when(F.col(id_col).isNull(), piece - pieces).when(F.col(id_col).isin(often) if often else F.lit(False), at * (parts + pieces) + parts + piece).otherwise(at * (parts + pieces) + within).cast("bigint")
    rows = rows.withColumn("_hash", F.xxhash64(*own))
    firsts = rows.select(id_col, "_hash", bucket.alias("_bucket")).groupBy("_bucket").agg(F.min(F.struct(F.col(id_col).alias("id"), F.col("_hash").alias("hash"))).alias("first")).orderBy("_bucket").collect()
    follow = [(a["_bucket"], b["first"]["id"], b["first"]["hash"]) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    closing = spark.createDataFrame(follow, "_to bigint, _first bigint, _first_hash bigint").coalesce(1)
    heads = rows.join(F.broadcast(closing), F.col(id_col).eqNullSafe(F.col("_first")) & (F.col("_hash") == F.col("_first_hash"))).dropDuplicates(["_to"])
    heads = derive(heads).select("_to", "_first", "_first_hash", *columns)
    placed = derive(rows).select(id_col, "_hash", *columns, bucket.alias("_bucket"))
    both = placed.withColumn("_end", F.lit(0)).unionByName(heads.select(F.col("_first").alias(id_col), F.col("_first_hash").alias("_hash"), *columns, F.col("_to").alias("_bucket"), F.lit(1).alias("_end")))
    order = Window.partitionBy("_bucket").orderBy("_end", F.asc_nulls_first(id_col), "_hash", *own)
    ahead = both.select(id_col, *columns, "_end", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return ahead.where("_end = 0").drop("_end")


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's, their likeness, and the group of equal texts.

    The edited text is the text with its last floor(n/4) code points replaced by the first as many
    of the next document (all of it if it has fewer)."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, id_col, ["text", "fingerprint"], with_fingerprint)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    rows = rows.select(id_col, n.cast("bigint").alias("n_chars"), "text", "next_text", "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.withColumn("edited_fingerprint", digest(canonical(F.col("edited"))))

    def like(other: str, its_text: str) -> Column:
        """Equal digests, and then equal texts."""
        return F.when(F.col("fingerprint") == F.col(other), canonical(F.col("text")) == canonical(F.col(its_text))).otherwise(False).cast("double")

    rows = rows.select(
        id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        like("edited_fingerprint", "edited").alias("near_edited"), like("next_fingerprint", "next_text").alias("near_next"),
    )
    return with_groups(written(rows, "edited"), docs, id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    return edit_and_compare(table(spark, sf_dir, "documents"))
