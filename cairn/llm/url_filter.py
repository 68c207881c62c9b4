"""URL filters: a register-blocked Bloom filter in front of an exact hash join.

A list holds canonical entries (host, path prefix, verdict).  An entry fits its host and every
subdomain of it when the URL's path starts with the entry's path; the longest entry wins.

Every URL is turned into the canonical strings under which an entry could list it: its last
``n`` host labels followed by the first ``m`` characters of its path, for each *shape* (n, m)
that occurs in the list and is not longer than the URL.  Each
string is looked up in a blocked Bloom filter: one 64-bit word per block, ``BITS_SET`` bits of
that word per key, so one probe touches one word.  Only strings that may be listed go on to the
hash join on the string itself, which removes the false positives.

Everything is DataFrame code.  The filter's words become a literal array while they number at
most ``MAX_LITERAL_WORDS`` (512 KB); a longer list keeps them as a table joined on the block, and
Spark picks the join.  Neither limit drops entries.

Defined results: null URLs and URLs without ``://`` have empty host and path and get the default
verdict; repeated rows are kept; an empty list gives the default verdict to all; an empty table
gives no rows; other columns of the input are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import table, written

BITS_SET = 4
BITS_PER_KEY = 16
MAX_LITERAL_WORDS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _mask(key: Column) -> Column:
    """The bits of its block that a key sets: BITS_SET six-bit pieces of a second hash."""
    h = F.xxhash64(F.lit(7), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS_SET)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("bigint")


def filter_words(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word) of the Bloom filter over ``listed.key``."""
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word"))


def canonical_list(entries: DataFrame) -> DataFrame:
    """(key, rule, verdict) with one row per canonical entry of (host, path, verdict).

    Entries with a null host are dropped as they can fit no URL; of contradicting repeats of an
    entry ``block`` stays (the greater verdict)."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    return (
        entries.where(F.col("host").isNotNull())
        .select(host.alias("rule_host"), path.alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(
            F.concat("rule_host", F.lit("\n"), "rule_path").alias("key"),
            F.concat("rule_host", "rule_path").alias("rule"),
            "rule_verdict",
            _labels(F.col("rule_host")).alias("labels"),
            F.length("rule_path").alias("path_len"),
            F.length("rule_host").alias("host_len"),
        )
    )


def _candidates(shapes: dict[int, list[int]]) -> Column:
    """The strings under which a list of these shapes (path lengths by number of labels) could hold a (host, path).

    One expression over a map, however many shapes there are; a URL has at most labels times path length of them."""
    host, path = F.col("host"), F.col("path")
    lengths = F.create_map(*[x for n, ms in shapes.items() for x in (F.lit(n), F.lit(sorted(ms)))])
    counts = F.filter(F.lit(sorted(shapes)), lambda n: (n <= _labels(host)) & (host != ""))

    def of_count(n: Column) -> Column:
        tail = F.call_function("substring_index", host, F.lit("."), -n)
        fitting = F.filter(F.element_at(lengths, n), lambda m: m <= F.length(path))
        return F.transform(fitting, lambda m: F.concat(tail, F.lit("\n"), F.substring(path, F.lit(1), m)))

    return F.flatten(F.transform(counts, of_count))


def judge_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``; see the module's text.

    Verdicts depend on host and path alone.  Pairs of these that pass the filter are looked up once each; rows that
    do not pass are judged where they are and shuffle nowhere."""
    listed = written(canonical_list(entries), "listed")
    shapes: dict[int, list[int]] = {}
    for r in listed.select("labels", "path_len").distinct().collect():  # of the list: as many as its numbers of labels times its path lengths at most
        shapes.setdefault(r["labels"], []).append(r["path_len"])
    count = listed.count()
    blocks = max(64, count * BITS_PER_KEY // 64)

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    none = lambda df: df.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not shapes:
        return none(rows)
    keyed = _candidates(shapes)
    if blocks <= MAX_LITERAL_WORDS:
        words = [0] * blocks
        for r in filter_words(listed, blocks).collect():  # at most `blocks` rows
            words[r["block"]] = r["word"]
        bits = F.lit(words).cast("array<bigint>")
        hits = lambda: F.filter(keyed, lambda k: F.get(bits, _block(k, blocks).cast("int")).bitwiseAND(_mask(k)) == _mask(k))
        some = F.size(hits()) > 0
        possible = rows.where(some).select("host", "path", F.explode(hits()).alias("key")).distinct()
    else:
        some = F.size(keyed) > 0
        probes = rows.where(some).select("host", "path").distinct().select("host", "path", F.explode(keyed).alias("key")).withColumn("block", _block(F.col("key"), blocks))
        possible = probes.join(filter_words(listed, blocks), "block").where(F.col("word").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).select("host", "path", "key")
    exact = possible.join(listed.select("key", "rule", "rule_verdict", "host_len"), "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule", "rule_verdict")).alias("best"))
    judged = written(best.select("host", "path", "best.rule", F.col("best.rule_verdict").alias("verdict")), "judged")
    met = rows.where(some).join(judged, ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return none(rows.where(~some)).unionByName(met)


#: The rules that the query op5_url_filter judges by, in the contract's order.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(spark, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    entries = spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), entries)


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
host AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM host),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM fits
"""
