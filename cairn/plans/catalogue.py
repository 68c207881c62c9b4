"""The registered queries over the archive operators, and their SQL.

Rows of ``documents`` and other tables stand for files (see ``cairn.sources.rows``); chunks of
CHUNK bytes and packs of PACK bytes suit files of that size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import bytes as b
from cairn.functions import numbers, paths
from cairn.functions.numbers import long
from cairn.model import Bounds
from cairn.operators import catalog, chunking, codec, packing, parity, restore, validate, verify
from cairn.sources import headers
from cairn.sources.rows import directory_files, table_files

CHUNK, PACK, WINDOW, PCT = 4096, 262_144, 16_384, 15
GEAR = Bounds(4096, 8192, 65_536)
KEY = b"cairn-test-key-0123456789abcdef!"

QUERIES: dict = {}
SQL: dict[str, str] = {}

FILES = """files AS (SELECT 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, encode(text) AS content,
  octet_length(encode(text))::BIGINT AS size FROM documents)"""
CHUNKS = f"""{FILES}, cut AS (SELECT path, unnest(range(0, (size + {CHUNK - 1}) // {CHUNK}))::BIGINT AS i, content, size FROM files),
ec AS (SELECT path, i::INTEGER AS pos, i * {CHUNK} AS start, least({CHUNK}, size - i * {CHUNK})::BIGINT AS len,
  substr(sha256(array_slice(content, i * {CHUNK} + 1, i * {CHUNK} + {CHUNK})), 1, 32) AS chunk_id FROM cut)"""
INDEX = f"""{CHUNKS}, firsts AS (SELECT chunk_id AS id, max(len) AS plaintext_len, min(path || chr(1) || lpad(pos::VARCHAR, 10, '0')) AS place FROM ec GROUP BY 1),
idx AS (SELECT id, plaintext_len, row_number() OVER (ORDER BY place) - 1 AS block_index,
  coalesce(sum(plaintext_len + 8) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset FROM firsts)"""


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table_files(spark, sf, "documents")


def _entries(files: DataFrame) -> DataFrame:
    return files.select("path", "size", F.lit(False).alias("is_dir"))


def _blocks(files: DataFrame) -> DataFrame:
    """(id, data): the bytes of each distinct chunk."""
    n = F.octet_length("content").cast("bigint")
    parts = F.transform(F.sequence(long(0), numbers.ceil_div(n, CHUNK) - 1), lambda i: F.substring(F.col("content"), (i * CHUNK + 1).cast("int"), F.lit(CHUNK)))
    rows = files.where(F.octet_length("content") > 0).select(F.explode(parts).alias("data"))
    return rows.select(b.chunk_id(F.col("data")).alias("id"), "data").groupBy("id").agg(F.first("data").alias("data"))


@query(f"""WITH {CHUNKS}, d AS (SELECT chunk_id, count(*) AS refs, max(len) AS len FROM ec GROUP BY 1)
SELECT (SELECT count(*) FROM files)::BIGINT AS files, sum(refs)::BIGINT AS logical, count(*)::BIGINT AS physical, (sum(refs) - count(*))::BIGINT AS dedup_chunks,
  sum(refs * len)::BIGINT AS logical_bytes, sum(len)::BIGINT AS physical_bytes FROM d""")
def dedup_summary(spark, sf):
    files = _files(spark, sf)
    return catalog.summary(_entries(files), chunking.entry_chunks(files, CHUNK))


@query(f"""WITH {CHUNKS}, n AS (SELECT path, count(*) AS n FROM ec GROUP BY 1)
SELECT path, split_part(path, '/', -1) AS name, nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS parent, len(string_split(path, '/'))::INTEGER AS depth,
  size, false AS is_dir, coalesce(n, 0)::BIGINT AS chunk_count,
  CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN ((size * 10 + 512) // 1024) // 10 || '.' || ((size * 10 + 512) // 1024) % 10 || ' KiB'
    ELSE ((size * 10 + 524288) // 1048576) // 10 || '.' || ((size * 10 + 524288) // 1048576) % 10 || ' MiB' END AS size_text
FROM files LEFT JOIN n USING (path)""")
def entry_listing(spark, sf):
    files = _files(spark, sf)
    rows = catalog.listing(_entries(files), chunking.entry_chunks(files, CHUNK))
    return rows.withColumn("size_text", numbers.format_size(F.col("size")))


@query("""SELECT DISTINCT unnest(['docs', 'docs/' || lang, 'docs/' || lang || '/' || source]) AS path FROM documents""")
def implied_directories(spark, sf):
    return catalog.directories(_entries(_files(spark, sf)))


ASKED = """asked AS (SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' WHEN 1 THEN 'docs/' || lang WHEN 2 THEN 'docs/' || lang || '/' || source || '/' || doc_id
  WHEN 3 THEN 'made/' || lang WHEN 4 THEN 'made' END AS path FROM documents)"""


@query(f"""WITH {FILES}, {ASKED}, dirs AS (SELECT DISTINCT unnest(['docs', 'docs/' || lang, 'docs/' || lang || '/' || source]) AS path FROM documents)
SELECT path, CASE WHEN path IN (SELECT path FROM files) THEN 'file' WHEN starts_with(path, 'made') THEN 'directory' WHEN path IN (SELECT path FROM dirs) THEN 'implicit' ELSE 'none' END AS kind FROM asked WHERE path IS NOT NULL""")
def entry_kinds(spark, sf):
    """Paths of files, of directories with and without rows of their own, and of nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    k, folder = F.col("doc_id") % 5, F.concat(F.lit("docs/"), "lang")
    file = F.concat(folder, F.lit("/"), "source", F.lit("/"), "doc_id")
    asked = F.when(k == 0, F.concat(file, F.lit(".txt"))).when(k == 1, folder).when(k == 2, file).when(k == 3, F.concat(F.lit("made/"), "lang")).otherwise("made")
    made = docs.select(F.explode(F.array(F.lit("made"), F.concat(F.lit("made/"), "lang"))).alias("path")).where("path IS NOT NULL").distinct()
    entries = _entries(_files(spark, sf)).unionByName(made.select("path", long(0).alias("size"), F.lit(True).alias("is_dir")))
    return catalog.kinds(entries, docs.select(asked.alias("path")).where("path IS NOT NULL").distinct())


@query(f"""WITH {FILES} SELECT count(*)::BIGINT AS files, (SELECT count(DISTINCT d) FROM (SELECT unnest(['docs', 'docs/' || lang, 'docs/' || lang || '/' || source]) AS d FROM documents))::BIGINT AS dirs,
  sum(size)::BIGINT AS bytes FROM files""")
def tree_totals(spark, sf):
    tree = catalog.with_directories(_entries(_files(spark, sf)))
    return tree.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"), F.sum("size").alias("bytes"))


@query(f"WITH {INDEX} SELECT id, plaintext_len, block_index, data_offset FROM idx")
def chunk_index(spark, sf):
    rows = catalog.chunk_index(chunking.entry_chunks(_files(spark, sf), CHUNK))
    return rows.select("id", "plaintext_len", "block_index", "data_offset")


@query(f"WITH {INDEX} SELECT coalesce(max(block_index) + 1, 0)::BIGINT AS next_block_index FROM idx")
def next_block_index(spark, sf):
    return catalog.next_block_index(catalog.chunk_index(chunking.entry_chunks(_files(spark, sf), CHUNK)))


@query(f"WITH {FILES} SELECT path, sha256(content) AS sha256, 0::BIGINT AS missing FROM files")
def restore_files(spark, sf):
    """All files from their chunks, empty ones too."""
    files = _files(spark, sf)
    got = restore.restored(chunking.entry_chunks(files, CHUNK), _blocks(files), _entries(files))
    return got.select("path", F.sha2("content", 256).alias("sha256"), "missing")


@query(f"WITH {FILES} SELECT path, sha256(array_slice(content, 5001, 8000)) AS sha256, least(3000, size - 5000)::BIGINT AS len FROM files WHERE size > 5000")
def restore_slice(spark, sf):
    files = _files(spark, sf)
    got = restore.slices(chunking.entry_chunks(files, CHUNK), _blocks(files), 5000, 3000)
    return got.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("len"))


@query(f"""WITH {INDEX}, other AS (SELECT encode(text) AS content, octet_length(encode(text)) AS size FROM conversations),
oc AS (SELECT unnest(range(0, (size + {CHUNK - 1}) // {CHUNK})) AS i, content FROM other)
SELECT DISTINCT substr(sha256(array_slice(content, i * {CHUNK} + 1, i * {CHUNK} + {CHUNK})), 1, 32) AS id FROM oc
WHERE substr(sha256(array_slice(content, i * {CHUNK} + 1, i * {CHUNK} + {CHUNK})), 1, 32) NOT IN (SELECT id FROM idx)""")
def fresh_chunks(spark, sf):
    new = chunking.entry_chunks(table_files(spark, sf, "conversations"), CHUNK)
    new = new.select(F.col("chunk_id").alias("id"), F.struct("path", "pos").alias("arrival"))
    old = chunking.entry_chunks(_files(spark, sf), CHUNK).select(F.col("chunk_id").alias("id")).distinct()
    return catalog.fresh_chunks(new, old).select("id")


@query(f"""WITH {INDEX}, live AS (SELECT * FROM idx WHERE id IN (SELECT chunk_id FROM ec WHERE NOT starts_with(path, 'docs/en/')))
SELECT id, block_index, coalesce(sum(plaintext_len + 8) OVER (ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset FROM live""")
def collect_garbage(spark, sf):
    """Delete a subtree, then keep only chunks that are referred to, at new offsets."""
    files = _files(spark, sf)
    chunks = catalog.chunk_index(chunking.entry_chunks(files, CHUNK)).withColumn("block_len", F.col("plaintext_len"))
    left = catalog.delete(_entries(files), ["docs/en"], recursive=True)
    refs = chunking.entry_chunks(files, CHUNK).join(left.select("path"), "path", "left_semi")
    return catalog.live_chunks(chunks, refs).select("id", "block_index", "data_offset")


@query(f"WITH {FILES} SELECT path, size FROM files WHERE NOT starts_with(path, 'docs/de/') AND NOT starts_with(path, 'docs/fr/src1/')")
def delete_lenient(spark, sf):
    return catalog.delete_lenient(_entries(_files(spark, sf)), ["docs/de", "docs/fr/src1", "docs/missing"]).select("path", "size")


@query(f"""WITH {FILES} SELECT CASE WHEN starts_with(path, 'docs/en/') THEN 'archive/english' || substr(path, 8) ELSE path END AS path, size, false AS is_dir FROM files
UNION ALL SELECT 'archive', 0, true""")
def move_subtree(spark, sf):
    return catalog.move(_entries(_files(spark, sf)), "docs/en", "archive/english").select("path", "size", "is_dir")


@query(f"""WITH {FILES} SELECT path, size, false AS is_dir FROM files UNION ALL SELECT 'docs/english' || substr(path, 8), size, false FROM files WHERE starts_with(path, 'docs/en/')
UNION ALL SELECT 'docs', 0, true""")
def copy_subtree(spark, sf):
    return catalog.copy(_entries(_files(spark, sf)), "docs/en", "docs/english").select("path", "size", "is_dir")


@query(f"WITH {FILES} SELECT CASE WHEN starts_with(path, 'docs/en/') THEN 'docs/english' || substr(path, 8) ELSE path END AS path, size, false AS is_dir FROM files UNION ALL SELECT 'docs', 0, true")
def rename_directory(spark, sf):
    return catalog.rename(_entries(_files(spark, sf)), "docs/en", "english").select("path", "size", "is_dir")


@query(f"WITH {FILES} SELECT path, size, false AS is_dir FROM files UNION ALL SELECT unnest(['new', 'new/a', 'new/a/b']), 0, true")
def make_directory(spark, sf):
    return catalog.make_directory(_entries(_files(spark, sf)), "new/a/b").select("path", "size", "is_dir")


@query(f"""WITH {FILES}, incoming AS (SELECT path, 7::BIGINT AS size FROM files WHERE starts_with(path, 'docs/es/') UNION ALL SELECT 'bench/' || item_id || '.txt', octet_length(encode(text)) FROM benchmark)
SELECT path, size FROM files WHERE path NOT IN (SELECT path FROM incoming) UNION ALL SELECT path, size FROM incoming""")
def upsert_files(spark, sf):
    own = _entries(_files(spark, sf))
    new = own.where(F.startswith("path", F.lit("docs/es/"))).withColumn("size", long(7)).unionByName(_entries(table_files(spark, sf, "benchmark")))
    return catalog.upsert(own, new).select("path", "size")


@query(f"""WITH {FILES}, incoming AS (SELECT path || '/x' AS path FROM files WHERE starts_with(path, 'docs/es/') UNION ALL SELECT 'other/y') SELECT path FROM incoming WHERE path <> 'other/y'""")
def file_ancestors(spark, sf):
    """New entries below a file."""
    own = _entries(_files(spark, sf))
    new = own.where(F.startswith("path", F.lit("docs/es/"))).select(F.concat("path", F.lit("/x")).alias("path")).unionByName(spark.sql("SELECT 'other/y' AS path"))
    return catalog.orphans(new, own)


PACKS = f"""{FILES}, lanes AS (SELECT split_part(path, '/', 2) AS lane, path, size, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY path) AS n FROM files),
packed AS (WITH RECURSIVE r AS (
  SELECT lane, path, size, n, 0::BIGINT AS pack, 0::BIGINT AS start FROM lanes WHERE n = 1 UNION ALL
  SELECT l.lane, l.path, l.size, l.n, CASE WHEN r.start + r.size >= {PACK} THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.start + r.size >= {PACK} THEN 0 ELSE r.start + r.size END
  FROM r JOIN lanes l ON l.lane = r.lane AND l.n = r.n + 1) SELECT * FROM r)"""


@query(f"WITH {PACKS} SELECT lane, path, pack, start, start + size AS \"end\" FROM packed")
def pack_members(spark, sf):
    files = _files(spark, sf)
    rows = packing.assemble(packing.small_files(_entries(files)), PACK, F.split_part(F.col("path"), F.lit("/"), F.lit(2)))
    return rows.select("lane", "path", "pack", "start", "end")


@query(f"""WITH {PACKS} SELECT path, (start // {CHUNK})::INTEGER AS first_chunk, ((start + size - 1) // {CHUNK} - start // {CHUNK} + 1)::BIGINT AS chunks, (start % {CHUNK})::BIGINT AS pack_offset
FROM packed WHERE size > 0""")
def pack_coverage(spark, sf):
    """The chunks of a pack that hold each member, and where it starts in the first."""
    files = _files(spark, sf)
    members = packing.assemble(_entries(files), PACK, F.split_part(F.col("path"), F.lit("/"), F.lit(2)))
    packs = packing.pack_contents(members, files).select(F.concat_ws("/", "lane", "pack").alias("path"), "lane", "pack", "content")
    chunks = chunking.entry_chunks(packs, CHUNK, ["lane", "pack"])
    found = packing.covering(members, chunks)
    return found.groupBy("path").agg(F.min("pos").alias("first_chunk"), F.count(F.lit(1)).alias("chunks"), F.first("pack_offset").alias("pack_offset"))


@query(f"WITH {FILES} SELECT CASE WHEN size < 2000 THEN 'small' ELSE 'large' END AS kind, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1")
def small_and_large(spark, sf):
    rows = _entries(_files(spark, sf))
    both = packing.small_files(rows, 2000).withColumn("kind", F.lit("small")).unionByName(packing.large_files(rows, 2000).withColumn("kind", F.lit("large")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/' || url || '/ ' WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN 'C:\' || page_id WHEN 4 THEN 'a/./b' ELSE ' x/y' || page_id || ' ' END AS raw FROM pages),
c AS (SELECT page_id, raw, trim(trim(raw), '/') AS cut FROM p)
SELECT page_id, raw, raw <> '' AND NOT starts_with(raw, '/') AND NOT contains(raw, '\') AND NOT list_contains(string_split(raw, '/'), '..') AND substr(raw, 2, 1) <> ':' AS valid,
  CASE WHEN cut <> '' AND NOT contains(cut, '\') AND NOT list_contains(string_split(cut, '/'), '..') AND substr(cut, 2, 1) <> ':' AND NOT list_contains(string_split(cut, '/'), '') AND NOT list_contains(string_split(cut, '/'), '.') THEN cut END AS normal FROM c""")
def check_paths(spark, sf):
    k = F.col("page_id") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("/"), "url", F.lit("/ ")))
        .when(k == 1, F.regexp_replace("url", "^[a-z]+://", ""))
        .when(k == 2, F.concat(F.lit("a/../"), "page_id"))
        .when(k == 3, F.concat(F.lit("C:\\"), "page_id"))
        .when(k == 4, "a/./b")
        .otherwise(F.concat(F.lit(" x/y"), "page_id", F.lit(" ")))
    )
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", raw.alias("raw"))
    return rows.select("page_id", "raw", paths.is_valid(F.col("raw")).alias("valid"), paths.normalized(F.col("raw")).alias("normal"))


@query("""WITH p AS (SELECT CASE page_id % 4 WHEN 0 THEN 'a//' || page_id WHEN 1 THEN '/c/' || page_id WHEN 2 THEN 'x/' || (page_id // 8) ELSE 'y/' || page_id END AS path FROM pages)
SELECT path, CASE WHEN path LIKE 'a//%' OR path LIKE '/%' THEN 'not canonical' ELSE 'duplicate' END AS rule FROM p GROUP BY path HAVING path LIKE 'a//%' OR path LIKE '/%' OR count(*) > 1""")
def duplicate_paths(spark, sf):
    """Paths of which some are not canonical, and some come twice."""
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("a//"), k)).when(k % 4 == 1, F.concat(F.lit("/c/"), k)).when(k % 4 == 2, F.concat(F.lit("x/"), F.floor(k / 8))).otherwise(F.concat(F.lit("y/"), k))
    return validate.bad_paths(spark.read.parquet(f"{sf}/pages.parquet").select(path.alias("path")))


@query("""SELECT s_suppkey, s AS smallest, a AS average, m AS largest FROM (SELECT s_suppkey, (s_suppkey % 4) * 2048 AS s, 1024 * (s_suppkey % 9)::BIGINT AS a, 8192::BIGINT * (s_suppkey % 3) AS m FROM supplier)
WHERE NOT (s >= 4096 AND s <= a AND a <= m AND m <= 268435456 AND (a & (a - 1)) = 0)""")
def check_bounds(spark, sf):
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", ((k % 4) * 2048).alias("smallest"), ((k % 9) * 1024).alias("average"), ((k % 3) * 8192).alias("largest"))
    return validate.bad_bounds(rows)


@query("""SELECT o_orderkey, offs, n FROM (SELECT o_orderkey, ((o_orderkey % 3 - 1) * 4611686018427387904)::BIGINT AS offs, o_custkey AS n FROM orders)
WHERE offs < 0 OR offs::HUGEINT + n > 4611686018427387999""")
def check_ranges(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", ((F.col("o_orderkey") % 3 - 1) * long(1 << 62)).alias("offs"), F.col("o_custkey").alias("n"))
    return validate.bad_ranges(rows, "offs", "n", F.lit(4611686018427387999))


@query("""WITH x AS (SELECT 'e' || (CASE p_partkey % 5 WHEN 1 THEN p_partkey - 1 ELSE p_partkey END) AS extension_id, p_partkey % 5 = 2 AS critical, CASE p_partkey % 5 WHEN 3 THEN 95 WHEN 4 THEN 9223372036854775807 ELSE p_partkey % 50 END AS o, (p_partkey % 50)::BIGINT AS n FROM part)
SELECT extension_id, 'critical' AS rule FROM x WHERE critical UNION ALL SELECT extension_id, 'range' FROM x WHERE o::HUGEINT + n > 100 UNION ALL SELECT extension_id, 'duplicate' FROM x GROUP BY 1 HAVING count(*) > 1""")
def check_extensions(spark, sf):
    """Extensions of which some are critical, reach beyond the payload, overflow, or share their id."""
    k = F.col("p_partkey")
    offset = F.when(k % 5 == 3, long(95)).when(k % 5 == 4, long((1 << 63) - 1)).otherwise(k % 50)
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("e"), F.when(k % 5 == 1, k - 1).otherwise(k)).alias("extension_id"), (k % 5 == 2).alias("critical"), offset.alias("offset"), (k % 50).alias("length"))
    return validate.bad_extensions(rows, 100)


WRAPPER_SLOTS = ["pack", "chunk", "id", "compress", "crypt", "index", "extra"]


@query("""WITH s(slot, ok) AS (VALUES ('pack', 'greedy-pack'), ('chunk', 'gear-cdc'), ('id', 'sha256-128'), ('compress', 'zstd'), ('crypt', 'none'), ('index', 'json'), ('extra', 'x')),
w AS (SELECT n_nationkey AS k, slot, ok, row_number() OVER (PARTITION BY n_nationkey ORDER BY CASE slot WHEN 'pack' THEN 0 WHEN 'chunk' THEN 1 WHEN 'id' THEN 2 WHEN 'compress' THEN 3 WHEN 'crypt' THEN 4 WHEN 'index' THEN 5 ELSE 6 END) - 1 AS i FROM nation, s)
SELECT k AS archive, slot, CASE WHEN slot = 'extra' AND k % 2 = 0 THEN 'unknown slot' WHEN i = k % 7 THEN 'missing' WHEN i = (k + 2) % 7 THEN 'version' WHEN i = (k + 4) % 7 THEN 'algorithm' END AS rule FROM w
WHERE (slot = 'extra' AND k % 2 = 0) OR (slot <> 'extra' AND i IN (k % 7, (k + 2) % 7, (k + 4) % 7))""")
def check_wrappers(spark, sf):
    """The wrappers of an archive for each nation; some lack one, some have one of another version or algorithm, some have one too many."""
    from cairn.model import ALGORITHMS

    rows = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("archive"), F.posexplode(F.lit(WRAPPER_SLOTS)).alias("i", "slot"))
    k, i = F.col("archive"), F.col("i")
    rows = rows.where(F.when(F.col("slot") == "extra", k % 2 == 0).otherwise(i != k % 7))
    known = F.create_map(*[x for pair in ALGORITHMS.items() for x in map(F.lit, pair)])
    usual = F.coalesce(F.try_element_at(known, F.col("slot")), F.lit("x"))
    rows = rows.select("archive", "slot", F.when(i == (k + 4) % 7, "other").otherwise(usual).alias("algorithm_id"), F.when(i == (k + 2) % 7, 2).otherwise(1).alias("algorithm_version"))
    archives = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("archive"))
    return validate.bad_wrappers(rows, archives)


@query(f"""WITH {INDEX} SELECT id, 'offset' AS rule FROM idx WHERE block_index % 5 = 3 UNION ALL SELECT id, 'raw length' FROM idx WHERE block_index % 11 = 1""")
def check_chunks(spark, sf):
    rows = catalog.chunk_index(chunking.entry_chunks(_files(spark, sf), CHUNK))
    k = F.col("block_index")
    rows = rows.withColumn("data_offset", F.col("data_offset") + F.when(k % 5 == 3, 1).otherwise(0)).withColumn("block_len", F.col("plaintext_len"))
    rows = rows.withColumn("stored_raw", k % 11 == 1).withColumn("compressed_len", F.col("plaintext_len") - 1)
    return validate.bad_chunks(rows)


GRID = f"""{FILES}, pcts AS (SELECT unnest([5, 7, 15, 20, 25, 30, 60])::BIGINT AS pct),
g AS (SELECT path, size, pct, CASE WHEN least(greatest(pct, 5), 50) < 10 THEN 1 ELSE 2 END::BIGINT AS p, least(greatest(pct, 5), 50) AS c FROM files, pcts),
gk AS (SELECT *, greatest(2, (p * 100 + c // 2) // c)::BIGINT AS k FROM g),
gs AS (SELECT *, least(greatest((size + k - 1) // k, 4096), 1048576)::BIGINT AS shard FROM gk),
gg AS (SELECT *, ((size + shard - 1) // shard)::BIGINT AS shards FROM gs),
geo AS (SELECT *, ((shards + k - 1) // k)::BIGINT AS groups FROM gg)"""


@query(f"""WITH {GRID} SELECT path, pct, k, p, shard, shards, groups,
  CASE WHEN size = 0 THEN 0 ELSE 32 + 16 * (shards + p * groups) + p * groups * shard END::BIGINT AS payload FROM geo""")
def parity_geometry(spark, sf):
    rows = _files(spark, sf).select("path", "size", F.explode(F.lit([5, 7, 15, 20, 25, 30, 60]).cast("array<bigint>")).alias("pct"))
    k, p = numbers.grid(F.col("pct"))
    rows = rows.withColumn("k", k).withColumn("p", p)
    g = numbers.geometry(F.col("size"), F.col("k"))
    payload = numbers.payload_len(F.col("size"), F.col("k"), F.col("p"))
    return rows.select("path", "pct", "k", "p", *[c.alias(n) for n, c in g.items()], payload.alias("payload"))


TILES = f"""{FILES}, tiles AS (SELECT path, size, unnest(range(0, greatest((size + {WINDOW - 1}) // {WINDOW}, 1)))::BIGINT AS idx FROM files),
wins AS (SELECT path, idx, idx * {WINDOW} AS window_offset, least({WINDOW}, size - idx * {WINDOW})::BIGINT AS window_len FROM tiles)"""


@query(f"WITH {TILES} SELECT path, idx, window_offset, window_len FROM wins")
def parity_windows(spark, sf):
    rows = _files(spark, sf).select("path", F.explode(numbers.windows(F.col("size"), WINDOW)).alias("w"))
    return rows.select("path", "w.idx", "w.window_offset", "w.window_len")


@query(f"WITH {TILES} SELECT path AS file, idx, 'gap' AS rule FROM wins WHERE idx % 3 = 1 UNION ALL SELECT path, idx + 1, 'gap' FROM wins w WHERE idx % 3 = 1 AND (path, idx + 1) IN (SELECT path, idx FROM wins) UNION ALL SELECT path, idx, 'end' FROM wins w WHERE idx % 3 = 1 AND (path, idx + 1) NOT IN (SELECT path, idx FROM wins)")
def check_tiling(spark, sf):
    """Windows of which every third starts a byte late."""
    rows = _files(spark, sf).select("path", "size", F.explode(numbers.windows(F.col("size"), WINDOW)).alias("w"))
    late = F.when(F.col("w.idx") % 3 == 1, 1).otherwise(0)
    return validate.bad_tiling(rows.select(F.col("path").alias("file"), "w.idx", (F.col("w.window_offset") + late).alias("window_offset"), "w.window_len", F.col("size").alias("total")))


SHARDS = f"""{TILES}, k AS (SELECT w.*, content, 13::BIGINT AS k, least(greatest((window_len + 12) // 13, 4096), 1048576)::BIGINT AS shard FROM wins w JOIN files USING (path) WHERE window_len > 0),
i AS (SELECT *, unnest(range(0, (window_len + shard - 1) // shard))::BIGINT AS i FROM k),
sh AS (SELECT path, idx AS win, i // k AS grp, i % k AS slot, least(shard, window_len - i * shard)::BIGINT AS len, shard,
  array_slice(content, window_offset + i * shard + 1, window_offset + least((i + 1) * shard, window_len)) AS raw FROM i)"""


@query(f"WITH {SHARDS} SELECT path, win, grp, slot, len, substr(sha256(raw || from_hex(repeat('00', (shard - len)::INTEGER))), 1, 32) AS cksum FROM sh")
def data_shards(spark, sf):
    return parity.data_shards(_files(spark, sf), PCT, WINDOW).select("path", "win", "grp", "slot", "len", "cksum")


@query(f"""WITH {GRID.replace('[5, 7, 15, 20, 25, 30, 60]', '[15]')}, one AS (SELECT path, size, (333 + 168 + CASE WHEN size = 0 THEN 0 ELSE 32 + 16 * (shards + p * groups) + p * groups * shard END)::BIGINT AS sidecar_len FROM geo)
SELECT path, size, sidecar_len, CASE WHEN size > 20000 THEN 'too large' WHEN sidecar_len * 100 > size * 300 THEN 'not worth it' ELSE 'protect' END AS decision FROM one""")
def protection_gate(spark, sf):
    return parity.worth_protecting(_files(spark, sf), PCT, 300, cap=20_000)


@query(f"""WITH {INDEX} SELECT id, block_index, CASE WHEN starts_with(id, '2') THEN 'missing' WHEN starts_with(id, '0') THEN 'length' ELSE 'hash' END AS problem FROM idx WHERE substr(id, 1, 1) IN ('0', '1', '2')""")
def scrub_damage(spark, sf):
    """Blocks of which some are cut, changed or gone."""
    files = _files(spark, sf)
    blocks = _blocks(files)
    chunks = catalog.chunk_index(chunking.entry_chunks(files, CHUNK)).join(blocks.select("id", b.block_hash(F.col("data")).alias("cipher_hash"), F.octet_length("data").cast("bigint").alias("block_len")), "id")
    damaged = F.when(F.startswith("id", F.lit("0")), F.substring(F.col("data"), F.lit(1), F.octet_length("data") - 1)).when(F.startswith("id", F.lit("1")), F.concat(F.lit(b"\xff"), F.substring("data", 2, CHUNK))).otherwise(F.col("data"))
    stored = blocks.where(~F.startswith("id", F.lit("2"))).select("id", damaged.alias("block"))
    return verify.scrub(chunks, stored)


@query(f"WITH {CHUNKS} SELECT path, pos, chunk_id AS id, 'hash' AS problem FROM ec WHERE starts_with(chunk_id, '1')")
def damaged_entries(spark, sf):
    ec = chunking.entry_chunks(_files(spark, sf), CHUNK)
    bad = ec.where(F.startswith("chunk_id", F.lit("1"))).select(F.col("chunk_id").alias("id"), F.lit("hash").alias("problem")).distinct()
    return verify.damaged_entries(bad, ec)


@query("SELECT n_name AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'explicit' WHEN n_nationkey % 3 = 0 THEN 'sidecar' WHEN n_nationkey % 5 = 0 THEN 'embedded' ELSE 'none' END AS source FROM nation")
def parity_source(spark, sf):
    k = F.col("n_nationkey")
    return verify.parity_source(spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("file"), (k % 2 == 0).alias("explicit"), (k % 3 == 0).alias("sidecar"), (k % 5 == 0).alias("embedded")))


@query("SELECT n_name, hex(encode(n_name)) AS voted FROM nation")
def majority_vote(spark, sf):
    """Three copies of a record, of which one has a wrong byte."""
    raw = F.encode("n_name", "UTF-8")
    wrong = F.concat(F.substring(raw, 1, 1), F.lit(b"\x00"), F.substring(raw, 3, 100))
    k = F.col("n_nationkey") % 3
    copies = [F.when(k == i, wrong).otherwise(raw) for i in range(3)]
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_name", F.hex(b.majority(*copies)).alias("voted"))


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'low' WHEN 1 THEN ' Medium ' WHEN 2 THEN 'quartile' WHEN 3 THEN 'HIGH' WHEN 4 THEN (p_partkey % 90) || '%' WHEN 5 THEN (p_partkey % 90) || ' ' ELSE 'x' || p_partkey END AS level,
  (CASE p_partkey % 7 WHEN 0 THEN 7 WHEN 1 THEN 15 WHEN 2 THEN 25 WHEN 3 THEN 30 WHEN 4 THEN least(greatest(p_partkey % 90, 5), 50) WHEN 5 THEN least(greatest(p_partkey % 90, 5), 50) END)::VARCHAR AS pct FROM part""")
def parity_levels(spark, sf):
    k = F.col("p_partkey")
    named = F.when(k % 7 == 0, "low").when(k % 7 == 1, " Medium ").when(k % 7 == 2, "quartile").when(k % 7 == 3, "HIGH")
    level = named.when(k % 7 == 4, F.concat(k % 90, F.lit("%"))).when(k % 7 == 5, F.concat(k % 90, F.lit(" "))).otherwise(F.concat(F.lit("x"), k))
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", level.alias("level"))
    return rows.select("p_partkey", "level", numbers.level_pct(F.col("level")).cast("string").alias("pct"))


@query("SELECT doc_id, lower(hex(encode('cairn'))) || printf('%02x', (doc_id >> 0) & 255) || printf('%02x', (doc_id >> 8) & 255) || printf('%02x', (doc_id >> 16) & 255) || printf('%02x', (doc_id >> 24) & 255) || printf('%02x', (doc_id >> 32) & 255) || printf('%02x', (doc_id >> 40) & 255) || printf('%02x', (doc_id >> 48) & 255) || printf('%02x', (doc_id >> 56) & 255) || md5(text) AS aad, replace(replace(rtrim(to_base64(encode(substr(text, 1, 20))), '='), '+', '-'), '/', '_') AS token, doc_id AS back FROM documents")
def byte_codecs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    return rows.select("doc_id", F.lower(F.hex(b.block_aad("cairn", F.col("doc_id"), F.md5(F.encode("text", "UTF-8"))))).alias("aad"), b.base64url(F.encode(F.substring("text", 1, 20), "UTF-8")).alias("token"), b.read_le(b.write_le(F.col("doc_id")), 0, 8).cast("bigint").alias("back"))


@query(f"WITH {FILES} SELECT path, sha256(encode('cairn-sidecar-v1') || from_hex(sha256(content))) AS binding_id FROM files")
def sidecar_binding(spark, sf):
    rows = _files(spark, sf)
    return rows.select("path", b.binding_id(F.sha2("content", 256)).alias("binding_id"))


@query(f"WITH {FILES} SELECT path, CASE WHEN size % 4 = 1 THEN 'length' ELSE 'content' END AS problem FROM files WHERE size % 4 IN (1, 2)")
def binding_problems(spark, sf):
    files = _files(spark, sf)
    k = F.col("size") % 4
    wrong = F.when(k == 2, F.sha2(F.lit(b"other"), 256)).otherwise(F.sha2("content", 256))
    cars = files.select("path", wrong.alias("content_sha256"), (F.col("size") + F.when(k == 1, 1).otherwise(0)).alias("total_len"))
    return verify.binding_problems(cars.withColumn("binding_id", b.binding_id(F.col("content_sha256"))), files)


@query(f"WITH {FILES} SELECT path, sha256(content) AS sha256, (size > 100)::BIGINT AS rebuilt, CASE WHEN size > 100 THEN 'repaired' ELSE 'clean' END AS status FROM files")
def repair_files(spark, sf):
    """A byte of every longer file is changed, and repaired from parity."""
    files = _files(spark, sf)
    shards = parity.protect(files, PCT, WINDOW)
    expected = files.select("path", F.sha2("content", 256).alias("sha256"))
    got = parity.repair(verify.corrupted(files, 100), shards, expected, PCT, WINDOW)
    return got.select("path", F.sha2("content", 256).alias("sha256"), "rebuilt", "status")


@query(f"""WITH {SHARDS}, g AS (SELECT path, win, grp, count(*) AS n FROM sh GROUP BY ALL), f AS (SELECT count(*) AS bad FROM files WHERE size > 100)
SELECT sum(n)::BIGINT AS total_data_shards, (2 * count(*))::BIGINT AS total_parity_shards, (SELECT bad FROM f)::BIGINT AS damaged_data_shards, 0::BIGINT AS damaged_parity_shards,
  count(*)::BIGINT AS groups, 0::BIGINT AS unrecoverable_groups FROM g""")
def parity_health(spark, sf):
    files = _files(spark, sf)
    return parity.health(verify.corrupted(files, 100), parity.protect(files, PCT, WINDOW), PCT, WINDOW)


@query(f"WITH {CHUNKS} SELECT chunk_id AS id, max(len)::BIGINT AS plaintext_len, true AS same FROM ec GROUP BY 1")
def compress_round_trip(spark, sf):
    blocks = _blocks(_files(spark, sf))
    packed = codec.compressed(blocks)
    back = codec.decompressed(packed)
    return packed.join(back, "id").select("id", "plaintext_len", (b.chunk_id(F.col("data")) == F.col("id")).alias("same"))


@query(f"WITH {FILES} SELECT path, sha256(content) AS sha256, size + 28 AS stored, true AS tamper_found FROM files")
def encrypt_round_trip(spark, sf):
    files = _files(spark, sf)
    key, iv, aad = F.lit(KEY), F.unhex(F.substring(F.sha2(F.encode("path", "UTF-8"), 256), 1, 24)), F.encode("path", "UTF-8")
    rows = files.select("path", codec.encrypted(F.col("content"), key, iv, aad).alias("block"))
    back = codec.decrypted(F.col("block"), key, F.encode("path", "UTF-8"))
    wrong = codec.decrypted(F.col("block"), key, F.lit(b"other"))
    return rows.select("path", F.sha2(back, 256).alias("sha256"), F.octet_length("block").cast("bigint").alias("stored"), wrong.isNull().alias("tamper_found"))


@query(f"WITH {FILES} SELECT path, true AS is_archive, true AS authentic, false AS forged, 1 AS version, size AS data_len FROM files")
def archive_headers(spark, sf):
    """Headers are made, read, authenticated, and a change in them is found."""
    rows = _files(spark, sf)
    zero = long(0)
    made = headers.header(KEY, F.lit(1), F.lit(1), data_offset=long(512), data_len=F.col("size"), manifest_offset=F.col("size") + 512, manifest_len=zero, extension_offset=zero, extension_len=zero)
    rows = rows.select("path", made.alias("h"))
    forged = F.concat(F.substring("h", 1, 19), F.lit(b"\x01"), F.substring("h", 21, 512))
    seen = headers.peek(F.col("h"))
    return rows.select("path", headers.is_archive(F.col("h")).alias("is_archive"), headers.is_authentic(F.col("h"), KEY).alias("authentic"), F.when(forged != F.col("h"), headers.is_authentic(forged, KEY)).alias("forged"), seen["version"].alias("version"), seen["data_len"].cast("bigint").alias("data_len"))


@query()
def gear_chunks(spark, sf):
    """Content-defined chunks; SQL cannot express the rolling state at this size."""
    return chunking.gear_chunks(_files(spark, sf), GEAR)


@query()
def gear_dedup_summary(spark, sf):
    files = _files(spark, sf)
    return catalog.summary(_entries(files), chunking.gear_chunks(files, GEAR))


@query()
def scan_directory(spark, sf):
    """The files of the data folder itself, without their bytes."""
    return directory_files(spark, sf, content=False).select("path", "size")


