"""Registered queries over whole archives: what a store keeps, sidecars, and the smaller functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import bytes as b
from cairn.functions import names, numbers, paths
from cairn.functions.numbers import long
from cairn.model import Options
from cairn.operators import archive as archives
from cairn.operators import catalog, codec, parity, validate, verify
from cairn.operators.archive import Archive
from cairn.plans.catalogue import CHUNK, CHUNKS, FILES, INDEX, KEY, PACK, PACKS, PCT, SHARDS, TILES, WINDOW, _entries, _files, query
from cairn.scratch import shared_dir, written
from cairn.sources import headers, manifest, sidecar
from cairn.sources.rows import table_files
from cairn.sources.store import Store

LIST = f"""{FILES}, n AS (SELECT path, ((size + {CHUNK - 1}) // {CHUNK})::BIGINT AS n, size, sha256(content) AS sha256 FROM files)"""


def _root(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _archive(spark: SparkSession, sf: str, key: bytes | None = None) -> Archive:
    """An archive of the documents' files, made anew."""
    own = Archive.create(Store(spark, _root(spark, "archive")), CHUNK, Options(level=3), key)
    own.add(_files(spark, sf).select("path", "content"))
    return own


def _digests(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"), "missing")


def _stream(spark: SparkSession, sf: str) -> Store:
    """A store that documents have come into as a stream."""
    from cairn.streaming.ingest import ingest_stream, stream_files

    root = _root(spark, "stream")
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    path = F.expr("concat('docs/', lang, '/', source, '/', doc_id, '.txt')")
    folder = f"{sf}/documents.parquet" if _is_folder(spark, f"{sf}/documents.parquet") else f"{sf}/documents*.parquet"
    store = Store(spark, f"{root}/store")
    ingest_stream(stream_files(spark, folder, schema, path, F.col("text")), store, CHUNK, f"{root}/checkpoint").awaitTermination()
    return store


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(f"WITH {CHUNKS} SELECT path, pos, start, len, chunk_id FROM ec")
def stream_ingest(spark, sf):
    """Documents through a stream into a store, and their chunk lists read back."""
    return _stream(spark, sf).table("entry_chunks").select("path", "pos", "start", "len", "chunk_id")


@query(f"WITH {FILES} SELECT path, sha256(content) AS sha256, 0::BIGINT AS missing FROM files")
def stream_restore(spark, sf):
    """Documents through a stream into a store, and their bytes restored from its blocks."""
    return _digests(Archive(_stream(spark, sf), CHUNK).files())


@query(f"WITH {INDEX} SELECT count(*)::BIGINT AS chunks, sum(plaintext_len)::BIGINT AS plain_bytes, count(*)::BIGINT AS blocks, count(*) - 1 AS last_index, true AS offsets_follow FROM idx")
def stored_chunks(spark, sf):
    """Chunks of a store that files were added to twice: each once, at offsets that follow each other."""
    own = _archive(spark, sf)
    own.add(_files(spark, sf).select(F.concat(F.lit("again/"), "path").alias("path"), "content"))
    chunks = own.chunks()
    wrong = validate.bad_chunks(chunks)
    total = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.sum("plaintext_len").alias("plain_bytes"), F.max("block_index").alias("last_index"))
    blocks = own.store.table("blocks").agg(F.count(F.lit(1)).alias("blocks"))
    return total.join(blocks, F.lit(True)).join(wrong.agg((F.count(F.lit(1)) == 0).alias("offsets_follow")), F.lit(True)).select("chunks", "plain_bytes", "blocks", "last_index", "offsets_follow")


@query(f"""WITH {FILES}, m AS (SELECT CASE WHEN starts_with(path, 'docs/en/') THEN 'archive/english' || substr(path, 8) ELSE path END AS path, content FROM files WHERE NOT starts_with(path, 'docs/de/'))
SELECT path, sha256(content) AS sha256, 0::BIGINT AS missing FROM m UNION ALL SELECT 'docs/espanol' || substr(path, 8), sha256(content), 0 FROM m WHERE starts_with(path, 'docs/es/')""")
def archive_changes(spark, sf):
    """Move, copy and delete subtrees of a store, and then restore every file."""
    own = _archive(spark, sf)
    own.move("docs/en", "archive/english")
    own.delete(["docs/de"], recursive=True)
    own.copy("docs/es", "docs/spanish")
    own.rename("docs/spanish", "espanol")
    return _digests(own.files())


@query(f"""WITH {INDEX}, dead AS (SELECT * FROM idx WHERE id NOT IN (SELECT chunk_id FROM ec WHERE NOT starts_with(path, 'docs/en/')))
SELECT count(*)::BIGINT AS chunks_before, (count(*) - (SELECT count(*) FROM dead))::BIGINT AS chunks_after, (SELECT count(*) > 0 FROM dead) AS saved, (count(*) - (SELECT count(*) FROM dead))::BIGINT AS blocks, (SELECT count(*) FROM files WHERE NOT starts_with(path, 'docs/en/'))::BIGINT AS whole_files FROM idx""")
def archive_compact(spark, sf):
    """What compaction reports after a delete, and that nothing that is left has suffered."""
    own = _archive(spark, sf)
    own.delete(["docs/en"], recursive=True)
    done = own.compact()
    blocks = own.store.table("blocks").agg(F.count(F.lit(1)).alias("blocks"))
    whole = own.files().agg(F.count_if(F.col("missing") == 0).alias("whole_files"))
    report = blocks.join(whole, F.lit(True))
    return report.select(long(done.chunks_before).alias("chunks_before"), long(done.chunks_after).alias("chunks_after"), F.lit(done.saved > 0).alias("saved"), "blocks", "whole_files")


@query(f"""WITH {FILES}, later AS (SELECT 'docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, encode('new ' || doc_id) AS content FROM documents WHERE lang = 'es' UNION ALL SELECT 'bench/' || item_id || '.txt', encode(text) FROM benchmark)
SELECT path, sha256(content) AS sha256, 0::BIGINT AS missing FROM later UNION ALL SELECT path, sha256(content), 0 FROM files WHERE path NOT IN (SELECT path FROM later)""")
def archive_upsert(spark, sf):
    """Files added to a store that has some of them: those are replaced, the bytes of all are restored."""
    own = _archive(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'es'")
    later = docs.select(F.expr("concat('docs/', lang, '/', source, '/', doc_id, '.txt')").alias("path"), F.encode(F.concat(F.lit("new "), "doc_id"), "UTF-8").alias("content"))
    own.add(later.unionByName(table_files(spark, sf, "benchmark").select("path", "content")))
    return _digests(own.files())


@query(f"WITH {FILES} SELECT path, sha256(content) AS sha256, 0::BIGINT AS missing, true AS wrong_key_fails FROM files")
def archive_encrypted(spark, sf):
    """An encrypted store, read with its key and with another."""
    own = _archive(spark, sf, KEY)
    other = Archive(own.store, CHUNK, key=KEY[::-1]).files().select("path", (F.col("content").isNull() | (F.octet_length("content") == 0)).alias("wrong_key_fails"))
    return _digests(own.files()).join(other, "path")


@query(f"WITH {FILES} SELECT path, sha256(content) AS sha256, 0::BIGINT AS missing FROM files")
def archive_password(spark, sf):
    """Two layers of encryption and a password, which is changed before the archive is opened and read."""
    own = Archive.create(Store(spark, _root(spark, "archive")), CHUNK, password="first", cascade=True)
    own.add(_files(spark, sf).select("path", "content"))
    own.change_password("second")
    return _digests(Archive.open(own.store, "second").files())


@query("""SELECT doc_id, source || '/' || lang AS shown, true AS alike, true AS refused FROM documents""")
def hidden_names(spark, sf):
    """Names that are hidden and read back; a changed token and another key are refused."""
    name = F.concat("source", F.lit("/"), "lang")
    token = codec.hidden_name(KEY, name)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", token.alias("token"), codec.hidden_name(KEY, name).alias("again"))
    other = F.concat(F.when(F.substring("token", 1, 1) == "A", "B").otherwise("A"), F.substr("token", F.lit(2)))
    refused = codec.shown_name(KEY, other).isNull() & codec.shown_name(KEY[::-1], F.col("token")).isNull()
    return rows.select("doc_id", codec.shown_name(KEY, F.col("token")).alias("shown"), (F.col("token") == F.col("again")).alias("alike"), refused.alias("refused"))


@query(f"WITH {FILES} SELECT path, sha256(array_slice(content, 5001, 8000)) AS sha256 FROM files WHERE size > 5000")
def archive_slices(spark, sf):
    return _archive(spark, sf).slices(5000, 3000).select("path", F.sha2("content", 256).alias("sha256"))


@query(f"WITH {INDEX} SELECT id, CASE WHEN starts_with(id, '00') THEN 'unrecoverable' ELSE 'repaired' END AS status, NOT starts_with(id, '00') AS whole_after FROM idx WHERE starts_with(id, '0')")
def archive_repair(spark, sf):
    """Blocks of a store are damaged, some with their parity; repair mends what parity reaches and commits that alone."""
    own = _archive(spark, sf)
    own.protect(PCT, WINDOW)
    base = own.store.current()
    hit = F.startswith("id", F.lit("0"))
    broken = verify.corrupted(own.store.table("blocks", base).withColumnRenamed("block", "content"), 0).withColumnRenamed("content", "block")
    blocks = own.store.table("blocks", base).where(~hit).unionByName(broken.where(hit))
    shards = own.store.table("shards", base).where(~(F.startswith("path", F.lit("00")) & F.col("is_parity")))
    own.store.commit({"blocks": blocks, "shards": shards}, base)
    status = own.repair()
    left = own.scrub().select("id", F.lit(True).alias("bad"))
    return status.join(left, "id", "left").select("id", "status", F.col("bad").isNull().alias("whole_after"))


@query("SELECT 'before' AS step, false AS embedded, false AS detached, 'none' AS source UNION ALL SELECT 'protected', true, false, 'embedded' UNION ALL SELECT 'exported', true, true, 'sidecar' UNION ALL SELECT 'stripped', false, true, 'sidecar'")
def recovery_status(spark, sf):
    """Where parity is, step by step; states, not data."""
    own, outside = _archive(spark, sf), _root(spark, "parity")
    rows = [("before", own.recovery_status())]
    own.protect(PCT, WINDOW)
    rows.append(("protected", own.recovery_status()))
    own.export_parity(outside)
    rows.append(("exported", own.recovery_status(outside)))
    own.strip_parity(outside)
    rows.append(("stripped", own.recovery_status(outside)))
    return spark.createDataFrame([(step, s["embedded"], s["detached"], s["source"]) for step, s in rows], "step string, embedded boolean, detached boolean, source string")


SIDECARS = f"""{TILES}, g AS (SELECT path, idx, window_offset, window_len, 13::BIGINT AS k, 2::BIGINT AS p FROM wins),
gs AS (SELECT *, least(greatest((window_len + k - 1) // k, 4096), 1048576)::BIGINT AS shard FROM g), gg AS (SELECT *, ((window_len + shard - 1) // shard)::BIGINT AS shards FROM gs),
geo AS (SELECT *, ((shards + k - 1) // k)::BIGINT AS groups FROM gg),
pl AS (SELECT *, CASE WHEN window_len = 0 THEN 0 ELSE 32 + 16 * (shards + p * groups) + p * groups * shard END::BIGINT AS payload_len, count(*) OVER (PARTITION BY path) AS segments FROM geo),
loc AS (SELECT *, (333 + 168 * segments + coalesce(sum(payload_len) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS parity_offset FROM pl)"""


@query(f"""WITH {SIDECARS} SELECT path, idx, window_offset, window_len, parity_offset, payload_len, segments, size AS total_len, sha256(content) AS content_sha256,
  sha256(encode('cairn-sidecar-v1') || from_hex(sha256(content))) AS binding_id, false AS healed FROM loc JOIN files USING (path)""")
def sidecar_round_trip(spark, sf):
    """Sidecars are built and their directories read again."""
    located = sidecar.read(sidecar.build(_files(spark, sf), PCT, WINDOW))
    return located.where("problem IS NULL").select("path", "idx", "window_offset", "window_len", "parity_offset", "payload_len", "segments", "total_len", "content_sha256", "binding_id", "healed")


@query(f"""WITH {SIDECARS} SELECT path, size % 4 AS kind, CASE WHEN size % 4 = 3 THEN 0 ELSE any_value(segments) END::BIGINT AS segments, size % 4 IN (1, 2) AS healed, size % 4 = 3 AS rejected FROM loc JOIN files USING (path) GROUP BY path, size""")
def sidecar_healing(spark, sf):
    """One damaged copy, or damage in different places of all three copies, heals; damage in one place of all copies is refused."""
    files = _files(spark, sf)
    cars = sidecar.build(files, PCT, WINDOW).withColumn("kind", _total(F.col("sidecar")) % 4)
    n = F.greatest(numbers.ceil_div(_total(F.col("sidecar")), WINDOW), long(1))
    size = (n * 56 + 72 + 32).cast("int")  # a copy with its hash

    def hit(data, places):
        for at in places:
            byte = F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("bigint").bitwiseXOR(F.lit(90).cast("bigint"))
            data = F.concat(F.substring(data, F.lit(1), at), F.unhex(F.lpad(F.hex(byte), 2, "0")), F.substr(data, at + 2))
        return data

    start, s = F.lit(21), F.col("sidecar")
    one = hit(s, [start + 5])
    apart = hit(s, [start + 5, start + size + 20, start + 2 * size + 45])
    same = hit(s, [start + 5, start + size + 5, start + 2 * size + 5])
    damaged = F.when(F.col("kind") == 1, one).when(F.col("kind") == 2, apart).when(F.col("kind") == 3, same).otherwise(s)
    seen = sidecar.flags(sidecar.read(cars.select("path", damaged.alias("sidecar"))))
    return seen.join(files.select("path", (F.col("size") % 4).alias("kind")), "path").select("path", "kind", "segments", "healed", F.col("problem").isNotNull().alias("rejected"))


def _total(data):
    """The total length that a sidecar's first directory names."""
    return b.read_le(data, 21, 8).cast("bigint")


@query(f"WITH {FILES} SELECT path, sha256(content) AS sha256, (size > 100)::BIGINT AS rebuilt, CASE WHEN size > 100 THEN 'repaired' ELSE 'clean' END AS status, CASE WHEN size > 100 THEN 'unrecoverable' ELSE 'clean' END AS by_another FROM files")
def sidecar_repair(spark, sf):
    """A byte of every longer file is changed and repaired from its sidecar; by the sidecar of other content it is not."""
    files = _files(spark, sf)
    cars = sidecar.build(files, PCT, WINDOW)
    broken = verify.corrupted(files, 100)
    got = sidecar.repair(broken, cars, PCT, WINDOW)
    true_sums = files.select("path", F.sha2("content", 256).alias("sha256"))
    foreign = sidecar.build(files.withColumn("content", F.reverse(F.hex("content")).cast("binary")), PCT, WINDOW)
    other = sidecar.repair(broken, foreign, PCT, WINDOW, true_sums).select("path", F.col("status").alias("by_another"))
    return got.join(other, "path").select("path", F.sha2("content", 256).alias("sha256"), "rebuilt", "status", "by_another")


@query(f"WITH {SHARDS} SELECT sum(c)::BIGINT AS rebuilt FROM (SELECT count(*) AS c FROM files WHERE size > 100)")
def recovered_total(spark, sf):
    """Data shards that repair has computed again, over all files and windows."""
    files = _files(spark, sf)
    expected = files.select("path", F.sha2("content", 256).alias("sha256"))
    got = parity.repair(verify.corrupted(files, 100), parity.protect(files, PCT, WINDOW), expected, PCT, WINDOW)
    return got.agg(F.sum("rebuilt").alias("rebuilt"))


# Orders: a position beside each row, since rows of a table have none.


@query(f"WITH {LIST} SELECT path, size, n AS chunk_count, row_number() OVER (ORDER BY path) - 1 AS position FROM n")
def entry_order(spark, sf):
    """Files by path, each with its place in the order."""
    rows = catalog.listing(_entries(_files(spark, sf)), _chunk_lists(spark, sf)).withColumn("_one", long(1))
    return catalog.running(rows, "path", {"position": "_one"}).select("path", "size", "chunk_count", "position")


def _chunk_lists(spark, sf):
    from cairn.operators import chunking

    return chunking.entry_chunks(_files(spark, sf), CHUNK)


@query("""WITH d AS (SELECT DISTINCT unnest(['docs', 'docs/' || lang, 'docs/' || lang || '/' || source]) AS path FROM documents)
SELECT path, row_number() OVER (ORDER BY len(string_split(path, '/')), path) - 1 AS position FROM d WHERE path IS NOT NULL""")
def directories_by_depth(spark, sf):
    """Directories, parents before children, each with its place in the order."""
    rows = catalog.with_directories(_entries(_files(spark, sf)).where("path IS NOT NULL")).where("is_dir")
    key = F.concat(F.lpad(paths.depth(F.col("path")).cast("string"), 4, "0"), F.lit("/"), "path")
    return catalog.running(rows.select("path", key.alias("_key"), long(1).alias("_one")), "_key", {"position": "_one"}).select("path", "position")


@query(f"WITH {INDEX} SELECT id, block_index, data_offset, row_number() OVER (ORDER BY data_offset) - 1 AS position FROM idx")
def chunks_by_offset(spark, sf):
    """Chunks as they lie in the data, each with its place in the order."""
    rows = catalog.chunk_index(_chunk_lists(spark, sf)).withColumn("_one", long(1))
    return catalog.running(rows, "data_offset", {"position": "_one"}).select("id", "block_index", "data_offset", "position")


# Smaller functions


@query("""SELECT page_id, 'a/' || coalesce(url, '') AS joined, coalesce(url, '') AS top, starts_with(coalesce(url, ''), 'http://') AS under_http, page_id % 3 = 0 AS leaf FROM pages""")
def path_functions(spark, sf):
    """Joining, descent and leaf names."""
    k, url = F.col("page_id"), F.coalesce("url", F.lit(""))
    name = F.when(k % 3 == 0, F.concat(F.lit("p"), k)).when(k % 3 == 1, F.concat(F.lit("a/"), k)).otherwise(F.concat(F.lit("x.."), k))
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    return rows.select("page_id", paths.join(F.lit("a"), url).alias("joined"), paths.join(F.lit(""), url).alias("top"), paths.is_descendant(url, F.lit("http:/")).alias("under_http"), paths.is_leaf_name(name).alias("leaf"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(sha256(text)) END AS parsed FROM documents""")
def parse_digests(spark, sf):
    """Digests in text with blanks, too short, or with a wrong letter."""
    h = F.sha2(F.encode("text", "UTF-8"), 256)
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit(" "), h, F.lit("  "))).when(k == 1, F.substring(h, 1, 63)).otherwise(F.concat(F.lit("g"), F.substring(h, 2, 63)))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.hex(b.parse_sha256(raw)).alias("parsed"))


@query("""SELECT count(*)::BIGINT AS docs, count(DISTINCT source || '/' || lang)::BIGINT AS names, count(DISTINCT source || '/' || lang)::BIGINT AS tokens, 64::INTEGER AS token_len FROM documents""")
def name_tokens(spark, sf):
    """Names that are hidden: as many tokens as names."""
    name = F.concat("source", F.lit("/"), "lang")
    token = codec.name_token(KEY, name)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(name.alias("name"), token.alias("token"))
    return rows.agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("name").alias("names"), F.count_distinct("token").alias("tokens"), F.max(F.length("token")).alias("token_len"))


@query(f"""WITH {FILES} SELECT path, CASE WHEN size >= 10 THEN sha256(array_slice(content, 4, 9)) END AS inner, CASE WHEN size >= 3 THEN size - 3 END AS rest FROM files""")
def bounded_sections(spark, sf):
    """Ranges of bytes that may reach beyond the content, and content behind a length."""
    rows = _files(spark, sf)
    inner = F.when(F.col("size") >= 10, validate.section(F.col("content"), long(3), long(6)))
    beyond = validate.section(F.col("content"), F.col("size") - 2, long(6))
    framed = F.concat(F.lit(b"abc"), b.write_le(F.col("size") - 3, 4), F.substr(F.col("content"), F.lit(4)), F.lit(b"more"))
    held = F.when(F.col("size") >= 3, validate.prefixed(framed, long(3)))
    return rows.select("path", F.sha2(inner, 256).alias("inner"), F.when(beyond.isNull(), F.octet_length(held).cast("bigint")).alias("rest"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'embedded' WHEN 2 THEN 'sidecar' WHEN 3 THEN 'both' END AS placement, n_nationkey % 5 IN (1, 3) AS embeds, n_nationkey % 5 IN (2, 3) AS writes_sidecar, n_name || '.cairnside' AS sidecar,
  CASE WHEN n_nationkey % 2 = 0 THEN '-' ELSE n_nationkey || ' B' END AS cell, substr(n_name, 1, 1) || lower(substr(n_name, 2)) AS shown FROM nation""")
def names_and_cells(spark, sf):
    k = F.col("n_nationkey")
    text = F.when(k % 5 == 0, " None").when(k % 5 == 1, "EMBEDDED").when(k % 5 == 2, "sidecar ").when(k % 5 == 3, "both").otherwise("elsewhere")
    place = names.placement(text)
    return spark.read.parquet(f"{sf}/nation.parquet").select(
        "n_nationkey", place.alias("placement"), names.embeds(place).alias("embeds"), names.writes_sidecar(place).alias("writes_sidecar"), sidecar.sidecar_path(F.col("n_name")).alias("sidecar"),
        names.size_cell(k, k % 2 == 0).alias("cell"), names.capitalized(F.lower("n_name")).alias("shown"),
    )


@query("SELECT s_suppkey, w AS window_len, n AS payload_len FROM (SELECT s_suppkey, s_suppkey * 1000 AS w, s_suppkey * 1500 AS n FROM supplier) WHERE n > 32 + 16 * (((w + least(greatest((w + 3) // 4, 4096), 1048576) - 1) // least(greatest((w + 3) // 4, 4096), 1048576)) + 2 * (((w + least(greatest((w + 3) // 4, 4096), 1048576) - 1) // least(greatest((w + 3) // 4, 4096), 1048576) + 3) // 4)) + 2 * (((w + least(greatest((w + 3) // 4, 4096), 1048576) - 1) // least(greatest((w + 3) // 4, 4096), 1048576) + 3) // 4) * least(greatest((w + 3) // 4, 4096), 1048576)")
def check_payload_lengths(spark, sf):
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", (k * 1000).alias("window_len"), (k * 1500).alias("payload_len"))
    return validate.bad_payload_lengths(rows)


@query(f"""WITH {FILES} SELECT path, size AS rows_len, to_json(struct_pack(path := path, size := size)) AS json FROM files""")
def entries_as_json(spark, sf):
    rows = _entries(_files(spark, sf))
    return rows.join(names.as_json(rows.select("path", "size")).select(F.get_json_object("json", "$.path").alias("path"), "json"), "path").select("path", F.col("size").alias("rows_len"), "json")


@query(f"WITH {FILES} SELECT 'file' AS event, count(*)::BIGINT AS rows, sum(size)::BIGINT AS bytes FROM files UNION ALL SELECT 'chunk', (SELECT count(*) FROM (WITH {CHUNKS} SELECT * FROM ec))::BIGINT, (SELECT sum(size) FROM files)::BIGINT")
def telemetry(spark, sf):
    """What a sink is told of files and chunks that pass through a job."""
    from cairn.operators import chunking
    from cairn.streaming.telemetry import Totals, Watch

    totals = Totals()
    watch = Watch(totals)
    files = watch.on("file", _files(spark, sf), "size")
    files.write.format("noop").mode("overwrite").save()
    watch.on("chunk", chunking.entry_chunks(_files(spark, sf), CHUNK), "len").write.format("noop").mode("overwrite").save()
    watch.emit()
    return spark.createDataFrame([(e, c["rows"], c["bytes"]) for e, c in totals.counts.items()], "event string, rows bigint, bytes bigint")


@query(f"""WITH {FILES} SELECT path, size FROM files WHERE path = (SELECT max(path) FROM files)""")
def first_match(spark, sf):
    """The entry of one path."""
    entries = _entries(_files(spark, sf))
    return archives.first_match(entries, entries.agg(F.max("path")).first()[0]).select("path", "size")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '4' WHEN 1 THEN '5,4' ELSE '4,5,6' END AS tried FROM nation")
def count_candidates(spark, sf):
    """Of three numbers of segments, what is tried and in which order."""
    rows = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey").collect()  # three numbers in a header, read by the codec
    counts = [[4, 4, 4], [4, 5, 5], [4, 5, 6]]
    return spark.createDataFrame([(r[0], ",".join(map(str, sidecar.candidate_counts(counts[r[0] % 3])))) for r in rows], "n_nationkey bigint, tried string")


@query(f"""WITH {PACKS} SELECT lane, path, unnest(range(start // {CHUNK}, (start + size - 1) // {CHUNK} + 1))::INTEGER AS pos, (start % {CHUNK})::BIGINT AS pack_offset FROM packed WHERE size > 0""")
def packed_archive(spark, sf):
    """Small files put together and the chunks of their packs that hold them."""
    own = _archive(spark, sf)
    lane = F.split_part(F.col("path"), F.lit("/"), F.lit(2))
    return archives.packed_files(own, _files(spark, sf), PACK, lane).select("lane", "path", "pos", "pack_offset")


@query(f"""WITH {CHUNKS}, l AS (SELECT path, list(chunk_id ORDER BY pos) AS chunks FROM ec GROUP BY 1)
SELECT path, size, false AS is_dir, array_to_string(coalesce(chunks, []), ',') AS chunks, true AS bound FROM files LEFT JOIN l USING (path)""")
def manifest_round_trip(spark, sf):
    """Entries as lines of text, encrypted under their paths, and read back; under another path they are not."""
    lines = manifest.lines(_entries(_files(spark, sf)), _chunk_lists(spark, sf))
    rows = lines.select("path", manifest.sealed(F.col("json"), KEY, F.col("path")).alias("data"))
    bound = rows.select("path", manifest.opened(F.col("data"), KEY, F.lit("other")).isNull().alias("bound"))
    back = manifest.parsed(rows.select(manifest.opened(F.col("data"), KEY, F.col("path")).alias("json")))
    return back.join(bound, "path").select("path", "size", "is_dir", F.array_join("chunks", ",").alias("chunks"), "bound")


@query(f"""WITH {FILES} SELECT path || '#header' AS path, 'repaired' AS status, 1::BIGINT AS rebuilt, true AS authentic FROM files UNION ALL SELECT path || '#manifest', 'repaired', 1, true FROM files""")
def metadata_healing(spark, sf):
    """Headers and manifests with a wrong byte, healed by parity of their own: a header is authentic again, a manifest reads as before."""
    files = _files(spark, sf)
    zero = long(0)
    made = headers.header(KEY, F.lit(1), F.lit(1), data_offset=long(512), data_len=F.col("size"), manifest_offset=F.col("size") + 512, manifest_len=zero, extension_offset=zero, extension_len=zero)
    texts = manifest.lines(_entries(files), _chunk_lists(spark, sf)).select("path", F.encode("json", "UTF-8").alias("content"))
    regions = manifest.regions(files.select("path", made.alias("content")), texts)
    # Read three times.  Regions are small and their parity is not, so they are dealt out by number, not by bytes.
    regions = written(regions.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"), "regions")
    healed = manifest.healed(verify.corrupted(regions, 30), manifest.protected(regions, 30, WINDOW), 30, WINDOW)
    before = regions.select("path", F.sha2("content", 256).alias("before"))
    fine = F.when(F.endswith("path", F.lit("#header")), headers.is_authentic(F.col("content"), KEY)).otherwise(F.sha2("content", 256) == F.col("before"))
    return healed.join(before, "path").select("path", "status", "rebuilt", fine.alias("authentic"))
