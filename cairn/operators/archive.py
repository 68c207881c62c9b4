"""An archive in a store: what changes it keeps entries, chunk lists, chunk index and blocks in step.

Every change is one commit made from the snapshot it has read, so another writer's commit in between
refuses it.  Bytes are stored once a chunk: what a change adds is the chunks that the archive does not have
(an anti-join), compressed where it pays and encrypted if there is a key, appended as new files; moves, copies and deletes
touch the catalogue alone.  Reading a file checks the length and hash of each of its blocks, the
identity of each chunk and the length of the whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import keys, names, paths
from cairn.functions.bytes import block_hash, chunk_aad, chunk_id
from cairn.functions.numbers import long
from cairn.model import MAX_BLOCK, PREFIX, WINDOW, ArchiveError, Conflict, Damaged, NotFound, Options
from cairn.operators import catalog, chunking, codec, packing, parity, restore, validate, verify
from cairn.scratch import written
from cairn.sources.store import Store

ENTRY = "path string, size bigint, modified string, is_dir boolean"
ENTRY_CHUNKS = "path string, pos int, start bigint, len bigint, chunk_id string"
CHUNKS = "id string, block_index bigint, data_offset bigint, block_len bigint, plaintext_len bigint, compressed_len bigint, cipher_hash string, stored_raw boolean"
BLOCKS = "id string, block binary"


@dataclass(frozen=True)
class Compacted:
    """Bytes and chunks before and after what nothing refers to has gone."""

    chunks_before: int
    chunks_after: int
    bytes_before: int
    bytes_after: int

    @property
    def saved(self) -> int:
        return self.bytes_before - self.bytes_after


class Archive:
    """size: bytes of fixed chunks; None cuts by content, by the options' bounds.  key: 16, 24 or 32 bytes, or none.

    cascade: blocks are encrypted twice, under two keys made from the key."""

    def __init__(self, store: Store, size: int | None = 4096, options: Options | None = None, key: bytes | None = None, cascade: bool = False):
        self.store, self.size, self.options, self.key, self.cascade = store, size, options or Options(), key, cascade
        self.spark: SparkSession = store.spark
        if size is not None and not 0 < size <= MAX_BLOCK:
            raise ArchiveError(f"chunks of {size} bytes are not allowed")

    # Making and reading it

    @classmethod
    def create(cls, store: Store, size: int | None = 4096, options: Options | None = None, key: bytes | None = None, password: str | None = None, cascade: bool = False) -> Archive:
        """An empty archive; an error if there is one.  With a password, its key is a new one, kept wrapped."""
        if store.current() is not None:
            raise Conflict(f"{store.root} is an archive already")
        if password is not None:
            key = keys.new_key()
        own = cls(store, size, options, key, cascade)
        o = own.options
        fields = {"chunk_size": str(size), "level": str(o.level), "bounds": str(o.cdc()), "encrypted": str(key is not None), "cascade": str(cascade), "placement": o.placement, "parity_pct": str(o.parity_pct), "algorithms": " ".join(names.algorithm_chain())}
        if password is not None:
            fields |= own._wrapped(password)
        empty = lambda schema: store.spark.createDataFrame([], schema)
        store.commit({"entries": empty(ENTRY), "entry_chunks": empty(ENTRY_CHUNKS), "chunks": empty(CHUNKS), "blocks": empty(BLOCKS), "settings": own._settings_table(fields)}, None)
        return own

    @classmethod
    def open(cls, store: Store, password: str | None = None, key: bytes | None = None) -> Archive:
        """The archive as it was made; an error if the password is wrong, or the settings are not those that were sealed."""
        fields = {r["name"]: r["value"] for r in store.table("settings").collect()}
        if "wrapped_key" in fields:
            if password is None:
                raise ArchiveError("this archive needs a password")
            key = keys.unwrap(store.spark, keys.from_password(password, bytes.fromhex(fields["salt"])), bytes.fromhex(fields["wrapped_key"]))
        elif fields["encrypted"] == "True" and key is None:
            raise ArchiveError("this archive needs a key")
        if key is not None and keys.seal(key, {k: v for k, v in fields.items() if k != "seal"}) != fields["seal"]:
            raise Damaged("the settings are not those of this key")
        size = None if fields["chunk_size"] == "None" else int(fields["chunk_size"])
        parity_pct = None if fields["parity_pct"] == "None" else int(fields["parity_pct"])
        options = Options(level=int(fields["level"]), plaintext=key is None, parity_pct=parity_pct, placement=fields["placement"])
        return cls(store, size, options, key, fields["cascade"] == "True")

    def _wrapped(self, password: str) -> dict[str, str]:
        salt = keys.new_salt()
        return {"salt": salt.hex(), "wrapped_key": keys.wrap(self.spark, keys.from_password(password, salt), self.key).hex()}

    def _settings_table(self, fields: dict[str, str]) -> DataFrame:
        fields = {k: v for k, v in fields.items() if k != "seal"}
        if self.key is not None:
            fields["seal"] = keys.seal(self.key, fields)
        return self.spark.createDataFrame(list(fields.items()), "name string, value string")

    def change_password(self, new: str) -> int:
        """Wrap the archive's key by another password: one small table changes, no block does."""
        fields = self.settings()
        if "wrapped_key" not in fields:
            raise ArchiveError("this archive has no password")
        return self.store.commit({"settings": self._settings_table(fields | self._wrapped(new))}, self.store.current())

    def entries(self) -> DataFrame:
        return self.store.table("entries")

    def entry_chunks(self) -> DataFrame:
        return self.store.table("entry_chunks")

    def chunks(self) -> DataFrame:
        return self.store.table("chunks")

    def settings(self) -> dict[str, str]:
        """What :meth:`create` was given."""
        return {r["name"]: r["value"] for r in self.store.table("settings").collect()}

    def list(self) -> DataFrame:
        """The listing, by path: parents before children."""
        return catalog.listing(self.entries(), self.entry_chunks()).orderBy("path")

    def summary(self) -> DataFrame:
        """One row: files, chunks, bytes, and how much the stored blocks take."""
        stored = self.chunks().agg(F.coalesce(F.sum("block_len"), long(0)).alias("stored_bytes"))
        return catalog.summary(self.entries(), self.entry_chunks()).join(stored, F.lit(True))

    def _two_keys(self):
        return F.lit(keys.expand(self.key, "block")), F.lit(keys.expand(self.key, "outer"))

    # Adding

    def _cut(self, files: DataFrame) -> DataFrame:
        if self.size is None:
            return chunking.gear_chunks(files, self.options.cdc(), data=True)
        return chunking.entry_chunks(files, self.size, data=True)

    def new_blocks(self, cut: DataFrame, chunks: DataFrame) -> DataFrame:
        """(id, block, lengths, hash, index, offset) of the chunks of (chunk_id, data) that ``chunks`` lacks, each once.

        Their indexes and offsets go on where those of ``chunks`` end, in order of the id."""
        fresh = cut.select(F.col("chunk_id").alias("id"), "data").join(chunks.select("id"), "id", "left_anti")
        once = fresh.groupBy("id").agg(F.first("data").alias("data"))
        rows = codec.compressed(once, self.options.level)
        if self.key is not None:
            aad, once = chunk_aad(F.col("id")), F.aes_encrypt("block", F.lit(self.key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), chunk_aad(F.col("id")))
            rows = rows.withColumn("block", codec.cascaded(F.col("block"), *self._two_keys(), aad) if self.cascade else once)
        return rows.withColumn("block_len", F.octet_length("block").cast("bigint")).withColumn("cipher_hash", block_hash(F.col("block")))

    def add(self, files: DataFrame, replace: bool = True, prefix: str = "") -> int:
        """Add files (path, content and perhaps modified), by path and content once each: of one path twice in ``files`` the
        later modified one stays, then the one with the smaller hash.  Files that are there are replaced, or left as they are."""
        base = self.store.current()
        modified = F.col("modified").cast("string") if "modified" in files.columns else F.lit(None).cast("string")
        path = F.concat(F.lit(prefix.rstrip("/") + "/"), "path") if prefix else F.col("path")
        rows = files.select(path.alias("path"), F.coalesce("content", F.lit(b"")).alias("content"), modified.alias("modified"))
        latest = F.min_by(F.struct("content", "modified"), F.struct(F.col("modified").isNull(), F.expr("-unix_micros(try_cast(modified AS timestamp))"), F.sha2("content", 256)))
        once = rows.groupBy("path").agg(latest.alias("f")).select("path", "f.content", "f.modified", F.octet_length("f.content").cast("bigint").alias("size"))
        return self._add(once, base, replace)

    def _add(self, files: DataFrame, base: int | None, replace: bool) -> int:
        files = written(files)
        entries = files.select("path", "size", "modified", F.lit(False).alias("is_dir"))
        if not (bad := validate.bad_paths(entries.select("path"))).isEmpty():
            raise ArchiveError(f"{bad.first()['path']!r} may not be stored")
        old, old_ec, old_chunks = (self.store.table(t, base) for t in ("entries", "entry_chunks", "chunks"))
        if not replace:
            entries = entries.join(old.select("path"), "path", "left_anti")
            files = files.join(entries.select("path"), "path", "left_semi")
        merged = catalog.upsert(old, entries, replace)
        # Chunks of fixed size are cut again where they are wanted; their bytes are written as blocks only.
        cut = self._cut(files) if self.size is not None else written(self._cut(files))
        ec = chunking.entry_chunks(files, self.size) if self.size is not None else cut.select("path", "pos", "start", "len", "chunk_id")
        folder, blocks = self.store.put("blocks", self.new_blocks(cut, old_chunks))
        after = old_chunks.agg(F.coalesce(F.max("block_index") + 1, long(0)).alias("i"), F.coalesce(F.max(F.col("data_offset") + F.col("block_len") + PREFIX), long(0)).alias("o")).first()
        placed = catalog.running(blocks.drop("block").withColumn("_one", long(1)).withColumn("_size", F.col("block_len") + PREFIX), "id", {"block_index": "_one", "data_offset": "_size"})
        placed = placed.withColumn("block_index", F.col("block_index") + after["i"]).withColumn("data_offset", F.col("data_offset") + after["o"])
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        grown = {"chunks": placed.select(*names), "blocks": folder}
        if old.join(entries.select("path"), "path", "left_semi").isEmpty():
            return self.store.commit({}, base, grown | {"entries": entries, "entry_chunks": ec})
        kept = old_ec.join(entries.select("path"), "path", "left_anti")
        return self.store.commit({"entries": merged, "entry_chunks": kept.unionByName(ec)}, base, grown)

    def add_directory(self, root: str, prefix: str = "", replace: bool = True) -> tuple[int, int]:
        """(files, directories) added from a folder, empty directories too; links are not followed."""
        from cairn.sources.rows import directory_files, directory_tree

        files = directory_files(self.spark, root, prefix)
        folders = directory_tree(self.spark, root, prefix)
        self.add(files.withColumn("modified", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")), replace)
        base = self.store.current()
        old = self.store.table("entries", base)
        if not folders.join(old.where(~F.col("is_dir")), "path", "left_semi").isEmpty():
            raise Conflict("a directory is a file already")
        new = folders.join(old.select("path"), "path", "left_anti").select("path", long(0).alias("size"), F.lit(None).cast("string").alias("modified"), F.lit(True).alias("is_dir"))
        self.store.commit({}, base, {"entries": new})
        return files.count(), folders.count()

    # Changing the catalogue

    def _change(self, change) -> int:
        """Commit ``change`` (entries -> entries); chunk lists follow their files."""
        base = self.store.current()
        return self.store.commit({"entries": change(self.store.table("entries", base))}, base)

    def make_directory(self, path: str) -> int:
        return self._change(lambda e: catalog.make_directory(e, path))

    def delete(self, names: list[str], recursive: bool = False, lenient: bool = False) -> int:
        """Entries and their chunk lists go; blocks stay until :meth:`compact`."""
        base = self.store.current()
        old, ec = self.store.table("entries", base), self.store.table("entry_chunks", base)
        left = catalog.delete_lenient(old, names) if lenient else catalog.delete(old, names, recursive)
        return self.store.commit({"entries": left, "entry_chunks": ec.join(left.select("path"), "path", "left_semi")}, base)

    def move(self, old: str, new: str) -> int:
        """A file or subtree under another path, with its chunk lists."""
        base = self.store.current()
        entries, ec = self.store.table("entries", base), self.store.table("entry_chunks", base)
        if old == new:
            return base
        return self.store.commit({"entries": catalog.move(entries, old, new), "entry_chunks": catalog.relocated_chunks(ec, old, new)}, base)

    def rename(self, old: str, name: str) -> int:
        return self.move(old, catalog.renamed(old, name))

    def copy(self, old: str, new: str) -> int:
        """A subtree twice; the copy has chunk lists of its own and shares all chunks."""
        base = self.store.current()
        entries, ec = self.store.table("entries", base), self.store.table("entry_chunks", base)
        if old == new:
            return base
        both = ec.unionByName(catalog.relocate(ec, old, new))
        return self.store.commit({"entries": catalog.copy(entries, old, new), "entry_chunks": both}, base)

    def compact(self) -> Compacted:
        """Drop chunks that no file refers to; indexes are kept, offsets close up."""
        base = self.store.current()
        chunks, ec, blocks = (self.store.table(t, base) for t in ("chunks", "entry_chunks", "blocks"))
        live = written(catalog.live_chunks(chunks, ec))
        size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("block_len") + PREFIX), long(0)).alias("b")).first()
        before, after = size(chunks), size(live)
        if before["n"] != after["n"]:
            self.store.commit({"chunks": live, "blocks": blocks.join(live.select("id"), "id", "left_semi")}, base)
        return Compacted(before["n"], after["n"], before["b"], after["b"])

    # Reading files

    def plain_chunks(self, wanted: DataFrame | None = None) -> DataFrame:
        """(id, data): chunks, or those among ``wanted`` (id); data is null unless the block has its recorded length and
        hash, and unpacks to bytes that have the chunk's identity."""
        rows = self.chunks()
        if wanted is not None:
            rows = rows.join(wanted.select("id").distinct(), "id", "left_semi")
        rows = rows.join(self.store.table("blocks"), "id", "left")
        whole = (F.octet_length("block") == F.col("block_len")) & (block_hash(F.col("block")) == F.col("cipher_hash")) & (F.col("block_len") <= MAX_BLOCK)
        block = F.when(whole, F.col("block"))
        if self.key is not None:
            aad = chunk_aad(F.col("id"))
            block = codec.uncascaded(block, *self._two_keys(), aad) if self.cascade else codec.decrypted(block, F.lit(self.key), aad)
        got = codec.decompressed(rows.withColumn("block", block))
        return got.select("id", F.when(chunk_id(F.col("data")) == F.col("id"), F.col("data")).alias("data"))

    def files(self, names: list[str] | None = None) -> DataFrame:
        """(path, content, missing) of all files, or of those at or under the names; content is null where anything is wrong."""
        entries, ec = self.entries(), self.entry_chunks()
        if names is not None:
            entries = catalog.under(entries, self.spark.createDataFrame([(n,) for n in names], "target string"))
            ec = ec.join(entries.select("path"), "path", "left_semi")
        got = restore.restored(ec, self.plain_chunks(ec.select(F.col("chunk_id").alias("id"))), entries)
        sizes = entries.select("path", "size")
        right = F.octet_length("content") == F.col("size")
        return got.join(sizes, "path").select("path", F.when(right, F.col("content")).alias("content"), F.when(right | (F.col("missing") > 0), F.col("missing")).otherwise(long(1)).alias("missing"))

    def extract(self, root: str, names: list[str] | None = None) -> int:
        """Write files, and directories first, under a folder that all executors share; how many files.  Damage is an error, and nothing is written."""
        rows = written(self.files(names))
        if names is not None and rows.isEmpty():
            raise NotFound(", ".join(names))
        rows = restore.checked(rows)
        folders = self.entries().where("is_dir")
        if names is not None:
            folders = catalog.under(folders, self.spark.createDataFrame([(n,) for n in names], "target string"))
        restore.write_directories(folders.select("path"), root)
        restore.write_files(rows, root)
        return rows.count()

    def slices(self, offset: int, length: int) -> DataFrame:
        """(path, content) of a range of bytes of each file, from the chunks that hold some of it."""
        ec = self.entry_chunks()
        needed = ec.where((F.col("start") < offset + length) & (F.col("start") + F.col("len") > offset))
        return restore.slices(ec, self.plain_chunks(needed.select(F.col("chunk_id").alias("id"))), offset, length)

    # Integrity

    def scrub(self) -> DataFrame:
        """(id, block_index, problem) of blocks that are not what their record says."""
        return verify.scrub(self.chunks(), self.store.table("blocks"))

    def damaged_entries(self) -> DataFrame:
        return verify.damaged_entries(self.scrub(), self.entry_chunks())

    def _block_files(self, base: int) -> DataFrame:
        """Blocks as (path, content, size), which parity protects one by one."""
        b = self.store.table("blocks", base)
        return b.select(F.col("id").alias("path"), F.col("block").alias("content"), F.octet_length("block").cast("bigint").alias("size"))

    def protect(self, pct: int | None = None, window: int = WINDOW) -> int:
        """Embed parity of all blocks in the archive."""
        base = self.store.current()
        pct = pct if pct is not None else self.options.parity_pct or 20
        shards = parity.protect(self._block_files(base), pct, window).withColumn("pct", long(pct)).withColumn("window", long(window))
        return self.store.commit({"shards": shards}, base)

    def has_parity(self) -> bool:
        return self.store.has("shards") and not self.store.table("shards").isEmpty()

    def export_parity(self, path: str) -> int:
        """Write the embedded parity beside the archive; how many shards."""
        shards = self.store.table("shards")
        shards.write.parquet(path)
        return shards.count()

    def strip_parity(self, detached: str | None = None, force: bool = False) -> int:
        """Drop embedded parity; refused if there is none elsewhere, unless forced."""
        if not self.has_parity():
            raise NotFound("the archive has no parity")
        if detached is None and not force:
            raise Conflict("this is the only parity that there is")
        base = self.store.current()
        return self.store.commit({"shards": self.store.table("shards", base).where("false")}, base)

    def recovery_status(self, detached: str | None = None) -> dict[str, object]:
        """Where parity is, and of how many shards."""
        embedded = self.has_parity()
        outside = self.spark.read.parquet(detached).count() if detached else 0
        return {"embedded": embedded, "detached": outside > 0, "any": embedded or outside > 0, "source": "sidecar" if outside else "embedded" if embedded else "none"}

    def repair(self, detached: str | None = None, dry_run: bool = False) -> DataFrame:
        """(id, status) of damaged blocks: repaired, or unrecoverable.  Repaired blocks are committed unless it is a dry run.

        Only damaged blocks and their shards are read, and a block is replaced only if it then has its recorded hash."""
        base = self.store.current()
        shards = self.spark.read.parquet(detached) if detached else self.store.table("shards", base)
        grid = shards.select("pct", "window").first()
        if grid is None:
            raise NotFound("there is no parity")
        chunks, blocks = self.store.table("chunks", base), self.store.table("blocks", base)
        bad = written(verify.scrub(chunks, blocks).select("id"))
        records = chunks.join(bad, "id", "left_semi").select(F.col("id").alias("path"), F.col("cipher_hash").alias("sha256"), "block_len")
        have = blocks.join(bad, "id", "left_semi").select(F.col("id").alias("path"), "block")
        # A block of another length is brought to its own: what is missing counts as damage.
        n = F.col("block_len").cast("int")
        files = records.join(have, "path", "left").select("path", F.substring(F.rpad(F.coalesce("block", F.lit(b"")), n, F.lit(b"\0")), F.lit(1), n).alias("content"))
        own = shards.join(bad.select(F.col("id").alias("path")), "path", "left_semi")
        got = written(parity.repair(files, own, records.select("path", "sha256"), grid["pct"], grid["window"]))
        fixed = got.where("status <> 'unrecoverable'").select(F.col("path").alias("id"), F.col("content").alias("block"))
        if not dry_run and not fixed.isEmpty():
            rest = blocks.join(fixed.select("id"), "id", "left_anti")
            self.store.commit({"blocks": rest.unionByName(fixed)}, base)
        status = F.when(F.col("status") == "unrecoverable", "unrecoverable").otherwise("repaired")
        return got.select(F.col("path").alias("id"), status.alias("status"))


def first_match(entries: DataFrame, path: str) -> DataFrame:
    """The entry of that path, as one row; an error if there is none."""
    found = entries.where(F.col("path") == path).limit(1)
    if found.isEmpty():
        raise NotFound(path)
    return found


def packed_files(archive: Archive, files: DataFrame, target: int, lane=None) -> DataFrame:
    """(lane, path, pos, chunk_id, pack_offset): small files put together, and the chunks of their packs that hold them."""
    members = packing.assemble(files.select("path", "size"), target, lane)
    packs = packing.pack_contents(members, files).select(F.concat_ws("/", "lane", F.col("pack").cast("string")).alias("path"), "lane", "pack", "content")
    chunks = chunking.entry_chunks(packs, archive.size or target, ["lane", "pack"])
    return packing.covering(members, chunks)


def by_depth(entries: DataFrame) -> DataFrame:
    """Directories, parents first."""
    return entries.where("is_dir").orderBy(paths.depth(F.col("path")), "path")


__all__ = ["Archive", "Compacted", "by_depth", "first_match", "packed_files"]
