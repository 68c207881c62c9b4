"""Invariants of the archive operators that SQL does not cover."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cairn.functions import keys
from cairn.model import ArchiveError, Bounds, Conflict, Damaged, InvalidPath, NotFound, Options
from cairn.operators import catalog, chunking, codec, packing, parity, restore, validate
from cairn.operators.archive import Archive
from cairn.sources import sidecar
from cairn.sources.store import Store

SMALL = Bounds(4096, 8192, 65_536)


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def files_of(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").selectExpr("*", "cast(octet_length(content) as bigint) AS size")


def entries_of(spark, rows):
    return spark.createDataFrame([(p, s, d) for p, s, d in rows], "path string, size bigint, is_dir boolean")


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 65_536, 65_537, 200_000])
@pytest.mark.parametrize("kind", ["zeros", "ones", "noise"])
def test_cuts_cover_the_input(size, kind):
    data = {"zeros": bytes(size), "ones": b"\xff" * size, "noise": noise(size)}[kind]
    found = chunking.cuts(data, SMALL)
    assert [a for a, _ in found] == [0, *[b for _, b in found]][: len(found)]
    assert sum(b - a for a, b in found) == size
    assert all(SMALL.smallest <= b - a <= SMALL.largest for a, b in found[:-1])
    assert all(b - a <= SMALL.largest for a, b in found[-1:])


def test_contents_cut_together_are_cut_alike():
    data = [noise(n, n) for n in (0, 1, 4095, 4096, 4097, 9000, 30_000, 65_536, 65_537, 120_000)] + [noise(20_000 + 7 * i, i) for i in range(30)] + [b"", bytes(150_000)]
    assert chunking.cuts_of_many(data, SMALL) == [chunking.cuts(d, SMALL) for d in data]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=30))
def test_stream_cuts_like_the_whole(sizes):
    data = noise(120_000, 3)
    chunker, out, at = chunking.Chunker(SMALL), [], 0
    while at < len(data):
        for n in sizes:
            out += list(chunker.feed(data[at : at + n]))
            at += n
    out += list(chunker.finish())
    assert b"".join(out) == data
    assert [len(c) for c in out] == [b - a for a, b in chunking.cuts(data, SMALL)]


def test_equal_files_share_all_chunks(spark):
    data = noise(100_000)
    rows = chunking.gear_chunks(files_of(spark, [("a", data), ("b", data), ("c", b"")]), SMALL).collect()
    by = {p: [r.chunk_id for r in rows if r.path == p] for p in "abc"}
    assert by["a"] == by["b"] and by["a"] and not by["c"]


@pytest.mark.parametrize("bounds", [Bounds(4095, 8192, 65_536), Bounds(4096, 8193, 65_536), Bounds(8192, 4096, 65_536), Bounds(4096, 8192, 1 << 29)])
def test_bad_bounds(bounds):
    with pytest.raises(ArchiveError):
        bounds.checked()


def test_levels_choose_bounds():
    assert Options(level=19).cdc().average == 4 << 20 and Options().cdc() == Bounds() and Options(level=22, bounds=SMALL).cdc() == SMALL


@pytest.mark.parametrize(("k", "p"), [(10, 2), (4, 2), (14, 1), (2, 2)])
def test_any_lost_shards_are_found(k, p):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (k, 64), dtype=np.uint8)
    all_shards = [*data, *parity.encode_group(data, p)]
    for trial in range(20):
        gone = rng.choice(k + p, p, replace=False)
        got = parity.solve_group([None if i in gone else s for i, s in enumerate(all_shards)], k, p)
        assert (np.stack(got) == data).all()
    assert parity.solve_group([None] * (p + 1) + all_shards[p + 1 :], k, p) is None


def test_repair_is_all_or_nothing(spark):
    data = noise(60_000)
    hurt = lambda places: bytes(b ^ 0xFF if i // 4616 in places else b for i, b in enumerate(data))
    files = files_of(spark, [("ok", data), ("two", data), ("three", data), ("empty", b"")])
    shards = parity.protect(files, 15)
    expected = files.selectExpr("path", "sha2(content, 256) AS sha256")
    bad = files_of(spark, [("ok", data), ("two", hurt({0, 5})), ("three", hurt({0, 5, 7})), ("empty", b"")])
    got = {r.path: (r.status, bytes(r.content)) for r in parity.repair(bad, shards, expected, 15).collect()}
    assert got["ok"] == ("clean", data) and got["empty"] == ("clean", b"")
    assert got["two"] == ("repaired", data)
    assert got["three"] == ("unrecoverable", hurt({0, 5, 7}))
    h = parity.health(bad, shards, 15).first()
    assert (h.damaged_data_shards, h.unrecoverable_groups, h.groups) == (5, 1, 3)


def test_estimate_is_exact():
    from cairn.functions import numbers

    k, p = parity.grid_of(15)
    assert (k, p) == (13, 2)
    assert numbers.LEVELS["high"] == 30 and parity.grid_of(7) == (14, 1) and parity.grid_of(25) == (8, 2) and parity.grid_of(30) == (7, 2) and parity.grid_of(None) == (10, 2)


def test_sidecar_length_of_a_known_file(spark):
    from pyspark.sql import functions as F

    from cairn.functions import numbers

    assert spark.range(1).select(numbers.sidecar_len(numbers.long(200_000), F.lit(15), 64 << 20)).first()[0] == 31_543


def test_packs_close_after_the_target(spark):
    rows = entries_of(spark, [(f"f{i:02}", s, False) for i, s in enumerate([5, 5, 0, 9, 12, 3])])
    got = [(r.path, r.pack, r.start) for r in packing.assemble(rows, 10).orderBy("path").collect()]
    assert got == [("f00", 0, 0), ("f01", 0, 5), ("f02", 1, 0), ("f03", 1, 0), ("f04", 1, 9), ("f05", 2, 0)]


TREE = [("a", 0, True), ("a/x", 3, False), ("a/b/y", 4, False), ("ab", 5, False), ("c/z", 6, False)]


def names(df):
    return sorted(r.path for r in df.collect())


def test_tree_changes(spark):
    e = entries_of(spark, TREE)
    assert names(catalog.delete(e, ["a"], recursive=True)) == ["ab", "c/z"]
    assert names(catalog.delete_lenient(e, ["a/b", "none"])) == ["a", "a/x", "ab", "c/z"]
    assert names(catalog.move(e, "a", "d/e")) == ["ab", "c/z", "d", "d/e", "d/e/b/y", "d/e/x"]
    assert names(catalog.copy(e, "a/b", "n")) == sorted([p for p, *_ in TREE] + ["n/y"])
    assert names(catalog.copy(e, "a", "a")) == sorted(p for p, *_ in TREE)
    assert names(catalog.rename(e, "ab", "b")) == ["a", "a/b/y", "a/x", "b", "c/z"]
    assert names(catalog.make_directory(e, "a/b/c")) == sorted([p for p, *_ in TREE] + ["a/b", "a/b/c"])
    assert names(catalog.make_directory(e, "a")) == sorted(p for p, *_ in TREE)


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda e: catalog.delete(e, ["a"]), Conflict),
        (lambda e: catalog.delete(e, ["none"]), NotFound),
        (lambda e: catalog.move(e, "a", "a/b/c"), Conflict),
        (lambda e: catalog.move(e, "a", "ab"), Conflict),
        (lambda e: catalog.move(e, "ab", "c"), Conflict),
        (lambda e: catalog.move(e, "ab", "a/x/y"), Conflict),
        (lambda e: catalog.move(e, "ab", "../x"), InvalidPath),
        (lambda e: catalog.rename(e, "ab", "x/y"), InvalidPath),
        (lambda e: catalog.make_directory(e, "ab/c"), Conflict),
        (lambda e: catalog.upsert(e, e.sparkSession.createDataFrame([("a/x/y", 1, False)], e.schema)), Conflict),
        (lambda e: catalog.upsert(e, e.sparkSession.createDataFrame([("c", 1, False)], e.schema)), Conflict),
        (lambda e: catalog.bounded(e, 4), ArchiveError),
    ],
)
def test_refused_changes(spark, change, error):
    with pytest.raises(error):
        change(entries_of(spark, TREE))


def test_missing_blocks_are_an_error(spark):
    files = files_of(spark, [("a", noise(9000)), ("b", b"xy")])
    ec = chunking.entry_chunks(files, 4096)
    blocks = ec.select(ec.chunk_id.alias("id")).where("false").selectExpr("id", "cast(null as binary) AS data")
    got = restore.restored(ec, blocks)
    assert got.where("missing > 0").count() == 2
    with pytest.raises(Damaged):
        restore.checked(got)


def test_files_stay_in_their_folder(spark, tmp_path):
    restore.write_files(files_of(spark, [("d/e/f", b"1"), ("g", b"")]), str(tmp_path / "out"))
    assert (tmp_path / "out/d/e/f").read_bytes() == b"1" and (tmp_path / "out/g").read_bytes() == b""
    for bad in ("../x", "/x", "a/../../x", "a//b"):
        with pytest.raises(Exception, match="leaves"):
            restore.write_files(files_of(spark, [(bad, b"1")]), str(tmp_path / "out"))


def test_probe():
    assert codec.is_incompressible(noise(100_000)) and not codec.is_incompressible(b"abc " * 50_000) and not codec.is_incompressible(b"")
    assert len(codec.sample(noise(3 << 20))) == 1 << 20


def test_store_refuses_a_stale_commit(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    e = entries_of(spark, TREE)
    first = s.commit({"entries": e}, None)
    second = s.commit({"entries": e.where("not is_dir")}, first)
    assert s.current() == second and s.table("entries").count() == 4 and s.table("entries", first).count() == 5
    with pytest.raises(Conflict):
        s.commit({"entries": e}, first)
    with pytest.raises(Conflict):
        s.commit({"entries": e}, None)
    assert s.current() == second


def test_of_two_writers_one_commits(spark, tmp_path):
    """Both have read the same snapshot and written their tables; whoever publishes second is refused."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "store")
    base = Store(spark, root).commit({"entries": entries_of(spark, TREE)}, None)

    def write(n):
        try:
            return Store(spark, root).commit({}, base, {"entries": entries_of(spark, [(f"new{n}", 1, False)])})
        except Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(write, range(4)))
    assert sorted(got, key=str) == [base + 1, None, None, None]
    assert Store(spark, root).table("entries").count() == len(TREE) + 1


def test_a_writer_that_dies_leaves_no_trace(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "store"))
    base = s.commit({"entries": entries_of(spark, TREE)}, None)

    def dies(*_):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", dies)
        with pytest.raises(RuntimeError):
            s.commit({"entries": entries_of(spark, TREE[:1])}, base)
    assert s.current() == base and s.table("entries").count() == len(TREE)
    assert s.commit({}, base, {"entries": entries_of(spark, [("z", 1, False)])}) == base + 1
    assert len(s.vacuum(keep=1)) == 1 and s.table("entries").count() == len(TREE) + 1
    s.merge("entries")
    assert len(s.folders()["entries"]) == 1 and s.table("entries").count() == len(TREE) + 1


def content_of(archive):
    return {r["path"]: bytes(r["content"]) for r in archive.files().collect()}


def test_ingest_replaces_files(spark, tmp_path):
    from cairn.streaming.ingest import ingest_batch

    s = Store(spark, str(tmp_path / "store"))
    one, two = noise(9000), noise(9000)[::-1]
    ingest_batch(s, files_of(spark, [("a", one), ("b", b"1"), ("e", b"")]), 4096)
    before = s.table("blocks").count()
    ingest_batch(s, files_of(spark, [("a", b"2"), ("c", one)]), 4096)
    assert content_of(Archive(s)) == {"a": b"2", "b": b"1", "c": one, "e": b""}
    assert s.table("blocks").count() == before + 1, "the chunks of c are there already"
    ingest_batch(s, files_of(spark, [("d", one), ("d", two)]), 4096)
    got = content_of(Archive(s))
    assert got["d"] in (one, two) and s.table("entry_chunks").where("path = 'd'").count() == 3
    assert validate.bad_chunks(s.table("chunks")).isEmpty()


def test_archive_commands(spark, tmp_path):
    a = Archive.create(Store(spark, str(tmp_path / "store")))
    with pytest.raises(Conflict):
        Archive.create(a.store)
    assert a.list().count() == 0 and a.settings()["chunk_size"] == "4096"
    (tmp_path / "in/x/empty").mkdir(parents=True)
    (tmp_path / "in/x/f.txt").write_bytes(noise(5000))
    (tmp_path / "in/g.txt").write_bytes(b"g")
    assert a.add_directory(str(tmp_path / "in"), "top") == (2, 3)
    assert names(a.entries()) == ["top", "top/g.txt", "top/x", "top/x/empty", "top/x/f.txt"]
    a.move("top/x", "far/y")
    a.copy("far", "copy")
    a.make_directory("new/dir")
    a.delete(["top/g.txt"])
    assert content_of(a) == {"far/y/f.txt": noise(5000), "copy/y/f.txt": noise(5000)}
    assert a.extract(str(tmp_path / "out"), ["copy"]) == 1
    assert (tmp_path / "out/copy/y/f.txt").read_bytes() == noise(5000) and (tmp_path / "out/copy/y/empty").is_dir()
    with pytest.raises(NotFound):
        a.extract(str(tmp_path / "out2"), ["nothing"])
    done = a.compact()
    assert (done.chunks_before, done.chunks_after) == (3, 2) and done.saved > 0 and content_of(a)["far/y/f.txt"] == noise(5000)
    a.add(files_of(spark, [("far/y/f.txt", b"kept out")]), replace=False)
    assert content_of(a)["far/y/f.txt"] == noise(5000)
    for bad in ("../x", "a//b", "/x"):
        with pytest.raises(ArchiveError):
            a.add(files_of(spark, [(bad, b"1")]))


def test_archive_finds_and_repairs_damage(spark, tmp_path):
    a = Archive.create(Store(spark, str(tmp_path / "store")), key=b"0123456789abcdef")
    a.add(files_of(spark, [("a", noise(20_000)), ("b", b"abc " * 3000)]))
    a.protect(15, 16_384)
    assert a.has_parity() and a.scrub().isEmpty()
    base = a.store.current()
    blocks = a.store.table("blocks")
    hit = blocks.orderBy("id").first()["id"]
    a.store.commit({"blocks": blocks.where(blocks.id != hit)}, base)
    assert a.damaged_entries().count() >= 1 and a.files().where("missing > 0").count() == 1
    with pytest.raises(Damaged):
        a.extract(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    assert [r["status"] for r in a.repair(dry_run=True).collect()] == ["repaired"] and not a.scrub().isEmpty()
    a.repair()
    assert a.scrub().isEmpty() and content_of(a) == {"a": noise(20_000), "b": b"abc " * 3000}
    with pytest.raises(Conflict):
        a.strip_parity()
    a.strip_parity(force=True)
    assert not a.has_parity()


def test_passwords(spark, tmp_path):
    a = Archive.create(Store(spark, str(tmp_path / "store")), 4096, Options(level=5, parity_pct=15), password="one")
    a.add(files_of(spark, [("f", noise(9000))]))
    again = Archive.open(a.store, "one")
    assert again.key == a.key and again.options.level == 5 and again.options.parity_pct == 15 and content_of(again) == {"f": noise(9000)}
    for wrong in ("two", "One", "one "):
        with pytest.raises(Damaged):
            Archive.open(a.store, wrong)
    with pytest.raises(ArchiveError):
        Archive.open(a.store)
    a.change_password("two")
    assert content_of(Archive.open(a.store, "two")) == {"f": noise(9000)}
    with pytest.raises(Damaged):
        Archive.open(a.store, "one")
    forged = a.store.table("settings").withColumn("value", F.when(F.col("name") == "level", "9").otherwise(F.col("value")))
    a.store.commit({"settings": forged}, a.store.current())
    with pytest.raises(Damaged):
        Archive.open(a.store, "two")
    assert len({keys.expand(b"k" * 32, p) for p in keys.PURPOSES}) == len(keys.PURPOSES) and len(keys.expand(b"k", "mac", 64)) == 64


def test_pieces_that_come_late_are_cut_in_their_place(spark, tmp_path):
    """Content-defined chunks of a stream of pieces, out of order over micro-batches and one of them twice, are those of the whole."""
    from cairn.streaming.ingest import stream_gear_chunks

    bounds, data = Bounds(4096, 8192, 65_536), noise(120_000)
    pieces = [("f", i, data[at : at + 10_000], at == 110_000) for i, at in enumerate(range(0, 120_000, 10_000))]
    schema = "path string, seq bigint, data binary, last boolean"
    folder = tmp_path / "pieces"
    for n, part in enumerate(([3, 0, 11], [1, 5, 0], [2, 4, 7, 6], [10, 9, 8])):
        spark.createDataFrame([pieces[i] for i in part], schema).coalesce(1).write.parquet(str(folder / f"p{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    q = stream_gear_chunks(stream, bounds).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.pos, r.start, r.len) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()]
    assert got == [(i, s, e - s) for i, (s, e) in enumerate(chunking.cuts(data, bounds))]


@pytest.mark.parametrize("version", [1, 2])
def test_sidecar_codec(spark, version):
    data = noise(40_000)
    car = bytes(sidecar.build(files_of(spark, [("f", data)]), 15, 16_384, version).first()["sidecar"])
    rows, healed = sidecar.locate(car)
    assert len(rows) == 3 and not healed and rows[-1][3] + rows[-1][4] == len(car) - (32 if version == 1 else 0)
    got = sidecar.decode_payload(car[rows[1][3] : rows[1][3] + rows[1][4]], rows[1][2])
    k, p = parity.grid_of(15)
    again = sidecar.encode_payload(data[16_384:32_768], k, p)
    assert again == car[rows[1][3] : rows[1][3] + rows[1][4]] and got == sidecar.decode_payload(again, 16_384)
    for wrong in (again[:-1], again[:40], b"\xff" * len(again)):
        with pytest.raises(Damaged):
            sidecar.decode_payload(wrong, 16_384)
    for cut in (b"", car[:8], car[:60], b"x" + car[1:], car[:-1], car + b"x"):
        with pytest.raises(Damaged):
            sidecar.locate(cut)
    rng = random.Random(1)
    for _ in range(200):  # one wrong byte anywhere ahead of the payloads heals, or (version 1) is refused; none goes unseen
        at = rng.randrange(9, rows[0][3])
        bad = car[:at] + bytes([car[at] ^ 1 + rng.randrange(255)]) + car[at + 1 :]
        if version == 1:
            with pytest.raises(Damaged):
                sidecar.locate(bad)
        else:
            assert sidecar.locate(bad) == (rows, True)


def test_library_does_not_need_the_llm_package():
    import ast
    from pathlib import Path

    root = Path(__file__).parent.parent / "cairn"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            for node in ast.walk(ast.parse(file.read_text())):
                found = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in name or name == "corpus_pipeline" for name in found), file
