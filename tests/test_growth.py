"""What keeps whole-archive queries from growing faster than their input: how often a plan works, and how much a task holds."""

import pytest

from cairn.functions import batches
from cairn.operators import parity
from cairn.sources import sidecar


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def files_of(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary")


def test_rows_are_handed_on_in_small_batches():
    rows = ((str(i), bytes(1 << 16)) for i in range(1000))  # 62 MB
    sizes = [b.nbytes for b in batches.handed(rows, "path string, sidecar binary")]
    assert len(sizes) > 10 and max(sizes) < 1.1 * batches.HANDED


def test_sidecars_are_built_in_one_pass_and_read_by_their_heads(spark):
    data = bytes(range(256)) * 400
    cars = sidecar.build(files_of(spark, [("f", data), ("empty", b""), (None, b"x")]), 15, 16_384)
    plan = plan_of(cars)
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan
    rows = {r["path"]: (bytes(r["sidecar"]), bytes(r["head"])) for r in cars.select("path", "sidecar", sidecar.head(cars.sidecar).alias("head")).collect()}
    assert set(rows) == {"f", "empty"}
    for car, head in rows.values():
        found = sidecar.locate(car)
        assert len(head) == found[0][0][3] and sidecar.locate(head, len(car)) == found


def test_repair_evaluates_files_and_sidecars_once(spark):
    files = files_of(spark, [("f", bytes(5000)), ("g", b"")])
    plan = plan_of(sidecar.repair(files, sidecar.build(files, 15, 16_384), 15, 16_384))
    assert plan.count("MapInArrow") == 2 and plan.count("Join ") == 1
    sums = files.selectExpr("path", "sha2(content, 256) AS sha256")
    plan = plan_of(parity.repair(files, parity.protect(files, 15, 16_384), sums, 15, 16_384))
    assert plan.count("MapInArrow") == 2 and plan.count("Join ") == 2


def test_repair_with_a_sidecar_that_cannot_be_read(spark):
    files = files_of(spark, [("f", b"abc" * 2000), ("g", b"def")])
    cars = files_of(spark, [("f", b"no sidecar"), ("g", b"no sidecar")]).withColumnRenamed("content", "sidecar")
    sums = files.selectExpr("path", "CASE path WHEN 'g' THEN sha2(content, 256) ELSE sha2('other', 256) END AS sha256")
    got = {r.path: (r.status, r.rebuilt) for r in sidecar.repair(files, cars, 15, 16_384, sums).collect()}
    assert got == {"f": ("unrecoverable", 0), "g": ("clean", 0)}
    assert sidecar.repair(files, cars, 15, 16_384).isEmpty()


@pytest.mark.parametrize("query", ["sidecar_healing", "metadata_healing"])
def test_healing_builds_its_sidecars_once(spark, sf, query):
    import __spark_entry__

    plan = plan_of(__spark_entry__.queries()[query](spark, sf))
    assert plan.count("MapInArrow") == 2
    assert query == "sidecar_healing" or "text#" not in plan  # regions are made once, not with each reading


def test_an_add_writes_bytes_once_and_no_cut_files(spark, tmp_path):
    import random
    from pathlib import Path

    from cairn.operators.archive import Archive
    from cairn.sources.store import Store

    made = random.Random(3)
    data = {f"f{i}": made.randbytes(20_000) for i in range(20)}
    bytes_in = lambda *roots: sum(f.stat().st_size for r in roots for f in Path(r).rglob("*.parquet"))
    roots = tmp_path, spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = bytes_in(*roots)
    own = Archive.create(Store(spark, str(tmp_path / "store")), 4096)
    own.add(files_of(spark, list(data.items())))
    own.add(files_of(spark, [(f"again/{p}", d) for p, d in data.items()]))
    assert bytes_in(*roots) - before < 4 * 400_000  # the files of both adds and the blocks of the first; with cut files and blocks kept beside the store, six
    assert {r.path: bytes(r.content) for r in own.files().collect()} == data | {f"again/{p}": d for p, d in data.items()}
    own.store.vacuum()
    assert own.store.table("blocks").columns == ["id", "block"] and own.files().where("missing > 0").isEmpty()


def test_blocks_are_what_the_probe_and_the_level_say():
    import random

    import zstandard

    from cairn.operators import codec

    noise = random.Random(1).randbytes(5000)
    for chunk in (b"", b"a", b"abc " * 1000, noise, noise + b"abc " * 2000, noise * 300):
        for level in (3, 9):
            out = chunk if codec.is_incompressible(chunk) else zstandard.ZstdCompressor(level=level).compress(chunk)
            assert codec.packed(chunk, level) == ((chunk, True) if len(out) >= len(chunk) else (out, False))
