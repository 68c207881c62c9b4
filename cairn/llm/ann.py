"""Approximate nearest neighbours: NN-descent builds a graph, queries walk it greedily.

Equal vectors become one node first (however many they are), named by their smallest id; of its
members the search needs only the ``top`` + 1 with the smallest ids.  The graph starts from
brute force inside small cells: each node goes to the cells of its nearest pivots, a bounded
sample of nodes, and a cell that is too large is cut again by pivots of its own, as often as it takes.
NN-descent then improves the graph, until a round changes few edges: in each round every node gathers
its nearest neighbours and some of the nodes that it is a neighbour of, compares them with
each other, and tells each about the nearest of the others: neighbours of neighbours.  Every row is
indexed.  While the graph is built, vectors are 32-bit copies, moved to the middle of the pivots and scaled to the
largest component, compared in double precision: neither large nor small nor mixed magnitudes are lost.  Search and results use the
original vectors in double precision.

A query starts at its own node (if it has one) and at the nearest pivots.  In each round the nearest
nodes of its beam that were not expanded yet are joined with the graph, and the distances to the
new nodes computed; it ends when the beam's nodes are all expanded.  A query that reaches fewer
nodes than it should return is answered by an exact scan in blocks of queries.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
neither do those whose length is not the commonest (ties: the longest); a query has no row for
itself, but has rows for other ids with an equal vector; repeated ids count once (the vector that
sorts first); with fewer candidates than ``top``, all are returned; an empty table gives no
rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import forget, table, written

TOP = 10
#: Neighbours of a node, others it is compared with that name it, how many it is told in a round, and the fewest rounds.
NEIGHBOURS, REVERSE, TOLD, ROUNDS = 24, 18, 8, 3
#: Rounds go on while at least this share of the edges is new.
CHANGED = 0.03
#: Pivots (bounded in number and bytes), cells of each node, nodes of a cell that are compared at once, and most pivots of a large cell.
PIVOTS, PIVOT_BYTES, CELLS, CELL, AGAIN = 8192, 1 << 25, 10, 1200, 64
#: Nodes of a large cell that one task deals to its pivots.
DEALT = 100_000
#: Beam of a query, nodes expanded in a round, pivots that it starts from.
BEAM, EXPANDED, ENTRIES = 160, 40, 4
QUERY_BLOCK = 4096


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec) with vec an array of doubles: those that take part."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("vec") == F.lit(size["n"] if size else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def _rows(vec: pa.Array, n: int) -> np.ndarray:
    return vec.flatten().to_numpy().reshape(n, -1)


def _packed(vec: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec.to_pylist()), np.float32).reshape(n, -1).astype(np.float64)


def distances(pairs: DataFrame) -> DataFrame:
    """(q, node, d): Euclidean distances of (q, node, q_vec, node_vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                d = np.sqrt(((_rows(b.column(2), len(b)) - _rows(b.column(3), len(b))) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["q", "node", "d"])

    return pairs.select("q", "node", "q_vec", "node_vec").mapInArrow(run, "q bigint, node bigint, d double")


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of the k nearest others of each row of x."""
    norm = (x * x).sum(axis=1)
    d = norm[:, None] + norm - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(x) - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) - 1 else np.tile(np.arange(len(x)), (len(x), 1))
    found = np.take_along_axis(d, at, axis=1)
    order = np.argsort(found, axis=1)[:, :k]
    return np.take_along_axis(at, order, axis=1), np.maximum(np.take_along_axis(found, order, axis=1), 0)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one value of the first column at a time; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for a, e in zip(cuts, np.r_[cuts[1:], len(b)]):
            part = b.slice(int(a), int(e - a))
            if held and held[0].column(0)[0].as_py() != part.column(0)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _edges(a: np.ndarray, place: np.ndarray, d: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    keep = np.isfinite(d).ravel()
    a = np.repeat(a, place.shape[1])[keep]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids[place.ravel()[keep]]), pa.array(d.ravel()[keep])], ["a", "b", "d"])


EDGES = "a bigint, b bigint, d double"


def _in_groups(rows: DataFrame, key: str, told: int) -> DataFrame:
    """Edges from each member of a group (key, id, vec) to its ``told`` nearest others there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            if len(t) < 2:
                continue
            t = t.combine_chunks()
            ids = t.column(1).to_numpy()
            yield _edges(ids, *_nearest(_packed(t.column(2), len(ids)), told), ids)

    return rows.select(key, "id", "vec").repartition(F.col(key)).sortWithinPartitions(key, "id").mapInArrow(run, EDGES)


def _best(edges: DataFrame) -> DataFrame:
    """The NEIGHBOURS nearest of each node."""
    once = edges.groupBy("a", "b").agg(F.min("d").alias("d"))
    w = Window.partitionBy("a").orderBy("d", "b")
    return once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= NEIGHBOURS).drop("_n")


def _pivots(nodes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a sample of at most PIVOTS nodes, those with the smallest hash of their id."""
    first = nodes.select(F.size("vec").alias("n")).first()
    dim = first["n"] if first else 1
    most = min(PIVOTS, max(1, PIVOT_BYTES // (8 * dim)), max(1, int(2 * n**0.5)))
    got = nodes.orderBy(F.xxhash64("id"), "id").limit(most).select("id", "vec").toArrow()
    return got.column("id").to_numpy(), np.array(got.column("vec").to_pylist(), dtype=np.float64).reshape(-1, dim)


def _packed_nodes(nodes: DataFrame, centre: np.ndarray, scale: float) -> DataFrame:
    """(id, vec): 32-bit copies of the vectors, moved and scaled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = ((_rows(b.column(1), len(b)) - centre) / scale).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "vec"])

    return nodes.select("id", "vec").mapInArrow(run, "id bigint, vec binary")


def _hashed(cell: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Numbers for the parts of cells."""
    z = cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def _first_cells(packed: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, id): the cells of each node's nearest pivots."""
    norm = (pivots * pivots).sum(axis=1)
    k = min(CELLS, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                d = norm - 2 * (_packed(b.column(1), len(b)) @ pivots.T)
                near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(b), 1))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), k))], ["cell", "id"])

    return packed.mapInArrow(run, "cell bigint, id bigint")


def _cut(placed: DataFrame, big: DataFrame, packed: DataFrame) -> DataFrame:
    """(cell, id) of the large cells (cell, size), each cut by pivots of its own.

    A cell's nodes are dealt to as many tasks as its size asks for; each of them gets the cell's pivots
    (at most AGAIN).  Nodes as near to several go to one of these by a hash, so that a cell always shrinks."""
    rows = written(placed.join(big, "cell"), "large")
    w = Window.partitionBy("cell").orderBy(F.xxhash64("id", "cell"), "id")
    chosen = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= AGAIN).where(F.col("_n") <= F.ceil(2 * F.col("size") / CELL))
    salts = F.ceil(F.col("size") / DEALT)
    chosen = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).select("cell", "salt", F.lit(0).alias("kind"), "id")
    others = rows.select("cell", F.pmod(F.xxhash64("id"), salts).alias("salt"), F.lit(1).alias("kind"), "id")
    both = chosen.unionByName(others).join(packed, "id").select(F.xxhash64("cell", "salt").alias("part"), "cell", "kind", "id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads, pivots, norm = None, [], None, None
        for b in batches:
            if not len(b):
                continue
            part, cell, kind, ids = (b.column(c).to_numpy() for c in range(4))
            x = _packed(b.column(4), len(b))
            cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
            for a, e in zip(cuts, np.r_[cuts[1:], len(b)]):
                if part[a] != last:
                    last, heads, pivots = part[a], [], None
                if kind[a] == 0:
                    heads.append(x[a:e])
                    continue
                if pivots is None:
                    pivots = np.concatenate(heads)
                    norm = (pivots * pivots).sum(axis=1)
                y = x[a:e]
                d = norm - 2 * (y @ pivots.T)
                tie = d <= d.min(axis=1, keepdims=True) + 1e-12 * ((y * y).sum(axis=1, keepdims=True) + norm.max())
                nth = (_hashed(ids[a:e], cell[a:e]).view(np.uint64) % tie.sum(axis=1).astype(np.uint64)).astype(np.int64)
                near = (np.cumsum(tie, axis=1) == nth[:, None] + 1).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(_hashed(cell[a:e], near)), pa.array(ids[a:e])], ["cell", "id"])

    return both.repartition(F.col("part")).sortWithinPartitions("part", "cell", "kind", "id").mapInArrow(run, "cell bigint, id bigint")


def _cells(packed: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, id): no cell has more than CELL nodes."""
    placed = written(_first_cells(packed, pivots), "cells")
    small = None
    while True:
        sizes = written(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size")), "sizes")
        fits = placed.join(sizes.where(F.col("size") <= CELL), "cell", "left_semi")
        small = fits if small is None else small.unionByName(fits)
        big = sizes.where(F.col("size") > CELL)
        if big.isEmpty():
            return small
        placed = written(_cut(placed, big, packed), "cells")


def _reverse(graph: DataFrame) -> DataFrame:
    """(a, b): the REVERSE nearest of the nodes that have a among their neighbours."""
    w = Window.partitionBy("a").orderBy("d", "b")
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
    return back.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= REVERSE).select("a", "b")


def build_graph(nodes: DataFrame, pivots: np.ndarray, n: int) -> DataFrame:
    """(a, b, d): the neighbours of every node of (id, vec); pivots: vectors of some of them."""
    centre = np.median(pivots, axis=0)
    far = F.greatest(*[F.abs(f("vec")) for f in (F.array_max, F.array_min)])
    scale = 2 * max(float(nodes.agg(F.max(far)).first()[0] or 1.0), float(np.abs(centre).max()))
    packed = written(_packed_nodes(nodes, centre, scale), "packed")
    placed = _cells(packed, ((pivots - centre) / scale).astype(np.float32).astype(np.float64))
    graph = written(_best(_in_groups(placed.join(packed, "id"), "cell", NEIGHBOURS)), "graph")
    own = packed.select(F.col("id").alias("a"), F.col("id").alias("b"))
    for done in range(1, ROUNDS + n.bit_length() + 1):
        around = graph.select("a", "b").unionByName(_reverse(graph)).unionByName(own).distinct()
        met = around.join(packed.withColumnRenamed("id", "b"), "b").select("a", F.col("b").alias("id"), "vec")
        before, graph = graph, written(_best(graph.unionByName(_in_groups(met, "a", TOLD))), "graph")
        settled = done >= ROUNDS and graph.join(before, ["a", "b"], "left_anti").count() < CHANGED * graph.count()
        forget(before)
        if settled:
            break
    forget(packed)
    return graph


def exact(queries: DataFrame, rows: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, id, d): candidates from a scan of all rows (id, vec), among them the ``top`` nearest of each query (id, vec).

    Queries come to the driver QUERY_BLOCK at a time and go to all tasks; each task keeps its nearest of each."""
    out = rows.sparkSession.createDataFrame([], "query_id bigint, id bigint, d double")

    def scanned(block: list) -> DataFrame:
        ids, q = np.array([r["id"] for r in block], np.int64), np.array([r["vec"] for r in block], np.float64)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best_d, best_id = np.full((len(ids), top), np.inf), np.full((len(ids), top), np.iinfo(np.int64).max)
            for b in batches:
                if not len(b):
                    continue
                x, own = _rows(b.column(1), len(b)), b.column(0).to_numpy()
                for i in range(len(ids)):
                    d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
                    d[own == ids[i]] = np.inf
                    some = np.flatnonzero(d <= best_d[i, -1])
                    d, who = np.r_[best_d[i], d[some]], np.r_[best_id[i], own[some]]
                    near = np.lexsort((who, d))[:top]
                    best_d[i], best_id[i] = d[near], who[near]
            found = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top)[found.ravel()]), pa.array(best_id[found]), pa.array(best_d[found])], ["query_id", "id", "d"])

        return written(rows.select("id", "vec").mapInArrow(scan, "query_id bigint, id bigint, d double"), "scanned")

    block: list = []
    for r in queries.select("id", "vec").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(scanned(block)), []
    return out.unionByName(scanned(block)) if block else out


def search(queries: DataFrame, vectors: DataFrame, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``top`` nearest found of each query (id, vec), which may be
    rows of ``vectors``; nearest first, ties to the smaller id."""
    if top >= BEAM:
        raise ValueError(f"at most {BEAM - 1} neighbours can be asked for")
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    classes = written(rows.groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("members")), "classes")
    nodes = classes.select(F.col("node").alias("id"), "vec")
    n = nodes.count()
    all_rows = rows.count()
    queries = written(queries.join(rows.select(F.size("vec").alias("_n")).limit(1), F.size("vec") == F.col("_n"), "left_semi") if n else queries.limit(0), "queries")
    empty = "query_id bigint, rank int, id bigint, score double"
    if not n:
        return rows.sparkSession.createDataFrame([], empty).withColumnRenamed("id", id_col)
    pivot_ids, pivots = _pivots(nodes, n)
    graph = build_graph(nodes, pivots, n)
    links = written(graph.select("a", "b").unionByName(_reverse(graph)).distinct(), "links")
    forget(graph)
    middle = pivots.mean(axis=0)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = pivots - middle
        norm = (moved * moved).sum(axis=1)
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                x = _rows(b.column(1), len(b)) - middle
                k = min(ENTRIES, len(pivots))
                near = np.argpartition(norm - 2 * (x @ moved.T), k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), k)), pa.array(pivot_ids[near.ravel()])], ["q", "node"])

    q = queries.select(F.col("id").alias("q"), F.col("vec").alias("q_vec"))
    v = nodes.select(F.col("id").alias("node"), F.col("vec").alias("node_vec"))
    own = q.join(v, F.col("q_vec") == F.col("node_vec")).select("q", "node")
    start = queries.select("id", "vec").mapInArrow(enter, "q bigint, node bigint").unionByName(own).distinct()

    def measured(pairs: DataFrame) -> DataFrame:
        return written(distances(pairs.join(v, "node").join(q, "q")), "measured")

    by_d = Window.partitionBy("q").orderBy("d", "node")

    def beamed(rows: DataFrame) -> DataFrame:
        """The BEAM nearest of each query, and which of them are to be expanded now."""
        kept = rows.withColumn("_n", F.row_number().over(by_d)).where(F.col("_n") <= BEAM).drop("_n")
        due = F.sum((~F.col("done")).cast("int")).over(by_d.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return written(kept.withColumn("now", ~F.col("done") & (due <= EXPANDED)), "beam")

    found = measured(start)
    seen, state = found.select("q", "node"), beamed(found.withColumn("done", F.lit(False)))
    # Each round expands nodes that were not, and those that leave the beam never come back: it ends.
    while not (front := state.where("now").select("q", "node")).isEmpty():
        met = front.join(links, F.col("node") == F.col("a")).select("q", F.col("b").alias("node")).distinct()
        found = measured(met.join(seen, ["q", "node"], "left_anti"))
        seen = seen.unionByName(found.select("q", "node"))
        expanded = state.select("q", "node", "d", (F.col("done") | F.col("now")).alias("done"))
        before, state = state, beamed(expanded.unionByName(found.withColumn("done", F.lit(False))))
        forget(before)

    near = state.withColumn("_n", F.row_number().over(by_d)).where(F.col("_n") <= top + 1).select("q", "node", "d")  # the beam is wider
    first = Window.partitionBy("node").orderBy("id")
    members = rows.join(classes.select("node", "vec"), "vec").select("node", "id").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= top + 1).select("node", "id")
    found = near.join(members, "node").where(F.col("id") != F.col("q")).select(F.col("q").alias("query_id"), "id", "d")
    rank = Window.partitionBy("query_id").orderBy("d", "id")
    best = written(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top), "found")
    full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ids = rows.select(F.col("id").alias("_id"))
    due = queries.join(ids, F.col("id") == F.col("_id"), "left").join(full, F.col("id") == F.col("query_id"), "left")
    due = due.where(F.coalesce("n", F.lit(0)) < F.least(F.lit(top), F.lit(all_rows) - F.col("_id").isNotNull().cast("int"))).select("id", "vec")
    due = written(due, "short")
    if not due.isEmpty():
        more = exact(due, rows, top).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
        best = best.join(due.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more.select(best.columns))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), F.col("d").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = usable(vectors).where("id % 100 = 0")
    return search(asked, vectors)
