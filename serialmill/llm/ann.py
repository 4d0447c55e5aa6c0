"""Nearest neighbours by cosine with a vantage-point tree for each shard.

Equal vectors become one entry with its smallest ids (a copy beyond the first k + 1 can never be among
the k nearest, as ties go to smaller ids), so a vector that a third of all rows share is one entry.
Entries belong to the cell of their nearest centre (a bounded sample of the vectors); a cell is cut into
shards of bounded size, and each shard's tree is stored as a row of the index. A query first searches its
own cell. Its k-th distance there, divided by ``factor``, then decides which cells it still has to visit: a
cell whose ball, or hollow, cannot hold a nearer vector is left out, as are such subtrees inside a shard,
both by the triangle inequality. A factor of 1 keeps the search exact, larger values drop more.
Query blocks stream past a tree that is read once; a task meets one shard and a bounded run of blocks.

Distances are Euclidean on unit vectors, which order as cosines do. The nearest of all shards are
scored again on the original vectors, in double precision and a fixed order of addition.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with
a null id, take no part; repeated rows of one id count once; only vectors of the same length meet; equal
cosines are ranked by id; only the id and the vector are read, whatever other columns are named; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialmill.llm.common import materialise, ship_code

CELLS = 64  # centres of each vector length, so cells and their bounds are a table of fixed size
SHARD = 4096
QUERY_BLOCK = 1024
RUN = 64  # query blocks that meet a shard in one task
LEAF = 256
SLACK = 1e-11


class VantageTree:
    """Nodes in arrays: vantage point, least and greatest distance of either half, child numbers; leaves are slices of one order.

    ``laid``: the vectors in that order. ``places``: (start, end, place of the vantage point, inner child, outer child) of each node,
    with -1 for none; ``bounds``: the four distances.
    """

    def __init__(self, laid: np.ndarray, places: np.ndarray, bounds: np.ndarray):
        self.laid, self.places, self.bounds = laid, places.tolist(), bounds.tolist()

    @classmethod
    def grow(cls, unit: np.ndarray, leaf: int = LEAF, seed: int = 7) -> tuple["VantageTree", np.ndarray]:
        """A tree over ``unit`` and the order in which it lays the vectors."""
        rng, order = np.random.default_rng(seed), np.arange(len(unit))
        places, bounds = [], []

        def build(lo: int, hi: int) -> int:
            at = len(places)
            places.append((lo, hi, -1, -1, -1))
            bounds.append((0.0, 0.0, 0.0, 0.0))
            if hi - lo > leaf:
                vp = order[lo + int(rng.integers(hi - lo))]
                d = distance(unit[vp] @ unit[order[lo:hi]].T)
                by = np.argsort(d, kind="stable")
                order[lo:hi], d = order[lo:hi][by], d[by]
                mid = (hi - lo) // 2
                inner, outer = build(lo, lo + mid), build(lo + mid, hi)
                places[at] = (lo, hi, vp, inner, outer)
                bounds[at] = (d[0], d[mid - 1], d[mid], d[-1])
            return at

        build(0, len(unit))
        of = np.empty(len(order), np.int64)
        of[order] = np.arange(len(order))
        where = np.array(places, np.int64)
        inside = where[:, 2] >= 0
        where[inside, 2] = of[where[inside, 2]]
        return cls(unit[order], where, np.array(bounds)), order

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, least: np.ndarray | None = None):
        """(query, place, cosine) of each query's k nearest and of all that tie with the k-th; ``least``: k-th cosines already found elsewhere."""
        best = np.full((len(queries), k), -2.0) if least is None else np.repeat(least[:, None], k, 1)
        got: list[tuple] = []

        def visit(at: int, q: np.ndarray) -> None:
            if not len(q):
                return
            lo, hi, vp, inner, outer = self.places[at]
            if vp < 0:
                sims = queries[q] @ self.laid[lo:hi].T
                r, c = np.nonzero(sims >= best[q, 0][:, None] - SLACK)
                got.append((q[r], lo + c, sims[r, c]))
                both = np.concatenate([best[q], sims], 1)
                both.partition(both.shape[1] - k, axis=1)
                best[q] = np.sort(both[:, -k:], 1)
                return
            near, edge, rim, far = self.bounds[at]
            d = distance(queries[q] @ self.laid[vp])
            first = d < (edge + rim) / 2
            visit(inner, q[first])
            visit(outer, q[~first])
            tau = (distance(best[q, 0]) + 1e-7) / factor
            visit(outer, q[first & (d + tau >= rim) & (d - tau <= far)])
            visit(inner, q[~first & (d - tau <= edge) & (d + tau >= near)])

        if len(self.laid) and len(queries):
            visit(0, np.arange(len(queries)))
        if not got:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        q, e, s = (np.concatenate(x) for x in zip(*got, strict=True))
        keep = s >= best[q, 0] - SLACK
        return q[keep], e[keep], s[keep]


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.where(F.coalesce(F.forall("v", finite), F.lit(False)) & F.exists("v", lambda x: x != 0))


def _fold(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    return _fold(a, b) / (F.sqrt(_fold(a, a)) * F.sqrt(_fold(b, b)))


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    m = m / np.abs(m).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return m / np.linalg.norm(m, axis=1, keepdims=True)


_PLACED = "dim int, cell int, away double, id bigint, unit binary"
_PLACED_ARROW = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("away", pa.float64()), ("id", pa.int64()), ("unit", pa.binary())])


def _place(shared):
    """(dim, id, v) -> the cell of the nearest centre, the distance from it, and the unit vector."""

    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                unit = _unit(b.column(2).take(pa.array(at)).to_pylist())
                away = distance(unit @ shared.value[int(dim)].T)
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dims[at], pa.int32()), pa.array(cell, pa.int32()), pa.array(away[np.arange(len(at)), cell]), b.column(1).take(pa.array(at)), pa.array([x.tobytes() for x in unit], pa.binary())], schema=_PLACED_ARROW
                )

    return run


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)


_INDEX = "dim int, cell int, shard int, reps array<bigint>, units binary, places binary, bounds binary"


def _grow(batches):
    """(dim, cell, shard, e) -> the shard's tree with its entries in the tree's order."""
    for b in batches:
        for i in range(b.num_rows):
            dim, cell, shard, e = (c[i].as_py() for c in b.columns)
            tree, order = VantageTree.grow(_matrix([x["unit"] for x in e], dim))
            cols = [pa.array([x], pa.int32()) for x in (dim, cell, shard)] + [pa.array([np.array([x["id"] for x in e], np.int64)[order]], pa.list_(pa.int64()))]
            blobs = [tree.laid.tobytes(), np.array(tree.places, np.int64).tobytes(), np.array(tree.bounds).tobytes()]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([x], pa.binary()) for x in blobs], names=["dim", "cell", "shard", "reps", "units", "places", "bounds"])


class Index:
    """Trees by shard, and for each cell its shards and the least and greatest distance of an entry from its centre."""

    def __init__(self, entries: DataFrame, shard: int = SHARD, cells: int = CELLS):
        """``entries``: (rep, dim, v). Centres are the ``cells`` entries of each length with the smallest hashes."""
        spark = entries.sparkSession
        first = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("rep"), "rep"))
        chosen = entries.select("dim", "rep", "v", first.alias("r")).where(F.col("r") <= cells).collect()
        dims = sorted({r["dim"] for r in chosen})
        centres = {d: _unit([r["v"] for r in sorted(chosen, key=lambda r: r["r"]) if r["dim"] == d]) for d in dims}
        self.centres = spark.sparkContext.broadcast(centres)  # ``cells`` vectors of each length
        placed = materialise(self.place(entries.select("dim", F.col("rep").alias("id"), "v")))
        self.cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect()  # ``cells`` rows of each length
        self.parts = [(r["dim"], r["cell"], max(1, -(-r["n"] // shard))) for r in self.cells]
        small = spark.createDataFrame(self.parts, "dim int, cell int, parts int")
        dealt = placed.join(F.broadcast(small), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        packed = dealt.groupBy("dim", "cell", "shard").agg(F.sort_array(F.collect_list(F.struct("id", "unit"))).alias("e"))
        self.trees = materialise(packed.mapInArrow(_grow, _INDEX))

    def place(self, rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(_place(self.centres), _PLACED)

    def others(self, asked: DataFrame, factor: float) -> DataFrame:
        """(dim, cell, id, unit, near) with the home cell and k-th cosine of a query -> the same for each other cell that may hold a nearer vector."""
        centres, held = self.centres, {}
        for r in self.cells:
            held.setdefault(r["dim"], []).append((r["cell"], r["near"], r["far"]))

        def run(batches):
            for b in batches:
                dims, homes, near = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(4).to_numpy()
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    cell, least, most = (np.array(x) for x in zip(*held[int(dim)], strict=True))
                    d = distance(_matrix(b.column(3).take(pa.array(at)).to_pylist(), int(dim)) @ centres.value[int(dim)][cell].T)
                    tau = ((distance(near[at]) + 1e-7) / factor)[:, None]
                    r, c = np.nonzero((cell[None] != homes[at][:, None]) & (d - tau <= most) & (d + tau >= least))
                    if len(r):
                        row = pa.array(at[r])
                        yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(cell[c], pa.int32()), *(b.column(i).take(row) for i in (2, 3, 4))], names=["dim", "cell", "id", "unit", "near"])

        return asked.select("dim", "cell", "id", "unit", "near").mapInArrow(run, "dim int, cell int, id bigint, unit binary, near double")

    def search(self, asked: DataFrame, k: int, factor: float, query_block: int) -> DataFrame:
        """(dim, cell, id, unit, near) -> (qrep, rep, near): what each query finds in all shards of the named cell."""
        spark = asked.sparkSession
        n = {(r["dim"], r["cell"]): r["count"] for r in asked.groupBy("dim", "cell").count().collect()}
        size = [(d, c, p, -(-n[d, c] // query_block)) for d, c, p in self.parts if (d, c) in n]
        if not size:
            return spark.createDataFrame([], _FOUND)
        small = F.broadcast(spark.createDataFrame(size, "dim int, cell int, parts int, blocks int"))
        packed = asked.join(small, ["dim", "cell"]).groupBy("dim", "cell", "parts", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "near", "unit")).alias("q"))
        to = ["dim", "cell", "shard", "run"]
        sent = packed.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("shard"), F.expr(f"int(block div {RUN})").alias("run"), "q")
        trees = self.trees.join(small, ["dim", "cell"]).select("dim", "cell", "shard", F.explode(F.sequence(F.lit(0), F.expr(f"int((blocks - 1) div {RUN})"))).alias("run"), "reps", "units", "places", "bounds")
        both = trees.unionByName(sent, allowMissingColumns=True)
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = both.repartition(n_parts, *to).sortWithinPartitions(*to, F.col("q").isNotNull())
        return dealt.select("dim", "reps", "units", "places", "bounds", "q").mapInArrow(_walk(k, factor), _FOUND)


_FOUND = "qrep bigint, rep bigint, near double"


def _walk(k: int, factor: float):
    """Rows of trees, each before the query blocks that it is to meet."""

    def run(batches):
        tree, reps = None, None
        for b in batches:
            for i in range(b.num_rows):
                dim, ids, units, places, bounds, q = (c[i].as_py() for c in b.columns)
                if q is None:
                    tree = VantageTree(_matrix([units], dim), np.frombuffer(places, np.int64).reshape(-1, 5), np.frombuffer(bounds, np.float64).reshape(-1, 4))
                    reps = np.array(ids, np.int64)
                    continue
                at, e, s = tree.search(_matrix([x["unit"] for x in q], dim), k, factor, np.array([x["near"] for x in q]))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([x["id"] for x in q], np.int64)[at]), pa.array(reps[e]), pa.array(s)], names=["qrep", "rep", "near"])

    return run


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, factor: float = 1.0, shard: int = SHARD, query_block: int = QUERY_BLOCK, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row of ``df`` for which ``queries`` (over ``id``) holds."""
    ship_code(df.sparkSession)
    rows = valid_vectors(df, key, vector)
    copies = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
    entries = materialise(few.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")))
    index = Index(entries.select("rep", "dim", "v"), shard, min(cells, max(1, entries.count() // shard)))  # cells of at least a shard

    asked = rows.where(queries)
    distinct = materialise(asked.groupBy("v").agg(F.min("id").alias("qrep")).withColumn("dim", F.size("v")))
    home = materialise(index.place(distinct.select("dim", F.col("qrep").alias("id"), "v")))
    near = materialise(index.search(home.withColumn("near", F.lit(-2.0)), k + 1, factor, query_block))
    kth = near.groupBy(F.col("qrep").alias("id")).agg(F.get(F.sort_array(F.collect_list("near"), False), F.lit(k)).alias("near"))
    rest = materialise(index.others(home.join(kth, "id", "left").withColumn("near", F.coalesce("near", F.lit(-2.0))), factor))
    found = near.unionByName(index.search(rest, k + 1, factor, query_block))
    best = Window.partitionBy("qrep").orderBy(F.round("near", 10).desc())
    close = found.withColumn("r", F.rank().over(best)).where(F.col("r") <= k + 1)  # ties with the last stay

    pairs = close.join(entries.select("rep", "ids", F.col("v").alias("cv")), "rep").join(distinct.select("qrep", F.col("v").alias("qv")), "qrep")
    scored = pairs.select("qrep", "ids", cosine(F.col("qv"), F.col("cv")).alias("score"))
    own = asked.select("id", "v").distinct().join(distinct.select("v", "qrep"), "v").select(F.col("id").alias("query_id"), "qrep")
    each = own.join(scored, "qrep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
  SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda t, x: t + x)) AS norm FROM e
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda t, x: t + x) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
