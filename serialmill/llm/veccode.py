"""Product codes of vectors: integer k-means for each of PARTS parts, pruned by fixed pivots (LAESA).

Components become integers floor(SCALE x). The distances of every part to a few fixed pivots are computed once and
stored beside the parts. In each round the distances of the pivots to the entries are computed; for a part and an
entry the greatest difference of their distances to a pivot is a lower bound. Entries are taken in the order of that bound, and only
those whose bound does not exceed the best distance so far are evaluated, exactly and in integers; so the codes are those of a full search.

A round is one pass over the stored parts. A task adds up what it assigned, so the sums that reach the driver are one
codebook in size. Sums over labels: labels that hold a large share of the rows are few and are broadcast, the others are joined by a shuffle.

Defined results: vectors that are null, or hold null or non-finite components, are dropped, as are those of another length than
the vector of the smallest id; the length must divide by PARTS; components must be under 2^27 in size as integers. Null ids
come last in the order that starts the codebooks, rows with equal ids in the order of their vectors; each repeated row counts. With fewer than
ENTRIES vectors a codebook has fewer entries. Null labels are one label; other columns are not carried on; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialmill.llm.common import materialise, ship_code

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Pivots of each part, entries evaluated before the rest is pruned, pairs evaluated at once.
PIVOTS, EARLY, PAIRS = 8, 8, 1 << 17
#: A label is broadcast if it holds at least this share of the rows (1/HOT); so there are at most HOT of them.
HOT = 4096


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x), in doubles."""
    out = np.floor(SCALE * x.astype(np.float64))
    if out.size and np.abs(out).max() >= 1 << 27:
        raise ValueError("a component is too large for exact integer distances")
    return out.astype(np.int32)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exactly."""
    d = x.astype(np.int64) - y
    return np.einsum("...j,...j->...", d, d)


def pivots(seeds: np.ndarray) -> np.ndarray:
    """PIVOTS far-apart rows of ``seeds``: the first, then always the farthest from those chosen."""
    chosen = [0]
    far = squared(seeds, seeds[0])
    while len(chosen) < min(PIVOTS, len(seeds)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(seeds, seeds[chosen[-1]]))
    return seeds[chosen]


def to_pivots(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(x[:, None], pivot[None]).astype(np.float64)).astype(np.float32)


def assign(x: np.ndarray, near: np.ndarray, book: np.ndarray, book_near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (ties: the lowest index), its squared distance, and how many distances were evaluated.

    ``near``, ``book_near``: distances of rows and of entries to the pivots, in single precision; ``slack`` covers its rounding.
    """
    bound = np.zeros((len(x), len(book)), np.float32)
    for p in range(near.shape[1]):
        np.maximum(bound, np.abs(near[:, p, None] - book_near[None, :, p]), out=bound)
    slack = 1e-6 * (float(near.max(initial=0)) + float(book_near.max(initial=0)) + 1)
    low = np.maximum(bound.astype(np.float64) - slack, 0) ** 2
    early = min(EARLY, len(book))
    first = np.sort(np.argpartition(bound, early - 1, axis=1)[:, :early], axis=1)
    d = squared(x[:, None], book[first])
    at, rows = d.argmin(1), np.arange(len(x))  # entries rise, so the first least is the lowest index
    best, code = d[rows, at], first[rows, at]
    np.put_along_axis(low, first, np.inf, axis=1)
    left_row, left_entry = np.nonzero(low <= best[:, None])
    for lo in range(0, len(left_row), PAIRS):
        r, e = left_row[lo : lo + PAIRS], left_entry[lo : lo + PAIRS]
        d = squared(x[r], book[e])
        begins = np.flatnonzero(np.diff(r, prepend=-1))
        least = np.minimum.reduceat(d, begins)
        is_least = np.flatnonzero(d == np.repeat(least, np.diff(begins, append=len(r))))
        is_least = is_least[np.diff(r[is_least], prepend=-1) > 0]
        row, entry = r[is_least], e[is_least]
        better = (least < best[row]) | (least == best[row]) & (entry < code[row])
        best[row[better]], code[row[better]] = least[better], entry[better]
    return code, best, early * len(x) + len(left_row)


class Books:
    """Codebooks of all parts with the distances of their entries to the fixed pivots; this is what is broadcast."""

    def __init__(self, entries: np.ndarray, pivot: np.ndarray):
        self.entries, self.pivot = entries, pivot
        self.near = np.stack([to_pivots(e, p) for e, p in zip(entries, pivot, strict=True)])

    def renewed(self, n: np.ndarray, sums: np.ndarray) -> Books:
        return Books(np.where(n[..., None] > 0, sums // np.maximum(n, 1)[..., None], self.entries).astype(np.int32), self.pivot)

    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The stored parts (rows, PARTS, dim / PARTS) and pivot distances of a batch."""
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("parts").to_pylist()), np.int32).reshape(n, PARTS, dim // PARTS)
    return x, np.frombuffer(b"".join(batch.column("near").to_pylist()), np.float32).reshape(n, PARTS, -1) if n else np.zeros((0, PARTS, 1), np.float32)


def prepare(vectors: DataFrame, id_col: str, vector: str, label: str):
    """(stored parts with pivot distances, first codebooks, length of the vectors); None for an empty table."""
    spark = vectors.sparkSession
    ship_code(spark)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & sound)
    order = [F.asc_nulls_last("id"), F.asc("v")]
    lead = kept.orderBy(*order).limit(1).collect()
    if not lead:
        return None
    dim = len(lead[0]["v"])
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components have no {PARTS} equal parts")
    kept = kept.where(F.size("v") == dim)
    seeds = whole(np.array([r["v"] for r in kept.orderBy(*order).limit(ENTRIES).collect()]).reshape(-1, dim)).reshape(-1, PARTS, dim // PARTS).swapaxes(0, 1)
    books = Books(seeds, np.stack([pivots(s) for s in seeds]))
    shared = spark.sparkContext.broadcast(books.pivot)
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches):
        for b in batches:
            v = b.column("v")
            x = whole(np.asarray(v.flatten()).reshape(b.num_rows, dim)).reshape(b.num_rows, PARTS, dim // PARTS)
            near = np.concatenate([to_pivots(x[:, p], shared.value[p]) for p in range(PARTS)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in near], pa.binary())], names=["id", "label", "parts", "near"])

    stored = materialise(kept.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, parts binary, near binary"))
    return stored, books, dim


def learn(stored: DataFrame, books: Books, dim: int, rounds: int = ROUNDS) -> Books:
    """``rounds`` passes: every part to its nearest entry, every used entry to the floored mean of its parts."""
    spark, width = stored.sparkSession, dim // PARTS
    n_entries = books.entries.shape[1]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches, shared=shared):
            total = np.zeros((PARTS, n_entries, width + 1), np.int64)  # the count, then the sums of the components
            for b in batches:
                x, near = _rows(b, dim)
                for p in range(PARTS if len(x) else 0):
                    code, _, _ = assign(x[:, p], near[:, p], shared.value.entries[p], shared.value.near[p])
                    order = np.argsort(code, kind="stable")
                    begins = np.flatnonzero(np.diff(code[order], prepend=-1))
                    used = code[order][begins]
                    total[p, used, 0] += np.diff(begins, append=len(code))
                    total[p, used, 1:] += np.add.reduceat(x[order, p].astype(np.int64), begins, axis=0)
            flat = total.reshape(-1)
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["slot", "n"])

        total = np.zeros(PARTS * n_entries * (width + 1), np.int64)
        for r in stored.select("parts", "near").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
            total[r["slot"]] = r["n"]
        total = total.reshape(PARTS, n_entries, width + 1)
        books = books.renewed(total[..., 0], total[..., 1:])
    return books


def coded(stored: DataFrame, books: Books, dim: int) -> DataFrame:
    """(id, label, code, error, n_evaluated): two hex digits for each part, the summed squared distance, and the work it took."""
    shared = stored.sparkSession.sparkContext.broadcast(books)
    kinds = {c: stored.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches):
        for b in batches:
            x, near = _rows(b, dim)
            found = [assign(x[:, p], near[:, p], shared.value.entries[p], shared.value.near[p]) for p in range(PARTS)] if len(x) else []
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8) if found else np.zeros((0, PARTS), np.uint8)
            error = sum(f[1] for f in found) if found else np.zeros(0, np.int64)
            work = np.full(len(x), sum(f[2] for f in found) / max(len(x), 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64()), pa.array(work, pa.float64())], names=["id", "label", "code", "error", "n_evaluated"])

    return stored.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint, n_evaluated double")


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the sum of ``error`` over each label."""
    sums = materialise(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")).withColumnRenamed("label", "_label"))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    hot, same = sums.where(F.col("_n") * HOT >= total), F.col("label").eqNullSafe(F.col("_label"))
    few = F.broadcast(hot)
    some = rows.join(few, same)
    others = rows.join(few, same, "left_anti").join(sums.where(F.col("_n") * HOT < total), same)
    return some.unionByName(others).drop("_label", "_n")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256, n_evaluated) of every kept vector; n_evaluated is the mean over its batch."""
    made = prepare(vectors, id_col, vector, label)
    if made is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string, n_evaluated double")
    stored, books, dim = made
    books = learn(stored, books, dim)
    out = with_label_error(materialise(coded(stored, books, dim)))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"), "n_evaluated")


def oracle(rounds: int = ROUNDS) -> str:
    """The same by a full search in SQL, the rounds written out."""
    nearest = "min((xx - 2 * list_inner_product(x, c.y) + list_inner_product(c.y, c.y))::BIGINT * 256 + e)"
    sql = rf"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT *, list_inner_product(x, x) AS xx FROM (
    SELECT rid, p, list_transform(embedding[p * len(embedding) // {PARTS} + 1 : (p + 1) * len(embedding) // {PARTS}], lambda x: floor({SCALE} * x::DOUBLE)) AS x
    FROM kept, range({PARTS}) AS r(p))
), book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS y FROM parts WHERE rid <= {ENTRIES})"""
    for k in range(rounds + 1):
        sql += f"\n, near{k} AS MATERIALIZED (SELECT rid, p, m % 256 AS e, m // 256 AS d FROM (SELECT rid, p, {nearest} AS m FROM parts JOIN book{k} AS c USING (p) GROUP BY rid, p))"
        if k < rounds:
            sql += f"""
, mean{k} AS (
  SELECT p, e, list(floor(s / n) ORDER BY i) AS y FROM (
    SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{k} JOIN parts USING (rid, p)) GROUP BY p, e, i) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, b.y) AS y FROM book{k} AS b LEFT JOIN mean{k} AS m USING (p, e))"""
    return sql + f"""
, done AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM done JOIN kept USING (rid)
"""
