"""N-gram Jaccard join with signature trees.

A document's set holds the 64-bit fingerprints of its distinct 5-word shingles (white-space words,
A-Z lower-cased). Two documents link when 100 * |intersection| >= 80 * |union|. The join is exact on
those fingerprints: nothing is sampled or capped.

1. Equal sets become one node, so copies never meet each other.
2. Linked sets share a shingle among the first ``n - ceil(0.8 n) + 1`` of any fixed order. The order
   puts shingles that are frequent (found by counts over blocks of documents) last, least frequent first,
   and the rest by fingerprint. The nodes that share such a shingle form a group; groups with the same
   members are one. Large groups are cut into parts and searched part against part.
3. In a group, each node of a signature tree holds the OR of its members' token bitmaps, their size range
   and collision slack; a dual traversal drops pairs of tree nodes whose greatest possible overlap cannot
   reach the threshold. The members of surviving pairs form blocks (components), which then hold little
   but true links. A second dual traversal in each block compares every surviving pair exactly, once; a
   large block is dealt as pairs of small parts, so no task holds a whole one.
4. Components of the verified links give each document's class, and their counts its number of links.

A shingle's fingerprint mixes strong 64-bit hashes of its words one after another, so two different
shingles agree with probability 2^-64; a set is named by a 64-bit hash of its fingerprints.

Defined results: documents without words (or with a null text) have no shingles, link with nothing and
are their own class; with fewer than five words the whole sequence is the one shingle; repeated rows
get equal rows, and each counts the others as links; very long texts are read whole; the least id names a
class, so ties do not arise; only the id and the text are read, whatever other columns are named; a class
whose ids are all null has a null id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialmill.llm.common import materialise, ship_code, slices
from serialmill.llm.components import connected_components

WORDS = 5
FANOUT = 8
FREQUENT = 0.002  # of the documents; at most (mean set size / FREQUENT) shingles can be frequent
LEAST_FREQUENT = 8
MOST_FREQUENT = 1 << 20  # entries of the broadcast table of frequent shingles; which shingles it holds never changes a result
PART = 1024  # nodes of a group that are searched at once
BLOCK_PART = 64  # nodes of a block, half of what is compared at once
CHUNK_SHINGLES = 2_000_000
CHUNK_POSTINGS = 1_000_000
PAIR_BYTES = 8_000_000  # bitmaps that are compared at once
WORD_MEMO = 300_000

_R = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """The hash of each word seen; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted fingerprints of the distinct shingles of the whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    m = len(w) - k + 1
    h = w[:m].copy()
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(32))) * _R + w[i : i + m]
    return np.unique(_mix(h ^ np.uint64(k)))


def set_id(s: np.ndarray) -> int:
    """A fingerprint of a set, as a signed 64-bit number."""
    x = _mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF))
    both = np.array([x.sum(dtype=np.uint64), np.bitwise_xor.reduce(s)], np.uint64) * np.array([1, 31], np.uint64)
    return int(_mix(both[:1] + both[1:] ^ np.uint64(len(s))).view(np.int64)[0])


def bitmap(s: np.ndarray) -> np.ndarray:
    """A token bitmap of at least two bits for each member, 64 at least; its width doubles with the size."""
    width = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of ``s`` that a linked set must share one of."""
    n = len(s)
    keep = n - (4 * n + 4) // 5 + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = frequent[at] == s
        if often.any():
            rare = s[~often]
            if len(rare) >= keep:
                return rare[:keep]
            late = s[often][np.argsort(rank[at[often]], kind="stable")]
            return np.concatenate([rare, late[: keep - len(rare)]])
    return s[:keep]


# --- 1. sets and frequent shingles


def _describe(batches):
    """A row for each document (n, node) and rows for shingles frequent within a block of documents."""
    names = ["rk", "doc_id", "n", "node", "count", "sig"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    batch = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
    held, docs, size = [], 0, 0

    def frequent():
        all_h = np.sort(np.concatenate(held))
        edge = np.flatnonzero(np.concatenate([[True], all_h[1:] != all_h[:-1], [True]]))
        count = np.diff(edge)
        big = np.flatnonzero(count >= max(2, FREQUENT / 2 * docs))
        return batch([all_h[edge[big]].view(np.int64), [None] * len(big), [None] * len(big), [None] * len(big), count[big], [None] * len(big)])

    for b in (part for whole in batches for part in slices(whole, 2)):
        rk, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        ns, nodes, sigs = [], [], []
        for t in b.column(2).to_pylist():
            s = shingles(t)
            ns.append(len(s))
            nodes.append(set_id(s) if len(s) else None)
            sigs.append(bitmap(s).tobytes() if len(s) else None)
            if len(s):
                held.append(s)
                docs, size = docs + 1, size + len(s)
                if size >= CHUNK_SHINGLES:
                    yield frequent()
                    held, docs, size = [], 0, 0
        yield batch([rk, ids, ns, nodes, [None] * len(ns), sigs])
    if held:
        yield frequent()


# --- 2. groups

_BLOB = "bucket int, keys binary, nodes binary"
_BLOB_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())])


def _postings(shared, buckets: int, part: int):
    """Packed (shingle, node) pairs for each bucket. A shingle held by many documents is dealt as part pairs: s parts of its
    nodes by a hash, a place for each pair of parts, and every node at the s places of its own part."""

    def run(batches):
        frequent, rank, count = shared.value
        keys, nodes, size = [], [], 0

        def flush():
            k, v = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            k, v = k[new], v[new]
            to = ((k >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = [{"bucket": i, "keys": k[order[lo:hi]].tobytes(), "nodes": v[order[lo:hi]].tobytes()} for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo]
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOB_ARROW)

        for b in (part for whole in batches for part in slices(whole, 0)):
            for t in b.column(0).to_pylist():
                s = shingles(t)
                if not len(s):
                    continue
                p, node = prefix(s, frequent, rank), set_id(s)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, p), len(frequent) - 1)
                    hot = (frequent[at] == p) & (count[at] > part)
                    if hot.any():
                        p = np.concatenate([p[~hot], *(_places(h, node, -(-int(c) // part)) for h, c in zip(p[hot], count[at[hot]], strict=True))])
                keys.append(p)
                nodes.append(np.full(len(p), node, np.int64))
                size += len(p)
                if size >= CHUNK_POSTINGS:
                    yield from flush()
                    keys, nodes, size = [], [], 0
        if keys:
            yield from flush()

    return run


def _places(h: np.uint64, node: int, parts: int) -> np.ndarray:
    mine = int(_mix(np.array([node], np.int64).view(np.uint64))[0] % np.uint64(parts))
    other = np.arange(parts)
    pair = np.minimum(mine, other) * parts + np.maximum(mine, other)
    return _mix(np.full(parts, h, np.uint64) + pair.astype(np.uint64) * _R)


def _meet(part: int):
    """Postings in order of their buckets, one bucket at a time -> groups of two nodes or more, each set of members once for each task."""

    def run(batches):
        seen: set[int] = set()
        now, k, v = None, [], []
        for batch in batches:
            for bucket, keys, nodes in zip(*batch.columns, strict=True):
                if bucket.as_py() != now:
                    yield from groups(k, v, seen)
                    now, k, v = bucket.as_py(), [], []
                k.append(np.frombuffer(keys.as_py(), np.uint64))
                v.append(np.frombuffer(nodes.as_py(), np.int64))
        yield from groups(k, v, seen)

    def groups(k, v, seen):
        if not k:
            return
        keys, nodes = np.concatenate(k), np.concatenate(v)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        keys, nodes = keys[new], nodes[new]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        rows: list[tuple[int, bytes]] = []
        for i in np.flatnonzero(np.diff(edge) > 1):
            for m in _cut(nodes[edge[i] : edge[i + 1]], part):
                g = set_id(m.view(np.uint64))
                if g not in seen:
                    seen.add(g)
                    rows.append((g, m.tobytes()))
            if len(rows) >= 5000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["grp", "members"])

    return run


def _cut(m: np.ndarray, part: int):
    """A group, or the unions of two of its parts if it is large."""
    if len(m) <= 2 * part:
        yield m
        return
    parts = np.array_split(m, -(-len(m) // part))
    for i, x in enumerate(parts):
        for y in parts[i + 1 :]:
            yield np.concatenate([x, y])


def _members(batches):
    for b in batches:
        g, m = b.column(0).to_numpy(), [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        if len(m):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g, [len(x) for x in m])), pa.array(np.concatenate(m))], names=["grp", "node"])


# --- 3. signature trees


class SignatureTree:
    """Levels from the members up; a level has OR-bitmaps, least and greatest sizes and greatest slack (tokens beyond one for each set bit)."""

    def __init__(self, maps: np.ndarray, n: np.ndarray):
        slack = n - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, n, n, slack)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sl = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))


def _may_link(x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of tree nodes some members of which could link: by sizes, then by the greatest possible overlap."""
    ok = (5 * x[2][i] >= 4 * y[1][j]) & (5 * y[2][j] >= 4 * x[1][i])
    at = np.flatnonzero(ok)
    step = max(1, min(100_000, PAIR_BYTES // x[0][:1].nbytes)) if len(at) else 1
    for lo in range(0, len(at), step):
        p = at[lo : lo + step]
        a, b = i[p], j[p]
        most = np.bitwise_count(x[0][a] & y[0][b]).sum(1, dtype=np.int64) + np.minimum(x[3][a], y[3][b])
        most = np.minimum(most, np.minimum(x[2][a], y[2][b]))
        ok[p] = 9 * most >= 4 * (x[1][a] + y[1][b])  # overlap >= 0.8 union <=> 9 overlap >= 4 (sum of sizes)
    return ok


def _candidates(x: SignatureTree, y: SignatureTree | None):
    """Dual traversal from the roots down; member pairs that survive, by blocks of the first tree's nodes."""
    other = y or x
    depth = max(len(x.levels), len(other.levels))
    level = lambda t, d: t.levels[min(d, len(t.levels) - 1)]
    stack = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        d, i, j = stack.pop()
        ok = _may_link(level(x, d), level(other, d), i, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if d == 0:
            yield (i[i < j], j[i < j]) if y is None else (i, j)
            continue
        ni, nj = len(level(x, d - 1)[0]), len(level(other, d - 1)[0])
        fi = FANOUT if d < len(x.levels) else 1
        fj = FANOUT if d < len(other.levels) else 1
        step = max(1, 200_000 // (fi * fj))
        for lo in range(0, len(i), step):
            a = (i[lo : lo + step, None] * fi + np.arange(fi)[None]).repeat(fj, 1).reshape(-1)
            b = np.tile(j[lo : lo + step, None] * fj + np.arange(fj)[None], (1, fi)).reshape(-1)
            ok = (a < ni) & (b < nj) & ((a <= b) | (y is not None))
            stack.append((d - 1, a[ok], b[ok]))


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    o = int((both[1:] == both[:-1]).sum())
    return 100 * o >= 80 * (len(s) + len(t) - o)


def _surviving(maps: list[np.ndarray], n: np.ndarray):
    """Pairs of members that no bound excludes, as index arrays. Members meet those of their own bitmap width and of the next,
    folded to their own; sizes under wider bitmaps differ by more than the threshold allows."""
    width = np.array([len(m) for m in maps])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        own = SignatureTree(np.stack([maps[i] for i in at]), n[at])
        for i, j in _candidates(own, None):
            yield at[i], at[j]
        up = np.flatnonzero(width == 2 * w)
        if len(up):
            wide = np.stack([maps[i] for i in up])
            for i, j in _candidates(own, SignatureTree(wide[:, :w] | wide[:, w:], n[up])):
                yield at[i], up[j]


def _connect(pairs, m: int) -> np.ndarray:
    """Labels of ``m`` members, joined along ``pairs``."""
    label = np.arange(m)
    for i, j in pairs:
        open_ = label[i] != label[j]
        for a, b in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            if label[a] != label[b]:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
    return label


def _overlapping(pairs, sets: list[np.ndarray]):
    """The pairs that link: the members of one set are marked, and marks are counted in all sets it is to meet."""
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    ids, mark = np.split(at, np.cumsum(size)[:-1]), np.zeros(len(every), bool)
    for i, j in pairs:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else np.zeros(1, np.int64)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            mark[ids[i[lo]]] = True
            for k in range(lo, hi, 4096):
                js = j[k : min(k + 4096, hi)]
                starts = np.concatenate([[0], np.cumsum(size[js])[:-1]])
                both = np.add.reduceat(mark[np.concatenate([ids[x] for x in js])], starts, dtype=np.int64)
                js = js[100 * both >= 80 * (size[i[lo]] + size[js] - both)]
                if len(js):
                    yield np.full(len(js), i[lo]), js
            mark[ids[i[lo]]] = False


def join_sets(sets: list[np.ndarray], weight: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set a label, equal for sets that links connect, and the summed weight of the sets it links with; with ``part``
    only pairs of different parts are compared. Sets should be ordered so that like ones are near."""
    label, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    if len(sets) < 2:
        return label, links
    pairs = _surviving([bitmap(s) for s in sets], np.array([len(s) for s in sets], np.int64))
    if part is not None:
        pairs = ((i[on], j[on]) for i, j in pairs for on in [part[i] != part[j]])

    def counted():
        for i, j in _overlapping(pairs, sets):
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            yield i, j

    return _connect(counted(), len(sets)), links


def _edges(nodes: np.ndarray, label: np.ndarray):
    """From each node to the first of its label."""
    on = np.flatnonzero(label != np.arange(len(label)))
    if len(on):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[label[on]])], names=["a", "b"])


def _by_group(n_keys: int, work):
    """Streams rows sorted by their first ``n_keys`` columns, a group at a time."""

    def run(batches):
        now, rows = None, []
        for b in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:n_keys] != now:
                    if len(rows) > 1:
                        yield from work(rows)
                    now, rows = r[:n_keys], []
                rows.append(r[n_keys:])
        if len(rows) > 1:
            yield from work(rows)

    return run


def _prune(rows):
    """(node, n, sig) of a group -> edges along pairs that may link."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    maps, n = [np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[1] for r in rows], np.int64)
    yield from _edges(np.array([r[0] for r in rows], np.int64), _connect(_surviving(maps, n), len(rows)))


def _verify(rows):
    """(inner, part, node, copies, s) of a block or of two of its parts -> edges (a, b) along verified links, and the links of nodes (a, links)."""
    each = {node: (part, copies, np.frombuffer(s, np.uint64)) for _, part, node, copies, s in rows}
    nodes = sorted(each, key=lambda k: (int(each[k][2][0]), k))  # like sets have like least shingles
    part, copies = (np.array([each[k][c] for k in nodes], np.int64) for c in (0, 1))
    label, links = join_sets([each[k][2] for k in nodes], copies, None if rows[0][0] else part)
    a = np.array(nodes, np.int64)
    on, some = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(links)
    if len(some):
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a[on]), pa.array(a[label[on]]), none(len(on))], names=["a", "b", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(a[some]), none(len(some)), pa.array(links[some])], names=["a", "b", "links"])


def _sets(batches):
    """(grp, parts, node, copies, text) -> (grp, parts, node, copies, s); a text of another node (repeated ids) is left out."""
    for b in (part for whole in batches for part in slices(whole, 4)):
        out = [(*x, s.tobytes()) for *x, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if len(s := shingles(t)) and set_id(s) == x[2]]
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.binary()), strict=True)], names=["grp", "parts", "node", "copies", "s"])


def row_key(key: str, text: str):
    """Names a row by its id and text; rows that agree in both are repeats."""
    return F.xxhash64(F.col(key).cast("bigint"), F.col(text))


def _frequent(base: DataFrame, n_docs: int) -> DataFrame:
    """(rk, c): frequent shingles with their counts. At most 2 * mean set size / FREQUENT pass the first bar; it is raised while more
    than MOST_FREQUENT do, which changes the order of shingles in a prefix, not the links."""
    bar = max(LEAST_FREQUENT, FREQUENT / 2 * n_docs)
    often = materialise(base.where("count IS NOT NULL").groupBy("rk").agg(F.sum("count").alias("c")).where(F.col("c") >= bar))
    while often.where(F.col("c") >= bar).count() > MOST_FREQUENT:
        bar *= 2
    return often.where(F.col("c") >= bar)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", part: int = PART, block_part: int = BLOCK_PART) -> DataFrame:
    """(doc_id, n_shingles, component_id), ``class_key``, which names the class also where ids are null, ``row_key`` and ``n_links``.

    Tables that are joined by a key some rows share (a set with many copies, a class, a large block) are written first and hold
    that key once, so that both sides of the join are plain shuffles and a hot key is split by the adaptive skew join.
    """
    spark = docs.sparkSession
    ship_code(spark)
    source = docs.select(row_key(key, text).alias("rk"), F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    base = materialise(source.mapInArrow(_describe, "rk bigint, doc_id bigint, n bigint, node bigint, count bigint, sig binary"))
    each = base.where("count IS NULL").select("rk", "doc_id", "n", "node")
    one = materialise(each.where("node IS NOT NULL").groupBy("node").agg(F.min("rk").alias("rk"), F.count("*").alias("copies"), F.min("doc_id").alias("least")))
    often = _frequent(base, one.agg(F.sum("copies")).first()[0] or 0).toPandas().sort_values(["c", "rk"])
    h, rank, count = often["rk"].to_numpy(np.int64).view(np.uint64), np.arange(len(often)), often["c"].to_numpy(np.int64)
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((h[order], rank[order], count[order]))

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posts = source.select("text").mapInArrow(_postings(shared, 4 * n_parts, part), _BLOB)
    groups = posts.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(part), "grp bigint, members binary").dropDuplicates(["grp"])
    signed = base.where("node IS NOT NULL").select("node", "n", "sig").dropDuplicates(["node"])
    met = groups.mapInArrow(_members, "grp bigint, node bigint").join(signed, "node").select("grp", "node", "n", "sig")
    may = met.repartition(n_parts, "grp").sortWithinPartitions("grp").mapInArrow(_by_group(1, _prune), "a bigint, b bigint")
    blocks = connected_components(may)

    large = materialise(blocks.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block_part).select("label", F.ceil(F.col("m") / block_part).cast("bigint").alias("parts")))
    member = blocks.join(large, "label", "left").select(F.col("label").alias("grp"), F.coalesce("parts", F.lit(1).cast("bigint")).alias("parts"), "node")
    wanted = member.join(one.select("node", "rk", "copies"), "node")
    blob = "grp bigint, parts bigint, node bigint, copies bigint, s binary"
    sets = source.select("rk", "text").join(wanted, "rk").select("grp", "parts", "node", "copies", "text").mapInArrow(_sets, blob)
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
    dealt = sets.select("grp", "parts", "node", "copies", "s", mine).select(
        "grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"), "part", "node", "copies", "s"
    ).select("grp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") == F.col("other")).alias("inner"), "part", "node", "copies", "s")
    found = materialise(dealt.repartition(n_parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(_by_group(3, _verify), "a bigint, b bigint, links bigint"))
    classes = connected_components(found)
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))

    named = materialise(
        one.join(classes, "node", "left").join(links, "node", "left")
        .select("node", "least", F.coalesce("label", "node").alias("class_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    firsts = materialise(named.groupBy("class_key").agg(F.min("least").alias("component_id")))
    facts = materialise(named.join(firsts, "class_key").select("node", "class_key", "component_id", "n_links"))
    own = F.col("rk").alias("row_key")
    alone = each.where("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("class_key"), own, F.lit(0).cast("bigint").alias("n_links"))
    return each.where("node IS NOT NULL").join(facts, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_key", own, "n_links").unionByName(alone)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), o AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), r(x, y) AS (
  SELECT rid, rid FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(v.doc_id) AS component_id, (SELECT count(*) FROM e WHERE e.x = w.rid)::BIGINT AS n_links
FROM w JOIN r ON r.x = w.rid JOIN w v ON v.rid = r.y LEFT JOIN n ON n.rid = w.rid
GROUP BY w.rid, w.doc_id
"""
