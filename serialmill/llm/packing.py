"""Best-fit packing of documents into training sequences, with conflicts.

A bin has a capacity in words and may hold at most one piece of a source and at most one piece of a
duplicate cluster. Documents longer than a bin are cut into full bins and a rest. Pieces are dealt to
packing groups of bounded size by a hash of their row and piece number, so a source or cluster with
a third of all rows is spread over all groups, and each group is packed by itself: longest piece first,
bins ordered by what room they have left, each with a bitmap of its sources and one of its clusters. The
search starts at the smallest room that fits and goes from successor to successor until a bin without a
conflict is found, which is the tightest compatible one; if there is none, a bin is opened.

Defined results: null and empty texts have no words and go nowhere (no row); null sources and null
clusters conflict with nothing; repeated rows are pieces of their own; pieces of equal length are taken by
id, then place, then cluster; very long texts are cut, never shortened; only the named columns are read,
whatever others are called; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialmill.llm.common import ship_code, words

CAPACITY = 2048
GROUP = 2048

SCHEMA = "doc_id bigint, piece int, start int, n_words int, bin string, position int, room int"


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each piece, and each bin's room left. Pieces come longest first."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    rooms: list[tuple[int, int]] = []  # (room, bin) in order
    has_source: list[int] = []
    has_cluster: list[int] = []
    bins, room = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        sb, cb = source_bit.get(s, 0), cluster_bit.get(c, 0)
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (has_source[rooms[at][1]] & sb or has_cluster[rooms[at][1]] & cb):
            at += 1
        if at < len(rooms):
            b = rooms.pop(at)[1]
        else:
            b = len(room)
            room.append(capacity)
            has_source.append(0)
            has_cluster.append(0)
        room[b] -= size
        has_source[b] |= sb
        has_cluster[b] |= cb
        if room[b]:
            insort(rooms, (room[b], b))
        bins.append(b)
    return bins, room


def _pack_group(capacity: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable")
        plain = lambda c: [None if pd.isna(x) else x for x in pdf[c]]
        bins, room = pack(pdf["n_words"].tolist(), plain("source"), plain("cluster"), capacity)
        out = pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "n_words": pdf["n_words"], "bin": [f"{key[0]}-{b}" for b in bins], "room": [room[b] for b in bins]})
        out["position"] = out.groupby("bin").cumcount()
        return out[["doc_id", "piece", "start", "n_words", "bin", "position", "room"]]

    return run


def cluster_of(text: Column) -> Column:
    """Texts with the same words share a cluster."""
    return F.xxhash64(F.lower(F.array_join(words(text), " ")))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """A row for each piece: its words (start, n_words), its bin, its position there and the room that the bin has left."""
    ship_code(docs.sparkSession)
    sized = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"),
        (cluster_of(F.col(text)) if cluster is None else cluster).cast("string").alias("cluster"), F.size(words(F.col(text))).alias("total"), F.monotonically_increasing_id().alias("row"),
    ).where("total > 0")
    pieces = sized.select("row", "doc_id", "source", "cluster", F.posexplode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(capacity))).alias("piece", "start"), "total")
    pieces = pieces.select("row", "doc_id", "source", "cluster", "piece", "start", F.least(F.lit(capacity), F.col("total") - F.col("start")).alias("n_words"))
    full = pieces.where(F.col("n_words") == capacity)  # these fill a bin each
    alone = full.select("doc_id", "piece", "start", "n_words", F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("piece").cast("string")).alias("bin"), F.lit(0).alias("position"), F.lit(0).alias("room"))
    rest = pieces.where(F.col("n_words") < capacity)
    groups = max(1, -(-docs.count() // group))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)))
    packed = dealt.groupBy("g").applyInPandas(_pack_group(capacity), SCHEMA)
    return alone.unionByName(packed)
