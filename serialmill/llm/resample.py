"""Importance resampling towards a target distribution, over hashed runs of words.

Features are all runs of 1 to 3 consecutive words; the bucket of a feature is the CRC-32 of its UTF-8 bytes modulo
BUCKETS. Three passes read the texts:

1. the head of the vocabulary: the most frequent words and pairs. A slice of texts reports only words and pairs that make
   up at least 1/HEAD_WORDS or 1/HEAD_PAIRS of it, so few rows are shuffled, and whatever has that share of all
   texts is reported by some slice. The head only saves work: any head gives the same result.
2. exact totals of all buckets, of the documents and of the target. The broadcast head holds the CRC state of each of its
   words and the state and bucket of each of its pairs. Tail words take their CRC from their bytes, and tail pairs and all
   triples continue a state (appending bytes of a known CRC is linear, so whole batches are continued by table lookups).
3. the weight of each document under the gains of the buckets.

The draw takes the highest scores: rows are dealt by ranges of score, numbered inside a range, and moved by the
counts of the ranges before it. Only bounded tables reach the driver: the head, the buckets, the counts of ranges.

Defined results: null and the empty text have no words, weight 0 and are never drawn; a null id scores as the empty
string would and comes last among ties; rows that agree in id and score are drawn in order of their features and weight;
very long texts are counted in blocks; an empty table gives no rows; an empty target has only zero counts; other columns are not carried on.
"""

from __future__ import annotations

import math
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialmill.llm.common import materialise, ship_code, slices

BUCKETS = 10_000
#: Greatest numbers of words and pairs in the head, and the longest word in it, in bytes.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 1 << 14, 1 << 16, 64
#: Documents of fewer words are not drawn; the share that is, in percent.
LEAST_WORDS, PERCENT = 20, 5
#: Words whose features are computed at once.
BLOCK = 1 << 19
_SLOTS = 1 << 18

#: What each byte is read as: A-Z in lower case, and a space for all ASCII characters but letters and digits.
READ_AS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables that move a CRC over zero bytes, a row for each of its bytes: over 0 to 64 bytes, and over 2^k bytes."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    near = np.zeros((65, 4, 256), np.uint32)
    near[0] = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
    for k in range(1, 65):
        near[k] = step[near[k - 1] & 255] ^ (near[k - 1] >> 8)
    far = np.zeros((31, 4, 256), np.uint32)
    far[0] = near[1]
    for k in range(1, 31):
        far[k] = _moved(far[k - 1], far[k - 1])
    return near, far


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


NEAR, FAR = _shifts()


def continued(crc: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC of a text of CRC ``crc`` followed by one of CRC ``other`` and ``size`` bytes, element by element."""
    short = np.minimum(size, 64)
    out = NEAR[short, 0, crc & 255] ^ NEAR[short, 1, crc >> 8 & 255] ^ NEAR[short, 2, crc >> 16 & 255] ^ NEAR[short, 3, crc >> 24]
    long = np.flatnonzero(size > 64)
    if len(long):
        left, moved = size[long] - 64, out[long]
        for k in range(int(left.max()).bit_length()):
            moved = np.where(left >> k & 1, _moved(FAR[k], moved), moved)
        out[long] = moved
    return out ^ other


class Words:
    """The words of a run of texts: ``names`` (distinct, bytes), ``code`` of each word, ``edge`` of each text's words."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = READ_AS[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]]
        edge = edge - edge[0]
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = raw != 32
        first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
        inner = edge[(edge > 0) & (edge < len(raw))]  # a text's end ends a word
        first[inner] |= word[1:-1][inner]
        last[inner - 1] |= word[1:-1][inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        bounds = np.concatenate([[0], np.cumsum(end - start)])
        compact = raw[word[1:-1]]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(compact)]).dictionary_encode()
        self.names, self.code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.edge = np.searchsorted(start, edge)

    def follows(self) -> np.ndarray:
        """For each word, how many words of its text follow it, 2 at most."""
        out = np.full(len(self.code), 2, np.int8)
        size = np.diff(self.edge)
        out[self.edge[1:][size > 1] - 2] = 1
        out[self.edge[1:][size > 0] - 1] = 0
        return out


class Head:
    """The broadcast head. ``words``: word -> number; ``pairs``: (number, number) -> CRC state and bucket, in a hash table."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.words = {w: i for i, w in enumerate(words)}
        self.state = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.spaced = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        self.pair_key, self.pair_state, self.pair_bucket = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.uint32), np.zeros(_SLOTS, np.int64)
        for a, b in reversed(pairs):  # where two meet in a slot the more frequent stays; the other is computed as the tail is
            key = self.words[a] << 16 | self.words[b]
            at = int(self.slot(np.array([key]))[0])
            crc = zlib.crc32(a + b" " + b)
            self.pair_key[at], self.pair_state[at], self.pair_bucket[at] = key, crc, crc % BUCKETS

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def features(self, words: Words):
        """Block by block: (number of its first word, buckets of words, pairs and triples, how many words follow each)."""
        number = np.array([self.words.get(n, -1) for n in words.names], np.int64)
        state, spaced = np.zeros(len(number), np.uint32), np.zeros(len(number), np.uint32)
        frequent = number >= 0
        state[frequent], spaced[frequent] = self.state[number[frequent]], self.spaced[number[frequent]]
        size = np.array([len(n) + 1 for n in words.names], np.int64)
        for i in np.flatnonzero(~frequent).tolist():
            state[i], spaced[i] = zlib.crc32(words.names[i]), zlib.crc32(b" " + words.names[i])
        follows = words.follows()
        for lo in range(0, len(words.code), BLOCK):
            more = follows[lo : lo + BLOCK]
            code = words.code[lo : lo + BLOCK + 2]
            one = state[code[: len(more)]]
            i = np.flatnonzero(more >= 1)
            a, b = code[i], code[i + 1]
            key = np.where(frequent[a] & frequent[b], number[a] << 16 | number[b], 0)
            at = self.slot(key)
            known = frequent[a] & frequent[b] & (self.pair_key[at] == key)
            two, bucket = self.pair_state[at], self.pair_bucket[at]
            tail = np.flatnonzero(~known)
            two[tail] = continued(one[i[tail]], spaced[b[tail]], size[b[tail]])
            bucket[tail] = two[tail] % BUCKETS
            j = np.flatnonzero(more[i] == 2)
            c = code[i[j] + 2]
            yield lo, one % BUCKETS, (i, bucket), (i[j], continued(two[j], spaced[c], size[c]) % BUCKETS)


def _frequent(words: Words):
    """Words and pairs of a slice that have the share of it that the head asks for, with their counts."""
    n = np.bincount(words.code, minlength=len(words.names)) if len(words.names) else np.zeros(0, np.int64)
    short = np.array([len(x) <= HEAD_BYTES for x in words.names], bool)
    for i in np.flatnonzero((n * HEAD_WORDS >= len(words.code)) & short).tolist():
        yield words.names[i], None, int(n[i])
    often = (n * HEAD_PAIRS >= len(words.code)) & short
    i = np.flatnonzero(words.follows() >= 1)
    a, b = words.code[i].astype(np.int64), words.code[np.minimum(i + 1, max(len(words.code) - 1, 0))].astype(np.int64)
    both = often[a] & often[b]
    key, m = np.unique(a[both] << 32 | b[both], return_counts=True)
    for k, c in zip(key[m * HEAD_PAIRS >= len(i)].tolist(), m[m * HEAD_PAIRS >= len(i)].tolist(), strict=True):
        yield words.names[k >> 32], words.names[k & 0xFFFFFFFF], c


def head(docs: DataFrame, text: str = "text") -> Head:
    """The words and pairs that were counted as often as the shares ask for, so at most HEAD_WORDS and HEAD_PAIRS of them; pairs the most frequent first."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 0)):
            words = Words(b.column(0))
            rows = [*_frequent(words), (None, None, len(words.code))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "n"])

    found = materialise(docs.select(text).mapInArrow(run, "a binary, b binary, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")))
    n = found.where("a IS NULL").agg(F.sum("n")).first()[0] or 0
    words = [bytes(r[0]) for r in found.where(F.col("b").isNull() & F.col("a").isNotNull() & (F.col("n") * HEAD_WORDS >= n)).select("a").collect()]
    known = set(words)
    common = found.where(F.col("b").isNotNull() & (F.col("n") * HEAD_PAIRS >= n))
    pairs = [(bytes(r[0]), bytes(r[1])) for r in common.orderBy(F.desc("n"), "a", "b").select("a", "b").collect()]
    return Head(words, [p for p in pairs if p[0] in known and p[1] in known])


def totals(docs: DataFrame, shared, text: str = "text") -> np.ndarray:
    """The count of every bucket over all texts. ``shared``: the broadcast head. A task reports each bucket once."""

    def run(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in (part for whole in batches for part in slices(whole, 0)):
            for _, one, two, three in shared.value.features(Words(b.column(0))):
                for x in (one, two[1], three[1]):
                    n += np.bincount(x, minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) for each bucket."""
    s_all, t_all = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def chance(key: str) -> int:
    """The Gumbel part of a score: floor(-1000 ln(-ln(u))), u in (0, 1) from the first 32 bits of the key's SHA-256."""
    u = (int(sha256(key.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
    return math.floor(-1000 * math.log(-math.log(u)))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = 42) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(head(docs, text))
    gain = spark.sparkContext.broadcast(gains(totals(docs, shared, text), totals(target, shared, target_text)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 0)):
            words = Words(b.column(0))
            own = np.zeros(len(words.code) + 1, np.int64)
            for lo, one, two, three in shared.value.features(words):
                part = gain.value[one]
                for at, bucket in (two, three):
                    part[at] += gain.value[bucket]
                own[lo + 1 : lo + 1 + len(part)] = part
            weight = np.diff(np.cumsum(own)[words.edge])
            n = np.diff(words.edge)
            drawn = [chance(f"{seed}:{'' if i is None else i}") for i in b.column(1).to_pylist()]
            cols = [n, n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0), weight, weight + np.array(drawn, np.int64)]
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(c, pa.int64()) for c in cols]], names=[id_col, "n_words", "n_features", "weight", "score"])

    return docs.select(text, id_col).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(rows: DataFrame, order: list[Column], most, rank: str = "rank") -> DataFrame:
    """``rows`` numbered from 1 in ``order`` as far as ``most`` (a number, or a function of the number of rows); null beyond it.

    Rows are dealt by ranges of the order and written; the counts of the ranges, one number for each partition, say where a range begins.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    size = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = most(sum(size.values())) if callable(most) else most
    before, begin = 0, {}
    for p in sorted(size):
        begin[p], before = before, before + size[p]
    taken = [p for p in begin if begin[p] < most]
    if not taken:
        return dealt.drop("_range").withColumn(rank, F.lit(None).cast("bigint"))
    starts = F.broadcast(spark.createDataFrame([(p, begin[p]) for p in taken], "_range int, _begin bigint"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_begin")
    first = dealt.where(F.col("_range") <= max(taken)).join(starts, "_range").withColumn(rank, place)
    first = first.withColumn(rank, F.when(F.col(rank) <= most, F.col(rank)).cast("bigint")).drop("_begin")
    return first.unionByName(dealt.where(F.col("_range") > max(taken)).withColumn(rank, F.lit(None).cast("bigint"))).drop("_range")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, seed: int = 42) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    scored = materialise(weigh(docs, target, id_col, text, target_text, seed))
    long_enough = F.col("n_words") >= LEAST_WORDS
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("n_features"), F.asc("weight")]
    drawn = ranked(scored.where(long_enough), order, lambda n: percent * n // 100)
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select(id_col, "n_features", "weight", "score", "rank")


#: The query in SQL, with the CRC written out byte by byte over the distinct features.
ORACLE = rf"""
WITH words AS (
  SELECT src, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT 0 AS src, row_number() OVER () AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
), runs AS (
  SELECT src, id, array_to_string(w[i : i + k - 1], ' ') AS f
  FROM (SELECT src, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) AS t(k))
), counts AS MATERIALIZED (SELECT src, id, f, count(*) AS n FROM runs GROUP BY ALL
), crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b)
), bucketed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM counts), crc
), totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (src = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (src = 1), 0)::BIGINT AS t FROM counts JOIN bucketed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM totals) + {BUCKETS}))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM totals) + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM totals
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counts JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE src = 0 GROUP BY id
), scored AS (
  SELECT id, doc_id, len(w) >= {LEAST_WORDS} AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS id, doc_id FROM documents) JOIN (SELECT id, w FROM words WHERE src = 0) USING (id) LEFT JOIN weights USING (id)
), ordered AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE able
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN ordered USING (id)
"""
