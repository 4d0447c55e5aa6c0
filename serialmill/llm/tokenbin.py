"""Token ids in a compact binary format: static range asymmetric numeral system (rANS).

Texts are encoded where they lie and counted; one frequency table over all ids is shared by every block.
Documents are then dealt by ranges of their id, so files follow each other in ascending order, and each
file's ids are cut into blocks that are decoded independently. A block interleaves many lanes (symbol k
belongs to lane k mod lanes), so a whole row of lanes is coded by one vector operation. Every block has
checksums of its ids and of its payload, and a checkpoint (lane states and word offset) for every
CHECKPOINT_IDS ids, from which ``fetch`` decodes a range of documents without what stands before.

The container is Parquet, written and read by Spark alone: ``table`` (the frequencies) and ``blocks``. A task
holds one block at a time. Documents may be longer than a block's target; a block then holds one document.
Defined results: a null text is encoded as the empty text and holds the end id alone; repeated ids keep one
entry for each row, ordered by the text's hash, and equal rows are equal entries; null ids come first; only
the id and the text are read, whatever other columns are named; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialmill.llm.bpe import PieceMemo, byte_alphabet, read_spec
from serialmill.llm.common import materialise, ship_code, work_dir

SCALE = 20  # frequencies add up to 2**SCALE
LOW = np.uint64(1 << 31)
BLOCK_IDS = 1 << 20
LANES = 2048
CHECKPOINT_IDS = 1 << 18
END_ID = 2

TABLE_SCHEMA = "freqs binary"
BLOCK_SCHEMA = (
    "file int, block int, first_doc bigint, last_doc bigint, doc_ids array<bigint>, lengths array<int>, n_ids bigint, lanes int, "
    "states binary, checkpoints array<struct<step:int,word:bigint,states:binary>>, payload binary, "
    "payload_crc32 bigint, ids_crc32 bigint, before bigint"
)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Counts -> frequencies of at least 1 for every id that occurs, adding up to 2**SCALE."""
    total, whole = int(counts.sum()), 1 << SCALE
    if total == 0:
        return counts.astype(np.int64)
    f = np.where(counts > 0, np.maximum(1, counts * whole // total), 0).astype(np.int64)
    over = int(f.sum()) - whole
    if over < 0:
        f[f.argmax()] -= over
    while over > 0:  # taken from the largest, which lose least
        big = np.argsort(-f, kind="stable")[: max(1, (f > 1).sum() // 4)]
        cut = np.minimum(f[big] - 1, max(1, over // len(big)))
        cut = np.where(np.cumsum(cut) <= over, cut, 0)
        f[big] -= cut
        over -= int(cut.sum())
    return f


def encode_block(ids: np.ndarray, freqs: np.ndarray, lanes: int = LANES, checkpoint_ids: int = CHECKPOINT_IDS) -> dict:
    n = len(ids)
    lanes = int(max(1, min(lanes, n // 128)))
    every = max(1, checkpoint_ids // lanes)
    steps = -(-n // lanes)
    start = (np.cumsum(freqs) - freqs).astype(np.uint64)
    f64 = freqs.astype(np.uint64)
    x = np.full(lanes, LOW, np.uint64)
    out: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    words, s32, scale = 0, np.uint64(32), np.uint64(SCALE)
    limit = f64 << np.uint64(63 - SCALE)
    for k in range(steps - 1, -1, -1):  # the last symbol goes in first, so that decoding runs forwards
        sym = ids[k * lanes : (k + 1) * lanes]
        m = len(sym)
        f, v = f64[sym], x[:m]
        full = v >= limit[sym]
        if full.any():
            out.append(v[full].astype(np.uint32))
            words += len(out[-1])
            v = np.where(full, v >> s32, v)
        q = v // f
        x[:m] = (q << scale) + (v - q * f) + start[sym]
        if k and k % every == 0:
            marks.append((k, words, x.tobytes()))
    payload = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return {
        "lanes": lanes, "states": x.tobytes(), "payload": payload.tobytes(),
        "checkpoints": [{"step": k, "word": words - w, "states": s} for k, w, s in reversed(marks)],
    }


def slots(freqs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(freqs), dtype=np.uint16 if len(freqs) <= 1 << 16 else np.uint32), freqs)  # small enough for the cache


def decode_block(payload: bytes, states: bytes, n: int, freqs: np.ndarray, slot_ids: np.ndarray, lanes: int, step: int = 0, word: int = 0, until: int | None = None) -> np.ndarray:
    """Ids from ``step`` on; with a checkpoint's step, word and states, from the middle of the block."""
    words = np.frombuffer(payload, np.uint32)
    start, f64 = (np.cumsum(freqs) - freqs).astype(np.uint64), freqs.astype(np.uint64)
    x = np.frombuffer(states, np.uint64).copy()
    steps = -(-n // lanes)
    until = steps if until is None else min(until, steps)
    out = np.empty(max(0, min(n, until * lanes) - step * lanes), np.int64)
    mask, scale, s32 = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for k in range(step, until):
        m = min(lanes, n - k * lanes)
        v = x[:m]
        slot = v & mask
        sym = slot_ids[slot]
        v = f64[sym] * (v >> scale) + slot - start[sym]
        low = v < LOW
        if low.any():
            got = int(low.sum())
            v[low] = (v[low] << s32) | words[word : word + got].astype(np.uint64)
            word += got
        x[:m] = v
        out[(k - step) * lanes : (k - step) * lanes + m] = sym
    return out


_coders: dict[int, PieceMemo] = {}


def library_coder(spec: str) -> PieceMemo:
    """The tokenizers library behind a memo of pieces, one for each worker process."""
    key = hash(spec)
    if key not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tk = Tokenizer.from_str(spec)
        tk.no_truncation()
        tk.no_padding()
        dtype = np.uint16 if tk.get_vocab_size() <= 1 << 16 else np.uint32
        special = {t.content: i for i, t in tk.get_added_tokens_decoder().items() if t.special}
        space = next(c for c, b in byte_alphabet().items() if b == 32)
        starts = np.zeros(tk.get_vocab_size(), bool)
        starts[[i for t, i in tk.get_vocab().items() if t[0] == space]] = True
        own = any(" " in s for s in special)

        def apart(parts):
            each = [e.ids for e in tk.encode_batch_fast(parts, add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], dtype), np.array([len(ids) for ids in each], np.int64)

        def run(parts, spaced):
            """One call for many words after spaces: each begins with the one token that holds its space."""
            if not spaced or own:
                return apart(parts)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for lo in range(0, len(parts), 128):
                some = parts[lo : lo + 128]
                ids = np.array(tk.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype)
                first = np.flatnonzero(starts[ids])
                out.append((ids, np.diff(first, append=len(ids))) if len(first) == len(some) else apart(some))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))

        _coders.clear()
        _coders[key] = PieceMemo(run, special, dtype, most=900_000)
        _coders[key].vocab_size = tk.get_vocab_size()
    return _coders[key]


_CODED = "k bigint, tie bigint, ids binary, counts array<bigint>"
_CODED_ARROW = pa.schema([("k", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary()), ("counts", pa.list_(pa.int64()))])
_BLOCK_ARROW = pa.schema([
    ("file", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int64()),
    ("lanes", pa.int32()), ("states", pa.binary()), ("checkpoints", pa.list_(pa.struct([("step", pa.int32()), ("word", pa.int64()), ("states", pa.binary())]))),
    ("payload", pa.binary()), ("payload_crc32", pa.int64()), ("ids_crc32", pa.int64()), ("before", pa.int64()),
])


def _code(spec, end_id: int):
    """(k, tie, text) -> the ids of each text with the end id (little-endian, 4 bytes each if the vocabulary needs it, else 2), then one row of counts for the task."""

    def run(batches):
        coder = library_coder(spec.value)
        counts = np.zeros(max(coder.vocab_size, end_id + 1), np.int64)
        width = np.dtype(coder.dtype).itemsize
        for b in batches:
            at = 0
            for ids, lengths in coder.encode(b.column(2).to_pylist()):
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                counts += np.bincount(ids, minlength=len(counts))
                edge = np.concatenate([[0], np.cumsum(lengths + 1)]) * width
                n = len(lengths)
                held = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), b.column(1).slice(at, n), held, pa.nulls(n, pa.list_(pa.int64()))], schema=_CODED_ARROW)
                at += n
        if counts.any():
            yield pa.RecordBatch.from_pylist([{"counts": counts}], schema=_CODED_ARROW)

    return run


def _lay_out(shared, dtype):
    """Coded documents in order -> blocks of about BLOCK_IDS ids; one block is held at a time."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        freqs, file, block, before = shared.value, TaskContext.get().partitionId(), 0, 0
        keys: list = []
        parts: list[bytes] = []
        held = 0

        def flush():
            ids = np.frombuffer(b"".join(parts), dtype).astype(np.int64)
            known = [k for k in keys if k is not None]
            row = encode_block(ids, freqs) | {
                "file": file, "block": block, "doc_ids": keys, "lengths": [len(p) // width for p in parts], "n_ids": len(ids),
                "first_doc": min(known, default=None), "last_doc": max(known, default=None), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "before": before,
            }
            row["payload_crc32"] = zlib.crc32(row["payload"])
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(p) // width
                if keys and held + n > BLOCK_IDS:
                    yield flush()
                    block, before = block + 1, before + held
                    keys, parts, held = [], [], 0
                keys.append(k)
                parts.append(p)
                held += n
        if keys:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text and write the blocks in ascending order of ``key``."""
    spark = docs.sparkSession
    ship_code(spark)
    tokens = read_spec(tokenizer)
    spec = spark.sparkContext.broadcast(tokens)  # a file of fixed size
    size = max(library_coder(tokens).vocab_size, end_id + 1)
    coded = materialise(docs.select(F.col(key).cast("bigint").alias("k"), F.xxhash64(text).alias("tie"), F.col(text).alias("t")).mapInArrow(_code(spec, end_id), _CODED), "zstd")
    sums = coded.where("counts IS NOT NULL").select(F.posexplode("counts").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for r in sums.collect():  # a row for each id of the vocabulary
        counts[r["id"]] = r["n"]
    freqs = quantise(counts)
    spark.createDataFrame([(bytearray(zlib.compress(freqs.astype(np.int32).tobytes())),)], TABLE_SCHEMA).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freqs)  # as many numbers as the vocabulary has ids
    ranged = coded.where("ids IS NOT NULL").select("k", "tie", "ids").repartitionByRange("k", "tie").sortWithinPartitions("k", "tie")
    blocks = ranged.select("k", "ids").mapInArrow(_lay_out(shared, library_coder(tokens).dtype), BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _open(spark: SparkSession, path: str):
    """The blocks, and broadcasts of the shared table and of the number of ids before each file (as many as files)."""
    ship_code(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    freqs = np.frombuffer(zlib.decompress(spark.read.schema(TABLE_SCHEMA).parquet(f"{path}/table").first()["freqs"]), np.int32).astype(np.int64)
    first, at = {}, 0
    for r in sorted(blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["file"]):
        first[r["file"]] = at
        at += r["n"]
    return blocks, spark.sparkContext.broadcast((freqs, first))


def _documents(ids: np.ndarray, keys, lengths: np.ndarray, begins: np.ndarray, origin: int, digest_only: bool):
    """A row for each document whose ids start at ``begins`` in ``ids``; ``origin`` is the place of the first of them in the whole."""
    each = [ids[s : s + n] for s, n in zip(begins, lengths, strict=True)]
    out = [pa.array(keys, pa.int64()), pa.array(begins + origin, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if not digest_only:
        out.append(pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(out, names=names)


def _result(digest_only: bool) -> str:
    return "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ("" if digest_only else ", ids array<int>")


def _checked(r: dict) -> bytes:
    if zlib.crc32(r["payload"]) != r["payload_crc32"]:
        raise ValueError(f"file {r['file']}, block {r['block']}: payload checksum differs")
    return r["payload"]


def read(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """Decode the blocks: doc_id, start, n_tokens, ids_crc32 and, unless ``digest_only``, ids. A damaged block raises."""
    blocks, shared = _open(spark, path)

    def run(batches):
        freqs, first = shared.value
        slot_ids = slots(freqs)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids = decode_block(_checked(r), r["states"], r["n_ids"], freqs, slot_ids, r["lanes"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["ids_crc32"]:
                    raise ValueError(f"file {r['file']}, block {r['block']}: ids checksum differs")
                lengths = np.array(r["lengths"], np.int64)
                yield _documents(ids, r["doc_ids"], lengths, np.cumsum(lengths) - lengths, first[r["file"]] + r["before"], digest_only)

    cols = ["file", "block", "doc_ids", "lengths", "n_ids", "lanes", "states", "payload", "payload_crc32", "ids_crc32", "before"]
    return blocks.select(*cols).mapInArrow(run, _result(digest_only))


def fetch(spark: SparkSession, path: str, least: int, most: int) -> DataFrame:
    """The rows of ``read`` for documents with ids from ``least`` to ``most``. Other blocks are skipped by their id ranges, and a block
    is decoded from the last checkpoint before the first such document to the end of the last one."""
    blocks, shared = _open(spark, path)

    def run(batches):
        freqs, first = shared.value
        slot_ids = slots(freqs)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                on = [j for j, k in enumerate(r["doc_ids"]) if k is not None and least <= k <= most]
                if not on:
                    continue
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                begins, lanes = (ends - lengths)[on], r["lanes"]
                past = [c for c in r["checkpoints"] if c["step"] * lanes <= begins[0]]
                from_ = past[-1] if past else {"step": 0, "word": 0, "states": r["states"]}
                until = -(-int(ends[on[-1]]) // lanes)
                ids = decode_block(_checked(r), from_["states"], r["n_ids"], freqs, slot_ids, lanes, from_["step"], from_["word"], until).astype("<u4")
                skipped = from_["step"] * lanes
                yield _documents(ids, [r["doc_ids"][j] for j in on], lengths[on], begins - skipped, first[r["file"]] + r["before"] + skipped, False)

    cols = ["file", "block", "doc_ids", "lengths", "n_ids", "lanes", "states", "checkpoints", "payload", "payload_crc32", "before"]
    return blocks.where((F.col("last_doc") >= least) & (F.col("first_doc") <= most)).select(*cols).mapInArrow(run, _result(False))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = work_dir(docs.sparkSession)
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path, digest_only=True)
