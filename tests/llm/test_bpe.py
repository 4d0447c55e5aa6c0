import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from serialmill.llm import bpe, tokenbin
from serialmill.llm.queries import byte_bpe_path
from tests.llm.helpers import docs, sentence

tokenizers = pytest.importorskip("tokenizers")

ODD = [
    None, "", " ", "  a  b \n c\n\n  d \t e ", "a\n \nb", "it's 'S don't  'll", "<|endoftext|>x <|endoftext|> y", "x" * 3000, "ab" * 2000, "12 345٣ ½²x",
    "日本語 текст \U0001f642\U0001f642", "\x1c a \x1d", sentence(1, 2000),
]


@pytest.fixture(scope="module")
def lib():
    return tokenizers.Tokenizer.from_file(byte_bpe_path())


def test_encoder_matches_library(lib):
    rng = random.Random(4)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(" \n\t'sS.e!1é 日x") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    enc = bpe.Encoder(bpe.Vocabulary(bpe.read_spec(byte_bpe_path())))
    for t, got in zip(texts, enc.encode(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want, t
        assert enc.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_fragments_are_certain_cuts():
    v = bpe.Vocabulary(bpe.read_spec(byte_bpe_path()))
    assert not any(not v.inside_pairs[a << 8 | b] for t in list(v.ids)[:5000] for a, b in zip(t, t[1:]))  # noqa: B905


def test_round_trip_query(spark, lib):
    rows = bpe.round_trip(docs(spark, list(enumerate(ODD))).select("doc_id", "text"), byte_bpe_path()).collect()
    for r in rows:
        t = ODD[r["doc_id"]] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest())
    coded = bpe.encode(docs(spark, [(1, "a b"), (2, None)]).select("doc_id", "text"), byte_bpe_path())
    assert [r["decoded"] for r in bpe.decode(coded, byte_bpe_path()).orderBy("doc_id").collect()] == ["a b", ""]
    assert bpe.round_trip(docs(spark, []).select("doc_id", "text"), byte_bpe_path()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 4000, 300_001])
def test_rans_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 5000).astype(np.int64)
    freqs = tokenbin.quantise(np.bincount(ids, minlength=5001))
    assert n == 0 or freqs.sum() == 1 << tokenbin.SCALE
    b = tokenbin.encode_block(ids, freqs, lanes=64, checkpoint_ids=1024)
    slots = tokenbin.slots(freqs)
    assert (tokenbin.decode_block(b["payload"], b["states"], n, freqs, slots, b["lanes"]) == ids).all()
    for c in b["checkpoints"][:3]:  # from the middle, as parallel readers do
        part = tokenbin.decode_block(b["payload"], c["states"], n, freqs, slots, b["lanes"], c["step"], c["word"], c["step"] + 2)
        lo = c["step"] * b["lanes"]
        assert (part == ids[lo : lo + len(part)]).all() and len(part)


def test_token_files(spark, lib):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(0, "again"), (None, "no id")]
    df = docs(spark, rows).select("doc_id", "text")
    got = sorted(tokenbin.round_trip(df, byte_bpe_path()).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    at, left = 0, {i: sorted(zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in rows if k == i) for i, _ in rows}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        left[r["doc_id"]].remove(r["ids_crc32"])
    assert not any(left.values())
    assert tokenbin.round_trip(docs(spark, []).select("doc_id", "text"), byte_bpe_path()).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    tokenbin.write(docs(spark, [(1, sentence(2, 500))]).select("doc_id", "text"), str(tmp_path / "a"), byte_bpe_path())
    spark.read.parquet(str(tmp_path / "a" / "table")).write.parquet(str(tmp_path / "b" / "table"))
    blocks = spark.read.schema(tokenbin.BLOCK_SCHEMA).parquet(str(tmp_path / "a" / "blocks"))
    blocks.withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(str(tmp_path / "b" / "blocks"))
    with pytest.raises(Exception, match="checksum"):
        tokenbin.read(spark, str(tmp_path / "b")).collect()


def test_ranges_are_read_from_checkpoints(spark, tmp_path, monkeypatch):
    """A range of documents equals the same rows of the whole; the last ones of a long block start at a checkpoint."""
    spec = bpe.read_spec(byte_bpe_path())
    coder = tokenbin.library_coder(spec)
    ids, lengths = next(coder.encode([sentence(i, 900) for i in range(40)]))
    freqs = tokenbin.quantise(np.bincount(ids.astype(np.int64), minlength=coder.vocab_size))
    block = tokenbin.encode_block(ids.astype(np.int64), freqs, checkpoint_ids=1 << 14)
    assert len(block["checkpoints"]) >= 2 and len(ids) == lengths.sum()
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, sentence(i, 50 + i), "t", i) for i in range(30)] + [(31, None, "t", 0)], "doc_id bigint, text string, ids string, k int")
    tokenbin.write(df, path, byte_bpe_path())
    every = {r["doc_id"]: r for r in tokenbin.read(spark, path).collect()}
    got = tokenbin.fetch(spark, path, 20, 31).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(20, 30), 31] and all(r == every[r["doc_id"]] for r in got)


def test_memo_survives_its_limit(lib):
    """The memo is emptied between batches, and texts with odd spaces and long words stand beside plain ones."""
    coder = bpe.Encoder(bpe.Vocabulary(bpe.read_spec(byte_bpe_path())))
    coder.memo.most, coder.memo.batch_chars = 50, 300
    texts = [f"{sentence(i, 30)},{'  ' * (i % 2)} w{'y' * (70 * (i % 3))}. <|endoftext|>{i}" if i % 5 else sentence(i, 20) for i in range(60)]
    for t, got in zip(texts, coder.encode(texts), strict=True):
        assert got.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_clashing_columns(spark):
    """Columns named like a result are replaced by it, others are kept or not read; repeated rows give a row each."""
    df = spark.createDataFrame([(1, "a b", "x", 7, "y")] * 2, "doc_id bigint, text string, n_tokens string, ids int, file string")
    rows = bpe.round_trip(df, byte_bpe_path()).collect()
    assert [(r["n_tokens"], r["ids"], r["file"]) for r in rows] == [(2, 7, "y")] * 2
    got = tokenbin.round_trip(df, byte_bpe_path()).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in got) == [(1, 0, 3), (1, 3, 3)]
