import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from serialmill.llm import resample
from tests.llm.helpers import docs, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(rows, target):
    """The contract, step by step: {row number: (n_features, weight, score, rank)}."""
    source, aim = (Counter(bucket(f) for t in texts for f in features(t)[1]) for texts in ([r[1] for r in rows], target))
    s_all, t_all = sum(source.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out, able = {}, []
    for k, (i, t) in enumerate(rows):
        n, fs = features(t)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[k] = (len(fs), weight, score, None)
        if n >= 20:
            able.append((-score, i is None, i or 0, k))
    for rank, (*_, k) in enumerate(sorted(able)[: 5 * len(able) // 100], 1):
        out[k] = (*out[k][:3], rank)
    return out


ODD = [None, "", "   ", "A b-C, d'e 12ab\x7fÉé", "日本語 текст \U0001f642", "x" * 5000 + " y " + "z" * 70, "a\nb\tc", "one", "one two", "Ab AB ab aB " * 20]


def corpus():
    rng = random.Random(3)
    aim = [sentence(1000 + i, 40) for i in range(10)] + [None, ""]
    near = aim[0].split() + aim[1].split()
    rows = [(i * 7 % 400, sentence(i % 150, rng.randint(1, 90), near if i % 9 == 0 else None)) for i in range(400)]
    return rows + [(500 + i, t) for i, t in enumerate(ODD)], aim


def test_query_matches_brute_force(spark):
    rows, aim = corpus()
    want = brute(rows, aim)
    assert sum(w[3] is not None for w in want.values()) > 10
    target = spark.createDataFrame([(i, t) for i, t in enumerate(aim)], "item_id bigint, text string")
    got = resample.resample(docs(spark, rows).repartition(5), target).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {rows[k][0]: w for k, w in want.items()}
    assert len(got) == len(rows)


def test_continued_crc():
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 63, 64, 65, 1000, 70_001):
        a, b = rng.bytes(9), rng.bytes(size)
        got = resample.continued(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([size]))
        assert got[0] == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [2, 3, 1 << 19])
def test_any_head_gives_the_same_buckets(monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    texts = [t for _, t in corpus()[0][:60]] + ODD
    want = Counter(bucket(f) for t in texts for f in features(t)[1])
    words = resample.Words(pa.array(texts, pa.string()))
    assert [w.decode() for w in words.names] == list(dict.fromkeys(w for t in texts for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))))
    common = [w for w, _ in Counter(words.names[c] for c in words.code).most_common(40)]
    pairs = [(a, b) for a in common[:9] for b in common[:9]]
    for head in (resample.Head([], []), resample.Head(common, []), resample.Head(common, pairs)):
        got = Counter()
        for _, one, two, three in head.features(words):
            got.update([*one.tolist(), *two[1].tolist(), *three[1].tolist()])
        assert got == want


def test_head_holds_all_that_is_frequent(spark):
    rows = [(i, "the cat " * 30 + sentence(i, 30)) for i in range(40)]
    head = resample.head(docs(spark, rows))
    a, b = head.words[b"the"], head.words[b"cat"]
    assert a << 16 | b in head.pair_key and b << 16 | a in head.pair_key


def test_repeats_ties_empty_and_clashing(spark):
    text = sentence(5, 60)
    rows = [(7, text, 1, 2, 3)] * 60 + [(None, text, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rank int, score int, _range int")
    target = spark.createDataFrame([(1, "a b", 4)], "item_id bigint, text string, n_words int")
    got = resample.resample(df, target).collect()
    assert len(got) == 61 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    none = docs(spark, [])
    assert resample.resample(none, target).count() == 0
    assert resample.resample(docs(spark, [(1, "a b c")]), none).collect()[0]["n_features"] == 6
