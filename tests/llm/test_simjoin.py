import random

import numpy as np
import pytest

from serialmill.llm import simjoin
from tests.llm.helpers import docs, sentence


def brute(rows):
    """Classes by comparing all pairs of word-shingle sets."""
    sets = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(ids) if ids else None))
    return out


def mutate(text, k, rng):
    ws = text.split()
    for _ in range(k):
        ws[rng.randrange(len(ws))] = "w%d" % rng.randrange(10**6)
    return " ".join(ws)


def cases(seed):
    rng = random.Random(seed)
    passage = sentence(999, 55)
    rows = [(None, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "one two three four five"), (5, "one\ttwo\nthree four  FIVE"), (6, "Été one"), (7, "été one")]
    for f in range(6):
        base = sentence(seed * 100 + f, rng.choice([40, 120, 400]))
        for _ in range(rng.choice([1, 3, 12])):
            rows.append((len(rows) + 10, mutate(base, rng.choice([0, 1, 2, 4]), rng)))
    for f in range(30):  # unlike documents that share a passage
        rows.append((len(rows) + 10, sentence(5000 + f, 60) + " " + passage + " " + sentence(7000 + f, 60)))
    rows += [rows[12], (rows[12][0], "another text under the same id " + sentence(3, 30)), (None, rows[12][1]), (500, sentence(77, 9000))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "part"), [(1, 1024), (2, 4)])
def test_classes_match_brute_force(spark, monkeypatch, seed, part):
    if part < 10:  # small parts, so that groups and blocks are cut, and a low bar for the table of frequent shingles
        monkeypatch.setattr(simjoin, "PART", part)
        monkeypatch.setattr(simjoin, "MOST_FREQUENT", 3)
    rows = cases(seed)
    got = simjoin.near_duplicates(docs(spark, rows), part=part, block_part=part)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert simjoin.near_duplicates(docs(spark, [])).count() == 0
    assert simjoin.near_duplicates(docs(spark, [(1, None)])).collect()[0][:3] == (1, 0, 1)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)
        for _ in range(3):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 8)), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    alive = set()
    for i, j in simjoin._surviving([simjoin.bitmap(s) for s in sets], np.array([len(s) for s in sets])):
        alive.update(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True))
    for i in range(len(sets)):
        for j in range(i):
            if simjoin.linked(sets[i], sets[j]):
                assert (j, i) in alive


def test_prefix_is_shared_by_linked_sets():
    rng = np.random.default_rng(5)
    often = np.sort(rng.integers(0, 2**63, 50, dtype=np.uint64))
    rank = rng.permutation(50)
    for _ in range(300):
        core = np.unique(np.concatenate([rng.integers(0, 2**63, int(rng.integers(5, 80)), dtype=np.uint64), rng.choice(often, 10)]))
        a = core[rng.random(len(core)) > 0.1]
        b = core[rng.random(len(core)) > 0.1]
        if len(a) and len(b) and simjoin.linked(a, b):
            assert np.intersect1d(simjoin.prefix(a, often, rank), simjoin.prefix(b, often, rank)).size


@pytest.mark.parametrize("part", [1024, 4])
def test_every_link_is_counted(spark, part):
    rng = random.Random(9)
    base = sentence(61, 120)
    rows = [(k, mutate(base, rng.choice([0, 1, 2, 3]), rng)) for k in range(30)]
    rows += [rows[3], (None, rows[5][1]), (40, None), (41, ""), (42, sentence(62, 80))]
    sets = [set(simjoin.shingles(t).tolist()) for _, t in rows]
    want = [sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = simjoin.near_duplicates(docs(spark, rows), part=part, block_part=part).collect()
    assert sorted((r["doc_id"] or -1, r["n_links"]) for r in got) == sorted((k or -1, n) for (k, _), n in zip(rows, want, strict=True))
    assert sum(want) // 2 > len(rows)  # more than the edges that connect a class


def test_structured_texts_differ(spark):
    """Words of 2,048 characters whose letters follow the Thue-Morse sequence and its complement: a polynomial modulo 2^64 takes them for one."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    assert simjoin.shingles(one).tolist() != simjoin.shingles(other).tolist()
    got = simjoin.near_duplicates(docs(spark, [(1, one), (2, other), (3, one)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 5, "x", 1.0), (2, "a b c d e", 6, None, 2.0)], "doc_id bigint, text string, node bigint, class_key string, n double")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in simjoin.near_duplicates(df).collect()) == [(1, 1, 1, 1), (2, 1, 1, 1)]
