import re

import numpy as np
import pytest

from serialmill.llm import langid, pii, toxicity
from tests.llm.helpers import docs, sentence

A, B = ["alar", "orim", "enth", "tor", "ish"], ["zuk", "xov", "qiz", "vex", "wug"]


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(i, sentence(i, 40, A if i % 2 else B), "aa" if i % 2 else "bb") for i in range(60)]
    return langid.fit(docs(spark, rows))


def test_language_id(spark, languages):
    rows = [(1, sentence(901, 30, A)), (2, sentence(902, 30, B)), (3, None), (4, ""), (5, "123 ... ٣"), (6, sentence(903, 20000, A)), (6, sentence(903, 20000, A))]
    df = docs(spark, rows).withColumnRenamed("source", "score")
    got = langid.predict(df, languages).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["aa", "bb", "und", "und", "und", "aa", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got) and got[0].__fields__.count("score") == 1
    assert langid.predict(docs(spark, []), languages).count() == 0
    assert langid.predict(docs(spark, [(1, "abc")]), langid.fit(docs(spark, []))).first()["lang_pred"] == "und"


def test_kernel_is_normalised():
    rows = np.zeros((2, langid.DIM), np.uint8)
    langid.presence("same text", rows[0])
    langid.presence("same   TEXT", rows[1])
    assert np.allclose(langid.kernel(rows, rows), 1)


def test_nystroem_with_all_landmarks_is_kernel_ridge():
    """With every row a landmark, the fit equals weighted kernel ridge regression in closed form, on kernels of plain sets of n-grams."""
    texts, labels = [sentence(i, 6, A if i % 3 else B) for i in range(30)], ["aa" if i % 3 else "bb" for i in range(30)]
    model = langid.fit_rows(texts, labels, landmarks_each=30, ridge=0.5)
    rows = np.zeros((30, langid.DIM), np.uint8)
    for r, t in zip(rows, texts, strict=True):
        langid.presence(t, r)
    sets = [set(np.flatnonzero(r).tolist()) for r in rows]
    grams = lambda t: {f" {' '.join(t.lower().split())} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    assert all(len(s) <= len(grams(t)) and len(s) > 0.95 * len(grams(t)) for s, t in zip(sets, texts, strict=True))  # few hashes meet
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.array([[1.0 if x == n else -1.0 for n in model.labels] for x in labels])
    weight = np.array([1 / labels.count(x) for x in labels])
    exact = k @ np.linalg.solve(k + 0.5 / 2 * np.diag(1 / weight), y)
    order = [i for n in model.labels for i, x in enumerate(labels) if x == n]
    assert np.allclose(langid.kernel(rows, rows[order]) @ model.weights, exact, atol=1e-3)


def brute_marginals(e, trans, start):
    """By summing over all tag sequences."""
    n, total, on = len(e), 0.0, np.zeros(len(e))
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        s = start * y[0] + sum(e[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1))
        w = np.exp(s)
        total += w
        on += w * np.array(y)
    return on / total


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    texts = [rng.normal(0, 2, n) for n in (1, 5, 9, 3, 7, 2)]
    trans, start = rng.normal(0, 1, (2, 2)), 0.7
    first = np.concatenate([np.arange(len(t)) == 0 for t in texts])
    for lane in (3, 512):
        got = toxicity.marginals(np.concatenate(texts), first, trans, start, lane)
        assert np.allclose(got, np.concatenate([brute_marginals(t, trans, start) for t in texts]))


def test_expected_pairs_match_enumeration():
    """Neighbouring tags of one text, by summing over all tag sequences."""
    rng = np.random.default_rng(6)
    e, trans, start = rng.normal(0, 2, 7), rng.normal(0, 1, (2, 2)), -0.4
    first = np.arange(7) == 0
    total, want = 0.0, np.zeros((2, 2))
    for bits in range(1 << 7):
        y = [(bits >> i) & 1 for i in range(7)]
        w = np.exp(start * y[0] + e @ y + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        for a, b in zip(y, y[1:], strict=False):
            want[a, b] += w
    assert np.allclose(toxicity.expected_pairs(e, first, trans, *toxicity.forward_backward(e, first, trans, start)), want / total)


def test_toxicity(spark):
    bad = ["loser", "moron", "veqis", "veqor", "veqim"]
    texts, labels = [], []
    for i in range(160):
        ws = sentence(i, 60).split()
        if i % 4 == 0:
            for k in range(3):
                ws[7 * k + i % 5] = bad[(i // 4 + k) % 5].capitalize() if k else bad[i // 4 % 5]
        texts.append(" ".join(ws))
        labels.append(int(i % 4 == 0))
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels, strict=True)) if i % 5], "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df)
    held = [(i, t) for i, t in enumerate(texts) if i % 5 == 0]
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, [*held, (900, None), (901, "")]), model).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(labels[i]) for i, _ in held)
    assert got[900]["score"] == got[901]["score"] < 0.5 and got[900]["toxic_spans"] == []
    i = next(i for i, _ in held if labels[i])
    assert any(texts[i][s["start"] : s["end"]].lower() in bad for s in got[i]["toxic_spans"])
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert toxicity.score(docs(spark, [(1, "x")]), toxicity.fit(df.where("toxic = 0"))).first()["score"] == 0


NAIVE = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def naive(t):
    d = pii.digits_of
    ok = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 14 <= len(d(s)) <= 19 and pii.luhn(d(s)), lambda s: 10 <= len(d(s)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(NAIVE) for m in p.finditer(t) if ok[k](m[0]))


def test_base_spans_match_patterns():
    import random

    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("a1.@+- ()9b_é0") for _ in range(rng.randint(1, 50)))
        assert pii.base_spans(t) == naive(t), t


@pytest.fixture(scope="module")
def spans_model():
    data = [lambda i: f"+1 ({200 + i}) 555-{1000 + 7 * i}", lambda i: f"u.{i}@mail{i % 9}.example.com", lambda i: f"10.{i}.{3 * i}.7"]
    texts = [f"{sentence(i, 30)} {data[i % 3](i // 3)} {sentence(i + 500, 30)}" for i in range(240)]
    return pii.train(*pii.labelled_windows(texts))


def test_pii_keeps_base_and_adds_variants(spark, spans_model):
    plain = sentence(7, 50)
    rows = [
        (1, plain + " reach +44 (123) 456-7890 now"), (2, None), (3, ""), (4, plain), (5, "mail a.b@c.org\nip 1.2.3.4 card 4111 1111 1111 1111"),
        (6, sentence(8, 9000) + " a@b.cd"), (6, sentence(8, 9000) + " a@b.cd"), (7, "9" * 50000), (8, "@" * 2000),
    ]
    got = pii.digest(docs(spark, rows), spans_model).collect()
    for r in got:
        t = next(t for k, t in rows if k == r["doc_id"]) or ""
        base = naive(t)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]
        assert set(pii.written(base).split(",")) <= set(r["spans"].split(",")) or not base
    assert next(r for r in got if r["doc_id"] == 4)["spans"] == ""
    assert pii.digest(docs(spark, []), spans_model).count() == 0
    masked = {r["doc_id"]: r["m"] for r in pii.detect(docs(spark, rows[:5]), spans_model, masked="m").collect()}
    assert masked[5] == "mail [EMAIL]\nip [IP] card [CARD]" and masked[2] is None and masked[4] == plain


def test_crf_against_all_paths():
    """Log partition, marginals and the best path, by listing every path."""
    import itertools

    rng = np.random.default_rng(0)
    e, trans, start = rng.normal(0, 1, (4, 2, pii.TAGS)), rng.normal(0, 1, (pii.TAGS, pii.TAGS)), rng.normal(0, 1, pii.TAGS)
    z, marg, _ = pii.forward_backward(e, trans, start)
    best = pii.viterbi(e, trans, start)
    paths = np.array(list(itertools.product(range(pii.TAGS), repeat=4)))
    for w in range(2):
        score = start[paths[:, 0]] + sum(e[i, w, paths[:, i]] for i in range(4)) + sum(trans[paths[:, i], paths[:, i + 1]] for i in range(3))
        assert paths[score.argmax()].tolist() == best[:, w].tolist()
        p = np.exp(score - score.max())
        assert np.isclose(z[w], score.max() + np.log(p.sum()))
        assert np.allclose(marg[2, w], np.bincount(paths[:, 2], weights=p / p.sum(), minlength=pii.TAGS))


def test_lstm_crf_gradient_is_numeric():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in pii._init(3, 4).items()}
    x, tags = rng.integers(0, pii.CHARS, (3, 6)), rng.integers(0, pii.TAGS, (3, 6))
    _, g = pii.gradients(p, x, tags)
    for name in p:
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in p[name].shape) if name != "E" else (int(x[0, 0]), 1)
            loss = []
            for step in (1e-5, -1e-5):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += step
                loss.append(pii.gradients(q, x, tags)[0])
            assert np.isclose((loss[0] - loss[1]) / 2e-5, g[name][at], atol=1e-6), name


def test_recall_of_unseen_variants(spans_model):
    """Data in forms that no pattern has, in texts that no training window comes from: most are found, and clean texts stay clean."""
    rng = np.random.default_rng(77)
    say = {1: lambda: ".".join(map(str, rng.integers(1, 256, 4))), 2: lambda: pii._invented(2, rng), 3: lambda: f"+1 ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}", 0: lambda: f"{sentence(int(rng.integers(999)), 1)}.{sentence(int(rng.integers(999)), 1)}@{sentence(int(rng.integers(999)), 1)}.example.org"}
    for kind, least in ((0, 0.6), (1, 0.5), (2, 0.5), (3, 0.5)):
        data = [pii._variant(kind, say[kind](), rng) for _ in range(60)]
        texts = [f"{sentence(2000 + i, 15)} {v} {sentence(3000 + i, 15)}" for i, v in enumerate(data)]
        found = pii.find_spans(spans_model, texts)
        hit = [any(v in t[a:b] or t[a:b] in v and b - a >= 0.8 * len(v) for a, _, b in spans) for v, t, spans in zip(data, texts, found, strict=True)]
        assert np.mean(hit) >= least, (kind, np.mean(hit))
    clean = [sentence(4000 + i, 40) for i in range(200)] + [f"{sentence(5000 + i, 10)} {i} of {i * 7} at {i % 12}:30 in {1900 + i}, {sentence(6000 + i, 10)}" for i in range(100)]
    assert sum(map(bool, pii.find_spans(spans_model, clean))) <= 3


def test_very_long_text_of_addresses(spans_model):
    """Thousands of spans in one text cost little more than they are many."""
    import time

    text = " ".join(f"a{i}.b@mail.example.com" for i in range(12_000))
    began = time.time()
    taken = pii._Taken(pii.base_spans(text))
    assert not any(taken.meets((m.start(), 0, m.end())) for m in re.finditer(" ", text))
    chosen = pii._reconcile({(3 * i, 0, 3 * i + 4): 0.95 for i in range(30_000)})
    assert len(chosen) == 15_000 and time.time() - began < 5


def test_clashing_columns(spark, spans_model, languages):
    df = spark.createDataFrame([(1, "mail a.b@c.org", "x", 7, "y", 0.5)], "doc_id bigint, text string, spans string, n_email int, pii_spans string, score double")
    r = pii.digest(df, spans_model).first()
    assert (r["spans"], r["n_email"], r["score"]) == ("email:5:14", 1, 0.5)
    assert pii.detect(df, spans_model).first()["pii_spans"][0]["start"] == 5
    assert toxicity.score(df, None).first()["score"] == 0 and langid.predict(df, languages).first()["spans"] == "x"


def test_sample_is_the_same_however_rows_lie(spark):
    from serialmill.llm.common import bounded_sample

    rows = [(f"k{i % 50}", f"text {i}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, text string, n int")
    got = bounded_sample(df, "k", 20)
    assert len(got) == 20 and got == bounded_sample(df.repartition(7, "n"), "k", 20) == bounded_sample(df, "k", 20, total=10**9)
    assert all(r["text"] == min(t for k, t, _ in rows if k == r["k"]) for r in got)
    assert bounded_sample(df.where("n < 0"), "k", 5) == []


def test_added_spans(spans_model):
    texts = [f"{sentence(i, 12)} ({212 + i}) 555-1{230 + i} {sentence(i + 40, 12)}" for i in range(8)]
    found = pii.find_spans(spans_model, texts)
    assert any(found)  # written as no pattern has them
    for t, spans in zip(texts, found, strict=True):
        assert all(pii.digits_of(t[a:b]) for a, _, b in spans)


def test_spans_of_all_lengths_are_seen_whole():
    import random

    rng = random.Random(4)
    for _ in range(300):
        length = rng.randint(8, pii.LONGEST)
        before, after = sentence(rng.randrange(99), rng.randint(0, 400)), sentence(rng.randrange(99), rng.randint(0, 400))
        at, dot = rng.randrange(1, length - 6), rng.randrange(1, length - 6)
        datum = "x" * at + rng.choice([" at ", "(at)", "@", "7"]) + "y" * (length - at - 4)
        datum = datum[:length] if at <= dot < at + 4 else datum[:dot] + ".z" + datum[dot + 2 : length]
        t = f"{before} {datum} {after}"
        lo, hi = len(before) + 1, len(before) + 1 + len(datum)
        if pii._checks(0, t, lo, hi):
            assert any((a < lo or a == 0) and (b > hi or b == len(t)) for a, b in pii._stretches(t)), t
    many = "9" * 20000
    for lo in range(1, 19000, 37):
        assert any(a < lo and b > lo + pii.LONGEST for a, b in pii._stretches(many))


def test_written_addresses_without_digits_and_long_ones(spans_model):
    where = lambda t, v: any(t[a:b] == v for a, _, b in pii.find_spans(spans_model, [t])[0])
    place = lambda k, v: f"{sentence(k, 40)[: 80 + k]} {v} {sentence(k + 70, 12)}"
    short = [v for v in ("anna.bell at mail.example.org", "anna.bell [at] mail.example.org", "anna.bell(at)mail.example.org") for k in range(32) if where(place(k, v), v)]
    assert len(set(short)) == 3 and len(short) >= 32
    for n in (2, 4, 8):
        v = ".".join(sentence(n, n).split()) + ".hollings [at] customers.mailing.example.org"
        assert sum(where(place(k, v), v) for k in range(32)) >= 24
    assert not any(pii.find_spans(spans_model, [f"{sentence(k, 20)} at the door.Then at home. {sentence(k + 9, 20)}" for k in range(16)]))
