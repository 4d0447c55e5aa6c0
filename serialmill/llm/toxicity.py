"""Toxicity by a linear-chain conditional random field over words.

Words of a text are tagged clean or toxic. Training tokens come from labelled documents: a greedy
cover picks the words and word beginnings that explain the toxic documents and (almost) never occur in
clean ones; their occurrences in toxic documents are the toxic tokens, all others clean ones. The field
has word, prefix and suffix weights, transitions and a start weight, all fitted by gradient ascent on the
likelihood: labelled less expected counts, from forward-backward marginals of words and of neighbours.
The marginals give a toxic probability for each word; a logistic layer over their sum and maximum gives
the document's score, and words over one half give the offending offsets.

The fit takes at most ``sample_toxic`` + ``sample_clean`` labelled rows; scoring reads whole texts.
Defined results: null and empty texts have no words and score as a clean text without evidence;
without toxic or without clean labels every text scores 0; repeated rows get equal rows (the sample holds one
of each id); very long texts are read whole; columns named like a result are replaced by it; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialmill.llm.common import append_by_text, bounded_sample

WORD = re.compile(r"\w+")
PREFIXES, SUFFIX = (4, 5, 6), 4
CACHE = 400_000


@dataclass
class ToxicityModel:
    weights: dict[str, float]  # feature -> weight of the toxic tag
    bias: float
    trans: np.ndarray  # (2, 2) log transitions
    start: float  # log odds of starting toxic
    doc: np.ndarray  # logistic layer: constant, log(1 + sum), maximum


def features(word: str) -> list[str]:
    w = word.lower()
    return [f"w:{w}", *(f"p:{w[:n]}" for n in PREFIXES if len(w) > n), *([f"s:{w[-SUFFIX:]}"] if len(w) > SUFFIX else [])]


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Odds of toxic at each word, given it and the words before, and the odds that the words after add.

    ``e``: emission log odds of all texts in a row; ``first`` marks where a text starts.

    The recursions run over the odds of the two tags, which a step maps by a 2x2 matrix. The row is cut
    into blocks: block matrices first, then the odds entering each block, then all blocks abreast.
    """
    n = len(e)
    if n == 0:
        return np.zeros(0), np.zeros(0)
    t = np.exp(trans - trans.max())
    size = max(1, min(lane, int(np.sqrt(n)) or 1))
    blocks = -(-n // size)
    pad = blocks * size - n
    ex = np.exp(np.clip(np.concatenate([e, np.zeros(pad)]), -40, 40)).reshape(blocks, size)
    fs = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, size)
    pi = float(np.exp(np.clip(start, -40, 40)))

    def sweep(a, b, c, d):
        """odds' = (c + d * odds) / (a + b * odds), along each block; the matrices have shape (blocks, size)."""
        a, b, c, d = (np.ascontiguousarray(x.T) for x in (a, b, c, d))  # a step is a row
        m = (np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks))
        for k in range(size):
            x, y, u, v = m
            m = (a[k] * x + b[k] * u, a[k] * y + b[k] * v, c[k] * x + d[k] * u, c[k] * y + d[k] * v)
            scale = 1 / (m[0] + m[1] + m[2] + m[3])
            m = tuple(z * scale for z in m)
        odds, into = 1.0, np.empty(blocks)
        for k in range(blocks):
            into[k] = odds
            odds = min(max((m[2][k] + m[3][k] * odds) / max(m[0][k] + m[1][k] * odds, 1e-300), 1e-30), 1e30)
        out, r = np.empty((size, blocks)), into
        for k in range(size):
            r = np.clip((c[k] + d[k] * r) / (a[k] + b[k] * r), 1e-30, 1e30)
            out[k] = r
        return out.T

    one = np.ones_like(ex)
    # forward: alpha1/alpha0 after each word; at a start the odds before do not matter
    fwd = sweep(np.where(fs, 1, t[0, 0]), np.where(fs, 0, t[1, 0]), np.where(fs, pi * ex, t[0, 1] * ex), np.where(fs, 0, t[1, 1] * ex)).reshape(-1)
    # backward: beta1/beta0 before the next word; at the end of a text it is 1
    nx = np.concatenate([ex.reshape(-1)[1:], [1.0]])
    end = np.concatenate([fs.reshape(-1)[1:], [True]])
    back = lambda v: v[::-1].reshape(blocks, size)
    nx, end = back(nx), back(end)
    bwd = sweep(np.where(end, 1, t[0, 0]), np.where(end, 0, t[0, 1] * nx), np.where(end, 1, t[1, 0] * one), np.where(end, 0, t[1, 1] * nx)).reshape(-1)[::-1]
    return fwd[:n], bwd[:n]


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float, lane: int = 512) -> np.ndarray:
    """P(toxic) of each word."""
    fwd, bwd = forward_backward(e, first, trans, start, lane)
    odds = fwd * bwd
    return odds / (1 + odds)


def expected_pairs(e: np.ndarray, first: np.ndarray, trans: np.ndarray, fwd: np.ndarray, bwd: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring tags, (before, after), over all texts."""
    k = np.flatnonzero(~first)
    t, now = np.exp(trans - trans.max()), np.exp(np.clip(e[k], -40, 40)) * bwd[k]
    w = np.array([[np.full(len(k), t[0, 0]), t[0, 1] * now], [t[1, 0] * fwd[k - 1], t[1, 1] * fwd[k - 1] * now]])
    return (w / w.sum((0, 1))).sum(2)


def _cover(toxic: list[set[str]], clean: Counter, n_clean: int, times: int = 2) -> list[str]:
    """Words ``w:`` and beginnings ``p:`` that, picked greedily, explain each toxic text ``times`` times."""
    holds = defaultdict(set)
    for i, s in enumerate(toxic):
        for f in s:
            holds[f].add(i)
    need = np.full(len(toxic), times)
    least = max(2, len(toxic) // 100)
    cand = {f: np.fromiter(d, int) for f, d in holds.items() if len(d) >= least and clean[f] / max(n_clean, 1) < 0.02 * len(d) / len(toxic)}
    picked: list[str] = []
    while cand:
        gain = {f: int((need[d] > 0).sum()) for f, d in cand.items()}
        best = min(gain, key=lambda f: (-gain[f], clean[f], f))
        if gain[best] < least:
            break
        need[cand[best]] -= 1
        picked.append(best)
        nested = lambda f: f[2:].startswith(best[2:]) or best[2:].startswith(f[2:])  # noqa: B023, E731  the same words again
        cand = {f: d for f, d in cand.items() if not nested(f)}
    return picked


def fit_rows(texts: list[str | None], toxic: list[int], weights: list[float], steps: int = 60) -> ToxicityModel | None:
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return None
    toks = [WORD.findall(t or "") for t in texts]
    low = [[w.lower() for w in ws] for ws in toks]
    held = lambda ws: {f for w in set(ws) for f in features(w) if f[0] != "s"}
    bad_sets = [held(ws) for ws, x in zip(low, y, strict=True) if x]
    n_held = Counter(f for fs in bad_sets for f in fs)
    often = {f for f, c in n_held.items() if c >= max(2, len(bad_sets) // 100)}  # only these can be picked
    bad_sets = [fs & often for fs in bad_sets]
    clean: Counter = Counter()
    for ws, x in zip(low, y, strict=True):
        if not x:
            clean.update(held(ws) & often)
    picked = set(_cover(bad_sets, clean, int((y == 0).sum())))
    # unique words -> features
    vocab: dict[str, int] = {}
    ids = np.concatenate([np.array([vocab.setdefault(w, len(vocab)) for w in ws], dtype=np.int64) for ws in low] or [np.zeros(0, np.int64)])
    bad = np.array([not picked.isdisjoint(features(w)) for w in vocab], dtype=float)
    tags = bad[ids] * np.repeat(y, [len(ws) for ws in low])
    first = np.concatenate([np.arange(len(ws)) == 0 for ws in low]).astype(bool)
    doc = np.repeat(np.arange(len(low)), [len(ws) for ws in low])
    if not len(ids):
        return None
    counts: Counter = Counter()
    for w in vocab:
        counts.update(features(w))
    fid: dict[str, int] = {}
    rows, cols = [], []
    for w, i in vocab.items():
        for f in features(w):
            if f.startswith("w:") or counts[f] >= 2:
                rows.append(i)
                cols.append(fid.setdefault(f, len(fid)))
    rows_a, cols_a = np.array(rows), np.array(cols)
    # Adam on the likelihood's gradient, which is labelled less expected counts; the parameters: features, bias, start, four transitions
    pair = np.flatnonzero(~first)
    labelled = np.zeros((2, 2))
    np.add.at(labelled, (tags[pair - 1].astype(int), tags[pair].astype(int)), 1)
    smooth = labelled + 1
    near = np.log(smooth / smooth.sum(1, keepdims=True)) - np.log(smooth.sum(0) / smooth.sum())[None]  # how far a neighbour moves the odds
    n_f = len(fid)
    x = np.concatenate([np.zeros(n_f), [-3.0, 0.0], near.reshape(-1)])
    freq = np.bincount(cols_a, weights=np.bincount(ids, minlength=len(vocab))[rows_a], minlength=n_f)
    scale = 1 / np.sqrt(np.concatenate([freq, [len(ids), len(low)], [len(ids)] * 4]) + 1)
    rate = np.concatenate([np.full(n_f, 0.25), [0.25, 0.05], np.full(4, 0.05)])
    m1, m2 = np.zeros(len(x)), np.zeros(len(x))
    for s in range(1, steps + 1):
        emit = (np.bincount(rows_a, weights=x[:n_f][cols_a], minlength=len(vocab)) + x[n_f])[ids]
        trans, start = x[n_f + 2 :].reshape(2, 2), float(x[n_f + 1])
        fwd, bwd = forward_backward(emit, first, trans, start)
        diff = tags - fwd * bwd / (1 + fwd * bwd)
        words = np.bincount(cols_a, weights=np.bincount(ids, weights=diff, minlength=len(vocab))[rows_a], minlength=n_f)
        pairs = labelled - expected_pairs(emit, first, trans, fwd, bwd)
        g = np.concatenate([words, [diff.sum(), diff[first].sum()], pairs.reshape(-1)]) * scale - np.where(np.arange(len(x)) < n_f, 0.002 * x, 0)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        x = x + rate * (m1 / (1 - 0.9**s)) / (np.sqrt(m2 / (1 - 0.99**s)) + 1e-3)
    theta, bias, start, trans = x[:n_f], float(x[n_f]), float(x[n_f + 1]), x[n_f + 2 :].reshape(2, 2)
    emit = np.bincount(rows_a, weights=theta[cols_a], minlength=len(vocab)) + bias
    p = marginals(emit[ids], first, trans, start)
    doc_layer = _logistic(_doc_features(p, doc, len(low)), y, np.array(weights))
    return ToxicityModel({f: float(theta[i]) for f, i in fid.items() if abs(theta[i]) > 1e-3}, bias, trans, start, doc_layer)


def _doc_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    top = np.zeros(n)
    np.maximum.at(top, doc, p)
    return np.stack([np.ones(n), np.log1p(np.bincount(doc, weights=np.where(p > 0.05, p, 0), minlength=n)), top], 1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    beta, w = np.zeros(x.shape[1]), w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-1 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - 1e-1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_toxic: int = 900, sample_clean: int = 1500) -> ToxicityModel | None:
    """``labelled``: rows with key, text and a 0/1 label."""
    known = labelled.where(F.col(label).isin(0, 1)).select(key, text, label)
    n = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    pick = lambda y, rows: bounded_sample(known.where(F.col(label) == y), key, rows, total=n.get(y, 0))
    rows = pick(1, sample_toxic) + pick(0, sample_clean)
    got = Counter(r[label] for r in rows)
    return fit_rows([r[text] for r in rows], [r[label] for r in rows], [n[r[label]] / got[r[label]] for r in rows])


class _Emit(dict):
    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        get = self.model.weights.get
        v = self[word] = self.model.bias + sum(get(f, 0.0) for f in features(word))
        return v


def scorer(model: ToxicityModel | None, spans: bool, batch_words: int = 1_000_000):
    def make():
        if model is None:
            return lambda texts: ([0.0] * len(texts), [[] for _ in texts])[: 1 + spans]
        emit = _Emit(model)

        def flush(part, texts, toks, scores, found):
            sizes = np.array([len(x) for x in toks])
            e = np.concatenate([np.fromiter(map(emit.__getitem__, x), float, len(x)) for x in toks]) if sizes.sum() else np.zeros(0)
            first = np.zeros(len(e), bool)
            at = np.concatenate([[0], sizes.cumsum()])
            first[at[:-1][sizes > 0]] = True
            p = marginals(e, first, model.trans, model.start)
            z = _doc_features(p, np.repeat(np.arange(len(part)), sizes), len(part)) @ model.doc
            for k, i in enumerate(part):
                scores[i] = float(1 / (1 + np.exp(-np.clip(z[k], -30, 30))))
                if spans and (bad := np.flatnonzero(p[at[k] : at[k + 1]] > 0.5)).size:
                    where = [m.span() for m in WORD.finditer(texts[i])]
                    found[i] = [{"start": where[b][0], "end": where[b][1]} for b in bad]

        def score(texts):
            scores, found = [0.0] * len(texts), [[] for _ in texts]
            part, toks, held = [], [], 0
            for i, t in enumerate(texts):
                part.append(i)
                toks.append(WORD.findall(t or ""))
                held += len(toks[-1])
                if held >= batch_words:
                    flush(part, texts, toks, scores, found)
                    part, toks, held = [], [], 0
            if part:
                flush(part, texts, toks, scores, found)
            return (scores, found) if spans else (scores,)

        return score

    return make


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", out: str = "score", spans: str | None = "toxic_spans") -> DataFrame:
    """``docs`` with a score in [0, 1] and, unless ``spans`` is None, the offsets (code points) of toxic words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    fields = [(out, pa.float64(), "double")]
    if spans:
        fields.append((spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "array<struct<start:int,end:int>>"))
    return append_by_text(docs, text, fields, lambda: scorer(shared.value, bool(spans))())
