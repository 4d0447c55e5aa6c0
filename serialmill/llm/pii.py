"""Personal data: fixed patterns, and a character BiLSTM with a CRF that adds spans.

The patterns give the base spans. The model reads characters in overlapping stretches: a bidirectional
LSTM gives each character's scores for the tags (outside, and begin and inside of each kind), a linear
chain with learned transitions decodes each stretch, and stretches are reconciled globally: a span counts
only where a stretch sees beyond both its ends, equal spans merge, and of overlapping ones the surest
stays. Base spans always stay; a span of the model is added where it overlaps none, passes the same digit
checks as the patterns' spans (an address holds an at sign or the word "at", and a dot before a letter or
digit) and is sure enough. So every added span holds a digit, an at sign, or the word "at" with such a dot
within LONGEST characters; a stretch reaches LONGEST characters to either side of each of these, so all
spans of up to LONGEST characters are seen whole, and text beyond cannot hold one.

Trained in numpy on labelled spans: the patterns' spans in at most ``sample_rows`` documents, and variants
of them (other separators, no country code), which have no pattern, and cut-outs of invented addresses of
all lengths, with and without digits. Defined results: null counts as empty and is masked as null; without any
labelled span in the sample the templates alone train the model; of overlapping added spans that are equally
sure the first stays; repeated rows get equal rows; very long texts are read whole, in time near linear in
their length and spans; columns named like a result are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialmill.llm.common import append_by_text, bounded_sample

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
SURE = 0.9
LONGEST = 260  # characters of an added span: an address has 254 at most, and its at sign may be written out
STRETCH = 2048

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits: had the run's start failed, so would its middle.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_AT = re.compile(r"(?<!\w)at(?!\w)")
_DOT = re.compile(r"\.\w")


# --- base patterns


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _ip_ok(parts) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in parts)


def digits_of(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted; leftmost and non-overlapping within a kind."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m.groups())]
        for m in _CARD.finditer(text):
            d = digits_of(m[0]) if len(m[0]) < 64 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = len(_DIGIT.findall(m[0]))
                if 10 <= n <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- model

TAGS = 1 + 2 * len(KINDS)


def char_ids(text: str) -> np.ndarray:
    """Printable ASCII one by one, then classes: letter, digit, space, other."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((cps >= 32) & (cps < 127), cps - 32, 98)
    for p in np.flatnonzero(out == 98):
        c = text[p]
        out[p] = 95 if c.isalpha() else 96 if c.isdigit() else 97 if c.isspace() else 98
    return out


CHARS, PAD = 100, 99


@dataclass
class SpanModel:
    p: dict[str, np.ndarray]


def _init(embed: int, hidden: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.3, (CHARS, embed))}
    for d in "fb":
        p[f"W{d}"] = rng.normal(0, 1 / np.sqrt(embed + hidden), (embed + hidden, 4 * hidden))
        p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # gates: in, forget, out, new
    p["O"] = rng.normal(0, 0.2, (2 * hidden, TAGS))
    p["o"] = np.zeros(TAGS)
    p["T"] = np.zeros((TAGS, TAGS))
    p["S"] = np.zeros(TAGS)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x, w, c0, keep):
    """x: (T, B, D). Returns hidden states (T, B, H) and, if ``keep``, what the way back needs."""
    t, b, _ = x.shape
    h_n = w.shape[1] // 4
    h, c = np.zeros((b, h_n), x.dtype), np.zeros((b, h_n), x.dtype)
    hs, cache = np.empty((t, b, h_n), x.dtype), []
    for k in range(t):
        z = np.concatenate([x[k], h], 1)
        a = z @ w + c0
        s, g = _sig(a[:, : 3 * h_n]), np.tanh(a[:, 3 * h_n :])
        was = c
        c = s[:, h_n : 2 * h_n] * c + s[:, :h_n] * g
        th = np.tanh(c)
        h = s[:, 2 * h_n :] * th
        hs[k] = h
        if keep:
            cache.append((z, s, g, was, th))
    return hs, cache


def _lstm_back(dhs, cache, w):
    t, b, h_n = dhs.shape
    dw, dc0 = np.zeros_like(w), np.zeros(4 * h_n, w.dtype)
    dx = np.empty((t, b, w.shape[0] - h_n), w.dtype)
    dh, dc = np.zeros((b, h_n), w.dtype), np.zeros((b, h_n), w.dtype)
    for k in range(t - 1, -1, -1):
        z, s, g, was, th = cache[k]
        i, f, o = s[:, :h_n], s[:, h_n : 2 * h_n], s[:, 2 * h_n :]
        dh = dh + dhs[k]
        dc = dc + dh * o * (1 - th * th)
        da = np.concatenate([dc * g * i * (1 - i), dc * was * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw += z.T @ da
        dc0 += da.sum(0)
        dz = da @ w.T
        dx[k], dh, dc = dz[:, : -h_n], dz[:, -h_n:], dc * f
    return dx, dw, dc0


def emissions(p, ids, keep=False):
    """ids: (B, T) -> (T, B, TAGS)."""
    x = p["E"][ids.T]
    hf, cf = _lstm(x, p["Wf"], p["cf"], keep)
    hb, cb = _lstm(x[::-1], p["Wb"], p["cb"], keep)
    h = np.concatenate([hf, hb[::-1]], 2)
    return h @ p["O"] + p["o"], (h, cf, cb)


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def forward_backward(e, trans, start):
    """Log partition (B,), tag marginals (T, B, K), and the expected transitions summed over windows."""
    t, b, k = e.shape
    al, be = np.empty_like(e), np.zeros_like(e)
    al[0] = start + e[0]
    for i in range(1, t):
        al[i] = _lse(al[i - 1][:, :, None] + trans[None], 1) + e[i]
    for i in range(t - 2, -1, -1):
        be[i] = _lse(trans[None] + (e[i + 1] + be[i + 1])[:, None, :], 2)
    z = _lse(al[-1], 1)
    pair = np.zeros((k, k))
    for i in range(1, t):
        pair += np.exp(al[i - 1][:, :, None] + trans[None] + (e[i] + be[i])[:, None, :] - z[:, None, None]).sum(0)
    return z, np.exp(al + be - z[None, :, None]), pair


def viterbi(e, trans, start) -> np.ndarray:
    """Best tags (T, B)."""
    t, b, k = e.shape
    score, back = start + e[0], np.empty((t, b, k), np.int8)
    for i in range(1, t):
        s = score[:, :, None] + trans[None]
        back[i] = s.argmax(1)
        score = s.max(1) + e[i]
    out = np.empty((t, b), np.int64)
    out[-1] = score.argmax(1)
    for i in range(t - 1, 0, -1):
        out[i - 1] = back[i][np.arange(b), out[i]]
    return out


def gradients(p: dict[str, np.ndarray], x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean loss (negative log likelihood of the tags) of windows (B, T) and its gradient by every parameter."""
    y, n = tags.T, len(x)
    e, (h, cf, cb) = emissions(p, x, True)
    z, marg, pair = forward_backward(e, p["T"], p["S"])
    gold = np.eye(TAGS, dtype=e.dtype)[y]
    labelled = np.zeros((TAGS, TAGS))
    np.add.at(labelled, (y[:-1].reshape(-1), y[1:].reshape(-1)), 1)
    score = (e * gold).sum() + (p["T"] * labelled).sum() + p["S"][y[0]].sum()
    de = ((marg - gold) / n).astype(e.dtype)
    g = {"T": (pair - labelled) / n, "S": (marg[0] - gold[0]).mean(0), "o": de.sum((0, 1)), "O": np.einsum("tbh,tbk->hk", h, de)}
    dh = de @ p["O"].T
    half = dh.shape[2] // 2
    dxf, g["Wf"], g["cf"] = _lstm_back(dh[:, :, :half], cf, p["Wf"])
    dxb, g["Wb"], g["cb"] = _lstm_back(dh[::-1, :, half:], cb, p["Wb"])
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], x.T, dxf + dxb[::-1])
    return float((z.sum() - score) / n), g


def train(ids: np.ndarray, tags: np.ndarray, embed: int = 12, hidden: int = 16, epochs: int = 16, batch: int = 64, rate: float = 0.02) -> SpanModel:
    p = _init(embed, hidden)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    rng, step = np.random.default_rng(11), 0
    for ep in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), batch):
            take = order[lo : lo + batch]
            _, g = gradients(p, ids[take], tags[take])
            step += 1
            lr = rate * 0.5 ** (ep / 5)
            for k in p:
                gk = np.clip(g[k], -1, 1).astype(np.float32)
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
                p[k] = p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return SpanModel(p)


# --- labelled windows


def _variant(kind: int, s: str, rng) -> str:
    """The same datum written in a way that no pattern matches."""
    if kind == 0:
        return s.replace("@", rng.choice([" at ", " [at] ", "(at)"]), 1)
    if kind == 1:
        return s.replace(".", rng.choice([" . ", "[.]"]))
    if kind == 2:
        d = digits_of(s)
        return rng.choice([".", "_", "/"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    d = digits_of(s)[-10:]
    return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits_of(s)}"])


def _invented(kind: int, rng) -> str:
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == 0:
        w = "".join(rng.choice(list("abcdefghijklmnoprstuvwy"), 6))
        return f"{w}.{num(2)}@mail{num(1)}.{rng.choice(['example', 'post', 'web'])}.{rng.choice(['com', 'org', 'net'])}"
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice(["", " ", "-"]).join(d[i : i + 4] for i in range(0, 16, 4))
    return f"+{rng.integers(1, 60)} ({num(3)}) {num(3)}-{num(4)}"


def _word(rng, known: list[str]) -> str:
    return known[int(rng.integers(len(known)))] if known and rng.random() < 0.5 else "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 11))))


def _address(rng, least: int, known: list[str]) -> str:
    """An invented address of ``least`` characters or a few more, most of them with the at sign written out."""
    word = lambda: _word(rng, known)
    local, host = [word() for _ in range(int(rng.integers(1, 3)))], [word()]
    while sum(map(len, local)) + sum(map(len, host)) + len(local) + len(host) + 7 < least:
        (local if rng.random() < 0.5 else host).append(word())
    digits = str(rng.integers(1, 100)) if rng.random() < 0.3 else ""
    at = rng.choice(["@", " at ", " [at] ", "(at)", " at ", "[at]", " (at) "])
    join = rng.choice([".", ".", "_", "-"])
    return f"{join.join(local)}{digits}{at}{rng.choice(['.', '.', '-']).join(host)}.{rng.choice(['com', 'org', 'net', 'de', 'io', 'example', 'co.uk'])}"


def labelled_windows(texts: list[str | None], n_templates: int = 320, per_kind: int = 260, n_clean: int = 240, seed: int = 3, n_addresses: int = 480):
    """Windows with tags: pattern spans, their variants, invented ones in real surroundings, cut-outs of addresses, and windows without."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t]
    found: list[list[tuple[str, int, int]]] = [[] for _ in KINDS]
    clean: list[str] = []
    for t in texts:
        spans = base_spans(t)
        for lo, k, hi in spans:
            if hi - lo <= WINDOW - 12 and len(found[k]) < per_kind:
                found[k].append((t, lo, hi))
        for m in list(_TRIGGER.finditer(t))[:50:7]:
            a = max(0, m.start() - int(rng.integers(0, WINDOW)))
            if len(clean) < n_clean and not any(lo < a + WINDOW and hi > a for lo, _, hi in spans):
                clean.append(t[a : a + WINDOW])
        if len(t) > WINDOW and len(clean) < n_clean // 2:
            a = int(rng.integers(0, len(t) - WINDOW))
            if not any(lo < a + WINDOW and hi > a for lo, _, hi in spans):
                clean.append(t[a : a + WINDOW])
    ids, tags = [], []

    def add(before: str, datum: str, after: str, kind: int) -> None:
        room = WINDOW - len(datum)
        left = int(rng.integers(0, room + 1)) if room > 0 else 0
        left = min(left, len(before))
        s = (before[len(before) - left :] + datum + after)[:WINDOW]
        y = np.zeros(WINDOW, np.int64)
        if kind >= 0:
            y[left : left + len(datum)] = 2 + 2 * kind
            y[left] = 1 + 2 * kind
        ids.append(np.concatenate([char_ids(s), np.full(WINDOW - len(s), PAD)]))
        tags.append(y)

    around = clean or ["and then she said that it was so ", "number of the day is "]
    for k in range(len(KINDS)):
        for t, lo, hi in found[k]:
            before, after = t[max(0, lo - WINDOW) : lo], t[hi : hi + WINDOW]
            if not any(_TRIGGER.search(x) for x in (before, after)):
                add(before, t[lo:hi], after, k)
                add(before, _variant(k, t[lo:hi], rng), after, k)
    for i in range(n_templates):
        k = i % len(KINDS)
        a = re.sub(r"[0-9@+]", "", around[int(rng.integers(len(around)))])
        datum = _invented(k, rng)
        datum = datum if i % 3 else _variant(k, datum, rng)
        if len(datum) < WINDOW - 4:
            add(a[:30] + " ", datum, " " + a[30:], k)
    for s in clean:
        add("", "", s, -1)
    known = sorted({w for x in around for w in re.findall(r"\b[a-z]{2,10}\b", x)})
    for i in range(n_addresses):  # addresses are of the words around them, so that only their form tells them apart
        a, b = (re.sub(r"[0-9@+]", "", around[int(rng.integers(len(around)))]) if rng.random() < 0.5 else " ".join(_word(rng, known) for _ in range(12)) for _ in range(2))
        if i % 4:
            datum = _address(rng, int(rng.integers(12, 40 if i % 2 else LONGEST - 12)), known)
        else:  # the word alone, in prose with stops and joined words
            datum = f" at {rng.choice(['', 'the ', 'a '])}"
            b = b.replace(" ", rng.choice([" ", ". ", "."]), 1)
        s = a + (" " if i % 4 else "") + datum + (rng.choice([" ", ". ", ", "]) if i % 4 else "") + b
        y = np.zeros(len(s), np.int64)
        if i % 4:
            y[len(a) + 1 : len(a) + 1 + len(datum)] = 2
            y[len(a) + 1] = 1
        first = max(0, len(a) - 40)
        lo = int(rng.integers(first, max(first, len(s) - WINDOW) + 1))
        piece = s[lo : lo + WINDOW]
        ids.append(np.concatenate([char_ids(piece), np.full(WINDOW - len(piece), PAD)]))
        tags.append(np.concatenate([y[lo : lo + WINDOW], np.zeros(WINDOW - len(piece), np.int64)]))
    return np.stack(ids), np.stack(tags)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 600) -> SpanModel:
    marked = docs.where(F.col(text).rlike("[0-9@]")).select(key, text)
    return train(*labelled_windows([r[text] for r in bounded_sample(marked, key, sample_rows)]))


# --- decoding whole texts


def _checks(kind: int, text: str, lo: int, hi: int) -> bool:
    s = text[lo:hi]
    d = digits_of(s)
    if kind == 0:
        at = _AT.search(text, lo, hi + 1)  # a word of the text, not of the cut-out
        return bool(_DOT.search(s)) and ("@" in s or bool(at and at.end() <= hi))
    if kind == 1:
        p = re.findall(r"[0-9]+", s)
        return len(p) == 4 and _ip_ok(p)
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 and not re.search(r"[A-Za-z]", s)


def _triggers(text: str) -> list[int]:
    """Places one of which every added span holds, in order."""
    out = [m.start() for m in _TRIGGER.finditer(text)]
    ats = [m.start() for m in _AT.finditer(text)]
    dots = np.array([m.start() for m in _DOT.finditer(text)] if ats else [], np.int64)
    if len(dots):
        first = np.searchsorted(dots, np.array(ats) - LONGEST)
        near = (first < len(dots)) & (dots[np.minimum(first, len(dots) - 1)] <= np.array(ats) + LONGEST)
        out = sorted([*out, *np.array(ats)[near].tolist()])
    return out


def _stretches(text: str) -> list[tuple[int, int]]:
    """Starts and ends of what is read: all within LONGEST of a trigger, cut so that any LONGEST characters are inside a piece."""
    wide: list[list[int]] = []
    for at in _triggers(text):
        lo, hi = max(0, at - LONGEST), min(len(text), at + LONGEST + 2)
        if wide and lo <= wide[-1][1]:
            wide[-1][1] = hi
        else:
            wide.append([lo, hi])
    out = []
    for lo, hi in wide:
        while hi - lo > STRETCH:
            out.append((lo, lo + STRETCH))
            lo += STRETCH - LONGEST - WINDOW
        out.append((lo, hi))
    return out


def find_spans(model: SpanModel, texts: list[str | None], block: int = 1024) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, base and added, as (start, kind number, end)."""
    return _added(model, texts, [base_spans(t) for t in texts], block)


def _blocks(queue, block: int):
    """(text number, start, end) by like length; a block has ``block`` windows' characters at most, or one stretch."""
    queue = sorted(queue, key=lambda x: (x[2] - x[1], x))
    lo = 0
    while lo < len(queue):
        hi = lo + 1
        while hi < len(queue) and (hi + 1 - lo) * (queue[hi][2] - queue[hi][1]) <= block * WINDOW:
            hi += 1
        yield queue[lo:hi]
        lo = hi


def _added(model: SpanModel, texts, base, block: int = 1024):
    found: list[dict] = [{} for _ in texts]
    p, taken = model.p, [_Taken(b) for b in base]
    for part in _blocks([(i, a, b) for i, t in enumerate(texts) if t for a, b in _stretches(t)], block):
        ids = np.full((len(part), max(b - a for _, a, b in part)), PAD, np.int64)
        for r, (i, a, b) in enumerate(part):
            ids[r, : b - a] = char_ids(texts[i][a:b])
        e, _ = emissions(p, ids)
        tags = viterbi(e, p["T"], p["S"])
        spans = [(w, x) for w in np.flatnonzero((tags > 0).any(0)) for x in _collect(tags[:, w], *part[w][1:], len(texts[part[w][0]]))]
        spans = [(w, x) for w, x in spans if _checks(x[1], texts[part[w][0]], x[0], x[2]) and not taken[part[w][0]].meets(x)]
        if not spans:
            continue
        hit = sorted({w for w, _ in spans})
        _, marg, _ = forward_backward(e[:, hit], p["T"], p["S"])
        for w, (a, kind, b) in spans:
            i, s, _ = part[w]
            m = marg[:, hit.index(w)]
            each = m[np.arange(a - s, b - s), tags[a - s : b - s, w]]
            score = float(each.mean()) if each.min() >= 0.5 else 0.0
            found[i][a, kind, b] = max(score, found[i].get((a, kind, b), 0.0))
    return [sorted([*b, *_reconcile(f)]) for b, f in zip(base, found, strict=True)]


class _Taken:
    """Ranges that are taken, merged and in order, so a question costs a binary search."""

    def __init__(self, spans=()):
        self.lo: list[int] = []
        self.hi: list[int] = []
        for lo, _, hi in sorted(spans):
            if self.hi and lo <= self.hi[-1]:
                self.hi[-1] = max(self.hi[-1], hi)
            else:
                self.lo.append(lo)
                self.hi.append(hi)

    def meets(self, span) -> bool:
        at = bisect_right(self.hi, span[0])
        return at < len(self.lo) and self.lo[at] < span[2]

    def take(self, span) -> None:
        """Add a span that meets none."""
        at = bisect_right(self.lo, span[0])
        self.lo.insert(at, span[0])
        self.hi.insert(at, span[2])


def _collect(tags, lo, hi, size):
    """Spans that one stretch, from ``lo`` to ``hi`` of a text of ``size`` characters, sees whole."""
    k, n, out = 0, hi - lo, []
    while k < n:
        if not tags[k]:
            k += 1
            continue
        kind, end = (tags[k] - 1) // 2, k + 1
        while end < n and tags[end] == 2 + 2 * kind:
            end += 1
        if (k > 0 or lo == 0) and (end < n or hi == size):
            out.append((lo + k, int(kind), lo + end))
        k = end
    return out


def _reconcile(found: dict) -> list[tuple[int, int, int]]:
    """Of overlapping spans the surest, of equals the first."""
    out, taken = [], _Taken()
    for x, score in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if score >= SURE and not taken.meets(x):
            out.append(x)
            taken.take(x)
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


def mask(text: str | None, spans) -> str | None:
    """``text`` with every span replaced by its kind in brackets; overlapping spans count as one."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for lo, k, hi in spans:
        if lo >= at:
            out += [text[at:lo], f"[{KINDS[k].upper()}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def detect(docs: DataFrame, model: SpanModel, text: str = "text", out: str = "pii_spans", masked: str | None = None) -> DataFrame:
    """``docs`` with all spans (kind, start, end, base) of each whole text and, if named, the masked text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def make():
        def run(texts):
            base = [base_spans(t) for t in texts]
            every = _added(shared.value, texts, base)
            spans = [[{"kind": KINDS[x[1]], "start": x[0], "end": x[2], "base": x in held} for x in s] for s, held in zip(every, map(set, base), strict=True)]
            if masked:
                return spans, [mask(t, s) for t, s in zip(texts, every, strict=True)]
            return (spans,)

        return run

    fields = [(out, pa.list_(_SPAN), "array<struct<kind:string,start:int,end:int,base:boolean>>")]
    if masked:
        fields.append((masked, pa.string(), "string"))
    return append_by_text(docs, text, fields, make)


def digest(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` without the text: counts of base spans, their digest, and all spans in writing."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts):
            base = [base_spans(t) for t in texts]
            every = _added(shared.value, texts, base)
            counts = [[sum(x[1] == k for x in b) for b in base] for k in range(len(KINDS))]
            return (*counts, [sha256(written(b).encode()).hexdigest() for b in base], [written(s) for s in every])

        return run

    fields = [(f"n_{k}", pa.int64(), "bigint") for k in KINDS] + [("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string")]
    return append_by_text(docs, text, fields, make).drop(text)
