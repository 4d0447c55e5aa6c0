"""Language identification with a string kernel.

The kernel of two texts is the normalised count of 1-, 2- and 3-grams that both hold (a blended
spectrum of presences, hashed to DIM places). Nyström landmarks, as many for each language, turn
it into a feature map; kernel ridge regression, one against the rest, is solved in that map. A
batch of texts is scored by two matrix products.

The model is fitted on at most ``sample_rows`` labelled rows (smallest key hashes) so the driver's
work is bounded; every text is scored whole. Defined results: null text, or one without any letter,
gives ``und`` with score 0; without labelled rows every text is ``und``; ties go to the language
that sorts first; repeated rows get equal rows (the sample holds one of each id); very long texts are read
whole; columns named like a result are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialmill.llm.common import append_by_text, bounded_sample

DIM_BITS = 13
DIM = 1 << DIM_BITS
UNKNOWN = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
_CHUNK = 1 << 20


@dataclass
class LanguageModel:
    labels: list[str]
    landmarks: np.ndarray  # (m, DIM) uint8 presences
    weights: np.ndarray  # (m, n_labels)


def presence(text: str, row: np.ndarray) -> None:
    """Set row[h] for each 1-, 2- and 3-gram of the lower-cased text with white space folded."""
    cps = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shift = np.uint32(32 - DIM_BITS)
    for lo in range(0, len(cps), _CHUNK):
        c = cps[lo : lo + _CHUNK + 2]
        h = c * _MIX[0]
        row[(h * _MIX[1]) >> shift] = 1
        if len(c) > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[1] + c[1:]
            row[(h * _MIX[2]) >> shift] = 1
        if len(c) > 2:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * _MIX[2] + c[2:]
            row[(h * _MIX[0]) >> shift] = 1


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    a, b = rows.astype(np.float32), landmarks.astype(np.float32)
    return (a @ b.T) / np.sqrt(np.maximum(a.sum(1), 1)[:, None] * np.maximum(b.sum(1), 1)[None])


def fit_rows(texts: list[str], labels: list[str], landmarks_each: int = 40, ridge: float = 1e-2) -> LanguageModel | None:
    use = [i for i, t in enumerate(texts) if has_letter(t) and labels[i] is not None]
    names = sorted({labels[i] for i in use})
    if not names:
        return None
    rows = np.zeros((len(use), DIM), dtype=np.uint8)
    for k, i in enumerate(use):
        presence(texts[i], rows[k])
    y = np.array([names.index(labels[i]) for i in use])
    marks = rows[np.concatenate([np.flatnonzero(y == c)[:landmarks_each] for c in range(len(names))])]
    vals, vecs = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = vals > 1e-6 * vals.max()
    root = vecs[:, keep] / np.sqrt(vals[keep])
    phi = np.concatenate([kernel(rows[i : i + 256], marks) for i in range(0, len(rows), 256)]) @ root
    target = np.where(y[:, None] == np.arange(len(names))[None], 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]  # each language counts the same
    gram = phi.T @ (phi * weight[:, None]) + ridge / len(names) * np.eye(phi.shape[1])
    beta = np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return LanguageModel(names, marks, (root @ beta).astype(np.float32))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = 2400) -> LanguageModel | None:
    rows = bounded_sample(docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(key, text, label), key, sample_rows)
    return fit_rows([r[text] for r in rows], [r[label] for r in rows])


def scorer(model: LanguageModel | None, block: int = 128):
    def make():
        if model is None:
            return lambda texts: ([UNKNOWN] * len(texts), [0.0] * len(texts))
        marks = model.landmarks.astype(np.float32)
        scale = 1 / np.sqrt(np.maximum(marks.sum(1), 1))
        right = np.ascontiguousarray(marks.T * scale)

        def score(texts):
            best, value = [UNKNOWN] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if has_letter(t)]
            for lo in range(0, len(todo), block):
                part = todo[lo : lo + block]
                rows = np.zeros((len(part), DIM), dtype=np.float32)
                for k, i in enumerate(part):
                    presence(texts[i], rows[k])
                k_xm = (rows @ right) / np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
                f = k_xm @ model.weights
                for i, c, v in zip(part, f.argmax(1), f.max(1), strict=True):
                    best[i], value[i] = model.labels[c], float(min(max((v + 1) / 2, 0.0), 1.0))
            return best, value

        return score

    return make


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; every text is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: landmarks x DIM bytes
    return append_by_text(docs, text, [(out, pa.string(), "string"), (score, pa.float64(), "double")], lambda: scorer(shared.value)())
