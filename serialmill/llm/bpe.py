"""Byte-level BPE encoding and decoding by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be merged over, so every
such pair marks a certain cut. Texts are cut where a space begins a new word (no token holds a
non-space byte followed by a space), the words are split by the tokenizer's own pattern, and the
pieces are cut again at every other certain pair; fragments are encoded independently, and their
ids concatenated. Equal fragments have equal ids, so each task keeps a bounded memo of them.

Defined results: null counts as the empty text (no ids); the tokenizer's special tokens written in a
text are read as those tokens, as the tokenizers library does by default; very long texts are encoded
whole, a long fragment by a heap in near linear time; repeated rows and ties give a row each; input
columns named like a result are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from serialmill.llm.common import append_by_text

#: Fixed value: the pre-tokenization pattern of the byte-level family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000
TAIL = ".,;:!?"
_PLAIN = re.compile(r" (?:\s|$)")
_EDGE = re.compile(r"(?= \S)")


def pieces(text: str) -> list[str]:
    """Cut before each space that starts a word; runs of white space stay with what they follow or start."""
    if _PLAIN.search(text):
        return [p for p in _EDGE.split(text) if p]
    first, *rest = text.split(" ")
    out = [" " + p for p in rest]
    if first:
        out.insert(0, first)
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this family: visible Latin-1 stands for itself, others from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, spec: str):
        """``spec``: the text of the tokenizer's JSON file."""
        j = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        stand_in = byte_alphabet()
        raw = lambda s: bytes(stand_in[c] for c in s)
        self.ids = {raw(t): i for t, i in j["model"]["vocab"].items() if t not in self.special}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.rank = {}
        for r, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = r
        inside = np.zeros((256, 256), bool)
        for t in self.ids:
            for x, y in zip(t, t[1:]):  # noqa: B905
                inside[x, y] = True
        self.pattern = regex.compile(PATTERN)

        self.inside_pairs = inside.reshape(-1)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.byte_id = np.full(256, -1, np.int64)
        for b, i in self.ids.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        self._pair_tables(size)

    def _pair_tables(self, size: int) -> None:
        """(left id, right id) -> rank and merged id, in two hash tables; the second holds what collides in the first."""
        left, right, made = (np.array(x, np.int64) for x in zip(*((self.ids[a], self.ids[b], self.ids[a + b]) for a, b in self.rank), strict=True))
        self.size, self.made = size, made
        keys, ranks, self.tables = left * size + right, np.arange(len(made)), []
        for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5):
            if not len(keys):
                break
            k, r = np.full(1 << 19, -1, np.int64), np.full(1 << 19, len(made), np.int32)
            h = self._slot(keys, mult)
            _, chosen = np.unique(h, return_index=True)
            k[h[chosen]], r[h[chosen]] = keys[chosen], ranks[chosen]
            self.tables.append((mult, k, r))
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, ranks = keys[rest], ranks[rest]
        if len(keys):
            raise ValueError("the merges do not fit the pair tables")

    @staticmethod
    def _slot(keys: np.ndarray, mult: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(mult)) >> np.uint64(45)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        out = np.full(keys.shape, len(self.made), np.int32)
        for mult, k, r in self.tables:
            h = self._slot(keys, mult)
            np.copyto(out, r[h], where=k[h] == keys)
        out[(left < 0) | (right < 0)] = len(self.made)
        return out

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of byte ids padded with -1 -> rows of token ids padded with -1: the merge of least rank, leftmost first, in all rows at once."""
        out, rows, none = np.full_like(ids, -1), np.arange(len(ids)), len(self.made)
        if ids.shape[1] < 2:
            return ids.copy()
        rank = self.ranks_of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(1)
            here = np.arange(len(rows))
            least = rank[here, at]
            live = least < none
            if not live.all():
                out[rows[~live], : ids.shape[1]] = ids[~live]
                rows, ids, rank, at, least = rows[live], ids[live], rank[live], at[live], least[live]
                here = np.arange(len(rows))
            if not len(rows):
                break
            cols = np.arange(ids.shape[1] - 1)[None] <= at[:, None]
            ids = np.where(cols, ids[:, :-1], ids[:, 1:])  # the right half of the pair falls out
            ids[here, at] = self.made[least]
            if ids.shape[1] < 2:
                break
            # ranks move along; only the two pairs beside the new token are looked up
            rank = np.where(cols[:, :-1], rank[:, :-1], rank[:, 1:])
            last = ids.shape[1] - 1
            on = np.flatnonzero(at < last)
            rank[on, at[on]] = self.ranks_of(ids[on, at[on]], ids[on, at[on] + 1])
            on = np.flatnonzero(at > 0)
            rank[on, at[on] - 1] = self.ranks_of(ids[on, at[on] - 1], ids[on, at[on]])
        if len(rows):
            out[rows, : ids.shape[1]] = ids
        return out

    def merge_long(self, part: bytes) -> list[int]:
        """The same for a long fragment: a heap of pairs over a linked list, so the time stays near linear."""
        syms: list[bytes | None] = [part[i : i + 1] for i in range(len(part))]
        nxt, prv = list(range(1, len(syms) + 1)), list(range(-1, len(syms) - 1))
        heap = [(self.rank[p], i, p) for i, p in enumerate(zip(syms, syms[1:])) if p in self.rank]  # noqa: B905
        heapq.heapify(heap)
        n = len(syms)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = nxt[i]
            if syms[i] != pair[0] or j >= n or syms[j] != pair[1]:
                continue
            syms[i], syms[j] = pair[0] + pair[1], None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (p := (syms[a], syms[b])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], a, p))
        return [self.ids[s] for s in syms if s is not None]

    def encode_pieces(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has. All pieces are cut at certain pairs first; fragments of like length are merged together."""
        find = self.pattern.findall
        words, owner = [], []
        for k, p in enumerate(parts):
            if p.isalpha() or p[0] == " " and p[1:].isalpha():
                words.append(p.encode("utf-8", "replace"))
                owner.append(k)
                continue
            w = [x.encode("utf-8", "replace") for x in find(p)]
            words += w
            owner += [k] * len(w)
        if not words:
            return np.zeros(0, self.dtype), np.zeros(len(parts), np.int64)
        buf = np.frombuffer(b"".join(words), np.uint8)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.zeros(len(buf) + 1, bool)
        begins[np.cumsum(lens)] = True
        begins[0] = True
        pairs = buf[:-1].astype(np.int64) << 8 | buf[1:]
        begins[1:-1] |= ~self.inside_pairs[pairs]
        edge = np.flatnonzero(begins)
        start, size = edge[:-1], np.diff(edge)
        of = np.repeat(np.array(owner), lens)[start]
        raw = self.byte_id[buf]
        # tokens land at the place of their fragment's first bytes, then holes are squeezed out
        spot = np.full(len(buf), -1, np.int64)
        top = 0
        for top in (8, 16, 32, 64):
            pick = np.flatnonzero((size <= top) & (size > (top // 2 if top > 8 else 0)))
            for lo in range(0, len(pick), 20_000):
                f = pick[lo : lo + 20_000]
                idx = start[f, None] + np.arange(top)[None]
                inside = np.arange(top)[None] < size[f, None]
                rows = self.merge_rows(np.where(inside, raw[np.minimum(idx, len(buf) - 1)], -1))
                spot[idx[inside]] = rows[inside]
        for f in np.flatnonzero(size > 64):
            got = self.merge_long(buf[start[f] : start[f] + size[f]].tobytes())
            spot[start[f] : start[f] + len(got)] = got
        held = spot >= 0
        n = np.bincount(np.repeat(of, size)[held], minlength=len(parts))
        return spot[held].astype(self.dtype), n


def strung(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each run of ``size``, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class PieceMemo:
    """Texts -> ids through a bounded memo of pieces.

    Arrow cuts a batch of texts at their spaces and numbers its distinct words, each of which is looked up, or
    encoded, once; the ids of all texts are then gathered from the memo's one row of ids by a few vector operations.
    ``encode_pieces(parts, spaced)`` gets the new pieces at once, as (ids in a row, sizes); with ``spaced`` each of
    them is a space and a word without one.
    """

    def __init__(self, encode_pieces, special: dict[str, int], dtype, most: int = MEMO, batch_chars: int = 6_000_000):
        self.make, self.special, self.dtype, self.most, self.batch_chars = encode_pieces, special, dtype, most, batch_chars
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._clear()

    def _clear(self) -> None:
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})  # numbers of pieces, of words after a space
        self.begin, self.size, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.ids, self.used = np.zeros(1 << 14, self.dtype), 0
        self.known[False][""] = self._store(self.ids[:0], np.zeros(1, np.int64))
        for s, i in self.special.items():
            self.known[False][s] = self._store(np.array([i], self.dtype), np.ones(1, np.int64))

    def _store(self, ids: np.ndarray, size: np.ndarray) -> int:
        """Append pieces; the number of the first."""
        while self.n + len(size) > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = self.n
        self.begin[at : at + len(size)] = self.used + np.cumsum(size) - size
        self.size[at : at + len(size)] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = at + len(size), self.used + len(ids)
        return at

    def _learn(self, new: list[str], spaced: bool) -> None:
        known, ask, ends = self.known[spaced], {}, []
        for p in new:
            q = p.rstrip(TAIL)  # a letter or digit before punctuation is a certain cut, too
            if q and q != p and q[-1].isalnum() and ord(q[-1]) < 0x250:
                ends.append((p, q, p[len(q) :]))
                if q not in known:
                    ask[q] = None
            else:
                ask[p] = None
        if ask:
            at = self._store(*self.make([" " + p for p in ask] if spaced else list(ask), spaced))
            known.update(zip(ask, range(at, at + len(ask)), strict=True))
        if ends:
            tails = self._numbers([e[2] for e in ends], False)
            pair = np.stack([np.fromiter((known[e[1]] for e in ends), np.int64, len(ends)), tails], 1)
            sizes = self.size[pair]
            at = self._store(self.ids[strung(self.begin[pair].reshape(-1), sizes.reshape(-1))], sizes.sum(1))
            known.update(zip((e[0] for e in ends), range(at, at + len(ends)), strict=True))

    def _numbers(self, names: list[str], spaced: bool) -> np.ndarray:
        known = self.known[spaced]
        new = [p for p in names if p not in known]
        if new:
            new = list(dict.fromkeys(new))
            self._learn(new, spaced)
            self.long += [(spaced, p) for p in new if len(p) > 64]
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))

    def _special_in(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def cut(self, text: str) -> list[str]:
        if self._special_in(text):
            return [p for bit in self.split.split(text) for p in ([bit] if bit in self.special else pieces(bit) if bit else [])]
        return pieces(text)

    def encode(self, texts: list[str | None]):
        """Batch by batch: the ids of its texts in a row, and how many each text has."""
        part, held = [], 0
        for t in texts:
            part.append(t or "")
            held += len(part[-1])
            if held >= self.batch_chars:
                yield self._encode(part)
                part, held = [], 0
        if part:
            yield self._encode(part)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.most or self.used > 16 * self.most:
            self._clear()
        self.long: list[tuple[bool, str]] = []
        odd = np.array([bool(_PLAIN.search(t)) or self._special_in(t) for t in texts], bool)
        numbers, counts = self._plain([t for t, o in zip(texts, odd, strict=True) if not o])
        if odd.any():
            cut = [self.cut(t) for t, o in zip(texts, odd, strict=True) if o]
            other = np.concatenate([self._odd(x) for x in cut])
            size = np.zeros(len(texts), np.int64)
            size[~odd], size[odd] = counts, [len(x) for x in cut]
            begin = np.zeros(len(texts), np.int64)
            begin[~odd], begin[odd] = np.cumsum(size[~odd]) - size[~odd], len(numbers) + np.cumsum(size[odd]) - size[odd]
            numbers, counts = np.concatenate([numbers, other])[strung(begin, size)], size
        size = self.size[numbers]
        out = self.ids[strung(self.begin[numbers], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        lengths = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        for spaced, p in self.long:
            self.known[spaced].pop(p, None)
        return out, lengths

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of texts in which every space starts a word, and how many each text has."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        edge = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        inner = np.ones(len(code), bool)
        inner[edge[:-1]] = False
        used = np.flatnonzero(np.bincount(code[inner], minlength=len(names)))
        of = np.zeros(len(names), np.int64)
        of[used] = self._numbers([names[i] for i in used.tolist()], True)
        numbers = of[code]
        numbers[edge[:-1]] = self._numbers([names[i] for i in code[edge[:-1]].tolist()], False)
        return numbers, np.diff(edge).astype(np.int64)

    def _odd(self, parts: list[str]) -> np.ndarray:
        spaced = np.array([len(p) > 1 and p[0] == " " and " " not in p[1:] and not p[1].isspace() for p in parts], bool)
        out = np.zeros(len(parts), np.int64)
        out[spaced] = self._numbers([p[1:] for p, s in zip(parts, spaced, strict=True) if s], True)
        out[~spaced] = self._numbers([p for p, s in zip(parts, spaced, strict=True) if not s], False)
        return out


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.memo = PieceMemo(lambda parts, spaced: vocab.encode_pieces(parts), vocab.special, vocab.dtype)
        self.names = list(map(str, range(len(vocab.bytes))))

    def encode(self, texts):
        for ids, lengths in self.memo.encode(texts):
            yield from np.split(ids, np.cumsum(lengths)[:-1])

    def decode(self, ids) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids)).decode("utf-8", "replace")


def read_spec(path: str) -> str:
    """The tokenizer's file, read on the driver; it has a fixed size of a few MB and is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_made: dict[int, Encoder] = {}


def encoder_for(spec: str) -> Encoder:
    """One encoder for each worker process; tasks that follow reuse its tables and memo."""
    key = hash(spec)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(Vocabulary(spec))
    return _made[key]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def make():
        enc = encoder_for(spec.value)
        return lambda texts: ([x.astype(np.int32) for x in enc.encode(texts)],)

    return append_by_text(docs, text, [(out, pa.list_(pa.int32()), "array<int>")], make)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list."""
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def make():
        enc = encoder_for(spec.value)
        return lambda lists: ([None if x is None else enc.decode(x) for x in lists],)

    return append_by_text(df, ids, [(out, pa.string(), "string")], make)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens and the digests of the ids and of the text decoded from them.

    Both directions run in one pass, so ids never leave the task.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def make():
        enc = encoder_for(spec.value)

        def run(texts):
            n, a, b = [], [], []
            for x in enc.encode(texts):
                ids = x.tolist()
                n.append(len(ids))
                a.append(sha256(",".join(map(enc.names.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(enc.decode(ids).encode("utf-8", "replace")).hexdigest())
            return n, a, b

        return run

    made = append_by_text(docs, text, [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")], make)
    return made.drop(text)
