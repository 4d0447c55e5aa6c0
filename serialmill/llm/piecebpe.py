"""SentencePiece encoding (models of the merge type) and decoding, by exact backtracking.

The encoding of a fragment is the one sequence of pieces in which every two neighbours, merged again
from their characters, come out as those two pieces. It is searched from the left: an Aho-Corasick
automaton gives the longest piece at every position; a piece is taken when it agrees with the one
before it (a re-merge of both, remembered), else the next shorter piece that begins it is tried; where
none is left the position is marked in a bitfield of failed positions, and the last piece is taken back.
As the encoding of a prefix is unique, a failed position fails whichever way it is reached, so the search is
near linear in the length.

Fragments are runs of spaces with the characters that follow, which no piece crosses, cut again at
characters that occur in no piece (those become byte pieces). Equal fragments have equal ids, so each task
keeps a bounded memo of them. Pieces that share one lowest score (runs of spaces) are merged after all
others, leftmost first, over what the search gave.

Defined results: null and the empty text have no ids; the strings of control pieces in a text are ordinary
text; very long texts and fragments are encoded whole; repeated rows and ties give a row each; input columns named
like a result are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from serialmill.llm.bpe import PieceMemo, strung
from serialmill.llm.common import append_by_text

#: The mark that stands for a space in model files, and the kinds of pieces there.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Pairs of pieces whose agreement a worker remembers.
PAIRS = 1 << 20
_FRAGMENT = re.compile(r" +[^ ]*|[^ ]+")


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, read on the driver; a model has a fixed size of a few hundred KB and is broadcast."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not (rules.remove_extra_whitespaces or rules.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix)
    if model.trainer_spec.model_type != 2 or not plain or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
        raise ValueError("only merge models with byte pieces, an identity normaliser and a space put before each text are supported")
    return [(p.piece, p.score, p.type) for p in model.pieces]


def merged(symbols: list[str], score: dict[str, float]) -> list[str]:
    """Merge neighbours while their union has a score: the best score first, the leftmost of equals. A heap over a linked list, so long runs stay near linear."""
    syms, n = list(symbols), len(symbols)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-score[u], i, i + 1, len(u)) for i in range(n - 1) if (u := syms[i] + syms[i + 1]) in score]
    heapq.heapify(heap)
    while heap:
        _, i, j, size = heapq.heappop(heap)
        if not syms[i] or not syms[j] or len(syms[i]) + len(syms[j]) != size:
            continue
        syms[i] += syms[j]
        syms[j] = ""
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (u := syms[a] + syms[b]) in score:
                heapq.heappush(heap, (-score[u], a, b, len(u)))
    return [s for s in syms if s]


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.names = [p.replace(MARK, " ") for p, _, _ in pieces]
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else n.encode() if kind == NORMAL else b"" for n, (p, _, kind) in zip(self.names, pieces, strict=True)]
        self.byte_id = {self.bytes[i][0]: i for i, p in enumerate(pieces) if p[2] == BYTE}
        self.id = {n: i for i, n in enumerate(self.names) if pieces[i][2] == NORMAL}
        score = {n: pieces[i][1] for n, i in self.id.items()}
        lowest = min(score.values())
        self.late = {n: s for n, s in score.items() if s == lowest and len(n) > 1}
        self.score = {n: s for n, s in score.items() if n not in self.late and len(n) > 1}
        spaces = all(not n.strip(" ") for n in self.late)
        if len(set(self.score.values())) < len(self.score) or not spaces or any("  " in n for n in self.score) or any(" " in n[1:] for n in self.score):
            raise ValueError("pieces with equal scores, but for runs of spaces, or with a space inside are not supported")
        self.alphabet = set("".join(self.id))
        self.size = len(pieces)
        for c in sorted(self.alphabet - set(self.id)):  # characters that only longer pieces hold stand for their bytes
            self.id[c] = len(self.names)
            self.names.append(c)
        self.lone = {i: self.byte_ids(n) for n, i in self.id.items() if i >= self.size}
        self.foreign = re.compile("([^" + "".join(map(re.escape, sorted(self.alphabet))) + "])")
        usable = [n for n in self.id if n not in self.late and (len(n) == 1 or merged(list(n), self.score) == [n])]
        self.length = [len(n) for n in self.names]
        at, self.shorter = {n: self.id[n] for n in usable}, [-1] * len(self.names)
        self.matcher = ahocorasick.Automaton()
        for n, i in at.items():
            self.matcher.add_word(n, i)
            self.shorter[i] = next((at[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in at), -1)
        self.matcher.make_automaton()
        self.agreed: dict[int, bool] = {}

    def byte_ids(self, c: str) -> list[int]:
        return [self.byte_id[b] for b in c.encode()]

    def agree(self, a: int, b: int) -> bool:
        """Do the characters of both pieces, merged again, give the two pieces?"""
        key = a * len(self.names) + b
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) >= PAIRS:
                self.agreed.clear()
            known = self.agreed[key] = merged(list(self.names[a] + self.names[b]), self.score) == [self.names[a], self.names[b]]
        return known

    def search(self, s: str) -> list[int]:
        """The pieces of a fragment whose characters all occur in pieces, before late merges."""
        n, length, shorter, agree = len(s), self.length, self.shorter, self.agree
        longest = [-1] * n
        for end, i in self.matcher.iter(s):  # by rising ends, so the longest of a position comes last
            longest[end + 1 - length[i]] = i
        failed, out, at, take = bytearray(n // 8 + 1), [], 0, longest[0]
        while at < n:
            while take >= 0:
                end = at + length[take]
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or agree(out[-1], take)):
                    break
                take = shorter[take]
            if take >= 0:
                out.append(take)
                at, take = end, longest[end] if end < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at, take = at - length[last], shorter[last]
        return out

    def encode(self, s: str) -> list[int]:
        """The ids of a fragment: one foreign character, or characters that occur in pieces."""
        if s not in self.alphabet and len(s) == 1:
            return self.byte_ids(s)
        out = self.search(s)
        if "  " in s:
            out = [self.id[x] for x in merged([self.names[i] for i in out], self.late)]
        if self.lone:
            out = [j for i in out for j in self.lone.get(i, (i,))]
        return out


class Fragments(PieceMemo):
    """The memo of fragments; those with foreign characters are put together from their parts."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(self._make, {}, np.uint16 if vocab.size <= 1 << 16 else np.uint32)
        self.v = vocab

    def _make(self, parts: list[str], spaced: bool):
        ids = [self.v.encode(p) for p in parts]
        return np.array([i for x in ids for i in x], self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))

    def cut(self, text: str) -> list[str]:
        return _FRAGMENT.findall(text)

    def _learn(self, new: list[str], spaced: bool) -> None:
        known, whole, mixed = self.known[spaced], [], []
        for p in new:
            parts = self.v.foreign.split(p)
            (whole if len(parts) == 1 or len(p) == 1 and not spaced else mixed).append((p, parts))
        if whole:
            at = self._store(*self.make([" " + p if spaced else p for p, _ in whole], spaced))
            known.update(zip((p for p, _ in whole), range(at, at + len(whole)), strict=True))
        if mixed:
            first = self._numbers([parts[0] for _, parts in mixed], spaced)  # a space alone, where nothing else is before the foreign character
            rest = [[x for x in parts[1:] if x] for _, parts in mixed]
            numbers, edge = self._numbers([x for r in rest for x in r], False), np.concatenate([[0], np.cumsum([len(r) for r in rest])])
            for k, (p, _) in enumerate(mixed):
                of = np.concatenate([first[k : k + 1], numbers[edge[k] : edge[k + 1]]])
                known[p] = self._store(self.ids[strung(self.begin[of], self.size[of])], self.size[of].sum(keepdims=True))


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.v, self.memo = vocab, Fragments(vocab)
        self.numerals = list(map(str, range(vocab.size)))

    def encode(self, texts):
        """The ids of each text. A space goes before a text that is not empty, and the mark is read as a space."""
        for ids, lengths in self.memo.encode([" " + t.replace(MARK, " ") if t else "" for t in texts]):
            yield from np.split(ids, np.cumsum(lengths)[:-1])

    def decode(self, ids) -> str:
        raw = b"".join(map(self.v.bytes.__getitem__, ids))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


_made: dict[int, Encoder] = {}


def encoder_for(pieces: list[tuple[str, float, int]]) -> Encoder:
    """One encoder for each worker process; tasks that follow reuse its tables and memo."""
    key = hash(tuple(pieces))
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(Vocabulary(pieces))
    return _made[key]


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def make():
        enc = encoder_for(pieces.value)
        return lambda texts: ([x.astype(np.int32) for x in enc.encode(texts)],)

    return append_by_text(docs, text, [(out, pa.list_(pa.int32()), "array<int>")], make)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list; null stays null."""
    pieces = df.sparkSession.sparkContext.broadcast(read_model(model))

    def make():
        enc = encoder_for(pieces.value)
        return lambda lists: ([None if x is None else enc.decode(x) for x in lists],)

    return append_by_text(df, ids, [(out, pa.string(), "string")], make)


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens and the digests of the ids and of the text decoded from them. Both directions run in one pass."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def make():
        enc = encoder_for(pieces.value)

        def run(texts):
            n, a, b = [], [], []
            for x in enc.encode(texts):
                ids = x.tolist()
                n.append(len(ids))
                a.append(sha256(",".join(map(enc.numerals.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(enc.decode(ids).encode()).hexdigest())
            return n, a, b

        return run

    made = append_by_text(docs, text, [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")], make)
    return made.drop(text)
