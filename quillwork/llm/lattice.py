"""Marginal probability of a word over all its segmentations into pieces of a public vocabulary.

A word is spelled with a start mark, and a piece with that mark can only begin a word, so a text's
pieces say where its words are. Arcs of the lattice are the vocabulary's pieces; besides them any
single character can be spelled in its UTF-8 bytes. Words of one length are worked on together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
MARK = "▁"
_BASE = 0x9E3779B97F4A7C15
#: Words longer than this are worked on alone, in plain Python.
LONG = 96


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: dict[str, int] = {}
        self.byte = np.zeros(256, np.int64)
        self.size = sp.get_piece_size()
        #: The file's own score of each piece; pieces without one (bytes, marks) get the least.
        self.score = np.full(self.size, np.nan)
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[piece] = i
                self.score[i] = sp.get_score(i)
        self.score[np.isnan(self.score)] = np.nanmin(self.score)
        self.longest = max(map(len, self.text))
        keys = np.array([self._hash(p) for p in self.text], np.uint64)
        bits = int(len(keys) * 3).bit_length()
        self.mask, self.shift = (1 << bits) - 1, U(64 - bits)
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for key, i in zip(keys.tolist(), self.text.values(), strict=True):
            at = self._slot(key)
            while self.ids[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ids[at] = key, i

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * _BASE + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _slot(self, key: int) -> int:
        return ((key * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        at = ((h * U(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)
        while True:
            ids = self.ids[at]
            miss = (ids >= 0) & (self.keys[at] != h)
            if not miss.any():
                return ids
            at = np.where(miss, (at + 1) & self.mask, at)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def prior(p: Pieces) -> np.ndarray:
    """Weights from the file's scores, which fall by one from each piece to the next less frequent:
    probability in inverse proportion to that rank."""
    rank = p.score.max() - p.score
    return np.log(1.0 / (rank + 3.0) / (1.0 / (rank + 3.0)).sum())


class Lattice:
    """logp: natural log of each piece's probability."""

    def __init__(self, p: Pieces, logp: np.ndarray):
        self.p, self.logp = p, logp
        self.by_text = {t: float(logp[i]) for t, i in p.text.items()}

    def _spelled(self, ch: str) -> tuple[list[int], float]:
        ids = [int(self.p.byte[b]) for b in ch.encode("utf-8", "surrogatepass")]
        return ids, float(self.logp[ids].sum())

    def score(self, words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word and, with weights, the expected count of each piece."""
        out, counts = np.zeros(len(words)), np.zeros(self.p.size)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, rows in by_size.items():
            if size + 1 > LONG:
                for i in rows:
                    out[i] = self._long(MARK + words[i], None if weights is None else weights[i], counts)
                continue
            for a in range(0, len(rows), 20_000):
                part = rows[a : a + 20_000]
                out[part] = self._many([MARK + words[i] for i in part], size + 1, None if weights is None else weights[part], counts)
        return out, counts

    def _many(self, words: list[str], n: int, weights: np.ndarray | None, counts: np.ndarray) -> np.ndarray:
        code = np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        chars, which = np.unique(code, return_inverse=True)
        spelled = [self._spelled(chr(c)) for c in chars.tolist()]
        spell = np.array([s for _, s in spelled])[which.reshape(code.shape)]
        arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]  # by end: (start, ids, logp)
        ahead = np.full((n + 1, len(words)), -np.inf)
        ahead[0] = 0
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(n, i + self.p.longest) + 1):
                h = h * U(_BASE) + code[:, j - 1] + U(1)
                ids = self.p.find(h)
                if (ids >= 0).any():
                    arcs[j].append((i, ids, np.where(ids >= 0, self.logp[ids], -np.inf)))
        for j in range(1, n + 1):
            ahead[j] = ahead[j - 1] + spell[:, j - 1]
            for i, _, lp in arcs[j]:
                ahead[j] = np.logaddexp(ahead[j], ahead[i] + lp)
        total = ahead[n]
        if weights is not None:
            back = np.full((n + 1, len(words)), -np.inf)
            back[n] = 0
            for j in range(n, 0, -1):
                via = np.exp(ahead[j - 1] + spell[:, j - 1] + back[j] - total) * weights
                back[j - 1] = np.logaddexp(back[j - 1], spell[:, j - 1] + back[j])
                per_char = np.bincount(which.reshape(code.shape)[:, j - 1], via, len(chars))
                for (ids, _), w in zip(spelled, per_char.tolist(), strict=True):
                    if w:
                        np.add.at(counts, ids, w)
                for i, ids, lp in arcs[j]:
                    there = ids >= 0
                    via = np.exp((ahead[i] + lp + back[j] - total)[there]) * weights[there]
                    counts += np.bincount(ids[there], via, len(counts))
                    back[i] = np.logaddexp(back[i], lp + back[j])
        return total

    def _long(self, word: str, weight: float | None, counts: np.ndarray) -> float:
        n, longest, get = len(word), self.p.longest, self.by_text.get
        arcs = [[(i, lp) for i in range(max(0, j - longest), j) if (lp := get(word[i:j])) is not None] for j in range(n + 1)]
        spell = [self._spelled(ch)[1] for ch in word]
        ahead = [0.0] + [-np.inf] * n
        for j in range(1, n + 1):
            terms = [ahead[j - 1] + spell[j - 1], *(ahead[i] + lp for i, lp in arcs[j])]
            top = max(terms)
            ahead[j] = top + float(np.log(sum(np.exp(t - top) for t in terms)))
        if weight:
            back = [-np.inf] * n + [0.0]
            for j in range(n, 0, -1):
                for i, lp, ids in [(j - 1, spell[j - 1], self._spelled(word[j - 1])[0]), *((i, lp, [self.p.text[word[i:j]]]) for i, lp in arcs[j])]:
                    np.add.at(counts, ids, weight * float(np.exp(ahead[i] + lp + back[j] - ahead[n])))
                    back[i] = float(np.logaddexp(back[i], lp + back[j]))
        return ahead[n]
