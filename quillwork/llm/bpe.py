"""Byte-pair encoding over public vocabulary files, with a segment tree over adjacent pair ranks.

A word of n symbols has n - 1 adjacent pairs. The tree's leaves hold ``rank * width + position``
of each pair, so its root is the leftmost pair of the lowest rank. A merge changes three leaves,
each in O(log n); the word is done when the root is infinite. Many short words are merged
together, one merge of every word a step, with numpy holding one tree per row; a long word has a
tree of its own.

Words are encoded once and kept in a cache of bounded size, as real text repeats its words.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np

INF = np.int32(2**31 - 1)
#: Words of more symbols than this have a tree of their own.
LONG_WORD = 192
#: Words in the cache; one of this size takes about 150 MB.
CACHE_WORDS = 600_000
#: Characters of its words, as some sources have words of many thousands of characters.
CACHE_CHARS = 32 << 20
#: Characters of a text that are handed to the word splitter at once, at a safe boundary.
SEGMENT_CHARS = 1 << 18

# Letters and numbers of Latin-1 and Latin Extended-A, by Unicode category.
_L = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼½¾"
#: A text with any other character is split by the library, which knows all of Unicode.
_ODD = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-įı-ſ]")
#: Marks at the end of a run that a letter stands before: a word of their own, so that a word and the
#: same word before a comma are one key of the cache.
_TAIL = re.compile(f"[.,;:!?]+(?<=[{_L}][.,;:!?])(?=\\s|\\Z)")
_SPLIT = {
    "lower_words": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+"),
    "byte_level": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+"),
}


def byte_chars() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """(left id, right id) to (rank, merged id): open addressing in numpy."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, INF, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        # The first rule of a pair counts; later ranks for the same pair can't occur.
        todo = np.arange(len(keys))
        at = self._slot(keys)
        while len(todo):
            free = self.keys[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.keys[slot], self.rank[slot], self.merged[slot] = keys[won], won, merged[won]
            left_over = ~np.isin(todo, won)
            todo, at = todo[left_over], (at[left_over] + 1) & self.mask
        self.plain = {int(k): (i, int(m)) for i, (k, m) in enumerate(zip(keys, merged, strict=True))}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (INF where no rule) and merged ids."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        while True:
            there = self.keys[at]
            miss = (there != keys) & (there != -1)
            if not miss.any():
                break
            at = np.where(miss, (at + 1) & self.mask, at)
        return np.where(there == keys, self.rank[at], INF), self.merged[at]


class Bpe:
    """Encoder and decoder for one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max(chain(vocab.values(), self.special.values())) + 1)
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.pairs = PairTable(*np.array(ids, np.int64).T)
        chars = byte_chars()
        self.first = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + self.suffix] for b in range(256)], np.int32)
        self.lower = spec.get("normalizer") is not None
        self.split = _SPLIT["lower_words" if self.lower else "byte_level"]
        self.joined_by_space = spec.get("decoder") is None
        self._bytes = {c: b for b, c in chars.items()}
        spaced = [f"{t} ".encode() for t in self.tokens]
        self._token_bytes = np.frombuffer(b"".join(spaced), np.uint8)
        self._token_sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
        self._token_starts = np.cumsum(self._token_sizes) - self._token_sizes
        self._library = Tokenizer.from_file(path)
        self._marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._forget()

    # -- splitting ---------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, before any merge, as keys of the cache."""
        if len(text) <= SEGMENT_CHARS:
            return self._split(text)
        return list(chain.from_iterable(map(self._split, segments(text))))

    def _split(self, text: str) -> list[str]:
        """Keys of the cache. Where white space always ends a word, one key is a run between it,
        split further when it is new; ``\\n`` before a key says that it is one word already."""
        if _ODD.search(text):
            if self._library.normalizer is not None:
                text = self._library.normalizer.normalize_str(text)
            pieces = self._library.pre_tokenizer.pre_tokenize_str(text)
            return ["\0" + bytes(map(self._bytes.__getitem__, p)).decode("utf-8", "surrogateescape") for p, _ in pieces]
        return _TAIL.sub(r" \g<0>", text.lower()).split() if self.lower else self.split.findall(text)

    def _words_of(self, key: str) -> list[str]:
        if key[0] == "\0" and len(key) > 1:
            return [key[1:]]
        return self.split.findall(key) if self.lower else [key]

    def keys(self, text: str) -> list[str]:
        """The keys of a whole text; ``\\2`` stands before a special string."""
        if not any(s in text for s in self.special):
            return self.words(text)
        parts = [[f"\2{s}"] if s in self.special else self.words(s) for s in self._marks.split(text) if s]
        return list(chain.from_iterable(parts))

    # -- merging -----------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raws = [w.encode("utf-8", "surrogateescape") for w in words]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        out = [b""] * len(raws)
        for i in np.flatnonzero(sizes == 1).tolist():
            out[i] = int(self.last[raws[i][0]]).to_bytes(4, "little")
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] = self._merge_long(raws[i]).astype("<u4").tobytes()
        width = 2
        while width < 2 * LONG_WORD:
            rows = np.flatnonzero((sizes > width // 2) & (sizes <= min(width, LONG_WORD))).tolist()
            step = max(1, (1 << 18) // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part, self._merge_many([raws[i] for i in part], width), strict=True):
                    out[i] = ids
            width *= 2
        return out

    def _symbols(self, raw: bytes) -> np.ndarray:
        ids = self.first[np.frombuffer(raw, np.uint8)]
        ids[-1] = self.last[raw[-1]]
        return ids

    def _merge_many(self, raws: list[bytes], width: int) -> list[bytes]:
        """width: a power of two, at least each word's length. Row r of each array is word r."""
        count = len(raws)
        size = np.fromiter(map(len, raws), np.int64, count)
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(count, width)
        sym = self.first[flat]
        every = np.arange(count)
        sym[every, size - 1] = self.last[flat[every, size - 1]]
        place = np.arange(width, dtype=np.int32)
        live = place[None, :] < size[:, None]
        nxt = np.where(place + 1 < size[:, None], place + 1, width).astype(np.int32)  # width: no right neighbour
        prv = np.broadcast_to(place - 1, (count, width)).copy()
        tree = np.full((count, 2 * width), INF, np.int32)
        rank, _ = self.pairs.find(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        rank = rank.reshape(count, width - 1)
        ok = live[:, 1:] & (rank < INF)
        tree[:, width : 2 * width - 1] = np.where(ok, rank * width + place[:-1], INF)
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        # From here on the arrays are flat: word r's symbols start at r * width, its tree at 2 * r * width.
        sym, nxt, prv, alive, tree = sym.ravel(), nxt.ravel(), prv.ravel(), live.ravel(), tree.ravel()

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            base, node = 2 * width * row, at + width
            tree[base + node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                left = base + 2 * node
                tree[base + node] = np.minimum(tree[left], tree[left + 1])

        def pair_key(row: np.ndarray, at: np.ndarray) -> np.ndarray:
            base = row * width
            right = nxt[base + at]
            there = right < width
            r, _ = self.pairs.find(sym[base + at], sym[base + np.where(there, right, 0)])
            return np.where(there & (r < INF), r * width + at, INF)

        rows = np.flatnonzero(tree[1 :: 2 * width] < INF)
        while len(rows):
            base = rows * width
            at = tree[2 * base + 1] % width
            here = base + at
            right = nxt[here]
            _, merged = self.pairs.find(sym[here], sym[base + right])
            after = nxt[base + right]
            sym[here], nxt[here], alive[base + right] = merged, after, False
            has = after < width
            prv[(base + after)[has]] = at[has]
            before = prv[here]
            has = before >= 0
            changed, where = np.concatenate([rows, rows[has]]), np.concatenate([at, before[has]])
            put(
                np.concatenate([rows, changed]),
                np.concatenate([right, where]),
                np.concatenate([np.full(len(rows), INF), pair_key(changed, where)]),
            )
            rows = rows[tree[2 * base + 1] < INF]
        ids = sym[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.reshape(count, width).sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, raw: bytes) -> np.ndarray:
        """One long word: the same tree in plain Python, O(log n) a merge."""
        sym = self._symbols(raw).tolist()
        n = len(sym)
        width = 1 << (n - 1).bit_length()
        none = int(INF)
        rules = self.pairs.plain
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def key(i: int) -> int:
            j = nxt[i]
            rule = rules.get((sym[i] << 32) | sym[j]) if j >= 0 else None
            return rule[0] * width + i if rule else none

        for i in range(n):
            tree[width + i] = key(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
                k >>= 1

        while tree[1] < none:
            i = tree[1] % width
            j = nxt[i]
            sym[i] = rules[(sym[i] << 32) | sym[j]][1]
            sym[j] = -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            put(j, none)
            put(i, key(i))
            if prv[i] >= 0:
                put(prv[i], key(prv[i]))
        return np.array([s for s in sym if s >= 0], np.int32)

    # -- texts -------------------------------------------------------------------------------

    def _forget(self) -> None:
        """An empty cache: key to its place, and each place's run of ids in one array."""
        self._places: defaultdict[str, int] = defaultdict()
        self._places.default_factory = self._places.__len__
        self._chars = 0
        self._ids, self._starts, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of these keys, which have the next places."""
        self._chars += sum(map(len, new))
        plain = [key.isalpha() if self.lower else False for key in new]
        words = [[key] if p else [] if key[0] == "\2" else self._words_of(key) for key, p in zip(new, plain, strict=True)]
        several = list(dict.fromkeys(chain.from_iterable(words)))
        ids = dict(zip(several, self.encode_words(several), strict=True))
        runs = [self.special[key[1:]].to_bytes(4, "little") if key[0] == "\2" else ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for key, ws in zip(new, words, strict=True)]
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        self._starts = np.append(self._starts, len(self._ids) + np.cumsum(sizes) - sizes)
        self._sizes = np.append(self._sizes, sizes)
        self._ids = np.append(self._ids, np.frombuffer(b"".join(runs), "<u4"))

    def _looked_up(self, texts: list[str]) -> list[np.ndarray]:
        """The places of each text's keys in the cache, which holds the ids of all of them."""
        if len(self._places) > CACHE_WORDS or self._chars > CACHE_CHARS:
            self._forget()
        place, known = self._places.__getitem__, len(self._places)
        found = []
        for text in texts:
            keys = self.keys(text)
            found.append(np.fromiter(map(place, keys), np.int64, len(keys)))
        self._learn([*islice(reversed(self._places), len(self._places) - known)][::-1])
        return found

    def count_batch(self, texts: list[str]) -> list[int]:
        """Each text's number of ids."""
        return [int(self._sizes[at].sum()) for at in self._looked_up(texts)]

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for at in self._looked_up(texts):
            sizes = self._sizes[at]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            yield self._ids[np.repeat(self._starts[at] - ends + sizes, sizes) + np.arange(total)].tobytes()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, special tokens kept, of a vocabulary whose tokens are joined by spaces."""
        ids = np.asarray(ids, np.int64)
        sizes = self._token_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self._token_bytes[np.repeat(self._token_starts[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()[:-1]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids, special tokens kept."""
        if self.joined_by_space:
            return self.decode_bytes(ids).decode()
        tokens = map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)
        special, out, raw = set(self.special), [], bytearray()
        for t in tokens:
            if t in special:
                out.append(raw.decode("utf-8", "replace"))
                out.append(t)
                raw = bytearray()
            else:
                raw.extend(map(self._bytes.__getitem__, t))
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cuts a text before single spaces between two other characters, which no word of either
    vocabulary spans; a stretch without such a place stays whole."""
    start, n = 0, len(text)
    while n - start > limit:
        at = _boundary(text, start, start + limit)
        if at < 0:
            at = _boundary_after(text, start + limit)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def _boundary(text: str, start: int, end: int) -> int:
    at = text.rfind(" ", start + 1, end)
    while at > start and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace() or at + 1 >= len(text)):
        at = text.rfind(" ", start + 1, at)
    return at if at > start else -1


_CUT = re.compile(r"(?<=\S) (?=\S)")


def _boundary_after(text: str, start: int) -> int:
    found = _CUT.search(text, start)
    return found.start() if found else -1


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One encoder a worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Bpe(path)


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
