"""Segmentation of texts and of sequences of turns.

Rules on one text are expressions or vectorised functions of its column. Folds over the turns of a
conversation are sequential and run per conversation; a conversation's turns are bounded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Sentences ending in a mark before white space, or at a line's end; blanks go."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n"), lambda x: F.trim(x)), lambda x: x != "")


def parse_turns(text: Column) -> Column:
    """Turns of a transcript with 'Name: words' lines, in order; a line without a name continues the
    turn before it. Unlabelled text before the first name belongs to no one."""
    marked = F.regexp_replace(text, r"(?m)^([A-Z][\w .'-]{0,40}?):\s+", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: F.contains(x, F.lit("\u0002")))
    one = lambda x: F.struct(F.split(x, "\u0002")[0].alias("speaker"), F.trim(F.regexp_replace(F.split(x, "\u0002")[1], r"\s+", " ")).alias("text"))
    return F.transform(parts, one)


def split_text(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters: at sentences, else at words, else anywhere."""
    out, held = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        for piece in [s] if len(s) <= most else _at_words(s, most):
            if held and len(held) + 1 + len(piece) > most:
                out.append(held)
                held = piece
            else:
                held = f"{held} {piece}" if held else piece
    return [*out, held] if held else out


def _at_words(text: str, most: int) -> list[str]:
    out, held = [], ""
    for w in text.split():
        while len(w) > most:
            if held:
                out.append(held)
                held = ""
            out.append(w[:most])
            w = w[most:]
        if held and len(held) + 1 + len(w) > most:
            out.append(held)
            held = w
        elif w:
            held = f"{held} {w}" if held else w
    return [*out, held] if held else out


#: Where a text may be cut: before an empty line; behind a mark before a space, or behind a line.
_CUTS = (re.compile(r"(?=\n\n)"), re.compile(r"[.!?](?= )|\n"))
#: A window ends at a paragraph or sentence only beyond this share of it.
LEAST_SHARE = 0.55


def window_ends(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each window: it ends at the last paragraph that ends late enough in it, else at the
    last such sentence, else when it is full; the next one starts ``overlap`` before that end."""
    # Of paragraphs, then of sentences: places that a window must reach, and the cuts there.
    paragraphs = [(m.end() + 2, m.end()) for m in _CUTS[0].finditer(text)]
    kinds = [paragraphs, [(m.end() + (m[0] != "\n"), m.end()) for m in _CUTS[1].finditer(text)]]
    out: list[tuple[int, int]] = []
    start = 0
    while start < len(text):
        full = start + size
        if full >= len(text):
            out.append((start, len(text)))
            break
        late = start + LEAST_SHARE * size
        last = (cuts[at - 1][1] for cuts in kinds if (at := bisect_right(cuts, (full, full))))
        ends = [cut for cut in last if cut > late]
        out.append((start, ends[0] if ends else full))
        start = max(out[-1][1] - overlap, start + 1)
    return out


def chunk_text(text: str, size: int, overlap: int) -> list[str]:
    """What stands in the windows of a text, less white space at their ends; blank windows go."""
    said = (text[a:b].strip() for a, b in window_ends(text, size, overlap))
    return [s for s in said if s]


def _lists(f: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x or ""))

    return F.pandas_udf(run, "array<string>")


def split_long(text: Column, most: int) -> Column:
    return _lists(lambda x: split_text(x, most))(text)


def chunk_texts(text: Column, size: int, overlap: int) -> Column:
    return _lists(lambda x: chunk_text(x, size, overlap))(text)


_CLAUSE = re.compile(r"""("[^"]*")|(\s*[;,]\s*|\s+(?:and|but|while|however)\s+)""")


def split_clauses(text: str) -> list[str]:
    """Clauses at ; , and joining words, except inside double quotes."""
    out, at = [], 0
    for m in _CLAUSE.finditer(text):
        if m[2] is not None:
            out.append(text[at : m.start()])
            at = m.end()
    return [c for c in (x.strip() for x in [*out, text[at:]]) if c]


def clauses(text: Column) -> Column:
    return _lists(split_clauses)(text)


def cover_turns(turns: DataFrame, most: int, least: int) -> DataFrame:
    """Contiguous chunks that cover each conversation's turns: of at most ``most`` turns, and those
    under ``least`` folded into the smaller neighbour."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        sizes = [most] * (len(pdf) // most) + ([len(pdf) % most] if len(pdf) % most else [])
        while len(sizes) > 1 and min(sizes) < least:
            i = int(np.argmin(sizes))
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(sizes)]
            j = min(near, key=lambda k: (sizes[k], k))
            sizes[min(i, j)] += sizes.pop(max(i, j))
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "chunk": np.repeat(np.arange(len(sizes)), sizes)})

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, chunk long")


def batch_in_order(turns: DataFrame, most_items: int, most_size: int) -> DataFrame:
    """Batches of turns in order, closed before one more would exceed either bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        batch, items, held, out = 0, 0, 0, []
        for size in pdf["size"]:
            if items and (items >= most_items or held + size > most_size):
                batch, items, held = batch + 1, 0, 0
            items, held = items + 1, held + size
            out.append(batch)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "batch": out})

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, batch long")


def subject_segments(turns: DataFrame, k: int, least: int) -> DataFrame:
    """Segments at valleys of cohesion: the cosine of word counts of the k turns before and after."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        bags = [pd.Series(re.findall(r"[a-z]{3,}", (s or "").lower()), dtype=object).value_counts() for s in pdf["text"]]
        words = sorted(set().union(*[set(b.index) for b in bags]))
        at = {w: i for i, w in enumerate(words)}
        m = np.zeros((len(bags), max(1, len(words))))
        for i, b in enumerate(bags):
            m[i, [at[w] for w in b.index]] = b.to_numpy()
        cohesion = [1.0] * len(bags)
        for i in range(1, len(bags)):
            a, b = m[max(0, i - k) : i].sum(0), m[i : i + k].sum(0)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            cohesion[i] = float(a @ b / norm) if norm else 0.0
        depth = [max(cohesion[:i], default=1.0) + max(cohesion[i + 1 :], default=1.0) - 2 * c for i, c in enumerate(cohesion)]
        cut = float(np.mean(depth) + np.std(depth) / 2) if depth else 0.0
        segment, start, out = 0, 0, []
        for i in range(len(bags)):
            if i - start >= least and depth[i] > cut:
                segment, start = segment + 1, i
            out.append(segment)
        return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "segment": out, "cohesion": np.round(cohesion, 4)})

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, segment long, cohesion double")
