"""Transcripts to turns, by spans of the text.

A text is tokenised once: at the start of a line, and within a line behind the end of a sentence, a header
may stand. It is a name or a handle with a colon, or a name with a time, and a time may stand before either.
Two sets of spans are found, headers that name a speaker and headers whose handle names no one; where
they overlap the named one holds. Whether a capitalised label with a colon alone is a person is judged by the
whole text: a name of several words none of which is an everyday word, a name that recurs, or one that is
part of another speaker's name. ``Reminder:`` once is a label, so its line stays in the turn around it.

Every character of a text belongs to a header, to the words of a turn, or to a listed region that no one is
known to have spoken: what stands before the first header, or all of a text without headers. Words under a
handle belong to no one, never to the speaker before. A turn of more than ``MOST`` characters is split at
sentences. A null text has no turn and no region.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from quillwork.operators.segmenting import split_text

MOST = 5000
NO_ONE = "Unattributed"
#: Labels of a line that no one speaks, in lower case: fixed values.
LABELS = frozenset("note notes agenda action actions decision decisions summary title date time attendees participants topic subject http https".split())
#: Words that no name consists of, in lower case.
EVERYDAY = frozenset("a an and are as at be but by can do for from has have he how i if in is it just my no not of on one or our please she so that the their then there they this to today tomorrow was we what when where which who why will with yes you your".split())
#: Small words within a name.
_PARTICLES = frozenset("al bin da de del den der di dos el ibn la le ten ter van von".split())
_CLOCK = re.compile(r"[\[(]?(?:\d{1,2}:)?\d{1,2}:\d{2}[\])]?(?!\d|:\d)")
_WORD = re.compile(r"[^\W\d_][\w'’.\-]{0,39}|\d{1,3}(?!\w|:\d)")
_BLANK = re.compile(r"[ \t]+")
#: Where a header may stand: a line's first character, or a capital behind a sentence's end on the same line.
_PLACES = re.compile(r"(?:^|(?<=\n))[ \t]*(?=\S)|(?<=[.!?])[ \t]+(?=[^\W\d_a-z])")


@dataclass(frozen=True)
class Header:
    """begin to end: the header itself, blanks before the words included."""

    begin: int
    end: int
    name: str
    timed: bool
    #: At the start of a line, not within one.
    leading: bool

    @property
    def words(self) -> list[str]:
        return self.name.split(" ")


def _after(pattern: re.Pattern, text: str, at: int) -> int | None:
    m = pattern.match(text, at)
    return m.end() if m else None


def _header_at(text: str, place: int, begin: int, leading: bool) -> Header | None:
    """The header that stands at ``begin``, of whatever name: [time] words colon, or words time."""
    at = _after(_CLOCK, text, begin) if leading else None
    stamped = at is not None
    at = (_after(_BLANK, text, at) or at) if stamped else begin
    words: list[str] = []
    while len(words) < 5:
        m = _WORD.match(text, at)
        if not m:
            break
        words.append(m[0])
        at = m.end()
        gap = _after(_BLANK, text, at)
        if text[at : at + 1] == ":" and (gap_ := text[at + 1 : at + 2]) in ("", " ", "\t", "\n"):
            end = (_after(_BLANK, text, at + 1) or at + 1) if gap_ != "\n" else at + 1
            return Header(place, end, " ".join(words), stamped, leading)
        if gap is None:
            break
        clock = _after(_CLOCK, text, gap)
        if clock is not None and not stamped and not (behind := text[clock : clock + 1]).isdigit() and (not behind.isalpha() or behind.isupper()):
            return Header(place, _after(_BLANK, text, clock) or clock, " ".join(words), True, leading)
        at = gap
    return None


def _is_handle(name: str) -> bool:
    """A single word that English wouldn't open a sentence with: a dot, an underscore or a digit in it, or no capital."""
    return " " not in name and name.lower() not in LABELS and (bool(re.search(r"[._]\S|\d", name)) or name == name.lower())


def _may_be_name(words: list[str]) -> bool:
    """Capitalised words, particles and a number at the end; no label, and no word that names lack."""
    if words[0].lower() in LABELS or any(w.lower() in EVERYDAY or re.search(r"[._]\S|_", w) for w in words):
        return False
    *front, last = words
    ends = last.isdigit() or last[0].isupper()
    return ends and not words[0].isdigit() and all(w[0].isupper() or w in _PARTICLES for w in front) and len(words) <= 4


def headers(text: str) -> list[tuple[Header, bool]]:
    """(header, whether it names its speaker) in order, without overlaps. text: without carriage returns."""
    found = []
    for m in _PLACES.finditer(text):
        leading = m.start() == 0 or text[m.start() - 1] == "\n"
        h = _header_at(text, m.start(), m.end(), leading)
        if h:
            found.append(h)
    names = Counter(h.name for h in found if _may_be_name(h.words))
    parts = Counter(w for name in names for w in set(name.split(" ")))

    def is_person(h: Header) -> bool:
        if not _may_be_name(h.words):
            return False
        return h.timed or len(h.words) > 1 or names[h.name] > 1 or parts[h.name] > 1

    # Within a line only a name known from a line's start, or one that is sure by itself, cuts.
    at_lines = {h.name for h in found if h.leading}
    named = [h for h in found if is_person(h) and (h.leading or h.timed or h.name in at_lines or len(h.words) > 1)]
    taken = {i for h in named for i in (h.begin, h.end)}
    handles = [h for h in found if h.leading and _is_handle(h.name) and h.begin not in taken and not any(n.begin < h.end and h.begin < n.end for n in named)]
    out: list[tuple[Header, bool]] = []
    for h, sure in sorted([*((h, True) for h in named), *((h, False) for h in handles)], key=lambda x: x[0].begin):
        if not out or h.begin >= out[-1][0].end:
            out.append((h, sure))
    return out


@dataclass(frozen=True)
class Piece:
    """Characters from begin to end: a ``turn`` (with its header, whose words start at ``words``) or a ``region``."""

    kind: str
    begin: int
    words: int
    end: int
    speaker: str | None


def pieces(text: str) -> list[Piece]:
    """Turns and regions in order; they cover the text without a gap."""
    cuts = headers(text)
    first = cuts[0][0].begin if cuts else len(text)
    out = [Piece("region", 0, 0, first, None)] if first else []
    for i, (h, sure) in enumerate(cuts):
        end = cuts[i + 1][0].begin if i + 1 < len(cuts) else len(text)
        out.append(Piece("turn", h.begin, h.end, end, h.name if sure else NO_ONE))
    return out


def parse(text: str | None) -> list[tuple[str, str]]:
    """(speaker, words) of the turns in order, with single blanks."""
    text = (text or "").replace("\r", "")
    out = []
    for p in pieces(text):
        said = " ".join(text[p.words : p.end].split())
        if p.kind == "turn" and said:
            out += [(p.speaker, s) for s in (split_text(said, MOST) if len(said) > MOST else [said])]
    return out


def turns_of(transcripts: DataFrame, key: str, column: str) -> DataFrame:
    """key, idx, speaker and said of every turn of each transcript."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, speaker, said) for k, text in zip(b[key], b[column], strict=True) for i, (speaker, said) in enumerate(parse(text))]
            yield pd.DataFrame(rows, columns=[key, "idx", "speaker", "said"])

    return transcripts.select(key, column).mapInPandas(run, f"{key} {dict(transcripts.dtypes)[key]}, idx int, speaker string, said string")


def pieces_of(transcripts: DataFrame, key: str, column: str) -> DataFrame:
    """key, piece (its number), kind, speaker, begin, words and end of every turn and region: with ``end - begin``
    added up, all characters of a transcript but its carriage returns."""
    ddl = f"{key} {dict(transcripts.dtypes)[key]}, piece int, kind string, speaker string, begin int, words int, end int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, p.kind, p.speaker, p.begin, p.words, p.end) for k, text in zip(b[key], b[column], strict=True) for i, p in enumerate(pieces((text or "").replace("\r", "")))]
            yield pd.DataFrame(rows, columns=[key, "piece", "kind", "speaker", "begin", "words", "end"])

    return transcripts.select(key, column).mapInPandas(run, ddl)
