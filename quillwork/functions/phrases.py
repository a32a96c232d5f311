"""Rewrites of phrases: numbers in words, contractions, currency, voice; JSON in free text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"hundred": 100, "thousand": 1000, "million": 1_000_000}
_WORD = "|".join([*_UNITS, *_TENS, *_SCALES])
_RUN = re.compile(rf"\b(?:{_WORD})(?:(?:[ -]| and )(?:{_WORD}))*\b", re.IGNORECASE)
#: A lone 'one' is as often a pronoun as a number.
_KEEP = {"one"}


def number_of(words: str) -> int:
    """The value of number words, such as 'two hundred and five'."""
    total, part = 0, 0
    for w in re.split(r"[ -]+", words.lower()):
        if w in _UNITS or w in _TENS:
            part += _UNITS.get(w, 0) + _TENS.get(w, 0)
        elif w == "hundred":
            part = max(1, part) * 100
        elif w in _SCALES:
            total, part = total + max(1, part) * _SCALES[w], 0
    return total + part


def digits_in(text: str) -> str:
    return _RUN.sub(lambda m: m[0] if m[0].lower() in _KEEP else str(number_of(m[0])), text)


@F.pandas_udf(StringType())
def digits(text: pd.Series) -> pd.Series:
    """Number words as digits: a small grammar, so a vectorised function."""
    return text.map(digits_in, na_action="ignore")


def quantities(text: Column) -> Column:
    """Distinct numbers with sign, decimals, percent or currency; digits inside identifiers don't count."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.-])([£$€]?[-+]?\d+(?:[.,]\d+)*(?:e[-+]?\d+)?%?)(?![\w-])"), F.lit(1))
    return F.array_distinct(found)


def without_trailing_question(text: Column) -> Column:
    """The text before a short question at its end, if at least four words stand before it; null else."""
    p = r"^(.*\S)\s+((?:\S+\s+){1,5}\S*\?)$"
    before = F.regexp_extract(text, p, 1)
    return F.when((before != "") & (F.size(F.split(before, r"\s+")) >= 4), before)


CONTRACTIONS = {"can't": "cannot", "won't": "will not", "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "it's": "it is", "I'm": "I am"}


def expand_contractions(text: Column) -> Column:
    for short, long in CONTRACTIONS.items():
        text = F.regexp_replace(text, f"(?i)(?<=\\w){short}\\b" if short[0] in "n'" else f"\\b{short}\\b", long)
    return text


def pounds(text: Column) -> Column:
    """'GBP 5' and '5 pounds' as '£5'; both ends of '5 to 7 pounds'."""
    amount = r"(\d+(?:[.,]\d+)*)"
    s = F.regexp_replace(text, rf"\b{amount} (?:to|-) {amount} pounds\b", "£$1 to £$2")
    s = F.regexp_replace(s, rf"\bGBP ?{amount}", "£$1")
    return F.regexp_replace(s, rf"\b{amount} pounds?\b", "£$1")


#: A verb in the plural and the same of one team; fixed values.
VERBS_OF_ONE = {"are": "is", "have": "has"}


def team_voice(text: Column) -> Column:
    """First person plural as the team, with its verb: 'we are' as 'the team is'."""
    for verb, of_one in [*VERBS_OF_ONE.items(), ("", "")]:
        tail, written = (f" {verb}", f" {of_one}") if verb else ("", "")
        for letter in "Tt":
            text = F.regexp_replace(text, rf"\b{'W' if letter == 'T' else 'w'}e{tail}\b", f"{letter}he team{written}")
    return F.regexp_replace(text, r"\bour\b", "the team's")


def json_object_in(text: Column, schema: str) -> Column:
    """The object from the first brace to the last of a text, fences or not; null if it can't be read."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
