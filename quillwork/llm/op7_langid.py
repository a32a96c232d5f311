"""Operator 7, language ID (method: error-correcting output codes).

Each language has a codeword of +1 and -1 bits, far from all others. One linear classifier per bit,
over hashed letter trigrams of the whole text, predicts that bit; the language is the codeword of
the least loss, each bit weighted by its classifier's accuracy, so a few wrong bits are corrected.
A text whose two nearest codewords are about as near is flagged as ambiguous. One that is as far from its
nearest codeword as a text without any known trigram, and much farther than texts of the sample are
from theirs (each left out of the fit for that), is in none of the languages if it has letters enough
to tell, and ``accepted`` rejects it.

The classifiers are fitted (ridge regression) on a bounded sample: at most ``PER_LANG`` labelled
rows of each language and ``SAMPLE_ROWS`` in all, those with the least hash of doc_id among the rows
that may be learned from. Everything else covers all rows, and texts are read whole.

Edge cases: a text that is null, empty or without a letter is 'und' with score 0; with no labelled
row at all every text is; rows of null lang are predicted but not learned from; repeated rows each
give a row; an empty table gives no row; further input columns are ignored. Where no language could be
learned, ``accepted`` keeps every text with a letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.llm.common import documents, mapped, slices

SAMPLE_ROWS = 4000
PER_LANG = 400
DIMS = 1 << 13
RIDGE = 1e-3
#: A gap between the two least losses, as a share of a bit's weight, below which a text is ambiguous.
AMBIGUOUS = 0.05
#: Share of the loss of a text without known trigrams; nearer texts are never said to be far.
UNDECIDED = 0.93
#: A text of fewer letters is never said to be in no language.
LETTERS = 20
UNKNOWN = "und"

# Bytes of letters (lower-cased) stay, others are a space; bytes of other code points stay.
_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def features(text: str) -> np.ndarray:
    """Hashed trigram counts of a whole text, damped and of length 1."""
    data = _CLASS[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    data = data[np.concatenate([[True], (data[1:] != 0x20) | (data[:-1] != 0x20)])].astype(np.uint32)
    if len(data) < 3:
        return np.zeros(DIMS, np.float32)
    key = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    at = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    x = np.sqrt(np.bincount(at, minlength=DIMS).astype(np.float32))
    return x / np.linalg.norm(x)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def has_letters(text: str) -> bool:
    return len(list(islice(filter(str.isalpha, text), LETTERS))) == LETTERS


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1 at a large distance from each other; every column has both signs."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:  # all splits of the languages in two
        splits = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, 1 << (n - 1))]
        return np.array(splits, np.float32).T
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = 15 * max(1, int(np.ceil(np.log2(n)))) // 2
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        near = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if near > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, near
    return best


def _losses(code: np.ndarray, trust: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Of each codeword, for each row of predicted bits."""
    return (np.exp(-np.clip(2 * code * f[..., None, :], -8, 8)) * trust).sum(-1)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages by bits
    weights: np.ndarray  # (DIMS + 1) by bits, the last row is the bias
    trust: np.ndarray  # of each bit; its sum is 1
    far: float = np.inf  # loss beyond which the nearest codeword is farther than a learned text's would be

    def losses(self, text: str) -> np.ndarray:
        return _losses(self.code, self.trust, features(text) @ self.weights[:-1] + self.weights[-1])

    def judge(self, text: str | None) -> tuple[str, float, bool, bool]:
        """Language, score, whether it's ambiguous, and whether it's in none of the languages."""
        if not text or not has_letter(text):
            return UNKNOWN, 0.0, True, True
        if not self.langs:
            return UNKNOWN, 0.0, True, False
        loss = self.losses(text)
        near = np.argsort(loss, kind="stable")
        odds = np.exp(-4 * (loss - loss[near[0]]))
        close = len(near) > 1 and bool(loss[near[1]] - loss[near[0]] < AMBIGUOUS)
        none = bool(loss[near[0]] > self.far) and has_letters(text)
        return self.langs[near[0]], float(odds[near[0]] / odds.sum()), close, none

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.judge(text)[:3]


def fit(rows: list[tuple[str, np.ndarray, bool]]) -> Model:
    """rows: language, features, and whether the text has letters enough to be far from all."""
    langs = sorted({lang for lang, *_ in rows})
    if not langs:
        return Model([], np.zeros((0, 1)), np.zeros((DIMS + 1, 1)), np.ones(1))
    code = codewords(len(langs))
    x = np.stack([v for _, v, _ in rows]).astype(np.float32)
    label = np.array([langs.index(lang) for lang, *_ in rows])
    y = code[label]
    centre = y.mean(0)
    # Ridge regression in its dual form: one system of the sample's size for all bits.
    inverse = np.linalg.inv((x @ x.T).astype(np.float64) + RIDGE * len(rows) * np.eye(len(rows)))
    alpha = inverse @ (y - centre)
    weights = np.vstack([x.T @ alpha, centre]).astype(np.float32)
    right = (np.sign(x @ weights[:-1] + centre) == y).mean(0)
    trust = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
    trust /= trust.sum()
    left_out = y - alpha / np.diag(inverse)[:, None]
    nearest = _losses(code, trust, left_out).min(1)[[long for *_, long in rows]]
    unknown = UNDECIDED * _losses(code, trust, centre).min()
    return Model(langs, code, weights, trust, float(max(unknown, nearest.mean() + 6 * nearest.std())) if len(nearest) else np.inf)


def sample(docs: DataFrame, may_learn: Column) -> DataFrame:
    """At most PER_LANG rows of a language and SAMPLE_ROWS in all: lang, text."""
    rows = docs.filter(may_learn & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS).collect()}
    most = min(PER_LANG, SAMPLE_ROWS // max(1, len(counts)))
    near = F.lit(False)
    for lang, n in counts.items():  # about twice as many by hash, so that no large group is sorted
        share = min(1.0, 2.0 * most / n)
        near = near | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 20)) <= int(share * (1 << 20))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    return rows.filter(near).withColumn("place", place).filter(F.col("place") <= most).select("lang", "text")


def train(docs: DataFrame, may_learn: Column) -> Model:
    schema = pa.schema([("lang", pa.string()), ("vector", pa.binary()), ("long", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary()), pa.array(map(has_letters, texts), pa.bool_())], schema=schema)

    rows = mapped(sample(docs, may_learn), run, "lang string, vector binary, long boolean").collect()
    return fit([(lang, np.frombuffer(vector, np.float16), long) for lang, vector, long in sorted((r["lang"], bytes(r["vector"]), r["long"]) for r in rows)])


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            found = list(zip(*map(model.predict, texts), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(found, list(schema)[1:], strict=True))], schema=schema)

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are in some language, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            yield rows.filter(pa.array([not model.judge(t)[3] for t in texts], pa.bool_()))

    return mapped(docs, run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
