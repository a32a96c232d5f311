"""Operator 9, LM scoring (method: subword lattice likelihood).

A word's probability is the sum over all its segmentations into pieces of a public vocabulary, by
forward recursion in log space (``lattice.py``). The vocabulary's own scores give the first weights;
they are re-estimated once from the expected piece counts of all training words. A text's
probability is the product over its words and its end.

Texts are read once, in blocks: a block is the list of its distinct words and each text as places
in that list. Words of all blocks are grouped to the corpus's word counts, each distinct word is
scored once, and count and score go back to the blocks by joins on the word and on the block. A
frequent word has one row a block; if its blocks are more than LARGE, they meet its score in SALTS tasks,
and no text is shuffled.

Tokens are the words and one end per text. Edge cases: a null or empty text is its end alone; with
no training text all counts are 0 and the vocabulary's own scores are used; rows of null doc_id are
trained on; words of any length are scored whole; repeated rows each count and give a row; an empty
table gives no row; further input columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import bpe
from quillwork.llm.common import documents, mapped, ship, slices, within, written
from quillwork.llm.lattice import Lattice, pieces, prior

BLOCK_BYTES = 8 << 20
#: The end of a text, which no word is.
END = b""
SMOOTHING = 0.1
#: Distinct words of a task: the work is the lattice's, which the bytes of a word don't show.
TASK_WORDS = 1 << 16
#: Blocks of a word beyond which its rows are dealt to so many tasks.
LARGE, SALTS = 1024, 16


def blocks(docs: DataFrame, training: Column) -> DataFrame:
    """Rows of two kinds. A word of a block: block, idx, word and its count n in training texts. A
    block's texts (idx null): payload of doc_ids, training flags, sizes and word places."""
    schema = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0

        def start() -> tuple:
            places: defaultdict[bytes, int] = defaultdict()
            places.default_factory = places.__len__
            places[END]
            return places, [], [], []

        def flush(places: dict, ids: list, flags: list, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            block = first + made
            flat, sizes = np.concatenate(texts), np.fromiter(map(len, texts), np.int32, len(texts))
            counts = np.bincount(flat[np.repeat(np.array(flags, bool), sizes)], minlength=len(places))
            n = len(places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(places), pa.binary()), pa.array(counts, pa.int64()), pa.nulls(n, pa.binary())], schema=schema
            )
            body = pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([flat.astype(np.int32).tobytes()], pa.large_binary())], names=["ids", "flags", "sizes", "flat"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(body)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)

        places, ids, flags, texts = start()
        held = 0
        for rows, batch in slices(batches):
            for doc_id, flag, text in zip(rows.column("doc_id").to_pylist(), rows.column("training").to_pylist(), batch, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                # bytes.lower() and bytes.split() know ASCII only, as the definition of a token does.
                tokens = raw.lower().split()
                tokens.append(END)
                texts.append(np.fromiter(map(places.__getitem__, tokens), np.int32, len(tokens)))
                ids.append(doc_id)
                flags.append(flag)
                held += len(raw)
                if held >= BLOCK_BYTES:
                    yield from flush(places, ids, flags, texts)
                    made, held = made + 1, 0
                    places, ids, flags, texts = start()
        if texts:
            yield from flush(places, ids, flags, texts)

    rows = docs.select("doc_id", "text", training.alias("training"))
    return mapped(rows, run, "block long, idx int, word binary, n long, payload binary")


def _decoded(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in words]


def piece_weights(words: DataFrame, vocab_path: str) -> np.ndarray:
    """Log probability of each piece, and of the end last: expected counts over all training words
    under the vocabulary's own scores. What reaches the driver is a number for each piece."""
    schema = pa.schema([("piece", pa.int32()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocab_path)
        lattice, counts, ends = Lattice(p, prior(p)), np.zeros(p.size), 0.0
        for rows in batches:
            texts, n = rows.column("word").to_pylist(), rows.column("n").to_numpy().astype(np.float64)
            ends += sum(c for w, c in zip(texts, n.tolist(), strict=True) if w == END)
            keep = [i for i, w in enumerate(texts) if w != END]
            counts += lattice.score(_decoded([texts[i] for i in keep]), n[keep])[1]
        every = np.append(counts, ends)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(every[at])], schema=schema)

    p = pieces(vocab_path)
    found = mapped(words.filter("n > 0").select("word", "n"), run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(p.size + 1)
    for row in found:
        counts[row["piece"]] = row["n"]
    if not found:
        return np.append(prior(p) + math.log(0.99), math.log(0.01))
    smooth = counts + SMOOTHING
    return np.log(smooth / smooth.sum())


def score_words(words: DataFrame, vocab_path: str, weights: np.ndarray) -> DataFrame:
    """word, n and logp, the natural log of the word's marginal probability."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("logp", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces(vocab_path), weights[:-1])
        for rows in batches:
            texts = rows.column("word").to_pylist()
            logp, _ = lattice.score(_decoded(texts))
            logp[[i for i, w in enumerate(texts) if w == END]] = weights[-1]
            yield pa.RecordBatch.from_arrays([rows.column("word"), rows.column("n"), pa.array(logp)], schema=schema)

    return mapped(words.select("word", "n"), run, "word binary, n long, logp double")


def score_texts(docs: DataFrame, training: Column, vocab_path: str) -> DataFrame:
    """A row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    found = written(blocks(docs, training), "blocks")
    in_block = found.filter("idx is not null").select("block", "idx", "word", "n")
    words = written(in_block.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")), "words")
    total, kinds, every = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, True)), F.count(F.lit(1))).first()
    even = words.repartition(max(1, -(-every // TASK_WORDS)), "word")
    scored = score_words(even, vocab_path, piece_weights(even, vocab_path))
    # A word of many blocks goes to several tasks, by block; such words are few: one for LARGE rows at most.
    large = within(written(words.filter(F.col("blocks") > LARGE).select(F.col("word").alias("large_word"), F.lit(True).alias("is_large")), "large"), 8 << 20)
    parts = F.explode(F.sequence(F.lit(0), F.when(F.col("is_large"), SALTS - 1).otherwise(0)))
    told = scored.join(large, F.col("word") == F.col("large_word"), "left").select("word", "n", "logp", parts.alias("part"))
    part = F.when(F.col("is_large"), F.pmod(F.xxhash64("block"), F.lit(SALTS))).otherwise(0).cast("int").alias("part")
    dealt = in_block.join(large, F.col("word") == F.col("large_word"), "left").select("word", "block", "idx", part)
    back = dealt.join(told, ["word", "part"]).select("block", "idx", "n", "logp")
    texts = found.filter("payload is not null").select(F.col("block").alias("of"), "payload")
    schema = pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    floor = total + 0.5 * (kinds + 1)

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        order = np.empty(known.num_rows, np.int64)
        order[known.column("idx").to_numpy()] = np.arange(known.num_rows)
        n, logp = known.column("n").to_numpy()[order], known.column("logp").to_numpy()[order]
        base = np.log10((n + 0.5) / floor)
        body = pa.ipc.open_stream(block.column("payload")[0].as_py()).read_next_batch().to_pylist()[0]
        flat, sizes = np.frombuffer(body["flat"], np.int32), np.array(body["sizes"])
        starts = np.cumsum(sizes) - sizes
        sums = lambda x: np.add.reduceat(x[flat], starts)  # noqa: E731  every text has its end at least
        columns = [body["ids"], body["flags"], sizes, sums((n > 0).astype(np.int64)), np.full(len(sizes), total), sums(base), sums(logp) / math.log(10)]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ship(docs.sparkSession)
    ddl = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("of").cogroup(back.groupBy("block")).applyInArrow(run, ddl)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(documents(spark, sf_dir), ~held_out(), bpe.vocabulary("piece_bpe_32k.model"))
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
