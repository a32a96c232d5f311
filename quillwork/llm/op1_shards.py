"""Operator 1, token-ID output (method: training-order materialisation by a keyed permutation).

Documents' tokens are laid end to end, each with its end token, and cut into sequences of a fixed
length. A keyed Feistel network over the least even number of bits, walked on while it leaves the
range, maps the sequences' numbers 0..N-1 to the slots 0..N-1 of the training order. Shard k holds
the slots from k * shard_records on, in order, in records of one stride, so slot s is at byte
(s % shard_records) * stride of shard s // shard_records: a reader that knows how far it came
(``read_from``) skips whole shards, starts at that byte, and reads on in sequence.

A record is the ids as little-endian unsigned integers of 2 bytes (4 for a vocabulary of more than
65536 ids; ``layout_for`` chooses, and a width that can't hold every id is refused), padded with 0, the number of ids in 3 bytes, and a line feed. Shards are written by Spark's text
writer, whose commit protocol keeps a lost or repeated task from leaving half a shard, on any file
system that Spark writes to. Numbering needs the count of sequences of each input partition only;
sequences are written first, so a lost executor can't renumber them.

Edge cases: a null or empty text is its end token alone; the last sequence of an input partition
may be short; every row is written once, repeated rows and null ids too; an empty table gives no
shard and no row; further input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import bpe
from quillwork.llm.common import documents, gone_at_exit, mapped, shared_dir, slices, written
from quillwork.llm.textscan import mix

ROUNDS = 6
#: Records of a shard that are decoded at once.
READ_RECORDS = 256
_U = np.uint64
PIECES = "array<struct<doc_id:long,start:long,length:long,offset:long,ids_crc32:long>>"


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of numbers 0..n-1: a bijection of that range, the same for the same n and key."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(key & 0xFFFFFFFFFFFFFFFF))
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << _U(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    length: int = 2048
    shard_records: int = 2048
    width: int = 2
    key: int = 20240607

    def check(self, ids: int) -> None:
        """Raises if this layout can't hold each of so many ids."""
        if ids > 1 << (8 * self.width):
            raise ValueError(f"{ids} ids don't fit into {self.width} bytes each")

    @property
    def stride(self) -> int:
        return self.length * self.width + 4

    def record(self, ids: bytes) -> bytes:
        return ids.ljust(self.length * self.width, b"\0") + (len(ids) // self.width).to_bytes(3, "little") + b"\n"

    def ids(self, record: bytes) -> np.ndarray:
        n = int.from_bytes(record[-4:-1], "little")
        return np.frombuffer(record[: n * self.width], f"<u{self.width}")


def layout_for(vocab_path: str, **how) -> Layout:
    """A layout whose ids are as wide as the vocabulary needs."""
    return Layout(width=2 if len(bpe.load(vocab_path).tokens) <= 1 << 16 else 4, **how)


def sequences(docs: DataFrame, vocab_path: str, layout: Layout, end_id: int) -> DataFrame:
    """part, place (number within the part), n_tokens, ids and the pieces of documents in them."""
    piece = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "offset", "ids_crc32")]))
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("pieces", piece)])
    kind, most = f"<u{layout.width}", layout.length * layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocab_path)
        layout.check(max(len(coder.tokens), end_id + 1))
        end = np.array([end_id], kind).tobytes()
        part, made = TaskContext.get().partitionId(), 0
        held, pieces = bytearray(), []

        def rows(done: list) -> pa.RecordBatch:
            nonlocal made
            columns = [[part] * len(done), range(made, made + len(done)), [len(d) // layout.width for d, _ in done], *zip(*done, strict=True)]
            made += len(done)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch, texts in slices(batches):
            done = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), coder.encode_batch(texts), strict=True):
                ids = np.frombuffer(raw, "<u4").astype(kind).tobytes() + end
                at = 0
                while at < len(ids):
                    take = ids[at : at + most - len(held)]
                    w = layout.width
                    pieces.append({"doc_id": doc_id, "start": at // w, "length": len(take) // w, "offset": len(held) // w, "ids_crc32": zlib.crc32(take)})
                    held += take
                    at += len(take)
                    if len(held) == most:
                        done.append((bytes(held), pieces))
                        held, pieces = bytearray(), []
            if done:
                yield rows(done)
        if held:
            yield rows([(bytes(held), pieces)])

    return mapped(docs.select("doc_id", "text"), run, f"part int, place long, n_tokens int, ids binary, pieces {PIECES}")


def numbering(found: DataFrame) -> tuple[dict[int, int], int]:
    """The number of the first sequence of each input partition, and how many sequences there are."""
    counts = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(counts):
        base[part], total = total, total + counts[part]
    return base, total


def with_slots(found: DataFrame, layout: Layout, numbers: tuple[dict[int, int], int], columns: list[str], pack: bool = False) -> DataFrame:
    """slot, shard and the given columns (ids packed for the shuffle if asked for)."""
    base, total = numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for rows in batches:
            number = rows.column("place").to_numpy() + np.array([base[p] for p in rows.column("part").to_pylist()], np.int64)
            slot = permute(number, total, layout.key)
            kept = [rows.column(c) for c in columns]
            if pack:
                kept = [pa.array([packer.compress(b) for b in rows.column("ids").to_pylist()], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(slot), pa.array((slot // layout.shard_records).astype(np.int32)), *kept], names=["sequence", "slot", "shard", *columns])

    kinds = dict(found.dtypes)
    ddl = "sequence long, slot long, shard int, " + ", ".join(f"{c} {kinds[c]}" for c in columns)
    return mapped(found.select("part", "place", *columns), run, ddl)


def write_shards(found: DataFrame, layout: Layout, folder: str, numbers: tuple[dict[int, int], int]) -> None:
    """Writes the sequences to ``folder``: file part-k is shard k."""
    placed, total = with_slots(found, layout, numbers, ["ids"], pack=True), numbers[1]
    schema = pa.schema([("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for rows in batches:
            # The writer adds each record's line feed.
            yield pa.RecordBatch.from_arrays([pa.array([layout.record(unpacker.decompress(b))[:-1] for b in rows.column("ids").to_pylist()], pa.binary())], schema=schema)

    shards = max(1, -(-total // layout.shard_records))
    dealt = placed.select("slot", "shard", "ids").repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    mapped(dealt.select("ids"), run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(folder)


def read_shards(spark: SparkSession, folder: str, layout: Layout) -> DataFrame:
    """slot, n_tokens and seq_crc32 of every record of the shards, read in sequence; a shard stays one
    buffer, of which some records are looked at a time."""
    schema = pa.schema([("slot", pa.int64()), ("n_tokens", pa.int64()), ("seq_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                shard, data = rows.column("shard")[i].as_py(), memoryview(rows.column("content")[i].as_buffer())
                n = len(data) // layout.stride
                for start in range(0, n, READ_RECORDS):
                    slots = range(start, min(start + READ_RECORDS, n))
                    ids = [layout.ids(bytes(data[k * layout.stride : (k + 1) * layout.stride])) for k in slots]
                    yield pa.RecordBatch.from_arrays([pa.array([shard * layout.shard_records + k for k in slots], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0")
    shard = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("shard")
    return mapped(files.select(shard, "content"), run, "slot long, n_tokens long, seq_crc32 long")


def shards_from(first: int) -> str:
    """A pattern of the names of shards of this number and greater ones: the number is written with five digits at
    least. One alternative for each digit that is greater, so a few dozen, however many shards there are."""
    digits = f"{first:05d}"
    same_length = [digits, *(f"{digits[:i]}[{int(d) + 1}-9]{'[0-9]' * (len(digits) - i - 1)}" for i, d in enumerate(digits) if d != "9")]
    longer = ["[1-9]" + "[0-9]" * n for n in range(len(digits), 12)]
    return "part-{" + ",".join(same_length + longer) + "}-*"


def read_from(spark: SparkSession, folder: str, layout: Layout, first_slot: int = 0) -> DataFrame:
    """slot and ids of the records from ``first_slot`` on, each shard in sequence. Shards before it
    aren't opened; its own shard is read whole, and records before it there aren't decoded."""
    schema = pa.schema([("slot", pa.int64()), ("ids", pa.list_(pa.int32()))])
    first_shard, first_record = divmod(first_slot, layout.shard_records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                shard, data = rows.column("shard")[i].as_py(), memoryview(rows.column("content")[i].as_buffer())
                n, at = len(data) // layout.stride, first_record if shard == first_shard else 0
                for start in range(at, n, READ_RECORDS):
                    slots = range(start, min(start + READ_RECORDS, n))
                    ids = [layout.ids(bytes(data[k * layout.stride : (k + 1) * layout.stride])).astype(np.int32) for k in slots]
                    yield pa.RecordBatch.from_arrays([pa.array([shard * layout.shard_records + k for k in slots], pa.int64()), pa.array(ids, schema.field("ids").type)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", shards_from(first_shard)).load(folder).filter("length > 0")
    shard = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("shard")
    return mapped(files.select(shard, "content"), run, "slot long, ids array<int>")


def materialise(docs: DataFrame, vocab_path: str, layout: Layout | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes shards of all documents; returns a row per piece of a document: where it starts there,
    its length and checksum, its sequence's slot, shard and record, its offset in the record, and
    the record's size and checksum as read back from the shard."""
    spark, layout = docs.sparkSession, layout or layout_for(vocab_path)
    found = written(sequences(docs, vocab_path, layout, end_id), "sequences")
    numbers = numbering(found)
    kept = folder is not None
    folder = folder or f"{shared_dir(spark)}/shards"
    write_shards(found, layout, folder, numbers)
    if not kept:
        gone_at_exit(spark, folder)
    placed = with_slots(found, layout, numbers, ["pieces"])
    back = read_shards(spark, folder, layout).withColumnRenamed("slot", "at_slot")
    rows = placed.join(back, F.col("slot") == F.col("at_slot"), "left").select("*", F.inline("pieces"))
    record = (F.col("slot") % layout.shard_records).alias("record")
    return rows.select("doc_id", "start", "length", "ids_crc32", "sequence", "slot", F.col("shard").cast("long").alias("shard"), record, "offset", F.col("n_tokens").alias("record_tokens"), F.col("seq_crc32").alias("record_crc32"))


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), bpe.vocabulary("word_bpe_49k.json"))
