"""Operator 5, secret scans (method: incremental blob ledger).

Every version of a text is addressed by the SHA-256 of its content. The ledger holds a row for
each (blob, rule, rule version) that has been scanned, with the spans found. A run scans only the
blobs and rules that the ledger lacks, each blob once however many paths or versions hold it, and
joins the ledger's findings back to all of them. Raising a rule's version makes it run anew. The
ledger is a folder that every run appends to; the query itself takes the table in two increments.

Spans are code points with the end exclusive, leftmost and without overlap per kind. Edge cases: a
null text counts as empty and has no spans; equal texts share one scan; repeated rows each give a
row; long texts are scanned whole, and every rule takes time in proportion to the text; an empty table or ledger is fine; further columns are ignored. Letters
are those of ASCII: the long s or the Kelvin sign is no letter of "secret" or "token".
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import documents, free, gone_at_exit, mapped, salted, shared_dir, slices, within, written

BASE = ("assign", "access", "hex")
LEDGER = "blob binary, kind string, version int, spans string"
SALTS = 16
#: Texts stay where they are if one in FEW rows at most is of an unseen blob, and their names are of so many bytes at most.
FEW, MOST_BROADCAST = 8, 8 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: A text without any of these, in lower case, can't match.
    hints: tuple[str, ...] = ()
    flags: int = re.ASCII
    #: Group and least length of it for a match to count.
    group: int = 0
    least: int = 0


RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "api"), re.ASCII | re.IGNORECASE, 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), least=18),
    Rule("hex", 1, r"[0-9a-f]{16,}"),  # [0-9a-f]+ of 16 characters or more: runs are maximal either way
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?", ("private key",)),
    Rule("jwt", 1, r"[A-Za-z0-9_.-]*", ("eyj",)),  # the runs that web_tokens looks into
    Rule("forge", 1, r"gh[opusr]_[A-Za-z0-9]{36,}", ("gh",)),
)
KIND_ORDER = {r.kind: i for i, r in enumerate(RULES)}


def web_tokens(run: str) -> Iterator[tuple[int, int]]:
    """Spans of three parts of letters, digits, _ and -, joined by dots, of 8 characters or more, the first one behind
    ``eyJ``; leftmost, without overlap. Each part of the run is looked at once."""
    parts = run.split(".")
    begins = [0]
    for p in parts:
        begins.append(begins[-1] + len(p) + 1)
    i = 0
    while i + 2 < len(parts):
        at = parts[i].find("eyJ")
        if 0 <= at <= len(parts[i]) - 11 and len(parts[i + 1]) >= 8 and len(parts[i + 2]) >= 8:
            yield begins[i] + at, begins[i + 2] + len(parts[i + 2])
            i += 3
        else:
            i += 1


def scanner(rule: Rule) -> Callable[[str, str], list[tuple[int, int]]]:
    pattern = re.compile(rule.pattern, rule.flags)

    def scan(text: str, lowered: str) -> list[tuple[int, int]]:
        if rule.hints and not any(h in lowered for h in rule.hints):
            return []
        if rule.kind == "jwt":
            return [(m.start() + a, m.start() + b) for m in pattern.finditer(text) if "eyJ" in m[0] for a, b in web_tokens(m[0])]
        return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]

    return scan


def scan_unseen(unseen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """unseen: blob, text, kinds (those to run). Ledger rows: blob, kind, version, spans ('start:end,...')."""
    schema = pa.schema([("blob", pa.binary()), ("kind", pa.string()), ("version", pa.int32()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = {r.kind: (r.version, scanner(r)) for r in rules}
        for rows, texts in slices(batches):
            out = []
            for blob, kinds, text in zip(rows.column("blob").to_pylist(), rows.column("kinds").to_pylist(), texts, strict=True):
                lowered = text.lower()
                for kind in kinds:
                    version, scan = scans[kind]
                    out.append((blob, kind, version, ",".join(f"{a}:{b}" for a, b in scan(text, lowered))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return mapped(unseen.select("blob", "text", "kinds"), run, LEDGER)


def content_address(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(folder)


def extend_ledger(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions: doc_id (the path) and text. Scans the pairs of blob and rule version that the ledger in
    ``folder`` lacks, and appends them to it. Returns doc_id and blob of each version. A run that is
    lost before its rows are committed leaves the ledger as it was, and its pairs are scanned again."""
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(folder)  # the first run finds a ledger too
    paths = written(versions.select("doc_id", content_address().alias("blob")), "paths")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    known = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    seen = read_ledger(spark, folder).select("blob", F.struct("kind", "version").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("pairs"))
    # A run that adds little moves no text: the names of the few unseen blobs go to where the texts are.
    lacking = F.transform(F.array_except(known, F.coalesce("pairs", F.array().cast("array<struct<kind:string,version:int>>"))), lambda p: p["kind"])
    todo = blobs.join(seen, "blob", "left").select(F.col("blob").alias("todo_blob"), "holder", lacking.alias("kinds")).filter(F.size("kinds") > 0)
    todo = written(todo, "unseen")
    adds_little = todo.count() * FEW <= paths.count()
    todo = within(todo, MOST_BROADCAST) if adds_little else todo.hint("shuffle_hash")
    # A blob's text comes from one version that holds it; both keys, so a blob of many copies isn't one task.
    texts = versions.select("doc_id", "text", content_address().alias("blob"))
    unseen = texts.join(todo, (F.col("blob") == F.col("todo_blob")) & F.col("doc_id").eqNullSafe(F.col("holder")))
    # Repeated rows of a holder are scanned with it.
    scan_unseen(unseen, rules).dropDuplicates(["blob", "kind", "version"]).write.option("compression", "zstd").mode("append").parquet(folder)
    return paths


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every version's spans: doc_id, blob, found array<struct<start, order, kind, stop>> in order."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    order = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, KIND_ORDER.get(r.kind, 99))])
    spans = ledger.filter(current & (F.col("spans") != "")).select("blob", "kind", F.explode(F.split("spans", ",")).alias("span"))
    ends = F.split("span", ":")
    one = F.struct(ends[0].cast("int").alias("start"), order[F.col("kind")].alias("order"), "kind", ends[1].cast("int").alias("stop"))
    found = spans.groupBy(F.col("blob").alias("found_blob")).agg(F.sort_array(F.collect_list(one)).alias("found"))
    many, few, salt = salted(paths, found, F.col("doc_id"), SALTS)
    few = few.withColumnRenamed(salt, "found_salt")
    return many.join(few, (F.col("blob") == F.col("found_blob")) & (F.col(salt) == F.col("found_salt")), "left").select("doc_id", "blob", "found")


def report(found: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans, all spans in words, and the blob."""
    count = [F.expr(f"cast(coalesce(size(filter(found, x -> x.kind = '{k}')), 0) as long)").alias(f"n_{k}") for k in BASE]
    said = "concat(x.kind, ':', x.start, ':', x.stop)"
    base = F.expr(f"coalesce(array_join(transform(filter(found, x -> x.kind in {BASE}), x -> {said}), ','), '')")
    spans = F.expr(f"coalesce(array_join(transform(found, x -> {said}), ','), '')")
    return found.withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start:int,order:int,kind:string,stop:int>>)"))).select(
        "doc_id", *count, F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), "blob"
    )


def redact(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind; spans as in ``report``. Overlaps count as one."""
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda x: (x[1], -x[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, reported: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with every span of ``reported`` (doc_id, blob, spans) replaced by its kind; n_chars, if
    there is one, follows. The spans are broadcast while they have no more than ``most_bytes``."""
    at, said = free(docs, "at_blob", "at_spans")
    spans = written(reported.filter("spans <> ''").select(F.col("blob").alias(at), F.col("spans").alias(said)).distinct(), "spans")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            texts, found = rows.column("text").to_pylist(), rows.column(said).to_pylist()
            hit = [s is not None for s in found]
            columns = {n: rows.column(n) for n in names}
            if any(hit):
                texts = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t) if h else n for t, h, n in zip(texts, hit, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict(columns)

    return mapped(docs.join(within(spans, most_bytes), content_address() == F.col(at), "left").drop(at), run, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two increments as they might arrive; the second finds the first one's ledger and
    scans what that lacks."""
    docs, folder = documents(spark, sf_dir), f"{shared_dir(spark)}/ledger"
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    first, second = (extend_ledger(docs.filter(half == k), folder) for k in (0, 1))
    gone_at_exit(spark, folder)  # a ledger that is to last has a folder of its own
    return report(findings(first.unionByName(second), read_ledger(spark, folder))).drop("blob")
