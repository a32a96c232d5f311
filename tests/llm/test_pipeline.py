"""The pipeline's stages, each against its own brute-force version, and the whole run."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np

import __spark_entry__
import corpus_pipeline
from quillwork.llm import queries
from tests.llm.test_dedup import near_brute
from tests.llm.test_scans import base_spans
from tests.llm.test_tokens import ids_of, raw


def test_stages_one_after_another(spark, docs, rows, small, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, small)
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert at.columns == docs.columns
        seen[name] = at.collect()
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted((str(r.doc_id), r.text) for r in seen["language_id"]) == sorted((str(r[0]), r[1]) for r in want)

    best: dict[str, tuple] = {}
    for r in sorted(want, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), r)
    assert sorted((str(r.doc_id), r.text) for r in seen["exact_dedup"]) == sorted((str(r[0]), r[1]) for r in best.values())

    left = sorted(best.values(), key=lambda r: (r[0] is None, r[0] or 0))
    _, roots = near_brute([r[1] for r in left])
    near = [left[i] for i in sorted(set(roots))]
    assert sorted((str(r.doc_id), r.text) for r in seen["near_dedup"]) == sorted((str(r[0]), r[1]) for r in near)

    clean = {r[0]: r[1] for r in near if not base_spans(r[1]) and "PRIVATE KEY" not in r[1] and r[0] is not None}
    scanned = {r.doc_id: r.text for r in seen["secret_scan"]}
    assert len(seen["secret_scan"]) == len(near)
    assert {k: scanned[k] for k in clean} == clean
    assert not any(base_spans(r.text) for r in seen["secret_scan"])

    pieces = defaultdict(list)
    for r in seen["packing"]:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == scanned.keys()
    for doc_id in clean:
        data, at = raw([*ids_of(scanned[doc_id]), 1]), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(data[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(data) // 4


def test_the_run_packs_what_the_stages_keep(spark, small):
    found = corpus_pipeline.run(spark, small).collect()
    assert found and np.all([r.length > 0 for r in found])
    fill = sum(r.length for r in found) / sum({r.sequence_id: r.tier for r in found}.values())
    assert fill > 0.9


def test_empty_documents_go_through_all_stages(spark, empty, small):
    at = empty
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, small)
        assert at.collect() == []


def test_every_numbered_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
