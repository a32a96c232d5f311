"""All queries by name, the SQL that gives the same rows, and the operators each stands for."""

from __future__ import annotations

from quillwork.plans import aggregates, classifying, clusters, evaluating, joins, latest, records, reporting, scalars, scans, similarity, streams, textunits, vectors, wording, discourse, merging, serving, auditing

MODULES = (scans, joins, aggregates, latest, scalars, textunits, similarity, vectors, clusters, classifying, reporting, evaluating, records, streams, wording, discourse, merging, serving, auditing)
QUERIES = {name: q.run for m in MODULES for name, q in m.queries.found.items()}
ORACLE_SQL = {name: q.sql for m in MODULES for name, q in m.queries.found.items() if q.sql}
COVERS = {name: q.covers for m in MODULES for name, q in m.queries.found.items()}
