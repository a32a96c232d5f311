"""Evaluation: matched actions, burden, release gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import words
from quillwork.operators.matching import pairs_sharing
from quillwork.operators.ranks import nearest_rank, ranked_values
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()


@queries("Q2", """WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS t FROM conversations), e AS (SELECT conv_id, turn, role, len(t) AS n, unnest(t) AS tok FROM w)
SELECT a.conv_id, a.turn AS a, b.turn AS b, round(count(*) / least(a.n, b.n) * CASE WHEN a.role = b.role THEN 1 ELSE 0.4 END, 4) AS score FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.tok = b.tok AND a.turn < b.turn GROUP BY a.conv_id, a.turn, b.turn, a.role, b.role, a.n, b.n""")
def owner_penalised_match(t: Tables) -> DataFrame:
    items = t.conversations.select("conv_id", "turn", "role", F.array_distinct(words(F.col("text"), 4)).alias("tokens"))
    role = lambda c: items.select("conv_id", F.col("turn").alias(c), F.col("role").alias(f"role_{c}"))
    p = pairs_sharing(items, ["conv_id"], "turn", "tokens").join(role("a"), ["conv_id", "a"]).join(role("b"), ["conv_id", "b"])
    score = F.col("shared") / F.least("n_a", "n_b") * F.when(F.col("role_a") == F.col("role_b"), 1.0).otherwise(0.4)
    return p.select("conv_id", "a", "b", F.round(score, 4).alias("score"))


def _scored(pdf: pd.DataFrame) -> pd.DataFrame:
    """Expected (user) turns matched by others in order, each used once: recall, precision, duplicates."""
    turns = pdf.sort_values("turn")
    expected = [(t, set(x)) for t, r, x in zip(turns["turn"], turns["role"], turns["tokens"], strict=True) if r == "user"]
    made = [(t, set(x)) for t, r, x in zip(turns["turn"], turns["role"], turns["tokens"], strict=True) if r != "user"]
    used, hits, repeats = set(), 0, 0
    for _, m in made:
        scores = [(len(m & e) / min(len(m), len(e)) if m and e else 0.0, -t) for t, e in expected]
        score, t = max(scores, default=(0.0, 0))
        if score >= 0.15:
            repeats += -t in used
            hits += -t not in used
            used.add(-t)
    recall = hits / len(expected) if expected else 1.0
    precision = hits / len(made) if made else 1.0
    return pd.DataFrame([(int(pdf["conv_id"].iloc[0]), round(recall, 4), round(precision, 4), repeats, len(made) - hits - repeats)], columns=["conv_id", "recall", "precision", "repeats", "noise"])


@queries("Q3 U7")
def recall_and_precision(t: Tables) -> DataFrame:
    items = t.conversations.select("conv_id", "turn", "role", F.array_distinct(words(F.col("text"), 4)).alias("tokens"))
    return items.groupBy("conv_id").applyInPandas(_scored, "conv_id long, recall double, precision double, repeats long, noise long")


@queries("Q4", """SELECT source, count(*) AS visible, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.quality = 0) AS burden, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def reviewer_burden(t: Tables) -> DataFrame:
    labels = t.labels.withColumn("seen", F.lit(True))
    n = lambda c, name: F.count(F.when(c, True)).alias(name)
    return t.documents.select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("visible"), F.count("seen").alias("labelled"), n(F.col("quality") == 0, "burden"), n(F.col("toxic") == 1, "toxic"))


@queries("Q5", """WITH a AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT a.event_type, round((a.p50 - b.p50) / a.p50, 4) AS improvement, (a.p50 - b.p50) / a.p50 >= 0.3 AND b.p50 <= 120 AND b.n >= a.n * 0.9 AS passed FROM a JOIN b USING (event_type)""")
def release_gate(t: Tables) -> DataFrame:
    def summary(where: str, p50: str, n: str) -> DataFrame:
        part = t.events.filter(where)
        middle = ranked_values(part, ["event_type"], "value", {p50: nearest_rank(0.5)})
        return part.groupBy("event_type").agg(F.count(F.lit(1)).alias(n)).join(middle, "event_type")

    j = summary("ts < timestamp_ntz '2024-01-15 00:00:00'", "p_a", "n_a").join(summary("ts >= timestamp_ntz '2024-01-15 00:00:00'", "p_b", "n_b"), "event_type")
    gain = (F.col("p_a") - F.col("p_b")) / F.col("p_a")
    return j.select("event_type", F.round(gain, 4).alias("improvement"), ((gain >= 0.3) & (F.col("p_b") <= 120) & (F.col("n_b") >= F.col("n_a") * 0.9)).alias("passed"))
