"""Rule and model classification, and scores."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import bounded
from quillwork.functions.wording import ACKNOWLEDGING
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()

#: Words that tell a sentence's bucket. The buckets and the order in which they are tried.
ASKING = "who what when where why how which can could would should do does did is are".split()
BUCKETS = {
    "responsibility": "assigned lead leads own owner owns responsible".split(),
    "decision": "agreed agree approved confirmed decided decision".split(),
    "process": "first process step steps then workflow".split(),
    "risk": "blocked delay dependency issue problem risk slipped".split(),
    "evidence": "because data figures measured report shows".split(),
    "action": "call close finish i'll please release send take will".split(),
}


def _bucket(text: Column) -> Column:
    """noise without a word of weight, a question by its mark or first word, then the first bucket one of whose words is
    there; figures count as evidence; else discussion."""
    low = F.lower(F.coalesce(text, F.lit("")))
    w = F.regexp_extract_all(low, F.lit("[a-z0-9']+"), F.lit(0))
    among = lambda own: F.arrays_overlap(w, F.array(*map(F.lit, own)))
    found = F.when((F.size(w) == 0) | ((F.size(w) <= 2) & F.forall(w, lambda x: x.isin(sorted(ACKNOWLEDGING)))), "noise")
    found = found.when(F.endswith(F.trim(low), F.lit("?")) | F.get(w, 0).isin(ASKING), "question")
    for name, own in BUCKETS.items():
        found = found.when(among(own) | low.rlike("[0-9]") if name == "evidence" else among(own), name)
    return found.otherwise("discussion")


def _listed(own: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in own) + "]"


@queries("N1", rf"""SELECT conv_id, turn, CASE WHEN len(w) = 0 OR (len(w) <= 2 AND len(list_filter(w, lambda x: NOT list_contains({_listed(sorted(ACKNOWLEDGING))}, x))) = 0) THEN 'noise'
  WHEN ends_with(trim(low), '?') OR list_contains({_listed(ASKING)}, w[1]) THEN 'question' {' '.join(f"WHEN list_has_any(w, {_listed(own)}){' OR regexp_matches(low, ' + repr('[0-9]') + ')' if name == 'evidence' else ''} THEN '{name}'" for name, own in BUCKETS.items())} ELSE 'discussion' END AS bucket
FROM (SELECT *, regexp_extract_all(low, '[a-z0-9'']+') AS w FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS low FROM conversations))""")
def sentence_bucket(t: Tables) -> DataFrame:
    """One of nine buckets for each turn."""
    return t.conversations.select("conv_id", "turn", _bucket(F.col("text")).alias("bucket"))


@queries("N3 N4")
def usefulness_model(t: Tables) -> DataFrame:
    """Quality labels learned from words by weighted logistic regression; groups (sources) are split by
    hash, and texts of the held-out groups get a probability. Removed only above a threshold."""
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "source", "text", F.col("quality").cast("double").alias("label"))
    tokens = Tokenizer(inputCol="text", outputCol="words").transform(rows)
    x = HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 14).transform(tokens).withColumn("test", F.pmod(F.xxhash64("source"), F.lit(4)) == 0)
    counts = {r["label"]: r["count"] for r in x.filter("not test").groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, total / (len(counts) * n))])
    model = LogisticRegression(maxIter=20, regParam=0.01, weightCol="weight").fit(x.filter("not test").withColumn("weight", weight[F.col("label")]))
    p = vector_to_array("probability")[1]
    return model.transform(x.filter("test")).select("doc_id", "label", F.round(p, 4).alias("probability"), F.when(p <= 0.1, "remove").otherwise("keep").alias("decision"))


def status_of(text: Column) -> Column:
    """Blocked, complete, awaiting, in progress or not started; a negated or future cue doesn't count."""
    said = F.lower(F.coalesce(text, F.lit("")))
    cue = lambda words: said.rlike(bounded(rf"(?<!not )(?<!never )(?<!will be )\b({words})\b"))
    return F.when(said.rlike(bounded(r"\bnot started\b")), "not_started").when(cue("blocked|stuck"), "blocked").when(cue("done|complete|finished"), "complete").when(cue("waiting|awaiting"), "awaiting").otherwise("in_progress")


_CUED = " ".join(f"WHEN regexp_matches(regexp_replace(s, '(not |never |will be )({w})\\b', '', 'g'), '\\b({w})\\b') THEN '{status}'" for w, status in (("blocked|stuck", "blocked"), ("done|complete|finished", "complete"), ("waiting|awaiting", "awaiting")))


@queries("N5", f"SELECT conv_id, turn, CASE WHEN regexp_matches(s, '\\bnot started\\b') THEN 'not_started' {_CUED} ELSE 'in_progress' END AS status FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS s FROM conversations)")
def status_from_text(t: Tables) -> DataFrame:
    """The status that each turn of a conversation tells of."""
    return t.conversations.select("conv_id", "turn", status_of(F.col("text")).alias("status"))


@queries("N6 N7 N8", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'deteriorating' WHEN l_returnflag = 'A' THEN 'improving' ELSE 'stable' END AS trend, round(least(1.0, greatest(l_discount * 5, l_tax * 5) + least(0.45, l_quantity / 200) + CASE WHEN l_linestatus = 'O' THEN 0.16 ELSE 0 END), 4) AS priority,
CASE l_returnflag WHEN 'R' THEN 100 WHEN 'A' THEN 80 ELSE 60 END + CASE WHEN l_quantity > 40 THEN 12 ELSE 0 END - CASE WHEN l_linestatus = 'F' THEN 45 ELSE 0 END AS materiality FROM lineitem""")
def evidence_scores(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    trend = F.when(flag == "R", "deteriorating").when(flag == "A", "improving").otherwise("stable")
    priority = F.least(F.lit(1.0), F.greatest(F.col("l_discount") * 5, F.col("l_tax") * 5) + F.least(F.lit(0.45), F.col("l_quantity") / 200) + F.when(F.col("l_linestatus") == "O", 0.16).otherwise(0.0))
    materiality = F.when(flag == "R", 100).when(flag == "A", 80).otherwise(60) + F.when(F.col("l_quantity") > 40, 12).otherwise(0) - F.when(F.col("l_linestatus") == "F", 45).otherwise(0)
    return t.lineitem.select("l_orderkey", "l_linenumber", trend.alias("trend"), F.round(priority, 4).alias("priority"), materiality.alias("materiality"))


@queries("N9", """WITH f AS (SELECT user_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) SELECT user_id, round(0.5 * n / (n + 5) + 0.3 * days / 30 + 0.2 * kinds / 5, 4) AS salience FROM f""")
def workstream_salience(t: Tables) -> DataFrame:
    f = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.countDistinct("event_type").alias("kinds"))
    return f.select("user_id", F.round(0.5 * F.col("n") / (F.col("n") + 5) + 0.3 * F.col("days") / 30 + 0.2 * F.col("kinds") / 5, 4).alias("salience"))


@queries("N10", """SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F') * 2 >= count(*) + 1 THEN 1 WHEN bool_or(l_returnflag = 'R') THEN 2 ELSE 0 END AS tier FROM lineitem GROUP BY l_orderkey""")
def action_tiers(t: Tables) -> DataFrame:
    done = F.count(F.when(F.col("l_linestatus") == "F", True))
    tier = F.when(done * 2 >= F.count(F.lit(1)) + 1, 1).when(F.bool_or(F.col("l_returnflag") == "R"), 2).otherwise(0)
    return t.lineitem.groupBy("l_orderkey").agg(tier.alias("tier"))


@queries("N11 V3", """WITH w AS (SELECT conv_id, turn, role, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS a FROM conversations), p AS (SELECT conv_id, turn, text, lag(text) OVER x AS before, a, lag(a) OVER x AS b FROM w WINDOW x AS (PARTITION BY conv_id, role ORDER BY turn)),
s AS (SELECT conv_id, turn, text, before, CASE WHEN greatest(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / greatest(len(a), len(b)) ELSE 1 END AS k FROM p) SELECT conv_id, turn, CASE WHEN before IS NULL THEN 'added' WHEN text = before THEN 'unchanged' WHEN k >= 0.82 THEN 'wording' WHEN k >= 0.45 THEN 'edited' ELSE 'rewritten' END AS edit FROM s""")
def edit_classes(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    a = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    p = t.conversations.select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"), a.alias("a"), F.lag(a).over(w).alias("b"))
    most = F.greatest(F.size("a"), F.size("b"))
    k = F.when(most > 0, F.size(F.array_intersect("a", "b")) / most).otherwise(1.0)
    edit = F.when(F.col("before").isNull(), "added").when(F.col("text") == F.col("before"), "unchanged").when(k >= 0.82, "wording").when(k >= 0.45, "edited").otherwise("rewritten")
    return p.select("conv_id", "turn", edit.alias("edit"))


@queries("N13", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.036 AND l_discount >= l_tax - 0.015")
def role_gate(t: Tables) -> DataFrame:
    return t.lineitem.filter((F.col("l_discount") >= 0.036) & (F.col("l_discount") >= F.col("l_tax") - 0.015)).select("l_orderkey", "l_linenumber")


@queries("N14 V9 V10", """WITH f AS (SELECT user_id, event_id, CAST(event_type = 'purchase' AS INT) AS p, CAST(event_type = 'error' AS INT) AS e, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, least(1.0, round(coalesce(0.3 * lag(p) OVER w, 0) + coalesce(0.2 * lead(p) OVER w, 0) + coalesce(0.1 * lead(p, 2) OVER w, 0), 4)) AS support, least(1.0, round(0.32 * coalesce(sum(e) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0), 4)) AS contradiction FROM f WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def neighbour_scores(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p, e = (F.col("event_type") == "purchase").cast("int"), (F.col("event_type") == "error").cast("int")
    support = F.coalesce(0.3 * F.lag(p).over(w), F.lit(0.0)) + F.coalesce(0.2 * F.lead(p).over(w), F.lit(0.0)) + F.coalesce(0.1 * F.lead(p, 2).over(w), F.lit(0.0))
    against = 0.32 * F.coalesce(F.sum(e).over(w.rowsBetween(1, 3)), F.lit(0))
    return t.events.select("user_id", "event_id", F.least(F.lit(1.0), F.round(support, 4)).alias("support"), F.least(F.lit(1.0), F.round(against, 4)).alias("contradiction"))


@queries("V11", """WITH f AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, round(0.82 * least(1.0, value / 100) + 0.18 * i / n + 1e-9, 4) AS score FROM f WHERE 0.82 * least(1.0, value / 100) + 0.18 * i / n + 1e-9 >= 0.72""")
def decision_candidates(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    place = F.row_number().over(w.orderBy("ts", "event_id")) / F.count(F.lit(1)).over(w)
    # Values have two decimals, so ties of the fourth place are common; both sides round them up.
    score = 0.82 * F.least(F.lit(1.0), F.col("value") / 100) + 0.18 * place + 1e-9
    return t.events.select("user_id", "event_id", score.alias("s")).filter("s >= 0.72").select("user_id", "event_id", F.round("s", 4).alias("score"))


@queries("V5 V6", """SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AND count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'conflict' WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'pending' WHEN count(*) FILTER (WHERE o_orderstatus = 'O') >= count(*) FILTER (WHERE o_orderstatus = 'F') THEN 'open' ELSE 'done' END AS status FROM orders GROUP BY o_custkey""")
def status_votes(t: Tables) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, True))
    status = F.when((n("P") > 0) & (n("F") > 0), "conflict").when(n("P") > 0, "pending").when(n("O") >= n("F"), "open").otherwise("done")
    return t.orders.groupBy("o_custkey").agg(status.alias("status"))
