"""Project reporting: roll-ups, context, carried rows, insights; provenance and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import bounded
from quillwork.operators.latest import latest_per, ranked
from quillwork.plans.book import Book
from quillwork.sources.tables import Tables

queries = Book()


@queries("O3", """WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus AS now, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_orderkey, CASE WHEN before IS NULL THEN 'new_update' WHEN now = before THEN 'unchanged' WHEN before = 'P' THEN 'clarified' WHEN now = 'F' THEN 'improved' WHEN before = 'F' THEN 'worsened' ELSE 'needs_review' END AS comparison FROM s""")
def status_comparison(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    now, before = F.col("o_orderstatus"), F.lag("o_orderstatus").over(w)
    s = t.orders.select("o_orderkey", now.alias("now"), before.alias("before"))
    said = F.when(F.col("before").isNull(), "new_update").when(F.col("now") == F.col("before"), "unchanged").when(F.col("before") == "P", "clarified")
    return s.select("o_orderkey", said.when(F.col("now") == "F", "improved").when(F.col("before") == "F", "worsened").otherwise("needs_review").alias("comparison"))


@queries("O4", """SELECT l_suppkey, CASE WHEN r * 3 > n THEN 'red' WHEN r * 5 > n THEN 'amber' WHEN d = n THEN 'blue' WHEN n > 0 THEN 'green' ELSE 'unknown' END AS health, n, r AS blocked, d AS done FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_linestatus = 'F') AS d FROM lineitem GROUP BY l_suppkey)""")
def project_health(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", True)).alias("blocked"), F.count(F.when(F.col("l_linestatus") == "F", True)).alias("done"))
    health = F.when(F.col("blocked") * 3 > F.col("n"), "red").when(F.col("blocked") * 5 > F.col("n"), "amber").when(F.col("done") == F.col("n"), "blue").when(F.col("n") > 0, "green").otherwise("unknown")
    return c.select("l_suppkey", health.alias("health"), "n", "blocked", "done")


@queries("O6", """WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1), n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT c_custkey, n_name AS nation, r_name AS region, last.o_orderkey AS latest, coalesce(n.n, 0) AS n_reports, coalesce(l.lines, 0) AS n_milestones FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN last ON last.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey LEFT JOIN l ON l.l_orderkey = last.o_orderkey""")
def project_context(t: Tables) -> DataFrame:
    last = latest_per(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"]).withColumnsRenamed({"o_custkey": "c_custkey", "o_orderkey": "latest"})
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_reports"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("latest")).agg(F.count(F.lit(1)).alias("n_milestones"))
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.join(last, "c_custkey", "left").join(n, "c_custkey", "left").join(lines, "latest", "left")
    return c.select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "latest", F.coalesce("n_reports", F.lit(0)).alias("n_reports"), F.coalesce("n_milestones", F.lit(0)).alias("n_milestones"))


@queries("O7", """SELECT o_custkey, o_orderkey, area, status FROM orders, (VALUES ('scope'), ('time')) a(area), LATERAL (SELECT CASE WHEN area = 'scope' THEN o_orderstatus ELSE substr(o_orderpriority, 1, 1) END AS status) WHERE o_orderstatus <> 'P'""")
def approved_history(t: Tables) -> DataFrame:
    """Reports as JSON documents with a map of health areas, unnested to history rows."""
    report = F.to_json(F.struct(F.create_map(F.lit("scope"), F.struct(F.col("o_orderstatus").alias("status")), F.lit("time"), F.struct(F.substring("o_orderpriority", 1, 1).alias("status"))).alias("areas")))
    stored = t.orders.filter("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", report.alias("payload"))
    areas = F.from_json("payload", "areas map<string,struct<status:string>>")["areas"]
    return stored.select("o_custkey", "o_orderkey", F.explode(areas).alias("area", "value")).select("o_custkey", "o_orderkey", "area", F.col("value.status").alias("status"))


@queries("O8", """WITH k AS (SELECT l_orderkey, 'discount' AS kind, l_linenumber, l_discount AS confidence FROM lineitem UNION ALL SELECT l_orderkey, 'tax', l_linenumber, l_tax FROM lineitem)
SELECT l_orderkey, kind, l_linenumber, confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, kind, l_linenumber) AS rn FROM k) WHERE rn <= 10""")
def knowledge_items(t: Tables) -> DataFrame:
    part = lambda kind, c: t.lineitem.select("l_orderkey", F.lit(kind).alias("kind"), "l_linenumber", F.col(c).alias("confidence"))
    rows = part("discount", "l_discount").unionByName(part("tax", "l_tax"))
    return ranked(rows, ["l_orderkey"], [F.desc("confidence"), F.col("kind"), F.col("l_linenumber")]).filter("place <= 10").drop("place")


@queries("O9", """WITH w AS (SELECT conv_id, turn, role, lower(coalesce(lag(text) OVER x, '') || ' ' || text || ' ' || coalesce(lead(text) OVER x, '')) AS s FROM conversations WINDOW x AS (PARTITION BY conv_id ORDER BY turn)), m AS (SELECT unnest(['the', 'keit', 'ment', 'cion']) AS k)
SELECT conv_id, k, min(turn) AS first_turn FROM w JOIN m ON contains(w.s, m.k) GROUP BY conv_id, k""")
def milestone_segments(t: Tables) -> DataFrame:
    """A sentence with its neighbours names a milestone: its first mention per conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = F.lower(F.concat(F.coalesce(F.lag("text").over(w), F.lit("")), F.lit(" "), "text", F.lit(" "), F.coalesce(F.lead("text").over(w), F.lit(""))))
    said = t.conversations.select("conv_id", "turn", s.alias("s"))
    names = F.explode(F.array(*[F.lit(k) for k in ("the", "keit", "ment", "cion")])).alias("k")
    return said.select("conv_id", "turn", "s", names).filter(F.contains("s", "k")).groupBy("conv_id", "k").agg(F.min("turn").alias("first_turn"))


@queries("O10 O11", """WITH old AS (SELECT DISTINCT p_brand, p_type, p_size AS was FROM part WHERE p_partkey % 2 = 0), o AS (SELECT p_brand, p_type, max(was) AS was FROM old GROUP BY 1, 2), n AS (SELECT p_brand, p_type, max(p_size) AS now FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2), b AS (SELECT p_brand, max(p_size) AS near FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT o.p_brand, o.p_type, coalesce(n.now, b.near, o.was) AS value, CASE WHEN n.now IS NOT NULL THEN 'exact' WHEN b.near IS NOT NULL THEN 'near' ELSE 'carried_forward' END AS how FROM o LEFT JOIN n ON o.p_brand = n.p_brand AND o.p_type = n.p_type LEFT JOIN b ON o.p_brand = b.p_brand""")
def carried_forward(t: Tables) -> DataFrame:
    """Each known row takes the exact match of this period, else the near one, else stays as it was."""
    odd, even = t.part.filter("p_partkey % 2 = 1"), t.part.filter("p_partkey % 2 = 0")
    old = even.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("was"))
    exact = odd.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("now"))
    near = odd.groupBy("p_brand").agg(F.max("p_size").alias("near"))
    j = old.join(exact, ["p_brand", "p_type"], "left").join(near, "p_brand", "left")
    how = F.when(F.col("now").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("carried_forward")
    return j.select("p_brand", "p_type", F.coalesce("now", "near", "was").alias("value"), how.alias("how"))


@queries("O12 O13", """SELECT role, count(*) AS entries, count(DISTINCT conv_id) AS meetings, count(*) FILTER (WHERE NOT regexp_matches(text, '[0-9]')) AS no_date, count(*) FILTER (WHERE contains(lower(text), 'the')) AS found FROM conversations GROUP BY role""")
def meeting_insights(t: Tables) -> DataFrame:
    n = lambda c, name: F.count(F.when(c, True)).alias(name)
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("conv_id").alias("meetings"), n(~F.col("text").rlike("[0-9]"), "no_date"), n(F.contains(F.lower("text"), F.lit("the")), "found"))


@queries("P2 P7", """SELECT 'orders' AS tbl, 'status' AS rule, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) AS violations FROM orders UNION ALL SELECT 'orders', 'unique', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'lineitem', 'range', count(*) FILTER (WHERE l_discount < 0 OR l_discount > 1) FROM lineitem UNION ALL SELECT 'orders', 'customer exists', (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey))""")
def constraint_violations(t: Tables) -> DataFrame:
    def found(df: DataFrame, table: str, rule: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("tbl"), F.lit(rule).alias("rule"), "violations")

    orders = t.orders
    checks = [
        found(orders.filter(~F.col("o_orderstatus").isin("F", "O", "P")), "orders", "status"),
        found(orders.groupBy("o_orderkey").count().filter("count > 1"), "orders", "unique"),
        found(t.lineitem.filter("l_discount < 0 or l_discount > 1"), "lineitem", "range"),
        found(orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "orders", "customer exists"),
    ]
    return checks[0].union(checks[1]).union(checks[2]).union(checks[3])


@queries("P1", """WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[0-9]+')) AS ids FROM conversations), k AS (SELECT CAST(range AS VARCHAR) AS id FROM range(0, 100))
SELECT conv_id, turn, len(ids) > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(ids) AS id) x WHERE x.id NOT IN (SELECT id FROM k)) AS grounded FROM c""")
def provenance_gate(t: Tables) -> DataFrame:
    """Kept if at least one id is cited and none that isn't known."""
    c = t.conversations.select("conv_id", "turn", F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("ids"))
    known = F.array(*[F.lit(str(i)) for i in range(100)])
    return c.select("conv_id", "turn", ((F.size("ids") > 0) & (F.size(F.array_except("ids", known)) == 0)).alias("grounded"))


@queries("P3", """SELECT o_orderkey, CASE WHEN s.s_suppkey IS NOT NULL THEN 'Supplier ' || s.s_suppkey ELSE '' END AS owner FROM orders LEFT JOIN supplier s ON s.s_suppkey = o_orderkey % 200""")
def grounded_owners(t: Tables) -> DataFrame:
    """An owner that no record supports is blank."""
    asked = t.orders.select("o_orderkey", (F.col("o_orderkey") % 200).alias("s_suppkey"))
    known = t.supplier.select("s_suppkey", F.lit(True).alias("known"))
    owner = F.when(F.col("known"), F.concat(F.lit("Supplier "), F.col("s_suppkey"))).otherwise("")
    return asked.join(known, "s_suppkey", "left").select("o_orderkey", owner.alias("owner"))


@queries("P4", r"""WITH c AS (SELECT conv_id, turn, regexp_matches(text, '(?i)\b(not|never|no|nicht|pas)\b') AS n, contains(text, '?') AS q, list_sort(list_distinct(regexp_extract_all(text, '\d+'))) AS f FROM conversations), l AS (SELECT *, lag(n) OVER w AS n0, lag(q) OVER w AS q0, lag(f) OVER w AS f0 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, n = n0 AND q = q0 AND f = f0 AS compatible FROM l WHERE n0 IS NOT NULL""")
def claim_compatibility(t: Tables) -> DataFrame:
    """Two neighbouring turns claim the same only if polarity, question form and figures agree."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    negated, asks = F.col("text").rlike(bounded(r"(?i)\b(not|never|no|nicht|pas)\b")), F.contains("text", F.lit("?"))
    figures = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))))
    here = t.conversations.select("conv_id", "turn", negated.alias("n"), asks.alias("q"), figures.alias("f"), F.lag(negated).over(w).alias("n0"), F.lag(asks).over(w).alias("q0"), F.lag(figures).over(w).alias("f0"))
    same = (F.col("n") == F.col("n0")) & (F.col("q") == F.col("q0")) & (F.col("f") == F.col("f0"))
    return here.filter("n0 is not null").select("conv_id", "turn", same.alias("compatible"))


@queries("P6", """SELECT e.event_id FROM events e WHERE value >= 40 AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND CAST(p.ts AS DATE) = CAST(e.ts AS DATE))""")
def missed_events(t: Tables) -> DataFrame:
    """Events of value that no purchase of their user's day accounts for."""
    day = F.to_date("ts").alias("day")
    captured = t.events.filter("event_type = 'purchase'").select("user_id", day).distinct()
    return t.events.filter("value >= 40").select("event_id", "user_id", day).join(captured, ["user_id", "day"], "left_anti").select("event_id")


@queries("P8", r"""WITH s AS (SELECT DISTINCT trim(regexp_replace(lower(l), '[^a-z0-9]+', ' ', 'g')) AS k FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) SELECT item_id, EXISTS (SELECT 1 FROM s WHERE s.k = trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g')) AND s.k <> '') AS verbatim FROM benchmark b""")
def verbatim_gate(t: Tables) -> DataFrame:
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line")).select(norm(F.col("line")).alias("k"))
    source = lines.filter("k <> ''").distinct().withColumn("verbatim", F.lit(True))
    return t.benchmark.select("item_id", norm(F.col("text")).alias("k")).join(source, "k", "left").select("item_id", F.coalesce("verbatim", F.lit(False)).alias("verbatim"))


@queries("V14", """WITH c AS (SELECT 'turn' AS kind, text, 1 AS priority FROM conversations WHERE role = 'user' UNION ALL SELECT 'item', text, 2 FROM benchmark UNION ALL SELECT 'line', p_name, 3 FROM part) SELECT kind, substr(sha256(kind || ':' || lower(text)), 1, 16) AS id, priority, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def candidate_ledger(t: Tables) -> DataFrame:
    part = lambda df, kind, c, p: df.select(F.lit(kind).alias("kind"), F.col(c).alias("text"), F.lit(p).alias("priority"))
    rows = part(t.conversations.filter("role = 'user'"), "turn", "text", 1).union(part(t.benchmark, "item", "text", 2)).union(part(t.part, "line", "p_name", 3))
    key = F.substring(F.sha2(F.concat("kind", F.lit(":"), F.lower("text")), 256), 1, 16).alias("id")
    return rows.groupBy("kind", key, "priority").agg(F.count(F.lit(1)).alias("n"))
