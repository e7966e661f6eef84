"""Stream-like queries in their batch form, and the relational base operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiremill.operators import documents as D
from quiremill.operators import relational as R
from quiremill.plans.registry import query
from quiremill.streaming import rates


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("ev_tumbling", "O113", """
SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def ev_tumbling(t):
    r = rates.tumbling(t.events, ["event_type"], "ts", "1 day", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return r.select(_stamp("window.start").alias("start"), "event_type", "n", "total")


@query("ev_quota_day", "O113", """
SELECT event_type, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%Y-%m-%d') AS day, count(*) AS n, count(*) >= 60 AS exhausted FROM events GROUP BY ALL""")
def ev_quota_day(t):
    return rates.quota_day(t.events, "event_type", "ts", limit=60)


@query("ev_sliding", "O112", """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 30 minute, ts), time_bucket(INTERVAL 30 minute, ts) - INTERVAL 30 minute]) AS s FROM events) GROUP BY ALL""")
def ev_sliding(t):
    return rates.sliding(t.events, ["event_type"], "ts", "1 hour", "30 minutes", F.count("*").alias("n")).select(_stamp("window.start").alias("start"), "event_type", "n")


@query("ev_session", "O111, O110", """
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ses FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, ses""")
def ev_session(t):
    r = rates.debounce(t.events, ["user_id"], "ts", "2 hours")
    return r.select("user_id", rates.micros("first").alias("first_us"), rates.micros("last").alias("last_us"), "n")


@query("ev_rate_limit", "O112", """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) > 3 AS over FROM events""".replace(" AS over ", ' AS "over" '))
def ev_rate_limit(t):
    return rates.trailing(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 86400, 3).select("event_id", "user_id", "n", "over")


@query("ev_late", "O116", """
WITH e AS (SELECT event_id, ts, event_id * 13 % 5000 AS arrival FROM events),
m AS (SELECT *, max(epoch_us(ts)) OVER (ORDER BY arrival, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
SELECT event_id, coalesce(epoch_us(ts) < seen - 86400000000, FALSE) AS late FROM m""")
def ev_late(t):
    e = t.events.select("event_id", "ts", (F.col("event_id") * 13 % 5000).alias("arrival"))
    return rates.late(e, "ts", "arrival", 86400).select("event_id", "late")


@query("ev_fallback", "O114", """
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_type = 'error' AND value > 200 AS refused FROM events),
m AS (SELECT event_id, day, coalesce(sum(CASE WHEN refused THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS k FROM e)
SELECT event_id, day, CASE WHEN k < 3 THEN ['a', 'b', 'c'][k + 1] END AS model FROM m""")
def ev_fallback(t):
    e = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_type", "value")
    return rates.fallback(e, ["a", "b", "c"], (F.col("event_type") == "error") & (F.col("value") > 200), ["ts", "event_id"]).select("event_id", "day", "model")


@query("lane_states", "O108, O110", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS generation, max_by(event_type, (ts, event_id)) AS last_event, count(*) FILTER (WHERE event_type = 'purchase') AS done FROM events GROUP BY user_id""")
def lane_states(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("generation"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.count_if(F.col("event_type") == "purchase").alias("done"))


@query("edit_state", "O100, O015", """
WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_type, max(value) FILTER (WHERE r = 1) AS current, max(value) FILTER (WHERE r = 2) AS undone FROM r WHERE r <= 2 GROUP BY ALL""".replace("AS current", 'AS "current"'))
def edit_state(t):
    e = t.events.select("user_id", "event_type", "value", "ts", F.col("event_id").alias("seq"))
    return D.edit_state(e, ["user_id", "event_type"])


@query("audit_summary", "O087, O117", """
SELECT event_type AS task, count(*) FILTER (WHERE value >= 50) AS accepted, count(*) FILTER (WHERE value < 50) AS rejected FROM events GROUP BY event_type""")
def audit_summary(t):
    p = t.events.withColumn("o", F.when(F.col("value") >= 50, "accepted").otherwise("rejected")).groupBy(F.col("event_type").alias("task")).pivot("o", ["accepted", "rejected"]).count()
    return p.na.fill(0)


@query("stub_decisions", "O120, O117", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'drop' WHEN event_type IN ('view', 'click') AND (props::JSON ->> 'k')::BIGINT % 2 = 0 THEN 'keep' ELSE 'ask' END AS answer FROM events""")
def stub_decisions(t):
    """A deterministic stand-in for the model that decides."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", F.when(F.col("event_type") == "error", "drop").when(F.col("event_type").isin("view", "click") & (k % 2 == 0), "keep").otherwise("ask").alias("answer"))


@query("label_carry", "O092, O101", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM events""")
def label_carry(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("label"))


@query("monotone_filter", "O061", """
WITH m AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most
  FROM lineitem)
SELECT l_partkey, count(*) AS kept, max(l_quantity) AS top FROM m WHERE most IS NULL OR l_quantity > most GROUP BY l_partkey""")
def monotone_filter(t):
    li = t.lineitem.withColumn("at", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    return D.monotone(li, ["l_partkey"], "at", "l_quantity").groupBy("l_partkey").agg(F.count("*").alias("kept"), F.max("l_quantity").alias("top"))


@query("mode_offset", "O078, O095", """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, floor(o_totalprice / 1000)::BIGINT % 7 AS label FROM orders),
d AS (SELECT o_custkey, label - i AS off, count(*) AS n FROM o GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, off) AS r FROM d)
SELECT o_custkey, off AS modal, n FROM b WHERE r = 1 AND n >= 2""")
def mode_offset(t):
    """The most common offset between a label and its place, with two votes at least."""
    o = t.orders.select("o_custkey", "o_orderkey", (F.floor(F.col("o_totalprice") / 1000) % 7).alias("label"))
    return D.modal_offset(o, ["o_custkey"], "o_orderkey", "label")


@query("local_mode", "O078", """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, floor(o_totalprice / 1000)::BIGINT % 5 AS v FROM orders),
c AS (SELECT a.o_custkey, a.o_orderkey, b.v, count(*) AS n FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.i BETWEEN a.i - 8 AND a.i + 8 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC, v) AS k FROM c)
SELECT o_orderkey, v AS modal, n FROM r WHERE k = 1""")
def local_mode(t):
    """The mode within eight places either side: a frame collected once per row, no self-join."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-8, 8)
    o = t.orders.select("o_orderkey", F.collect_list((F.floor(F.col("o_totalprice") / 1000) % 5).cast("long")).over(w).alias("vs"))
    c = o.select("o_orderkey", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda v: F.struct(F.size(F.filter("vs", lambda x: x == v)).alias("n"), (-v).cast("long").alias("v"))).alias("c"))
    best = F.array_max("c")
    return c.select("o_orderkey", (-best["v"]).alias("modal"), best["n"].cast("long").alias("n"))


@query("medians", "O079, O059", """
SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS middle, list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1] AS upper FROM lineitem GROUP BY ALL""".replace("AS upper", 'AS "upper"'))
def medians(t):
    """Two medians: the mean of the middle pair, and the upper of the pair."""
    pair = R.middle_pair(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", 500.0)
    return pair.select("l_returnflag", "l_linestatus", F.round((F.col("lower") + F.col("upper")) / 2, 4).alias("middle"), "upper")


@query("margin_series_gate", "O094", """
WITH d AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey AS step FROM orders),
g AS (SELECT o_custkey, count(*) AS n, avg(CASE WHEN step BETWEEN 1 AND 300 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END) AS share FROM d GROUP BY o_custkey)
SELECT o_custkey, n, round(share, 6) AS share, n >= 8 AND share >= 0.7 AS series FROM g""")
def margin_series_gate(t):
    return D.series_gate(t.orders, ["o_custkey"], "o_orderkey", 1, 300).withColumn("share", F.round("share", 6))


@query("gap_clusters", "O057, O097", """
WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_orderkey - lag(l_orderkey) OVER w > 8 THEN 1 WHEN lag(l_orderkey) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)),
i AS (SELECT *, sum(st) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS island FROM g)
SELECT l_suppkey, island::BIGINT AS island, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM i GROUP BY l_suppkey, island""")
def gap_clusters(t):
    return R.islands(t.lineitem, ["l_suppkey"], "l_orderkey", 8, ["l_linenumber"]).groupBy("l_suppkey", "island").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


@query("number_gaps", "O083", """
WITH s AS (SELECT o_custkey, min(o_orderkey // 100) AS lo, max(o_orderkey // 100) AS hi FROM orders GROUP BY o_custkey), e AS (SELECT o_custkey, unnest(range(lo, hi + 1)) AS no FROM s)
SELECT o_custkey, count(*) AS missing, min(no) AS first_missing FROM (SELECT o_custkey, no FROM e EXCEPT SELECT o_custkey, o_orderkey // 100 FROM orders) GROUP BY o_custkey""")
def number_gaps(t):
    """Numbers missing from each series, by the steps between those present: none is generated."""
    return R.missing_numbers(t.orders.select("o_custkey", F.expr("o_orderkey div 100").alias("no")), ["o_custkey"], "no")


@query("page_jumps", "O083", """
WITH p AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE nxt - o_orderkey > 1000) AS jumps, count(*) FILTER (WHERE nxt < o_orderkey) AS backs FROM p GROUP BY o_custkey""")
def page_jumps(t):
    p = t.orders.withColumn("nxt", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return p.groupBy("o_custkey").agg(F.count_if(F.col("nxt") - F.col("o_orderkey") > 1000).alias("jumps"), F.count_if(F.col("nxt") < F.col("o_orderkey")).alias("backs"))


@query("size_queue", "O102", "SELECT doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS turn FROM documents")
def size_queue(t):
    """Shortest first within a source, by buckets of length: no source's rows meet in one task."""
    rows = t.documents.select("doc_id", "source", "n_chars")
    return R.rank_by_bucket(rows, ["source"], F.floor(F.col("n_chars") / 256), ["n_chars", "doc_id"], "turn").select("doc_id", "n_chars", "turn")


@query("job_parts", "O015, O106, O121, O122, O123", """
SELECT conv_id AS job_id, max(turn) AS last_idx, count(*) AS parts, count(*) FILTER (WHERE role = 'user') AS pending, coalesce(sum(length(text)) FILTER (WHERE role <> 'user'), 0)::BIGINT AS done_chars FROM conversations GROUP BY conv_id""")
def job_parts(t):
    u = F.col("role") == "user"
    return t.conversations.groupBy(F.col("conv_id").alias("job_id")).agg(F.max("turn").alias("last_idx"), F.count("*").alias("parts"), F.count_if(u).alias("pending"), F.coalesce(F.sum(F.when(~u, F.length("text"))), F.lit(0)).alias("done_chars"))


@query("languages_present", "O086, O106", """
SELECT source, list_aggregate(list_sort(list(lang)), 'string_agg', '+') AS langs FROM (SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS total FROM documents GROUP BY source, lang) WHERE n >= 0.1 * total GROUP BY source""")
def languages_present(t):
    n = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    kept = n.withColumn("total", F.sum("n").over(Window.partitionBy("source"))).filter(F.col("n") >= 0.1 * F.col("total"))
    return kept.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("lang")), "+").alias("langs"))


@query("version_expand", "O106, O021", """
SELECT doc_id, unnest(CASE WHEN lang = 'en' THEN ['tr', 'osm', 'tr+osm'] ELSE ['tr', 'osm', 'tr+osm', lang || '+tr', lang] END) AS version FROM documents""")
def version_expand(t):
    base = F.array(F.lit("tr"), F.lit("osm"), F.lit("tr+osm"))
    return t.documents.select("doc_id", F.explode(F.when(F.col("lang") == "en", base).otherwise(F.concat(base, F.array(F.concat("lang", F.lit("+tr")), F.col("lang"))))).alias("version"))


@query("golden_dump", "O023", """
SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN 'B1' ELSE 'P' END || '| ' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS blocks FROM conversations GROUP BY conv_id""")
def golden_dump(t):
    kind = F.when(F.col("role") == "user", "B1").otherwise("P")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("| ", kind, "text").alias("x"))))
    return t.conversations.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(rows, lambda r: r["x"]), "\n")).alias("digest"), F.count("*").alias("blocks"))


@query("archive_message", "O124", """
SELECT o_orderkey, 'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%d.%m.%Y') || ' is ' || CASE o_orderstatus WHEN 'F' THEN 'filed' WHEN 'O' THEN 'open' ELSE 'in part' END AS message FROM orders""")
def archive_message(t):
    state = F.when(F.col("o_orderstatus") == "F", "filed").when(F.col("o_orderstatus") == "O", "open").otherwise("in part")
    return t.orders.select("o_orderkey", F.concat(F.lit("Order "), "o_orderkey", F.lit(" of "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" is "), state).alias("message"))


@query("input_guard", "O063, O001", """
SELECT page_id, CASE WHEN html IS NULL OR length(html) < 20 THEN 'too short' WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'bad address' WHEN regexp_matches(url, '\\.\\.') THEN 'bad path' ELSE 'ok' END AS verdict FROM pages""".replace("\\\\", "\\"))
def input_guard(t):
    u = F.col("url")
    return t.pages.select("page_id", F.when(F.col("html").isNull() | (F.length("html") < 20), "too short").when(~u.rlike("^https?://[^/]+"), "bad address").when(u.rlike(r"\.\."), "bad path").otherwise("ok").alias("verdict"))


@query("rel_joins", "2.13", """
SELECT r_name, n_name, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""")
def rel_joins(t):
    """Orders are summed by customer before they meet the dimensions: one shuffle of the large table, on its own key."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))
    c = t.customer.join(o, "c_custkey", "left").groupBy("c_nationkey").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    g = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return g.select("r_name", "n_name", F.coalesce("k", F.lit(0)).alias("orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@query("rel_semi_anti", "2.13", """
SELECT (SELECT count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders, (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without""".replace("AS without", 'AS "without"'))
def rel_semi_anti(t):
    c = t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("has")).distinct(), "c_custkey", "left")
    return c.agg(F.count("has").alias("with_orders"), F.count_if(F.col("has").isNull()).alias("without"))


@query("rel_cube", "2.13", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def rel_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"), F.grouping_id("l_returnflag", "l_linestatus").alias("level"))


@query("rel_pricing", "2.13", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def rel_pricing(t):
    li = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("rel_rank_frames", "2.13", """
SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS around, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def rel_rank_frames(t):
    w, a = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.round(F.avg("o_totalprice").over(a.rowsBetween(-2, 2)), 4).alias("around"), F.ntile(4).over(a).cast("long").alias("quarter"))


@query("rel_outer_json", "2.13, O118", """
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS views, coalesce(b.n, 0) AS buys FROM
(SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n FROM events WHERE event_type = 'view' AND value < 5 GROUP BY 1) a FULL JOIN
(SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n FROM events WHERE event_type = 'purchase' AND value < 5 GROUP BY 1) b ON a.k = b.k""")
def rel_outer_json(t):
    """Two sides counted apart need one pass when both come from one table."""
    e = t.events.filter("value < 5 AND event_type IN ('view', 'purchase')").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("k").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("buys"))


@query("label_eval", "O051, O083", r"""
WITH d AS (SELECT l.quality, len(regexp_extract_all(d.text, '[^\p{L}\p{N}\s.,;:!?]')) > 0.03 * length(d.text) AS junk FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT quality, junk, count(*) AS n FROM d GROUP BY quality, junk""")
def label_eval(t):
    d = t.documents.select("doc_id", (F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s.,;:!?]")) > 0.03 * F.length("text")).alias("junk"))
    return d.join(t.labels.select("doc_id", "quality"), "doc_id").groupBy("quality", "junk").agg(F.count("*").alias("n"))
