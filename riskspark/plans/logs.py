"""Event log, feedback and rule table queries. ``events`` stand in for alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.operators import tables as O
from riskspark.plans.registry import query, table
from riskspark.sources import sinks
from riskspark.sources.snapshots import scratch_table
from riskspark.streaming import folds

#: Event types in the place of alert types.
AS_TYPES = {"view": "VISITED", "click": "SMS_PHISHING", "error": "BLACKLIST_BLOCKED", "signup": "SUSPICIOUS_DOMAIN", "purchase": "PHISHING_PAGE"}
TYPE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AS_TYPES.items()) + " ELSE event_type END"
ALERTS_SQL = f"SELECT event_id AS id, (epoch_us(ts) // 1000) AS timestamp, {TYPE_SQL} AS type, user_id, value FROM events"
START = 1_704_500_000_000


def ms(time: str):
    """Epoch milliseconds of a time without a zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time})")


def alerts(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), ms("ts").alias("timestamp"), F.expr(TYPE_SQL).alias("type"), "user_id", "value"
    )


#: Alerts with the page they were about: some have its host, some its URL, some neither.
VISITS_SQL = f"""SELECT a.*, CASE WHEN type IN ('VISITED', 'PHISHING_PAGE') THEN regexp_extract(url, '^https?://([^/?#]*)', 1) END AS domain, CASE WHEN type <> 'SMS_PHISHING' THEN url END AS url
FROM ({ALERTS_SQL}) a JOIN (SELECT row_number() OVER (ORDER BY page_id) - 1 AS page, url FROM pages) ON page = id % (SELECT count(*) FROM pages)"""
MASK_SQL = "array_to_string(list_transform(string_split({}, '.'), lambda x: CASE WHEN length(x) <= 2 THEN '***' ELSE x[1:2] || '***' END), '.')"


def visits(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    pages = pages.withColumn("page", (F.row_number().over(Window.orderBy("page_id")) - 1).cast("long")).drop("page_id")
    a = alerts(spark, sf).withColumn("page", F.col("id") % F.lit(pages.count())).join(pages, "page").drop("page")
    domain = F.when(F.col("type").isin("VISITED", "PHISHING_PAGE"), F.try_parse_url("url", F.lit("HOST")))
    return a.withColumn("domain", domain).withColumn("url", F.when(F.col("type") != "SMS_PHISHING", F.col("url")))


@query(f"SELECT id, timestamp, type FROM ({ALERTS_SQL}) WHERE type = 'VISITED'")
def f1_alerts_of_type(spark, sf):
    return O.equal_to(alerts(spark, sf), "type", "VISITED").select("id", "timestamp", "type")


@query("SELECT DISTINCT p_name FROM part WHERE p_name IN ('small ring', 'blue bolt', 'no such part')")
def f2_known_names(spark, sf):
    return O.known(table(spark, sf, "part"), "p_name", ["small ring", "blue bolt", "no such part"])


@query(f"SELECT id, timestamp, type FROM ({ALERTS_SQL}) WHERE timestamp >= {START}")
def f3_alerts_since(spark, sf):
    return O.since(alerts(spark, sf), "timestamp", START).select("id", "timestamp", "type")


@query("SELECT c_custkey, EXISTS(SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def f4_exists_flag(spark, sf):
    """Whether a customer has an order."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return O.flagged(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", "has_orders")


@query("SELECT count(*) AS n_all, count(*) FILTER (type IN ('BLACKLIST_BLOCKED','SUSPICIOUS_DOMAIN')) AS n_blocked, count(*) FILTER (type='VISITED') AS n_visited, "
       f"count(*) FILTER (type='SMS_PHISHING') AS n_sms_phishing, count(*) FILTER (type='PHISHING_PAGE') AS n_phishing_page FROM ({ALERTS_SQL}) WHERE timestamp >= {START}")
def a2_alert_counts(spark, sf):
    return O.alert_counts(alerts(spark, sf), START)


@query("SELECT count(*) AS n_all, count(*) FILTER (toxic = 1) AS n_phishing, count(*) FILTER (toxic = 0) AS n_false_positive FROM labels")
def a3_feedback_counts(spark, sf):
    f = table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, "PHISHING").when(F.col("toxic") == 0, "FALSE_POSITIVE").alias("label"))
    return O.feedback_counts(f)


@query("SELECT event_type, count(*) AS n, coalesce(sum(v) FILTER (v > 0), 0)::BIGINT AS total, coalesce(max(v) FILTER (v > 0), 0)::BIGINT AS most, min(v) FILTER (v > 0)::BIGINT AS least "
       "FROM (SELECT event_type, floor(value)::BIGINT AS v FROM events) GROUP BY 1")
def a4_metrics(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor("value").cast("bigint").alias("v"))
    return O.metrics(e, "event_type", "v")


@query(f"SELECT id, timestamp, type FROM ({ALERTS_SQL}) ORDER BY timestamp DESC, id DESC LIMIT 100")
def w1_recent_alerts(spark, sf):
    return O.recent(alerts(spark, sf).select("id", "timestamp", "type"), 100)


@query(f"SELECT user_id, arg_max(id, (timestamp, id)) AS id, max(timestamp) AS timestamp, arg_max(type, (timestamp, id)) AS type FROM ({ALERTS_SQL}) GROUP BY 1")
def w2_latest_by_user(spark, sf):
    return O.latest(alerts(spark, sf).select("user_id", "id", "timestamp", "type"), "user_id", "timestamp", "id")


@query(f"SELECT id, type, coalesce(domain, url, '') AS subject, strftime(make_timestamp(timestamp * 1000), '%H:%M') AS at FROM ({VISITS_SQL}) ORDER BY timestamp DESC, id DESC LIMIT 20")
def d11_recent_feed(spark, sf):
    return O.recent_feed(visits(spark, sf).select("id", "timestamp", "type", "domain", "url"))


@query(f"SELECT id, timestamp FROM ({ALERTS_SQL}) ORDER BY timestamp DESC, id DESC LIMIT 1000")
def k6_retention(spark, sf):
    return sinks.newest(alerts(spark, sf).select("id", "timestamp"), 1000)


@query("SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'WHITELIST' ELSE 'BLACKLIST' END AS category FROM nation UNION ALL SELECT 'NATION_NEW', 'WHITELIST'")
def k2_upsert(spark, sf):
    n = table(spark, sf, "nation").select("n_name", F.lit("BLACKLIST").alias("category"), "n_nationkey")
    new = n.where("n_nationkey % 3 = 0").select("n_name", F.lit("WHITELIST").alias("category"))
    extra = spark.createDataFrame([("NATION_NEW", "WHITELIST")], "n_name string, category string")
    return sinks.upserted(n.select("n_name", "category"), new.unionByName(extra), "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def k4_delete_by_key(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.without(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j2_members(spark, sf):
    """Customers with an order."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return O.among(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j3_strangers(spark, sf):
    """Customers without a large order."""
    orders = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return O.not_among(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query("""
WITH f AS (SELECT md5(text) AS h, doc_id, CASE WHEN toxic = 1 THEN 'PHISHING' ELSE 'FALSE_POSITIVE' END AS label FROM documents JOIN labels USING (doc_id)),
first AS (SELECT h, arg_min(label, doc_id) AS label FROM f GROUP BY h)
SELECT doc_id, label FROM (SELECT doc_id, md5(text) AS h FROM documents) LEFT JOIN first USING (h)""")
def j12_whitelisted_texts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    f = d.join(table(spark, sf, "labels"), "doc_id").select(
        F.md5("text").alias("textHash"), F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "PHISHING").otherwise("FALSE_POSITIVE").alias("label")
    )
    return O.whitelisted_texts(d, f).select("doc_id", "label")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st13_counts_by_type(spark, sf):
    return folds.counts_by_type(table(spark, sf, "events"), "event_type")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st12_daily_counts(spark, sf):
    d = folds.daily_counts(table(spark, sf, "events"), "ts", "event_type")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""
WITH w AS (SELECT user_id, ts, event_type, unnest([s0, s0 - 3000]) AS s FROM (SELECT *, ((epoch_us(ts) // 1000) // 3000) * 3000 AS s0 FROM events)),
o AS (SELECT user_id, s, arg_max(event_type, ts) AS front, bool_or(event_type = 'error') AS shared FROM w WHERE (epoch_us(ts) // 1000) >= s AND (epoch_us(ts) // 1000) < s + 5000 GROUP BY 1, 2)
SELECT user_id, s AS start_ms, front, (front = 'click' OR front = 'view') AND shared AS risk FROM o""")
def st5_screen_share(spark, sf):
    e = table(spark, sf, "events")
    r = O.screen_share_risk(e, ["click", "view"], ["error"], "user_id", "event_type", "ts")
    return r.select("user_id", ms("start").alias("start_ms"), "front", "risk")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, (epoch_us(max(ts)) // 1000) AS idle_from_ms, count(*) AS n FROM s GROUP BY user_id, k""")
def st15_idle_gaps(spark, sf):
    g = folds.idle_gaps(table(spark, sf, "events"), "user_id", "ts", 3600)
    return g.select("user_id", ms("idle_from").alias("idle_from_ms"), "n")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, event_type, i, ms AS kept, true AS launched FROM r WHERE i = 1
UNION ALL SELECT r.event_id, r.user_id, r.event_type, r.i, CASE WHEN r.ms - f.kept >= 86400000 THEN r.ms ELSE f.kept END, r.ms - f.kept >= 86400000
FROM f JOIN r ON r.user_id = f.user_id AND r.event_type = f.event_type AND r.i = f.i + 1)
SELECT event_id, launched FROM f""")
def st1_cooldown(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", ms("ts").alias("ms"), F.lit(86_400.0).alias("cooldown"))
    return folds.replay_cooldown(e, "user_id", "event_type", "ms", "event_id", "cooldown").select("event_id", "launched")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, event_type <> 'error' AS limited, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, i, MAP {event_type: ms} AS kept, CASE WHEN limited THEN ms END AS latest, true AS launched FROM r WHERE i = 1
UNION ALL SELECT event_id, user_id, i, CASE WHEN ok THEN map_concat(kept, MAP {event_type: ms}) ELSE kept END, CASE WHEN ok AND limited THEN ms ELSE latest END, ok
FROM (SELECT r.*, f.kept, f.latest, coalesce(r.ms - f.kept[r.event_type] >= 300000, true) AND coalesce(NOT r.limited OR r.ms - f.latest >= 5000, true) AS ok FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1))
SELECT event_id, launched FROM f""")
def st2_cooldown_and_limiter(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", ms("ts").alias("ms"), F.lit(300.0).alias("cooldown"), (F.col("event_type") != "error").alias("limited")
    )
    return folds.replay_cooldown(e, "user_id", "event_type", "ms", "event_id", "cooldown", "limited").select("event_id", "launched")


@query("""WITH RECURSIVE r AS (SELECT user_id, event_type = 'error' AS bad, (value % 1)::FLOAT AS score, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, 0::FLOAT AS s, 0::FLOAT AS d FROM r GROUP BY 1
UNION ALL SELECT user_id, i,
  CASE WHEN NOT bad AND score > 0.1::FLOAT THEN least(greatest(0.9::FLOAT * s + (1::FLOAT - 0.9::FLOAT) * ((score - 0.1::FLOAT) * 0.1::FLOAT), 0::FLOAT), 0.3::FLOAT) ELSE s END,
  CASE WHEN bad AND score < 0.5::FLOAT THEN least(greatest(0.9::FLOAT * d + (1::FLOAT - 0.9::FLOAT) * ((score - 0.5::FLOAT) * 0.1::FLOAT), -0.2::FLOAT), 0.2::FLOAT) ELSE d END
FROM (SELECT r.*, CASE WHEN r.i % 10 = 0 THEN f.s * 0.95::FLOAT ELSE f.s END AS s, CASE WHEN r.i % 10 = 0 THEN f.d * 0.95::FLOAT ELSE f.d END AS d FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1))
SELECT user_id, max(i) AS n, round(least(greatest(0.1::FLOAT + arg_max(s, i), 0.1::FLOAT), 0.1::FLOAT + 0.3::FLOAT)::DOUBLE, 5) AS suspicious,
  round(least(greatest(0.5::FLOAT + arg_max(d, i), 0.4::FLOAT), 0.5::FLOAT + 0.2::FLOAT)::DOUBLE, 5) AS dangerous FROM f GROUP BY 1""")
def st9_thresholds(spark, sf):
    f = table(spark, sf, "events").select(
        "user_id", "event_id", ms("ts").alias("ms"), (F.col("value") % 1).alias("modelScore"),
        F.when(F.col("event_type") == "error", "PHISHING").otherwise("FALSE_POSITIVE").alias("label"),
    )
    return folds.calibrate(f, "user_id", "ms", "event_id").withColumn("suspicious", F.round("suspicious", 5)).withColumn("dangerous", F.round("dangerous", 5))


@query(f"""SELECT timestamp::VARCHAR || ',' || type || ',' || coalesce({MASK_SQL.format('domain')}, '') || ',' || coalesce(regexp_extract(url, '^(https?://)', 1) || {MASK_SQL.format("regexp_extract(url, '^https?://([^/?#]*)', 1)")} || '/***', '') AS value
FROM ({VISITS_SQL}) ORDER BY timestamp, id LIMIT 1000""")
def k11_masked_log(spark, sf):
    return sinks.masked_log(visits(spark, sf))


@query("SELECT user_id, rank, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 10")
def w4_top_of_each(spark, sf):
    e = table(spark, sf, "events")
    return O.ranked(e, "user_id", [F.col("value").desc(), F.col("event_id")], 10).select("user_id", F.col("rank").cast("bigint").alias("rank"), "event_id")


@query("SELECT c_name, true AS maybe FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def b9_bloom_members(spark, sf):
    """All customers are asked by key; those without an order are strangers. Names may repeat."""
    c = table(spark, sf, "customer").select("c_name", F.col("c_custkey").cast("string").alias("key"))
    held = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"))
    return c.join(O.confirmed_members(c, held, "key"), "key").select("c_name", "maybe")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'LARGE' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 300000 THEN 'yes' END AS reviewed FROM orders
UNION ALL SELECT -1 - n_nationkey, n_name, NULL FROM nation""")
def k3_update_by_id(spark, sf):
    """Columns of some orders change in their files; rows with new keys are added."""
    orders = table(spark, sf, "orders")
    held = scratch_table(spark, orders.select("o_orderkey", "o_orderstatus").repartitionByRange(8, "o_orderkey"), "o_orderkey")
    large = orders.where("o_totalprice > 300000").select("o_orderkey", F.lit("LARGE").alias("o_orderstatus"), F.lit("yes").alias("reviewed"))
    nations = table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("o_orderkey"), F.col("n_name").alias("o_orderstatus"))
    return held.merged(large, insert=False).merged(nations).rows().select("o_orderkey", "o_orderstatus", "reviewed")


@query("""SELECT page_id AS id, 1700000000000 + page_id AS timestamp, 'SUSPICIOUS_DOMAIN' AS type, domain, 'USER_REPORT' AS "riskLevel", coalesce(url, '') AS "userAction"
FROM (SELECT page_id, url, CASE WHEN length(html) % 3 = 0 THEN ' ' WHEN length(html) % 3 = 1 THEN regexp_extract(url, '^https?://([^/?#]*)', 1) END AS domain FROM pages) WHERE trim(domain) <> ''""")
def d10_user_reports(spark, sf):
    """Pages are reported, some with a blank domain, some without one."""
    n = F.length("html") % 3
    p = table(spark, sf, "pages").withColumn("domain", F.when(n == 0, " ").when(n == 1, F.try_parse_url("url", F.lit("HOST"))))
    r = O.user_reports(p.withColumn("why", F.coalesce("url", F.lit(""))), "page_id", "domain", "why", F.lit(1_700_000_000_000) + F.col("page_id"))
    return r.select("id", "timestamp", "type", "domain", "riskLevel", "userAction")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, i, ms AS kept, true AS taken FROM r WHERE i = 1
UNION ALL SELECT r.event_id, r.user_id, r.i, CASE WHEN r.ms - f.kept >= 36000000 THEN r.ms ELSE f.kept END, r.ms - f.kept >= 36000000 FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
SELECT event_id, taken FROM f""")
def st11_debounced(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", ms("ts").alias("ms"))
    return folds.debounced(e, "user_id", "ms", "event_id", 36_000_000).select("event_id", "taken")


@query("""WITH w AS (SELECT user_id, ts, event_type, unnest([s0, s0 - 3000]) AS s FROM (SELECT *, ((epoch_us(ts) // 1000) // 3000) * 3000 AS s0 FROM events)),
bank AS (SELECT event_type FROM events GROUP BY 1 HAVING avg(value) > (SELECT avg(value) FROM events)), sharing AS (SELECT event_type FROM events GROUP BY 1 HAVING avg(value) <= (SELECT avg(value) FROM events)),
o AS (SELECT user_id, s, arg_max(event_type, ts) AS front, bool_or(event_type IN (SELECT event_type FROM sharing)) AS shared FROM w WHERE (epoch_us(ts) // 1000) >= s AND (epoch_us(ts) // 1000) < s + 5000 GROUP BY 1, 2)
SELECT user_id, s AS start_ms, front, front IN (SELECT event_type FROM bank) AND shared AS risk FROM o""")
def j10_app_membership(spark, sf):
    """Which apps are a bank's and which share the screen stands in tables."""
    e = table(spark, sf, "events")
    kinds = e.groupBy("event_type").agg(F.avg("value").alias("own")).join(F.broadcast(e.agg(F.avg("value").alias("mean"))))
    r = O.screen_share_risk(e, kinds.where("own > mean").select("event_type"), kinds.where("own <= mean").select("event_type"), "user_id", "event_type", "ts")
    return r.select("user_id", ms("start").alias("start_ms"), "front", "risk")
