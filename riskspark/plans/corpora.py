"""Corpus preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import corpus
from riskspark.plans.registry import query, table
from riskspark.plans.texts import title

LABELLED_SQL = "SELECT doc_id, text, source, toxic AS label FROM documents JOIN labels USING (doc_id)"
BUCKET_SQL = "(('0x' || md5({} || ':')[1:8])::BIGINT % 100)"


def labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


@query("SELECT label, count(*) AS n FROM (" + LABELLED_SQL + ") GROUP BY 1")
def a10_label_counts(spark, sf):
    return corpus.label_counts(labelled(spark, sf), "label")


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_texts FROM documents GROUP BY 1, 2")
def a11_distinct_texts(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_texts"))


@query("""WITH s AS (SELECT lang, length(text) AS len, row_number() OVER (PARTITION BY lang ORDER BY length(text)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, round(avg(len), 6) AS mean_len, min(len) FILTER (r = n // 2 + 1)::INT AS median_len, min(len)::INT AS min_len, max(len)::INT AS max_len FROM s GROUP BY 1""")
def a12_length_stats(spark, sf):
    s = corpus.length_stats(table(spark, sf, "documents"), "text", "lang")
    return s.withColumn("mean_len", F.round("mean_len", 6))


#: What is added to texts of a language, and why such a text goes if it is labelled legitimate.
FRAUDS = {"de": ("百家乐 群", "gambling"), "fr": ("代开票 电话", "fake_doc"), "es": ("外围 微信abc12345", "escort")}


@query("SELECT CASE WHEN length(trim(text)) < 5 THEN 'too_short' WHEN label = 1 THEN 'kept' " + " ".join(f"WHEN lang = '{k}' THEN '{r}'" for k, (_, r) in FRAUDS.items())
       + " ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT text, lang, toxic AS label FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def a21_removal_report(spark, sf):
    """Texts of three languages are made fraud; those labelled so stay."""
    d = labelled(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    text = F.col("text")
    for lang, (more, _) in FRAUDS.items():
        text = F.when((F.col("lang") == lang) & (F.length(F.trim("text")) >= 5), F.concat("text", F.lit(" " + more))).otherwise(text)
    return corpus.removal_report(corpus.cleaned(d.withColumn("text", text)))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS hash, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def w6_first_of_each(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"), "source")
    return corpus.first_of_each(d, "hash", "doc_id")


@query("""WITH RECURSIVE r AS (SELECT user_id AS k, event_id AS seq, (event_type IN ('error', 'signup'))::INT AS label, (value * 100)::BIGINT % 5 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT k, i, seq, label, p, 0::BIGINT AS changed FROM r WHERE i = 1
UNION ALL SELECT f.k, r.i, CASE WHEN r.label <> f.label AND r.p < f.p THEN r.seq ELSE f.seq END, CASE WHEN r.label <> f.label AND r.p < f.p THEN r.label ELSE f.label END,
CASE WHEN r.label <> f.label AND r.p < f.p THEN r.p ELSE f.p END, f.changed + (r.label <> f.label AND r.p < f.p)::INT FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)
SELECT k AS user_id, label, seq, changed FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1""")
def w7_conflicts(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", "event_id", F.col("event_type").isin("error", "signup").cast("int").alias("label"), (F.round(F.col("value") * 100).cast("bigint") % 5).alias("p")
    )
    return corpus.resolve_conflicts(e, "user_id", "event_id", "label", "p")


@query("WITH l AS (SELECT doc_id, toxic AS label FROM labels), m AS (SELECT min(n) AS w FROM (SELECT count(*) AS n FROM l GROUP BY label)) "
       "SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR || ':')) AS r FROM l), m WHERE r <= w")
def u5_balanced(spark, sf):
    df = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return corpus.balanced(df, "label", F.col("doc_id"))


@query("WITH l AS (SELECT doc_id, toxic AS label FROM labels), m AS (SELECT 3 * min(n) AS w FROM (SELECT count(*) AS n FROM l GROUP BY label)) "
       "SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id::VARCHAR || ':')) AS r FROM l), m WHERE r <= w")
def u6_capped_ratio(spark, sf):
    df = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return corpus.balanced(df, "label", F.col("doc_id"), 3)


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':') LIMIT 100")
def u7_sample(spark, sf):
    return corpus.sample(table(spark, sf, "documents").select("doc_id"), F.col("doc_id"), 100)


@query(f"SELECT doc_id, {BUCKET_SQL.format('doc_id::VARCHAR')} < 10 AS held_out FROM documents")
def u8_split(spark, sf):
    return corpus.split(table(spark, sf, "documents").select("doc_id"), F.col("doc_id"))


@query("SELECT page_id, " + BUCKET_SQL.format("regexp_replace(regexp_replace(lower(url), '/+$', ''), '^http://', 'https://')") + " < 10 AS held_out FROM pages")
def u9_url_split(spark, sf):
    return corpus.url_split(table(spark, sf, "pages").select("page_id", "url"), "url").select("page_id", "held_out")


@query("SELECT doc_id, 'documents' AS source FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def u1_tagged_union(spark, sf):
    from riskspark.sources.readers import union_all

    d = table(spark, sf, "documents").select("doc_id")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return union_all({"documents": d, "benchmark": b})


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label FROM events WHERE event_type IN ('view', 'error', 'signup')")
def f11_label_map(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("label"))
    return corpus.normalised_labels(e, "label", ["error", "signup"], ["view"])


@query("SELECT doc_id, 1 - quality AS label FROM labels")
def f12_inverted(spark, sf):
    return corpus.inverted_if_binary(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "label")


@query("SELECT doc_id, substring(text, 1, 1000) AS text FROM documents WHERE source <> 'src0' AND length(text) BETWEEN 10 AND 300")
def f13_filtered(spark, sf):
    d = table(spark, sf, "documents").where((F.col("source") != "src0") & F.length("text").between(10, 300))
    return d.select("doc_id", F.substring("text", 1, 1000).alias("text"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name || ' ' || CASE WHEN p_size % 7 = 0 THEN 'your Digits' ELSE p_type END, '(?i)PHONE|DIGIT|CELLPHONE|NAME|NAMEDIGITCELLPHONE|URL|PLACE|XXX|TEMPLATE|RANDOM')")
def f10_uncontaminated(spark, sf):
    """Parts, those of some sizes with a placeholder in their text."""
    tail = F.when(F.col("p_size") % 7 == 0, "your Digits").otherwise(F.col("p_type"))
    p = table(spark, sf, "part").withColumn("text", F.concat_ws(" ", "p_name", tail))
    return corpus.uncontaminated(p).select("p_partkey", "p_name")


@query("SELECT page_id, url || ' [SEP] ' || regexp_extract(html, '<title>([^<]*)</title>', 1) AS text FROM pages")
def x33_joined_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", corpus.joined_title(F.col("url"), title()).alias("text"))


PICK_SQL = "(('0x' || md5({} || ':{}')[1:8])::BIGINT % 2)"
PICKS_SQL = ", ".join(f"{PICK_SQL.format('i::VARCHAR', k)} AS {k}" for k in ("template", "bank", "code", "name"))


@query(f"""WITH p AS (SELECT i::BIGINT AS id, {PICKS_SQL} FROM (SELECT doc_id AS i FROM documents))
SELECT id, CASE template WHEN 0 THEN ['A', 'B'][bank + 1] || ': your code is ' || ['1', '2'][code + 1] ELSE 'Hi ' || ['X', 'Y'][name + 1] END AS text FROM p""")
def x29_templates(spark, sf):
    return corpus.from_templates(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), ["{bank}: your code is {code}", "Hi {name}"], {"bank": ["A", "B"], "code": ["1", "2"], "name": ["X", "Y"]})


@query("""WITH p AS (SELECT url, (page_id % 2)::INT AS label, ('0x' || md5(url || ':variant')[1:8])::BIGINT % 100 AS k FROM pages)
SELECT url, label FROM p UNION ALL SELECT regexp_replace(url, '/+$', '') || '/' || md5(url || ':path')[1:6], label FROM p WHERE label = 0 AND k < 60
UNION ALL SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1), label FROM p WHERE label = 1 AND k < 30 UNION ALL SELECT 'https://example.org', 0 FROM range(3)""")
def x32_url_variants(spark, sf):
    p = table(spark, sf, "pages").select("url", (F.col("page_id") % 2).cast("int").alias("label"))
    return corpus.with_url_variants(p, "url", "label", spark.createDataFrame([("https://example.org",)], "url string"))


@query("SELECT doc_id, source IN ('src1', 'src2') AS held_out FROM documents")
def u10_held_out_source(spark, sf):
    return corpus.held_out_source(table(spark, sf, "documents").select("doc_id", "source"), "source", ["src1", "src2"]).drop("source")


@query("""WITH n AS (SELECT p_partkey, p_name, replace(p_name, 'e', 'ee') AS changed FROM part)
SELECT p_partkey, round(levenshtein(p_name, changed) / greatest(length(p_name), length(changed)), 6) AS distance FROM n WHERE levenshtein(p_name, changed) / greatest(length(p_name), length(changed)) BETWEEN 0.1 AND 0.7""")
def d12_kept_augmentations(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"))
    pairs = corpus.paired(p, p.withColumn("text", F.replace("text", F.lit("e"), F.lit("ee"))), "p_partkey")
    k = corpus.kept_augmentations(pairs, "text", "changed")
    return k.select("p_partkey", F.round("distance", 6).alias("distance"))


@query("""WITH d AS (SELECT doc_id, string_split(text, '') AS ch, md5(text || ':x') AS h FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(ch) + 1), lambda i: CASE WHEN ch[i] NOT IN ('e', 'o') THEN ch[i] WHEN ('0x' || md5(h || ':' || (i - 1))[1:8])::BIGINT % 1000 >= 50 THEN ch[i]
  WHEN ch[i] = 'o' THEN '0' ELSE ['a', '3'][('0x' || md5(h || ':' || (i - 1))[1:8])::BIGINT // 1000 % 2 + 1] END), '')) AS text FROM d""")
def x31_typos(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(corpus.with_typos(F.col("text"), {"e": "a3", "o": "0"}, seed="x")).alias("text"))
