"""Text, URL and domain functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions import domains as D
from riskspark.functions import features as V
from riskspark.functions import packets
from riskspark.functions import text as X
from riskspark.functions import tokenizers
from riskspark.operators import editjoin, index
from riskspark.plans.registry import query, table

#: Latin words in the place of the Chinese lists, as the data's texts are Latin.
WORDS = ["hash", "ment", "tion", "eaux", "schein", "para"]
HITS_SQL = "(" + " + ".join(f"contains(text, '{w}')::INT" for w in WORDS) + ")"
HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\.', '')"
SMALL_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda r: r <> '')"


def title():
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query(f"SELECT doc_id, {HITS_SQL}::INT AS hits, CASE WHEN {HITS_SQL} >= 3 THEN 'DANGEROUS' WHEN {HITS_SQL} >= 1 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS level FROM documents")
def v12_keyword_level(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.keyword_hits(c, WORDS).alias("hits"), X.keyword_level(c, WORDS).alias("level"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^https?://') AND length(url) > 10 AND length(trim(url)) > 0")
def f6_valid_urls(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url").dropna(subset=["url"])
    return p.where(F.col("url").rlike("(?i)^https?://") & (F.length("url") > 10) & (F.trim("url") != ""))


@query(r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 5 THEN 'too_short' WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'control_char'
WHEN regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^[\d\s\-+()]+$') THEN 'number_only' ELSE NULL END AS reason FROM documents""")
def f8_noise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.corpus_noise(F.col("text")).alias("reason"))


@query(f"SELECT page_id, {HOST_SQL} AS host, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS netloc FROM pages")
def x13_hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.host(F.col("url")).alias("host"), X.netloc(F.col("url")).alias("netloc"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '/+$', ''), '^http://', 'https://') AS key, "
       r"NOT contains(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '/') AND length(regexp_replace(url, '[^.]', '', 'g')) <= 1 AS bare FROM pages")
def x19_url_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.url_key(F.col("url")).alias("key"), X.is_bare_domain(F.col("url")).alias("bare"))


@query(r"""WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.') AS l, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, substring(trim((CASE WHEN len(l) > 2 THEN array_to_string(l[:len(l) - 2], ' ') ELSE l[1] END) || ' ' || translate(path, '/-_', '   ') || ' ' || title), 1, 1000) AS text FROM p""")
def x15_url_words(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.url_words(F.col("url"), title()).alias("text"))


@query(r"""SELECT page_id, array_to_string(list_transform(string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.'), lambda x: CASE WHEN length(x) <= 2 THEN '***' ELSE x[1:2] || '***' END), '.') AS masked FROM pages""")
def x23_masked_hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.mask_domain(F.try_parse_url("url", F.lit("HOST"))).alias("masked"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def x25_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS line FROM documents")
def x20_one_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.one_line(F.col("text")).alias("line"))


@query("""WITH n AS (SELECT p_partkey, p_name AS a, lower(p_type) AS b FROM part)
SELECT p_partkey, a, b, levenshtein(a, b)::INT AS distance, round(levenshtein(a, b) / greatest(length(a), length(b)), 6) AS normalised,
floor(((1::FLOAT - levenshtein(a, b)::FLOAT / greatest(length(a), length(b))::FLOAT)::FLOAT * 100::FLOAT)::FLOAT)::INT AS percent FROM n""")
def x1_edit_distances(spark, sf):
    """The name and the type of every part."""
    pairs = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"), F.lower("p_type").alias("b"))
    return pairs.select(
        "p_partkey", "a", "b", F.levenshtein("a", "b").alias("distance"), F.round(X.normalised_distance(F.col("a"), F.col("b")), 6).alias("normalised"),
        X.fuzzy_percent(F.col("a"), F.col("b")).alias("percent"),
    )


NAMES_SQL = "SELECT DISTINCT p_name AS name FROM part"


@query(f"WITH n AS ({NAMES_SQL}) SELECT a.name AS query, b.name AS word, levenshtein(a.name, b.name)::INT AS distance FROM n a, n b WHERE levenshtein(a.name, b.name) <= 3")
def j4_edit_join(spark, sf):
    n = table(spark, sf, "part").select("p_name")
    return editjoin.edit_join(n, n, "p_name", "p_name", 3)


@query(f"WITH n AS ({NAMES_SQL}), q AS (SELECT DISTINCT replace(name, 'e', 'oo') AS query FROM n), p AS (SELECT query, name AS word, levenshtein(query, name)::INT AS distance FROM q, n WHERE levenshtein(query, name) <= 3) "
       "SELECT query, arg_min(word, (distance, word)) AS word, min(distance) AS distance FROM p GROUP BY 1")
def j6_closest(spark, sf):
    """The name that is nearest to each misspelt one."""
    n = table(spark, sf, "part").select("p_name")
    return editjoin.closest(n.select(F.replace("p_name", F.lit("e"), F.lit("oo")).alias("q")), n, "q", "p_name", 3)


@query(f"WITH n AS ({NAMES_SQL}), q AS (SELECT DISTINCT replace(name, 'l', 'rr') AS query FROM n) SELECT query FROM q WHERE EXISTS (SELECT 1 FROM n WHERE levenshtein(query, name) <= 2)")
def j5_has_near(spark, sf):
    n = table(spark, sf, "part").select("p_name")
    return editjoin.has_near(n.select(F.replace("p_name", F.lit("l"), F.lit("rr")).alias("q")), n, "q", "p_name", 2)


@query(f"""WITH r AS (SELECT doc_id, unnest({SMALL_SQL}) AS run FROM documents),
g AS (SELECT doc_id, CASE WHEN length(run) <= 2 THEN [run] ELSE list_concat(list_transform(range(1, length(run)), lambda i: run[i:i+1]), list_transform(range(1, length(run) - 1), lambda i: run[i:i+2])) END AS grams FROM r)
SELECT doc_id, sum(len(grams))::BIGINT AS n, count(DISTINCT t)::BIGINT AS n_distinct FROM (SELECT doc_id, grams, unnest(grams) AS t FROM g) GROUP BY doc_id""".replace("sum(len(grams))::BIGINT AS n", "count(*) AS n"))
def v1_ngram_counts(spark, sf):
    return index.token_counts(table(spark, sf, "documents"))


@query("""WITH c AS (SELECT page_id, unnest(string_split(url, '')) AS ch FROM pages), k AS (SELECT page_id, ch, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT page_id, sum(n) AS all_n FROM k GROUP BY 1)
SELECT page_id, round(-sum(n / all_n * log2(n / all_n)), 6) AS bits, round(-sum(n / all_n * ln(n / all_n)), 6) AS nats FROM k JOIN t USING (page_id) GROUP BY 1""")
def a9_entropy(spark, sf):
    c = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.round(X.entropy(c), 6).alias("bits"), F.round(X.entropy(c, True), 6).alias("nats"))


@query(r"""SELECT doc_id, length(text)::INT AS n, length(regexp_replace(text, '[^!！]', '', 'g'))::INT AS exclamations, length(regexp_replace(text, '[^?？]', '', 'g'))::INT AS questions,
round(length(regexp_replace(text, '\P{Nd}', '', 'g'))::FLOAT / length(text)::FLOAT, 5)::DOUBLE AS digits,
round(CASE WHEN length(regexp_replace(text, '\P{L}', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(text, '\P{Lu}', '', 'g'))::FLOAT / length(regexp_replace(text, '\P{L}', '', 'g'))::FLOAT END, 5)::DOUBLE AS upper,
round(length(regexp_replace(text, '[\p{L}\p{Nd}\s]', '', 'g'))::FLOAT / length(text)::FLOAT, 5)::DOUBLE AS special FROM documents""")
def v6_ratios(spark, sf):
    r = {"digits": "digitRatio", "upper": "uppercaseRatio", "special": "specialCharRatio"}
    names = ["textLength", "exclamationCount", "questionCount", *r.values()]
    d = table(spark, sf, "documents").select("doc_id", V.features(F.col("text"), names).alias("f"))
    return d.select(
        "doc_id", F.col("f.textLength").alias("n"), F.col("f.exclamationCount").alias("exclamations"), F.col("f.questionCount").alias("questions"),
        *[F.round(F.col(f"f.{v}"), 5).cast("double").alias(k) for k, v in r.items()],
    )


@query(r"""WITH d AS (SELECT doc_id, text, length(text) AS n, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words, string_split(text, '') AS ch, trim(regexp_split_to_array(text, '\r\n|\n|\r')[1]) AS line FROM documents)
SELECT doc_id, len(regexp_extract_all(text, 'https?://\S+'))::INT AS urls, len(regexp_extract_all(text, 'https?://\S+'))::INT AS links, regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])') AS phone,
CASE WHEN regexp_matches(line, '^1[3-9][0-9]{9}$') THEN 'PHONE_NUMBER' WHEN regexp_matches(line, '^[0-9]{3,6}$') THEN 'SHORT_CODE' WHEN regexp_matches(line, '^[A-Za-z]{3,11}$') THEN 'ALPHABETIC' ELSE 'UNKNOWN' END AS sender,
CASE WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'CHINESE' ELSE 'ENGLISH' END AS language,
round(CASE WHEN len(words) = 0 THEN 0 ELSE list_sum(list_transform(words, lambda w: length(w)))::FLOAT / len(words)::FLOAT END, 4)::DOUBLE AS word_length,
coalesce(list_sum(list_transform(range(2, len(ch) + 1), lambda i: (ch[i] = ch[i - 1])::INT)), 0)::INT AS repeated,
len(regexp_extract_all(text, '\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b'))::INT AS ips,
length(regexp_replace(text, '[^$€£¥₹₽₩]', '', 'g'))::INT AS money FROM d""")
def v6_counts(spark, sf):
    r = {
        "urls": "urlCount", "links": "linkCount", "phone": "hasPhoneNumber", "sender": "senderType", "language": "language",
        "word_length": "avgWordLength", "repeated": "repeatedCharCount", "ips": "ipAddressCount", "money": "moneySymbolCount",
    }
    d = table(spark, sf, "documents").select("doc_id", V.features(F.col("text"), set(r.values())).alias("f"))
    d = d.select("doc_id", *[F.col(f"f.{v}").alias(k) for k, v in r.items()])
    return d.withColumn("word_length", F.round(F.col("word_length"), 4).cast("double"))


@query()
def v7_feature_arrays(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", V.features(F.col("text")).alias("f"))
    return d.select("doc_id", V.as_array(F.col("f")).alias("features"), V.as_json(F.col("f")).alias("json"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def v9_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(V.cosine(F.col("x"), F.col("y")), 5).alias("similarity"))


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
b AS (SELECT doc_id, n, list_transform(range(0, least(n, 511)), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM h),
k AS (SELECT doc_id, b, CASE WHEN n <= 510 THEN n WHEN b[511] NOT BETWEEN 128 AND 191 THEN 510 WHEN b[510] NOT BETWEEN 128 AND 191 THEN 509 WHEN b[509] NOT BETWEEN 128 AND 191 THEN 508 ELSE 507 END AS k FROM b)
SELECT doc_id, array_to_string(list_concat([101], b[:k], [102], list_transform(range(0, 510 - k), lambda i: 0::BIGINT)), ' ') AS ids FROM k""")
def v2_byte_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(tokenizers.byte_encode(F.col("text")), " ").alias("ids"))


@query("SELECT doc_id, 'sms_' || source || '_' || md5(text) AS key FROM documents")
def st4_message_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sms_key(F.col("source"), F.col("text")).alias("key"))


@query()
def x21_sanitised(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sanitised(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(f"""SELECT page_id, CASE WHEN h LIKE '%.eth' THEN 'ENS' WHEN h LIKE '%.crypto' THEN 'UNSTOPPABLE' ELSE NULL END AS provider, CASE WHEN h LIKE '%.eth' THEN h[:-5] WHEN h LIKE '%.crypto' THEN h[:-8] ELSE NULL END AS name,
CASE WHEN h LIKE '%.eth' THEN 0.6 WHEN h LIKE '%.crypto' THEN 0.7 ELSE 0.5 END::DOUBLE AS risk
FROM (SELECT page_id, {HOST_SQL} || (CASE page_id % 3 WHEN 0 THEN '.eth' WHEN 1 THEN '.crypto' ELSE '' END) AS h FROM pages)""")
def x9_web3(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, ".eth").when(F.col("page_id") % 3 == 1, ".crypto").otherwise("")
    p = table(spark, sf, "pages").select("page_id", F.concat(X.host(F.col("url")), tail).alias("h"))
    w = D.web3(F.col("h"))
    return p.select("page_id", w["provider"].alias("provider"), w["resolved_name"].alias("name"), F.round(D.web3_risk(F.col("h")).cast("double"), 4).alias("risk"))


@query(f"""SELECT page_id, replace(h, 'e', 'а') AS name, replace(h, 'e', 'a') AS folded, contains(h, 'e') AS spoof FROM (SELECT page_id, {HOST_SQL} AS h FROM pages)""")
def x6_folded(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.replace(X.host(F.col("url")), F.lit("e"), F.lit("а")).alias("name"))
    return p.select("page_id", "name", D.folded(F.col("name")).alias("folded"), D.is_visual_spoof(F.col("name")).alias("spoof"))


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'URL' WHEN page_id % 4 = 1 THEN 'PAYMENT' WHEN page_id % 4 = 2 THEN 'WIFI' ELSE 'TEXT' END AS kind,
CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN 'upi://' || url WHEN page_id % 4 = 2 THEN 'S:' || url ELSE 'see ' || url END AS content FROM pages""")
def x24_qr_codes(spark, sf):
    k = F.col("page_id") % 4
    payload = F.concat(F.when(k == 0, "").when(k == 1, "upi://").when(k == 2, "wifi:S:").otherwise("see "), F.col("url"))
    p = table(spark, sf, "pages").select("page_id", payload.alias("payload"))
    return p.select("page_id", X.qr_kind(F.col("payload")).alias("kind"), X.qr_content(F.col("payload")).alias("content"))


@query("SELECT n_name, (CASE WHEN n_nationkey > 12 THEN 1 WHEN n_nationkey = 12 THEN 0 ELSE -1 END)::INT AS version_order FROM nation")
def x27_versions(spark, sf):
    v = F.concat(F.lit("1."), F.col("n_nationkey").cast("string"), F.lit(".x"))
    return table(spark, sf, "nation").select("n_name", X.version_order(v, F.lit("1.12")).alias("version_order"))


@query(r"""SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id::DOUBLE END AS epoch, CASE WHEN event_type IN ('click', 'view') THEN 1000::DOUBLE END AS epochs,
CASE WHEN event_type = 'view' THEN value::DECIMAL(18, 2)::DOUBLE END AS percent, CASE WHEN event_type IN ('click', 'signup') THEN value::DECIMAL(18, 2)::DOUBLE END AS acc,
CASE WHEN event_type IN ('click', 'purchase') THEN (value::DECIMAL(18, 2) + 0.25)::DOUBLE END AS loss, CASE WHEN event_type = 'signup' THEN (value::DECIMAL(18, 2) + 0.75)::DOUBLE END AS val_acc,
CASE WHEN event_type IN ('view', 'purchase') THEN value::DECIMAL(18, 2)::DOUBLE END AS val_loss FROM events""")
def x34_log_fields(spark, sf):
    """Lines as several trainers write them, with an event's figures; one kind tells nothing."""
    e = table(spark, sf, "events")
    n, v = F.col("user_id").cast("string"), F.col("value").cast("decimal(18,2)").cast("string")
    more, most = (F.expr(f"CAST(CAST(value AS DECIMAL(18, 2)) + {k}BD AS STRING)") for k in (0.25, 0.75))
    lines = {
        "click": F.concat(F.lit("epoch "), n, F.lit("/1000 - acc: "), v, F.lit(" - loss: "), more),
        "view": F.concat(F.lit("[train] EPOCH  "), n, F.lit(" / 1000 "), v, F.lit("% done, val_loss="), v),
        "signup": F.concat(F.lit("Epoch "), n, F.lit(" accuracy = "), v, F.lit("; val_accuracy = "), most),
        "purchase": F.concat(F.lit("Epoch "), n, F.lit(": loss="), more, F.lit(" val_loss="), v),
    }
    line = F.lit("loading data, 12 files, accurate")
    for kind, text in lines.items():
        line = F.when(F.col("event_type") == kind, text).otherwise(line)
    f = e.select("event_id", X.log_fields(line).alias("f"))
    f = f.select("event_id", "f.*")
    return f.withColumns({c: F.col(c).cast("double") for c in ("epoch", "epochs")})


@query(r"""SELECT page_id, round(CASE WHEN page_id % 2 = 0 THEN greatest(s, (u * 0.5::FLOAT)::FLOAT) ELSE s END, 4)::DOUBLE AS score
FROM (SELECT page_id, ((length(html) % 97) / 97.0::DOUBLE)::FLOAT AS s, ((length(url) % 11) / 11.0::DOUBLE)::FLOAT AS u FROM pages)""")
def v15_sms_score(spark, sf):
    """Every other message has a bare domain, the others a whole URL; both scores differ by page."""
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("see https://"), F.regexp_extract(X.host(F.col("url")), r"([^.]+\.[^.]+)$", 1))).otherwise(F.concat(F.lit("see "), "url"))
    sms, url = F.length("html") % 97 / F.lit(97.0), F.length("url") % 11 / F.lit(11.0)
    return table(spark, sf, "pages").select("page_id", F.round(X.sms_model_score(sms, url, body).cast("double"), 4).alias("score"))


def _hits_sql(words, column="text"):
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({column}, w)))"


#: Words that are added to texts, by language.
ADDED = {"de": "请立即转账到银行账户 😀💰", "fr": "恭喜 中奖 感谢", "es": "账户 冻结 法院 😀😀", "en": "谢谢"}
ADDED_SQL = "text || CASE lang " + " ".join(f"WHEN '{k}' THEN ' {v}'" for k, v in ADDED.items()) + " ELSE '' END"


@query(f"""WITH d AS (SELECT doc_id, {ADDED_SQL} AS text FROM documents),
k AS (SELECT doc_id, text, {_hits_sql(V.FINANCIAL)} AS financial, {_hits_sql(V.URGENCY)} AS urgency, {_hits_sql(V.THREAT)} AS threat, {_hits_sql(V.NEGATIVE)} AS neg, {_hits_sql(V.POSITIVE)} AS pos FROM d)
SELECT doc_id, financial::INT AS financial, urgency::INT AS urgency, threat::INT AS threat, financial > 0 AS has_financial, urgency > 0 AS has_urgency, threat > 0 AS has_threat,
length(regexp_replace(text, '[^{V.EMOJI[1:-1]}]', '', 'g'))::INT AS emoji,
round(length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g'))::FLOAT / list_sum(list_transform(string_split(text, ''), lambda x: CASE WHEN unicode(x) > 65535 THEN 2 ELSE 1 END))::FLOAT, 5)::DOUBLE AS chinese,
round(CASE WHEN neg + pos = 0 THEN 0.5 ELSE pos::FLOAT / (neg + pos)::FLOAT END, 5)::DOUBLE AS sentiment FROM k""")
def v6_keywords(spark, sf):
    """Texts with words of the lists, by language, and their emoji."""
    text = F.col("text")
    for lang, more in ADDED.items():
        text = F.when(F.col("lang") == lang, F.concat("text", F.lit(" " + more))).otherwise(text)
    r = {
        "financial": "financialWordCount", "urgency": "urgencyWordCount", "threat": "threatWordCount", "has_financial": "hasFinancialKeywords",
        "has_urgency": "hasUrgencyKeywords", "has_threat": "hasThreatKeywords", "emoji": "emojiCount", "chinese": "chineseCharRatio", "sentiment": "sentimentScore",
    }
    d = table(spark, sf, "documents").select("doc_id", V.features(text, set(r.values())).alias("f"))
    d = d.select("doc_id", *[F.col(f"f.{v}").alias(k) for k, v in r.items()])
    return d.withColumns({c: F.round(F.col(c), 5).cast("double") for c in ("chinese", "sentiment")})


#: The names are plain ASCII; that SQL's distance counts bytes, so one unlike byte stands for another letter.
VARIANTS_SQL = "[" + ", ".join("'" + "".join(c if c.isascii() else "~" for c in v) + "'" for variants in D.HOMOPHONES.values() for v in variants) + "]"


@query(f"""WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), v AS (SELECT unnest({VARIANTS_SQL}) AS v)
SELECT name, round(max((floor(((1::FLOAT - (levenshtein(v, name) / greatest(length(v), length(name)))::FLOAT)::FLOAT * 100::FLOAT)::FLOAT)::INT::FLOAT / 100::FLOAT)::FLOAT)::DOUBLE, 5) AS score FROM n, v GROUP BY 1""")
def x8_homophones(spark, sf):
    n = table(spark, sf, "part").select(F.lower("p_name").alias("name")).distinct()
    return n.select("name", F.round(D.homophone_score(F.col("name")).cast("double"), 5).alias("score"))


@query(r"""WITH t AS (SELECT doc_id, CASE lang WHEN 'de' THEN text WHEN 'fr' THEN text || chr(8203) WHEN 'es' THEN repeat(text[1:1], 30) ELSE text[1:80] || '语' END AS text FROM documents),
k AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM t WHERE text <> '') GROUP BY ALL), m AS (SELECT doc_id, sum(n) AS all_n FROM k GROUP BY 1),
h AS (SELECT doc_id, round(-sum(n / all_n * log2(n / all_n)), 9) AS bits FROM k JOIN m USING (doc_id) GROUP BY 1)
SELECT doc_id, (coalesce(bits, 0) < 1 AND length(text) > 20) OR regexp_matches(text, '[\x{200B}-\x{200F}\x{2028}\x{2029}\x{FE00}-\x{FE0F}\x{FEFF}]')
  OR (regexp_matches(text, '[\x{4E01}-\x{10FFFF}]') AND length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / greatest(length(text), 1) > 0.95 AND length(text) > 50) AS suspicious FROM t LEFT JOIN h USING (doc_id)""")
def x22_suspicious_inputs(spark, sf):
    """Whole texts, texts with an invisible character, runs of one, and beginnings with one Chinese character."""
    c = F.col("text")
    made = F.when(F.col("lang") == "de", c).when(F.col("lang") == "fr", F.concat(c, F.lit("​"))).when(F.col("lang") == "es", F.repeat(F.substring(c, 1, 1), F.lit(30)))
    made = made.otherwise(F.concat(F.substring(c, 1, 80), F.lit("语")))
    return table(spark, sf, "documents").select("doc_id", X.is_suspicious_input(made).alias("suspicious"))


#: A query packet from 10.0.0.2 to 8.8.8.8: its header after the length, ports, and what is before the name.
IP_REST, PORTS, BEFORE_NAME = "00000000401100000a00000208080808", "c0000035", "0000123401000001000000000000"


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS name FROM pages),
p AS (SELECT page_id, name, '4500' || printf('%04x', 46 + strlen(name)) || '0000000040110000' || '0a00000208080808' AS head FROM h)
SELECT page_id, name, true AS is_query, (65535 - (s % 65536 + s // 65536))::INT AS checksum FROM (SELECT *, list_sum(list_transform(range(0, 10), lambda i: ('0x' || head[4 * i + 1:4 * i + 4])::BIGINT))::BIGINT AS s FROM p)""")
def b2_dns_questions(spark, sf):
    """Packets that ask for every page's host, read again: whether they ask, for what, and their header's checksum."""
    name = F.try_parse_url("url", F.lit("HOST"))
    labels = F.array_join(F.transform(F.split(name, r"\."), lambda x: F.concat(F.lpad(F.hex(F.length(x)), 2, "0"), F.hex(F.encode(x, "utf-8")))), "")
    size = F.lpad(F.hex(F.length(name) + 46), 4, "0")
    udp = F.lpad(F.hex(F.length(name) + 26), 4, "0")
    packet = F.unhex(F.concat(F.lit("4500"), size, F.lit(IP_REST), F.lit(PORTS), udp, F.lit(BEFORE_NAME), labels, F.lit("0000010001")))
    p = table(spark, sf, "pages").select("page_id", packet.alias("p"))
    return p.select("page_id", packets.extract_domain(F.col("p")).alias("name"), packets.is_dns_query(F.col("p")).alias("is_query"), packets.ip_checksum(F.col("p")).alias("checksum"))
