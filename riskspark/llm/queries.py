"""The operators' queries over the data tables, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import alignment, bytebpe, fingerprints, langid, lines, media, minhash, packing, pii, substrings, suffixes, urls, vectorcodes
from riskspark.llm.common import small_batches, table
from riskspark.llm.pipeline import PII_KEY

#: Rules of the URL query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    judged = langid.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", (langid.fold("doc_id") == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PII_KEY)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = media.stored_pictures(table(spark, sf_dir, "documents"))
    return media.picture_digests(pictures, "doc_id", "n_bytes", "picture")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bytebpe.encoding_digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(docs, *paths, digests=True).withColumnRenamed("groups", "groups_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_url_filters,
        op3_substring_dedup,
        op4_line_dedup,
        op5_language_id,
        op6_pii,
        op7_packing,
        op8_near_duplicates,
        op9_media_columns,
        op10_byte_bpe,
        op11_suffix_dedup,
        op12_token_alignment,
        op13_vector_codes,
    )
}

OP2_SQL = r"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (r)
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS least FROM p GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN m USING (k) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
g AS (SELECT x.doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (c.j IS NULL) AS kept
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.j = c.j GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, k, count(*) AS n FROM (
        SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0))
      GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS total FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE common >= 0.8 * (x.total + y.total - common)
      UNION ALL SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.doc_id < y.doc_id WHERE len(x.w) = 0 AND len(y.w) = 0),
pairs AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, pairs.b FROM r JOIN pairs ON r.b = pairs.a),
c AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM r GROUP BY 1)
SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM c
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS MATERIALIZED (SELECT doc_id, low, substr(h, 2 * low + 1, 2098) AS z FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 1000)) AS low FROM d)),
p AS (SELECT doc_id, low + o AS i, substr(z, 2 * o + 1, 100) AS k FROM (SELECT doc_id, low, z, unnest(range(0, least(1000, len(z) // 2 - 49))) AS o FROM q)),
m AS (SELECT k, min(doc_id) AS least FROM p GROUP BY k),
c AS (SELECT doc_id, i FROM p JOIN m USING (k) WHERE least < doc_id),
x AS (SELECT doc_id, low + o AS j, substr(z, 2 * o + 1, 2) AS byte
      FROM (SELECT doc_id, low, z, unnest(range(0, least(1000, len(z) // 2))) AS o FROM q WHERE doc_id IN (SELECT doc_id FROM c))),
v AS (SELECT x.doc_id, j, byte, max(c.i) OVER (PARTITION BY x.doc_id ORDER BY j) >= j - 49 AS gone FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.j = c.i),
w AS (SELECT *, coalesce(gone, false) AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS starts FROM v),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY j) FILTER (NOT coalesce(gone, false)) AS kept FROM w GROUP BY 1)
SELECT documents.doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN r.doc_id IS NULL THEN encode(coalesce(text, '')) ELSE unhex(coalesce(kept, '')) END) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds, each a few common table expressions."""
    steps = [
        """k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"""p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM k, range({parts}) AS t(part))""",
        f"""c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS e FROM p WHERE r <= {entries})""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, part, min((list_inner_product(v, v) - 2 * list_inner_product(v, e) + list_inner_product(e, e))::HUGEINT * {entries} + entry) AS best
        FROM p JOIN c{n} USING (part) GROUP BY ALL)""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT part, entry, list(z ORDER BY i) AS e FROM (SELECT part, (best % {entries})::BIGINT AS entry, i, floor(sum(c) / count(*)) AS z
            FROM (SELECT part, best, unnest(range(len(v))) AS i, unnest(v) AS c FROM a{n} JOIN p USING (r, part)) GROUP BY ALL) GROUP BY ALL)""")
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s{n}.e, c{n}.e) AS e FROM c{n} LEFT JOIN s{n} USING (part, entry))""")
    return f"""WITH {", ".join(steps)},
    b AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda c: c::BIGINT), ','), ',' ORDER BY part, entry)) AS digest FROM c{rounds}),
    q AS (SELECT r, string_agg(printf('%02x', (best % {entries})::BIGINT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM k JOIN q USING (r), b"""


ORACLES: dict[str, str] = {
    "op2_url_filters": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op13_vector_codes": _vector_codes_sql(),
}
