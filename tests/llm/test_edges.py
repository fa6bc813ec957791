"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskspark.llm import bytebpe, fingerprints, langid, lines, media, minhash, packing, pii, pipeline, substrings, urls

LONG = " ".join(f"word{k % 977}é" for k in range(40_000))
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"),
    (6, LONG), (None, "no id here at all but some words"), (7, "😀 ünïcode\u2028line\x00zero"),
]
BPE, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")

OPERATORS = {
    "fingerprints": lambda d: fingerprints.compare_with_edits(d),
    "substrings": lambda d: substrings.remove_repeats(d),
    "lines": lambda d: lines.dedup_lines(d),
    "langid": lambda d: langid.identify(d, langid.fit(d)),
    "pii": lambda d: pii.pseudonymize(d, "key"),
    "packing": lambda d: packing.pack_documents(d, WORDS),
    "minhash": lambda d: minhash.near_duplicates(d),
    "media": lambda d: media.picture_digests(media.stored_pictures(d), "doc_id", "n_bytes", "picture"),
    "bytebpe": lambda d: bytebpe.encoding_digests(d, BPE, public_tokenizers.PATTERN),
}


@pytest.fixture(scope="module")
def edgy(spark, tmp_path_factory):
    """A stored table whose other columns have the names that operators use inside."""
    clash = ["id", "row", "key", "block", "line", "score", "gone", "text_", "size", "_row", "_all", "_judged", "judged", "_private", "_pairs", "_between", "private", "pairs", "between", "node", "bucket", "stay", "near", "made", "bands"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumns({c: F.lit(None).cast("int") for c in clash})
    path = str(tmp_path_factory.mktemp("edgy") / "t")
    df.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(edgy, name):
    got = [r["doc_id"] for r in OPERATORS[name](edgy).select("doc_id").collect()]
    if name == "packing":
        got = [k for n, k in enumerate(got) if k != 6 or 6 not in got[:n]]
    assert sorted(got, key=str) == sorted([r[0] for r in ROWS], key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(edgy, name):
    assert OPERATORS[name](edgy.limit(0)).count() == 0


def test_extra_columns_stay(edgy):
    for df in (lines.dedup_lines(edgy), pii.pseudonymize(edgy, "key"), langid.identify(edgy, langid.fit(edgy))):
        assert set(edgy.columns) <= set(df.columns)
        assert all(v is None for k, v in df.where("doc_id = 4").first().asDict().items() if k in edgy.columns and k not in ("doc_id", "text", "lang", "score"))
    assert minhash.distinct_documents(edgy).columns == edgy.columns


def test_defined_results(edgy):
    words = {(r.doc_id, r.n_words) for r in substrings.remove_repeats(edgy).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 1), (6, 40_000)} <= words
    classes = {r.doc_id: r for r in minhash.near_duplicates(edgy).collect()}
    assert classes[1].class_id == classes[2].class_id == classes[3].class_id == 1
    assert sum(r.kept for r in minhash.near_duplicates(edgy).where("doc_id = 5").collect()) == 1
    judged = {r.doc_id: r for r in langid.identify(edgy, langid.fit(edgy)).collect()}
    assert (judged[1].lang_pred, judged[1].score, judged[3].lang_pred) == ("und", 0.0, "und")


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Org/x?y"), (3, "http://A.Org/x?y"), (4, "http://org"), (5, "ftp://x.example.org/en/12#t"), (6, "https://b.com/fr/"), (None, "h://com/de/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit(1)).withColumn("_row", F.lit(2))
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    for most in (100, 0):  # broadcast, and by a salted shuffle
        got = sorted(map(str, urls.filter_urls(pages, rules, broadcast_rules=most).collect()))
        r = {x.page_id: tuple(x)[1:] for x in urls.filter_urls(pages, rules, broadcast_rules=most).collect()}
        assert len(got) == len(rows)
        assert r[1] == ("", "", None, "allow") and r[3] == ("a.org", "/x", "org/", "allow") and r[4] == ("org", "", None, "allow")
        assert r[5] == ("x.example.org", "/en/12", "example.org/en/1", "block") and r[None][3] == "block"
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    assert {x.verdict for x in urls.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_of_every_length(spark, monkeypatch):
    """More lengths than the plan lists, short prefixes that many rules share, hosts of very many labels."""
    from riskspark.llm import urls as module

    rows = [(k, f"http://{'a.' * k}b.com/{'x' * k}?q") for k in range(12)] + [(50, "http://" + "a." * 5000 + "b.com/"), (51, "http://a.com/"), (52, "http://"), (53, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    made = [("a." * n + "b.com", "/" + "x" * n, "block") for n in range(9)] + [("a.co", "m/", "block"), ("com", "", "allow")]
    rules = spark.createDataFrame(made, "host string, path string, verdict string")

    def plain(url):
        rest = (url or "").partition("://")[2]
        host, slash, path = rest.partition("/")
        path = (slash + path).partition("?")[0]
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in made if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (max(fits)[3], max(fits)[2]) if fits else (None, "allow")

    want = {k: plain(u) for k, u in rows}
    for listed, prefix in ((256, 8), (3, 8), (256, 1), (0, 1)):
        monkeypatch.setattr(module, "LISTED", listed)
        monkeypatch.setattr(module, "PREFIX_HEX", prefix)
        for most in (100, 0):
            assert {r.page_id: (r.rule, r.verdict) for r in module.filter_urls(pages, rules, broadcast_rules=most).collect()} == want


@pytest.mark.parametrize("stage", pipeline.STAGES[:4], ids=lambda s: s[0])
def test_stage_edges(spark, edgy, stage):
    """Nulls, blank texts, repeated rows and clashing names; empty tables."""
    kept = stage[1](spark, edgy, "")
    assert kept.columns == edgy.columns and {r["row"] for r in kept.collect()} <= {None}
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert {"language ID": len(ids) <= 6, "line dedup": {1, 2, 3, 4, 6, 7} <= set(ids), "MinHash near-dedup": ids.count(5) == 1 and 1 in ids and 2 not in ids, "PII": len(ids) == len(ROWS)}[stage[0]]
    assert stage[1](spark, edgy.limit(0), "").count() == 0


BROKEN_PICTURES = [
    None, b"", b"P6", b"P6\n99999999999999999999 1\n255\n", b"P6\n4000000000 4000000000\n255\n", b"P6\n1 1", b"P2\n1 1\n255\n70000", b"P2\n1 1\n70000\n70000", b"P2\n1 1\n0\n0",
    b"P5\n0 3\n255\n", b"P1\n3 3\n1 0", b"P4\n100000 100000\n1", b"P3\n2 1\n255\n1 2 3 4 5 99999999999999999999999", b"BM", b"BM" + bytes(60), b"BM" + b"\xff" * 60, b"GIF89a",
    b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1 << 30).to_bytes(4, "little") * 2 + b"\1\0\x18\0" + bytes(24),
    b"BM" + bytes(8) + (54).to_bytes(4, "little") + (400).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\1\0\x08\0" + bytes(24) + bytes(8), b"P6\n" + b"9" * 5000 + b" 1\n255\n",
]


def test_broken_pictures(spark):
    good = media.encode_ppm(bytes(range(192)), 64)
    rows = [(k, None if b is None else bytearray(b)) for k, b in enumerate([*BROKEN_PICTURES, good])]
    df = spark.createDataFrame(rows, "id int, blob binary").withColumn("n", F.lit(1))
    for r in media.media_columns(df, "id", "blob").collect():
        assert (r.error is None) == (r.id == len(BROKEN_PICTURES)) == (r.tile is not None)
    for r in media.picture_digests(df, "id", "n", "blob").collect():
        assert (r.feature is not None) == (r.payload_bytes is not None) == (r.id == len(BROKEN_PICTURES)) and (r.media_sha256 is None) == (r.id == 0)
