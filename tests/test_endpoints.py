"""Index files, endpoints and appended lines, each against what was put there."""

import base64
import json
import random
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.sources import endpoints, indexfile


def plain_file(labels, index):
    """An index file as its format says."""
    raw = struct.pack("<I", len(labels)) + bytes(labels)
    for token, postings in sorted(index.items()):
        raw += struct.pack("<H", len(token.encode())) + token.encode() + struct.pack("<I", len(postings))
        raw += b"".join(struct.pack("<IH", *p) for p in postings)
    return raw


def plain_read(raw):
    """All of an index file, by a reader that knows nothing of runs."""
    n = struct.unpack_from("<I", raw)[0]
    labels, at, out = raw[4 : 4 + n], 4 + n, {}
    while at < len(raw):
        size = struct.unpack_from("<H", raw, at)[0]
        token = raw[at + 2 : at + 2 + size].decode()
        count = struct.unpack_from("<I", raw, at + 2 + size)[0]
        at += 6 + size
        out[token] = [struct.unpack_from("<IH", raw, at + 6 * k) for k in range(count)]
        at += 6 * count
    return labels, out


def some_index(seed, n=300):
    r = random.Random(seed)
    labels = [r.randrange(2) for _ in range(50)]
    words = {"".join(r.choices("abé語", k=r.randint(1, 6))) for _ in range(n)}
    return labels, {w: sorted(((d, r.randrange(65_536)) for d in r.sample(range(50), r.randint(1, 20))), key=lambda p: (-p[1], p[0])) for w in words}


def rows_of(labels, index):
    return sorted((t, d, s, labels[d]) for t, p in index.items() for d, s in p)


def test_a_foreign_file_is_read(spark, tmp_path, monkeypatch):
    labels, index = some_index(1)
    monkeypatch.setattr(indexfile, "PIECE", 64)  # many small pieces (the workers keep theirs)
    (tmp_path / "index.bin").write_bytes(zlib.compress(plain_file(labels, index)))
    got = indexfile.index_postings(spark, str(tmp_path / "index.bin"))
    assert got.rdd.getNumPartitions() == 1 and sorted(map(tuple, got.collect())) == rows_of(labels, index)


def test_pieces_of_any_size():
    labels, index = some_index(2, 40)
    raw = plain_file(labels, index)[4 + len(labels) :]
    for size in (1, 2, 7, 1000, 10**6):
        got = {t: [tuple(x) for x in p.tolist()] for t, p in indexfile.entries(iter([raw[k : k + size] for k in range(0, len(raw), size)]))}
        assert got == index


@pytest.mark.parametrize("broken", [b"", b"no zlib at all", zlib.compress(b""), zlib.compress(struct.pack("<I", 9) + b"12")])
def test_broken_files_have_no_rows(spark, tmp_path, broken):
    (tmp_path / "index.bin").write_bytes(broken)
    assert indexfile.index_postings(spark, str(tmp_path)).count() == 0


def test_what_comes_after_a_broken_entry_is_left(spark, tmp_path):
    good = plain_file([1], {"ab": [(0, 7)]})
    for bad in (struct.pack("<H", 0), struct.pack("<H", 2) + b"cd" + struct.pack("<I", 0), struct.pack("<H", 2) + b"cd" + struct.pack("<I", 100_001), struct.pack("<H", 500) + b"x", struct.pack("<H", 2) + b"cd" + struct.pack("<I", 3) + b"12345"):
        (tmp_path / "index.bin").write_bytes(zlib.compress(good + bad))
        assert list(map(tuple, indexfile.index_postings(spark, str(tmp_path)).collect())) == [("ab", 0, 7, 1)]
    cut = zlib.compress(good + np.random.default_rng(1).bytes(5000))[:-2000]
    (tmp_path / "index.bin").write_bytes(cut)
    assert ("ab", 0, 7, 1) in set(map(tuple, indexfile.index_postings(spark, str(tmp_path)).collect()))


def test_round_trip_in_several_tasks(spark, tmp_path):
    labels, index = some_index(3)
    rows = rows_of(labels, index)
    df = spark.createDataFrame(rows, indexfile.SCHEMA).repartition(5)
    indexfile.write_postings(df, str(tmp_path / "ix"), files=3, run_bytes=500)
    files = sorted(p for p in (tmp_path / "ix").iterdir() if p.suffix == ".bin")
    assert len(files) == 3 and len(list((tmp_path / "ix").iterdir())) == 6  # nothing staged is left
    seen = []
    for f in files:  # any inflater reads a file as a whole: its checksum is right
        known, part = plain_read(zlib.decompress(f.read_bytes()))
        assert list(part) == sorted(part)
        seen += [(t, d, s, known[d]) for t, p in part.items() for d, s in p]
    assert sorted(seen) == rows
    whole = indexfile.index_postings(spark, str(tmp_path / "ix"))
    split = indexfile.index_postings(spark, str(tmp_path / "ix"), split_bytes=700)
    assert whole.rdd.getNumPartitions() == 3 and split.rdd.getNumPartitions() > 6
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) == rows
    indexfile.write_postings(df.where("doc_id < 3"), str(tmp_path / "ix"), most=2)  # takes the place of all
    best = {t: sorted(((s, -d) for d, s in p if d < 3), reverse=True)[:2] for t, p in index.items()}
    assert sorted((t, -d, s) for t, p in best.items() for s, d in p) == sorted((r.token, r.doc_id, r.score) for r in indexfile.index_postings(spark, str(tmp_path / "ix")).collect())


def test_a_failed_write_leaves_the_old_files(spark, tmp_path):
    path = str(tmp_path / "ix")
    df = spark.createDataFrame([("ab", 1, 2, 1)], indexfile.SCHEMA)
    indexfile.write_postings(df, path)
    bad = df.withColumn("score", F.expr("CAST(raise_error('no') AS INT)"))
    with pytest.raises(Exception, match="no"):
        indexfile.write_postings(bad, path, most=None)
    assert list(map(tuple, indexfile.index_postings(spark, path).collect())) == [("ab", 1, 2, 1)]


def test_joined_checksums():
    r = np.random.default_rng(2)
    for n, m in ((0, 0), (1, 0), (0, 5), (70_000, 3), (3, 200_000)):
        a, b = r.bytes(n), r.bytes(m)
        assert indexfile.joined_adler(zlib.adler32(a), zlib.adler32(b), m) == zlib.adler32(a + b)


class Rules(BaseHTTPRequestHandler):
    """A rules endpoint of three pages that is busy twice."""

    busy, asked = 2, []

    def do_GET(self):
        type(self).asked.append((self.path, self.headers.get("If-None-Match")))
        if self.path == "/api/rules/latest-version":
            return self.say(200, {"version": "1.3"})
        if type(self).busy:
            type(self).busy -= 1
            return self.say(503, {})
        if self.headers.get("If-None-Match") == "1.3":
            return self.say(304, None)
        if not self.path.startswith("/api/rules/diff"):
            return self.say(404, {})
        page = int(self.path.partition("=")[2] or 0)
        return self.say(200, {"adds": [f"a{page}.com"], "removes": [] if page else ["old.com"], "signature": "abc"} | ({"next": f"/api/rules/diff?page={page + 1}"} if page < 2 else {}))

    def say(self, status, body):
        self.send_response(status)
        self.end_headers()
        if body is not None:
            self.wfile.write(json.dumps(body).encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def rules_server():
    class Own(Rules):
        busy, asked = 2, []

    server = HTTPServer(("127.0.0.1", 0), Own)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", Own
    server.shutdown()


def test_rule_updates_of_a_busy_server(spark, rules_server):
    url, handler = rules_server
    rows = endpoints.rule_updates(spark, url, "1.2", pause_s=0.01).collect()
    assert [tuple(r) for r in rows] == [("1.3", ["a0.com", "a1.com", "a2.com"], ["old.com"], "abc")]
    assert handler.busy == 0 and ("/api/rules/diff", "1.2") in handler.asked


def test_nothing_is_fetched_for_the_latest_version(spark, rules_server):
    url, handler = rules_server
    assert endpoints.rule_updates(spark, url, "1.3").count() == 0
    assert not [a for a in handler.asked if "diff" in a[0]]


def test_a_version_filter_is_sent_along(spark, rules_server):
    url, handler = rules_server
    spark.dataSource.register(endpoints.RuleUpdates)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("rule_updates").options(url=url, pause=0.01, pushFilters=True).load()
        assert df.where("version > '1.2'").count() == 3 and ("/api/rules/diff", "1.2") in handler.asked
        n = len([a for a in handler.asked if "diff" in a[0]])
        assert df.where("version = '9.9'").count() == 0 and len([a for a in handler.asked if "diff" in a[0]]) == n
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_an_endpoint_that_stays_away_is_an_error(spark, rules_server):
    url, handler = rules_server
    handler.busy = 99
    with pytest.raises(Exception, match="503"):
        endpoints.rule_updates(spark, url, tries=2, pause_s=0.01).collect()


def started(lines, folder):
    q = lines.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp"))
    q = q.start()
    q.processAllAvailable()
    return q


def seen(spark, folder):
    return sorted((r.file.rpartition("/")[2], r.value) for r in spark.read.parquet(str(folder / "out")).collect())


def test_appended_lines_come_once(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    a, b = tmp_path / "logs/a.log", tmp_path / "logs/b.log"
    a.write_bytes(b"one\ntwo\nhalf a li")
    lines = endpoints.appended_lines(spark, str(tmp_path / "logs"), split_bytes=5)
    q = started(lines, tmp_path)
    assert seen(spark, tmp_path) == [("a.log", "one"), ("a.log", "two")]
    with a.open("ab") as f:
        f.write(b"ne\n\nlonger than a stretch\r\nbroken \xff byte\n")
    b.write_bytes(b"x\n")
    q.processAllAvailable()
    first = [("a.log", ""), ("a.log", "broken � byte"), ("a.log", "half a line"), ("a.log", "longer than a stretch"), ("a.log", "one"), ("a.log", "two"), ("b.log", "x")]
    assert seen(spark, tmp_path) == first
    q.stop()
    with b.open("ab") as f:  # while nobody reads
        f.write(b"y\nz\n")
    q = started(endpoints.appended_lines(spark, str(tmp_path / "logs"), split_bytes=5), tmp_path)
    q.processAllAvailable()
    assert seen(spark, tmp_path) == sorted([*first, ("b.log", "y"), ("b.log", "z")])
    b.write_bytes(b"n\n")  # begun anew
    q.processAllAvailable()
    assert ("b.log", "n") in seen(spark, tmp_path) and len(seen(spark, tmp_path)) == len(first) + 3
    q.stop()


def test_events_of_appended_lines(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    packet = base64.b64encode(b"\x45\x00").decode()
    rows = [{"device": "d", "ms": 5, "packet": packet}, {"device": "d", "ms": 6, "packet": "?"}, {"device": "d", "sender": "s", "body": "hi", "ms": 7}, {"device": "e", "app": "bank", "kind": 1, "ms": 8}]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("no json",), ("",)], "value string")
    assert [bytes(r.packet) for r in endpoints.packets(lines).where("packet IS NOT NULL").collect()] == [b"\x45\x00"]
    assert [tuple(r) for r in endpoints.messages(lines).collect()] == [("d", "s", "hi", 7)]
    assert [tuple(r) for r in endpoints.usage_events(lines).where("app IS NOT NULL").collect()] == [("e", "bank", 1, 8)]
