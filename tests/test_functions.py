"""Column functions on literals."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskspark.functions import domains as D
from riskspark.functions import features as V
from riskspark.functions import packets as P
from riskspark.functions import text as X
from riskspark.functions import tokenizers as K


def test_utf16_length(one):
    assert one("a😀", X.utf16_length) == 3


@pytest.mark.parametrize(("text", "level"), [("", "SAFE"), ("点击链接", "SUSPICIOUS"), ("冻结账户 点击链接 公安", "DANGEROUS")])
def test_keyword_level(one, text, level):
    assert one(text, lambda c: X.keyword_level(c, ["冻结账户", "点击链接", "公安"])) == level


def test_ngrams(one):
    assert one("转账汇款 Hi abc", X.ngrams) == ["转账", "账汇", "汇款", "转账汇", "账汇款", "hi", "ab", "bc", "abc"]
    assert one("", X.ngrams) == []


@pytest.mark.parametrize("text", ["转账汇款 Hi abc", "", "a b c dd 𝒜b x𝒜 𝒜 z", "𝒜𝒜𝒜b c", "x-y--zz 1 22 333 é", None, "😀a😀bc😀"])
def test_bag_has_the_same_ngrams(one, text):
    bag, grams = one(text, X.ngram_bag), one(text, X.ngrams)
    assert (bag and sorted(bag)) == (grams and sorted(grams))


@pytest.mark.parametrize("text", ["", "a", "aab", "hello world", "ééx"])
def test_entropy(one, text):
    n = len(text)
    want = -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0
    assert one(text, X.entropy) == pytest.approx(want)


def test_fuzzy_percent_is_cut_in_single_precision(one):
    assert one("abcd", lambda c: X.fuzzy_percent(c, F.lit("abce"))) == 75
    assert one("red anvil", lambda c: X.fuzzy_percent(c, F.lit("red widget"))) == 39


def test_urls(one):
    u = "http://www.Sub.Example.com:80/a-b/c_d?x=1"
    assert one(u, X.host) == "sub.example.com"
    assert one(u, X.netloc) == "www.sub.example.com:80"
    assert one("not a url", X.host) is None
    assert one('see "https://a.b/c" now', X.embedded_url) == "https://a.b/c"
    assert one("none", X.first_url) is None
    assert one("HTTP://A.b/c//", X.url_key) == "https://a.b/c"
    assert one("www.Example.com/p?q=1", X.full_url) == "https://example.com/p?q=1"
    assert one("example.com", X.is_bare_domain) and not one("a.b.com", X.is_bare_domain)


def test_masks(one):
    assert one("ab.example.com", X.mask_domain) == "***.ex***.co***"
    assert one("https://abc.de/x/y", X.mask_url) == "https://ab***.***/***"
    assert one(None, X.mask_url) is None


def test_sanitised(one):
    assert one("a" * 30 + "\x01b%00c", lambda c: X.sanitised(c)["text"]) == "a" * 10 + "bc"
    assert one("abc" * 20, lambda c: X.sanitised(c)["text"]) == ("abc" * 20)[:20]
    r = one("x" * 3000, X.sanitised)
    assert (r.had_control_chars, r.had_repetitions) == (False, True)


def test_versions(one):
    for a, b, want in [("1.2", "1.10", -1), ("2", "1.9.9", 1), ("1.0", "1", 0), ("1.x", "1.0", 0)]:
        assert one(a, lambda c, b=b: X.version_order(c, F.lit(b))) == want


def test_signature(one):
    import hashlib

    want = hashlib.sha256(b"a\nb\nc").hexdigest()
    adds, removes = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))
    assert one(want.upper(), lambda c: X.signature_fits(adds, removes, c))
    assert one(None, lambda c: X.signature_fits(adds, removes, c)) is False


def test_noise_and_labels(one):
    assert one(" ab ", X.corpus_noise) == "too_short"
    assert one("12-34 (5)", X.corpus_noise) == "number_only"
    assert one("手机号码", X.corpus_noise) == "too_short"
    assert one("fine text", X.corpus_noise) is None
    assert one("上门服务 微信 abc123", X.mislabelled) == "escort"
    assert one("百家乐群", X.mislabelled) == "gambling"
    assert one("代开票 电话", X.mislabelled) == "fake_doc"
    assert one("hello", X.mislabelled) is None


def test_lookalikes(one):
    assert one("gооgle.com", D.folded) == "google.com"
    assert one("ａbc", D.is_visual_spoof) and not one("google.com", D.is_visual_spoof)
    assert one("xn--pple-43d.com", D.homograph) == "PUNYCODE_SPOOFING"
    assert one("sub.xn--pple-43d.com", D.homograph) == "PUNYCODE_SPOOFING"
    assert one("xn--fiqs8s.com", D.homograph) is None
    assert one("ta0bao", D.homophone_score) > 0.5
    assert one("z" * 20, D.homophone_score) < 0.2
    assert one("", D.homophone_score) == 0


def test_web3(one):
    assert one("Vitalik.eth", D.web3).resolved_name == "vitalik"
    assert one("example.com", D.web3) is None
    assert one("a.888", D.web3_risk) == pytest.approx(0.75)


def test_domain_format(one):
    assert one("example.com", D.is_domain_format)
    for bad in ("-a.com", "a", "a..com", "a.c"):
        assert not one(bad, D.is_domain_format)


def test_features(one):
    f = one("10086\n您的账户异常！请立即点击 http://a.b/c 13812345678 aa", V.features)
    assert (f.senderType, f.language, f.urlCount, f.hasPhoneNumber) == ("SHORT_CODE", "CHINESE", 1, True)
    assert (f.urgencyWordCount, f.financialWordCount, f.exclamationCount) == (2, 1, 1)
    empty = one("", V.features)
    assert (empty.textLength, empty.digitRatio, empty.sentimentScore, empty.avgWordLength) == (0, 0, 0.5, 0)
    a = one("Hi there 1.2.3.4 $5 😀!!", lambda c: V.as_array(V.features(c)))
    assert len(a) == 24 and all(0 <= x <= 1 for x in a)
    assert one('{"textLength": 3', V.from_json) is None or one('{"textLength": 3', V.from_json).textLength is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(2**-0.5), 0, 0]
    assert df.select(V.cosine_of_common(F.col("a"), F.col("b"))).collect()[2][0] == 1


def test_byte_ids():
    assert K.byte_ids("ab", 6) == [101, 97, 98, 102, 0, 0]
    assert K.byte_ids("aé", 4) == [101, 97, 102, 0]
    assert K.byte_ids("abcdef", 4) == [101, 97, 98, 102]


def test_subwords(one):
    vocabulary = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 5, "b": 6, "c": 7, "ab": 8, "abc": 9, "中": 10, "1": 11}
    assert K.merged("abcab", vocabulary) == ["abc", "ab"]
    ids = one("ABC中1?", K.subword_encoder(vocabulary, 8))
    assert ids == [2, 9, 10, 11, 1, 3, 0, 0]
    assert one("ab", K.subword_encoder({}, 5)) == [101, 97, 98, 102, 0]
    assert one([2, 9, 10, 3, 0], K.subword_decoder(vocabulary), "array<bigint>") == "abc中"


def packet(name="www.example.com", port=53, version=4, flags=0x0100):
    question = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0\0\1\0\1"
    dns = b"\x12\x34" + flags.to_bytes(2, "big") + b"\0\1\0\0\0\0\0\0" + question
    udp = (40000).to_bytes(2, "big") + port.to_bytes(2, "big") + (8 + len(dns)).to_bytes(2, "big") + b"\0\0" + dns
    if version == 4:
        return b"\x45\0" + (20 + len(udp)).to_bytes(2, "big") + bytes(5) + b"\x11\0\0" + b"\x0a\0\0\1" + b"\x08\x08\x08\x08" + udp
    return b"\x60\0\0\0" + len(udp).to_bytes(2, "big") + b"\x11\x40" + bytes(range(16)) + bytes(range(16, 32)) + udp


@pytest.mark.parametrize("version", [4, 6])
def test_packets(version):
    p = packet(version=version)
    assert P.dns_query(p) and not P.dns_query(packet(port=80, version=version)) and not P.dns_query(p[:18])
    assert P.query_name(p) == "www.example.com"
    n = 20 if version == 4 else 40
    r = P.refusal(p)
    assert len(r) == len(p) and r[n : n + 4] == p[n + 2 : n + 4] + p[n : n + 2]
    assert P.payload(r)[:4] == b"\x12\x34\x81\x83"
    if version == 4:
        assert P.checksum(r[:20]) == 0 and r[12:16] == p[16:20]
    assert P.answers(P.payload(p), P.payload(r)) and not P.answers(b"\0\0" + P.payload(p)[2:], P.payload(r))
    assert P.payload(P.reply(p, P.payload(r))) == P.payload(r)


def test_name_limits():
    message = bytes(12) + b"\3abc\xc0\x0c"
    assert P.name_at(message, 12).startswith("abc") and len(P.name_at(message, 12)) < 100
    assert P.name_at(bytes(12) + b"\x3f" + b"a" * 10, 12) == "a" * 10
    assert P.refusal(packet()[:30]) == b""


def test_packet_columns(one):
    assert one(bytearray(packet()), P.extract_domain, "binary") == "www.example.com"
    assert one(None, P.is_dns_query, "binary") is None


def test_murmur_and_bloom():
    assert P.murmur3(b"", 0) == 0 and P.murmur3(b"hello", 0) == 0x248BFA47 and P.murmur3(b"hello, world", 0) == 0x149BBB7F
    bits, hashes = P.bloom_size(1000, 0.001)
    assert (bits, hashes) == (14377, 9)
    held = {b for w in map(str, range(1000)) for b in P.bloom_places(w, bits, hashes)}
    assert all(set(P.bloom_places(str(k), bits, hashes)) <= held for k in range(1000))
    assert sum(set(P.bloom_places(f"x{k}", bits, hashes)) <= held for k in range(2000)) < 20


def test_log_fields(one):
    r = one("Epoch 3/30 [45%] loss: 0.12 acc=0.9 val_acc: 0.8 val_loss=0.5", X.log_fields)
    assert tuple(r) == (3, 30, 45.0, 0.9, 0.12, 0.8, 0.5)
    assert tuple(one("nothing", X.log_fields)) == (None,) * 7


def test_sms_score(one):
    f = lambda c: X.sms_model_score(F.lit(0.1), F.lit(0.9), c)
    assert one("go https://a.com", f) == pytest.approx(0.45)
    assert one("go https://a.com/path", f) == pytest.approx(0.1)
    assert one("none", f) == pytest.approx(0.1)
