"""Column functions over texts and URLs. All are built-in expressions but :func:`entropy`,
whose characters are counted by numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut-offs that results depend on.
DANGEROUS_HITS, SUSPICIOUS_HITS = 3, 1
#: Longest sanitised text, and what a run of one character or of a short pattern is cut to.
SANITISED, RUN, PATTERN_RUN = 2048, 10, 20
#: Words of the "payment" kind of QR payload, by how they begin.
PAYMENT_STARTS = ("upi://", "alipay://", "wxp://", "weixin://", "mqqapi://", "银行卡")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units (``length`` counts code points)."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def keyword_hits(c: Column, words: Sequence[str]) -> Column:
    """How many of the distinct words occur in the text."""
    if not words:
        return F.lit(0)
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def keyword_level(c: Column, words: Sequence[str]) -> Column:
    hits = keyword_hits(c, words)
    return (
        F.when(hits >= DANGEROUS_HITS, "DANGEROUS").when(hits >= SUSPICIOUS_HITS, "SUSPICIOUS").otherwise("SAFE")
    )


def ngrams(c: Column) -> Column:
    """Runs of letters and digits, lower-cased: a run of one or two characters as it
    is, a longer one as all its pairs and then all its triples."""
    runs = F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda r: r != "")

    def grams(r: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))

    return F.flatten(
        F.transform(runs, lambda r: F.when(F.length(r) <= 2, F.array(r)).otherwise(F.concat(grams(r, 2), grams(r, 3))))
    )


def ngram_bag(c: Column) -> Column:
    """The tokens of :func:`ngrams`, as often, but in no stated order: two passes of
    compiled patterns, for texts whose tokens are only counted."""
    low, letter = F.lower(c), r"[\p{L}\p{Nd}]"
    # A letter beyond the first plane in the class makes the look-behind step over whole code points.
    before = r"(?<![\p{L}\p{Nd}𠀀])"
    pairs = F.regexp_extract_all(low, F.lit(rf"(?=({letter}{{2}}|{before}{letter}(?!{letter})))"), F.lit(1))
    return F.concat(pairs, F.regexp_extract_all(low, F.lit(rf"(?=({letter}{{3}}))"), F.lit(1)))


def _entropy(text: str | None, natural: bool) -> float | None:
    if not text:
        return None if text is None else 0.0
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(code) if code.max() < 1 << 16 else np.unique(code, return_counts=True)[1]
    share = counts[counts > 0] / len(code)
    log = np.log(share) if natural else np.log(share) / np.log(2.0)
    return 0.0 - float(np.add.accumulate(share * log)[-1])  # summed in the order of the characters


def entropy(c: Column, natural: bool = False) -> Column:
    """Shannon entropy of the characters, in bits or nats; 0 for the empty text."""

    @F.pandas_udf("double")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([_entropy(t, natural) for t in texts], dtype="float64")

    return found(c)


def normalised_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(a, b) / longer)


def fuzzy_percent(a: Column, b: Column) -> Column:
    """``1 - distance / longer length`` as whole per cent, cut; in 32-bit arithmetic."""
    share = (F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).cast("float")
    return F.floor(((F.lit(1).cast("float") - share).cast("float") * F.lit(100).cast("float")).cast("float")).cast("int")


def first_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"https?://\S+", 0), F.lit(""))


def embedded_url(c: Column) -> Column:
    """As :func:`first_url`, but it ends at quotes and angle brackets."""
    return F.nullif(F.regexp_extract(c, r"https?://[^\s\"'<>]+", 0), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; null where the URL has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def netloc(url: Column) -> Column:
    """Lower-case authority, with port and user."""
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def url_words(url: Column, title: Column) -> Column:
    """Subdomain words, path words and title in one text of at most 1000 characters."""
    labels = F.split(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), r"\.")
    name = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 2), " ")).otherwise(
        F.get(labels, F.lit(0))
    )
    path = F.translate(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/-_", "   ")
    joined = F.concat(name, F.lit(" "), path, F.lit(" "), F.coalesce(title, F.lit("")))
    return F.substring(F.trim(joined), 1, 1000)


def is_bare_domain(c: Column) -> Column:
    """No path and one dot at most."""
    rest = F.regexp_replace(F.regexp_replace(c, "^https?://", ""), r"^www\.", "")
    return ~F.contains(rest, F.lit("/")) & (F.regexp_count(rest, F.lit(r"\.")) <= 1)


def strip_www(c: Column) -> Column:
    return F.regexp_replace(c, r"^www\.", "")


def url_key(url: Column) -> Column:
    """Join key of a URL: lower case, no slashes at the end, https."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), "/+$", ""), "^http://", "https://")


def full_url(url: Column) -> Column:
    """``https://host/path?query`` without ``www.``; what has no host stays as it is."""
    u = F.trim(F.lower(url))
    u = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    u = F.replace(u, F.lit("http://"), F.lit("https://"))
    h = F.regexp_replace(F.try_parse_url(u, F.lit("HOST")), r"^www\.", "")
    query = F.try_parse_url(u, F.lit("QUERY"))
    whole = F.concat(
        F.lit("https://"),
        h,
        F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")),
        F.coalesce(F.concat(F.lit("?"), query), F.lit("")),
    )
    return F.coalesce(whole, u)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\r\n]+", " "))


def sanitised(c: Column) -> Column:
    """``text, was_truncated, had_control_chars, had_repetitions, original_length``."""
    plain = F.regexp_replace(c, r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}]", "")
    no_control = F.regexp_replace(plain, r"[\x{7F}-\x{9F}]", "")
    no_codes = F.regexp_replace(no_control, r"%(?:[01][0-9A-Fa-f]|7[Ff])", "")
    no_escapes = F.regexp_replace(no_codes, r"\\u00(?:[01][0-9A-Fa-f]|7[Ff])", "")
    short_runs = F.regexp_replace(no_escapes, r"(.)\1{" + str(RUN) + ",}", "$1" * RUN)
    # A pattern of two to five characters that fills more than PATTERN_RUN is cut to so many.
    cut = F.regexp_replace(short_runs, r"(.{5})\1{5,}", "$1" * 4)
    cut = F.regexp_replace(cut, r"(.{4})\1{5,}", "$1" * 5)
    cut = F.regexp_replace(cut, r"((..).)\1{6,}", "$1" * 6 + "$2")
    cut = F.regexp_replace(cut, r"(..)\1{10,}", "$1" * 10)
    return F.struct(
        F.substring(cut, 1, SANITISED).alias("text"),
        (F.length(cut) > SANITISED).alias("was_truncated"),
        (plain != c).alias("had_control_chars"),
        (cut != no_escapes).alias("had_repetitions"),
        F.length(c).alias("original_length"),
    )


def is_suspicious_input(c: Column) -> Column:
    """Little variety in a long text, invisible characters, or a trace of Chinese in ASCII."""
    n = F.length(c)
    ascii_share = F.length(F.regexp_replace(c, r"\P{ASCII}+", "")) / F.greatest(n, F.lit(1))
    return (
        ((entropy(c) < 1.0) & (n > 20))
        | c.rlike(r"[\x{200B}-\x{200F}\x{2028}\x{2029}\x{FE00}-\x{FE0F}\x{FEFF}]")
        | (c.rlike(r"[\x{4E01}-\x{10FFFF}]") & (ascii_share > 0.95) & (n > 50))
    )


def mask_domain(c: Column) -> Column:
    """Each label keeps two characters, short ones none."""
    return F.array_join(
        F.transform(
            F.split(c, r"\."),
            lambda x: F.when(F.length(x) <= 2, F.lit("***")).otherwise(F.concat(F.substring(x, 1, 2), F.lit("***"))),
        ),
        ".",
    )


def mask_url(c: Column) -> Column:
    """Scheme and masked host; the path is hidden."""
    h = F.try_parse_url(c, F.lit("HOST"))
    whole = F.concat(F.try_parse_url(c, F.lit("PROTOCOL")), F.lit("://"), mask_domain(h), F.lit("/***"))
    return F.when(c.isNotNull(), F.coalesce(whole, F.lit("***")))


def qr_kind(c: Column) -> Column:
    low = F.lower(c)

    def starts(*heads: str) -> Column:
        out = F.lit(False)
        for h in heads:
            out = out | F.startswith(low, F.lit(h))
        return out

    return (
        F.when(starts("http://", "https://"), "URL")
        .when(starts(*PAYMENT_STARTS), "PAYMENT")
        .when(starts("wifi:", "wifi;"), "WIFI")
        .otherwise("TEXT")
    )


def qr_content(c: Column) -> Column:
    wifi = F.trim(F.regexp_replace(F.regexp_replace(c, "^wifi:", ""), "^wifi;", ""))
    return F.when(qr_kind(c) == "WIFI", wifi).otherwise(c)


def signature(adds: Column, removes: Column) -> Column:
    return F.sha2(F.array_join(F.concat(adds, removes), "\n"), 256)


def signature_fits(adds: Column, removes: Column, given: Column) -> Column:
    return F.coalesce(F.lower(given) == signature(adds, removes), F.lit(False))


def version_key(v: Column) -> Column:
    """The numbers of a dotted version, which compare as versions do: parts that are not
    numbers count as 0, and zeros at the end say nothing."""
    parts = F.transform(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != 0, i + 1).otherwise(0)))
    return F.slice(parts, 1, F.greatest(last, F.lit(0)).cast("int"))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as dotted version ``a`` is before, equal to or after ``b``; parts
    that are not numbers count as 0, as do missing ones."""

    def parts(v: Column) -> Column:
        return F.transform(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))

    signs = F.zip_with(
        parts(a), parts(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int")
    )
    return F.coalesce(F.get(F.filter(signs, lambda s: s != 0), F.lit(0)), F.lit(0))


def corpus_noise(c: Column) -> Column:
    """Why a text is noise, or null; the first reason counts."""
    # Placeholders that are noise when they are all of a text.
    alone = ["URL", "DIGIT", "NAME", "PLACE", "CELLPHONE", "WECHAT", "BANK", "微信同号", "手机号码"]
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return (
        F.when(F.length(t) < 5, "too_short")
        .when(c.rlike(r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}]"), "control_char")
        .when(t.rlike(r"^[\d\s\-+()]+$"), "number_only")
        .when(t.isin(alone), "garbage_token")
    )


# What marks a "legitimate" text as fraud, by kind.
ESCORT = "找小姐 酒店特殊服务 上门服务 上门全套 酒店全套 特殊服务 小姐服务 外围 楼凤 兼职妹 商务模特 夜总会 桑拿 洗浴中心 会所 私人伴游 情人 全套服务 莞式 大活 口活 波推".split()
GAMBLING = "牛牛群 微信红包群 一分免押金 赌博群 彩票群 北京赛车 时时彩 百家乐 六合彩 外围盘口 真人视讯 棋牌 开元棋牌 龙虎斗 炸金花 德州扑克群 麻将群".split()
FAKE_PAPERS = "代开票 代开各类 增值税发票 发票代开 开票 代开医院 代开病历 代开诊断证明 代办证件 办证 刻章 假证".split()
CONTACT = r"微信.{0,5}[0-9a-zA-Z]{4,}|加微.{0,5}[0-9a-zA-Z]{4,}|微[:::]{1,3}[0-9a-zA-Z]{3,}|[Vv]信.{0,5}[0-9a-zA-Z]{4,}|[Qq]{2}.{0,3}[0-9]{5,}|1[3-9][0-9]{9}"
ESCORT_CONTACT = r"微信.{0,5}[0-9a-zA-Z]{5,}|加微.{0,5}[0-9a-zA-Z]{5,}|微[:::]{1,3}[0-9a-zA-Z]{4,}|[Vv]信.{0,5}[0-9a-zA-Z]{5,}"


def mislabelled(c: Column) -> Column:
    """The kind of fraud that a text labelled legitimate is, or null."""
    contact = c.rlike(CONTACT)
    return (
        F.when(((keyword_hits(c, ESCORT) > 0) | c.rlike(ESCORT_CONTACT)) & contact, "escort")
        .when((keyword_hits(c, GAMBLING) > 0) & (contact | F.contains(c, F.lit("群"))), "gambling")
        .when((keyword_hits(c, FAKE_PAPERS) > 0) & (contact | F.contains(c, F.lit("电话"))), "fake_doc")
    )


def log_fields(c: Column) -> Column:
    """``epoch, epochs, percent, acc, loss, val_acc, val_loss`` of a training log line;
    what a line does not tell is null."""

    def number(pattern: str, kind: str = "double") -> Column:
        return F.regexp_extract(c, pattern, 1).try_cast(kind)

    value = r"([0-9]*\.?[0-9]+)"
    return F.struct(
        number(r"(?i)epoch\s+(\d+)", "int").alias("epoch"),
        number(r"(?i)epoch\s+\d+\s*/\s*(\d+)", "int").alias("epochs"),
        number(value + "%").alias("percent"),
        number(r"(?i)(?<![_a-z])acc(?:uracy)?\s*[=:]\s*" + value).alias("acc"),
        number(r"(?i)(?<![_a-z])loss\s*[=:]\s*" + value).alias("loss"),
        number(r"(?i)val_acc(?:uracy)?\s*[=:]\s*" + value).alias("val_acc"),
        number(r"(?i)val_loss\s*[=:]\s*" + value).alias("val_loss"),
    )


def sms_key(sender: Column, body: Column) -> Column:
    """Cooldown key of a message: equal sender and body share one."""
    return F.concat_ws("_", F.lit("sms"), sender, F.md5(body))


def sms_model_score(sms: Column, url: Column, body: Column) -> Column:
    """The message score, or half the URL score if its URL is a bare domain and that is more."""
    bare = F.coalesce(is_bare_domain(first_url(body)), F.lit(False))
    half = F.when(bare, (url.cast("float") * F.lit(0.5).cast("float")).cast("float"))
    return F.greatest(sms.cast("float"), half)
