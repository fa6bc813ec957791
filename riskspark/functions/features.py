"""The 24 features of a message, their array form and similarity."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.text import keyword_hits, utf16_length
from riskspark.schemas import struct

# The words that are counted.
FINANCIAL = "银行 转账 密码 账户 资金 贷款 信用卡 借记卡 余额 提现 充值 支付 理财 投资 收益 分红".split()
URGENCY = "紧急 立即 马上 尽快 限时 截止 逾期 过期 失效 冻结 锁定 异常 风险 安全 警告".split()
THREAT = "涉案 传票 拘留 逮捕 违法 犯罪 洗钱 诈骗 公安 法院 检察院 纪委 监察 通缉 协查".split()
NEGATIVE = "危险 警告 威胁 风险 诈骗 违法 犯罪 冻结 锁定".split()
POSITIVE = "安全 保护 正常 成功 已验证 已确认".split()
MONEY = r"[$€£¥₹₽₩]"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IP = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
CHINESE = r"[\x{4E00}-\x{9FFF}]"
SENDERS, LANGUAGES = ("PHONE_NUMBER", "SHORT_CODE", "ALPHABETIC", "UNKNOWN"), ("CHINESE", "ENGLISH")

SCHEMA = struct(
    "textLength int, urlCount int, hasPhoneNumber boolean, hasFinancialKeywords boolean, hasUrgencyKeywords boolean, "
    "hasThreatKeywords boolean, senderType string, language string, specialCharRatio float, digitRatio float, "
    "avgWordLength float, exclamationCount int, questionCount int, uppercaseRatio float, repeatedCharCount int, "
    "linkCount int, ipAddressCount int, chineseCharRatio float, emojiCount int, moneySymbolCount int, "
    "urgencyWordCount int, threatWordCount int, financialWordCount int, sentimentScore float"
)
#: Counts and lengths are divided by these and cut at 1 in the array form.
FULL_SCALE = {
    "textLength": 500, "urlCount": 5, "avgWordLength": 20, "exclamationCount": 10, "questionCount": 10,
    "repeatedCharCount": 20, "linkCount": 5, "ipAddressCount": 3, "emojiCount": 10, "moneySymbolCount": 5,
    "urgencyWordCount": 10, "threatWordCount": 10, "financialWordCount": 10,
}


#: Dimensions in which vectors of unlike sizes are compared.
COMMON = 8


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _chars(c: Column, inside: str) -> Column:
    """Characters of the class ``[inside]``: what is left when runs of others go."""
    return F.length(F.regexp_replace(c, rf"[^{inside}]+", ""))


def _share(part: Column, whole: Column) -> Column:
    """A 32-bit ratio; 0 over 0 is 0."""
    return F.when(whole == 0, F.lit(0).cast("float")).otherwise((part.cast("float") / whole.cast("float")).cast("float"))


def features(c: Column, names: Collection[str] | None = None) -> Column:
    """The features of a text as a struct: all of :data:`SCHEMA`, or those named, in its
    order (others are not computed)."""
    n = utf16_length(c)
    urls = _count(c, r"https?://\S+")
    letters = _chars(c, r"\p{L}")
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    in_words = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
    line = F.trim(F.get(F.split(c, r"\R"), F.lit(0)))
    sender = (
        F.when(line.rlike("^1[3-9][0-9]{9}$"), "PHONE_NUMBER")
        .when(line.rlike("^[0-9]{3,6}$"), "SHORT_CODE")
        .when(line.rlike("^[A-Za-z]{3,11}$"), "ALPHABETIC")
        .otherwise("UNKNOWN")
    )
    negative, positive = keyword_hits(c, NEGATIVE), keyword_hits(c, POSITIVE)
    values = {
        "textLength": n,
        "urlCount": urls,
        "hasPhoneNumber": c.rlike(r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])"),
        "hasFinancialKeywords": keyword_hits(c, FINANCIAL) > 0,
        "hasUrgencyKeywords": keyword_hits(c, URGENCY) > 0,
        "hasThreatKeywords": keyword_hits(c, THREAT) > 0,
        "senderType": sender,
        "language": F.when(c.rlike(CHINESE), "CHINESE").otherwise("ENGLISH"),
        "specialCharRatio": _share(F.length(F.regexp_replace(c, r"[\p{L}\p{Nd}\s]+", "")), n),
        "digitRatio": _share(_chars(c, r"\p{Nd}"), n),
        "avgWordLength": _share(in_words, F.size(words)),
        "exclamationCount": _chars(c, "!！"),
        "questionCount": _chars(c, "?？"),
        "uppercaseRatio": _share(_chars(c, r"\p{Lu}"), letters),
        "repeatedCharCount": F.length(c) - F.length(F.regexp_replace(c, r"(?s)(.)\1+", "$1")),
        "linkCount": urls,
        "ipAddressCount": _count(c, IP),
        "chineseCharRatio": _share(_chars(c, CHINESE[1:-1]), n),
        "emojiCount": _chars(c, EMOJI[1:-1]),
        "moneySymbolCount": _chars(c, MONEY[1:-1]),
        "urgencyWordCount": keyword_hits(c, URGENCY),
        "threatWordCount": keyword_hits(c, THREAT),
        "financialWordCount": keyword_hits(c, FINANCIAL),
        "sentimentScore": F.when(negative + positive == 0, F.lit(0.5).cast("float")).otherwise(
            _share(positive, negative + positive)
        ),
    }
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in SCHEMA if names is None or f.name in names])


def as_array(f: Column) -> Column:
    """The features as 24 floats from 0 to 1."""
    out = []
    for field in SCHEMA:
        x = f[field.name]
        if field.name in FULL_SCALE:
            x = F.least((x.cast("float") / F.lit(FULL_SCALE[field.name]).cast("float")).cast("float"), F.lit(1).cast("float"))
        elif field.name == "senderType":
            x = (F.array_position(F.array(*map(F.lit, SENDERS)), x) - 1).cast("float") / F.lit(3).cast("float")
        elif field.name == "language":
            x = (x == LANGUAGES[1]).cast("int")
        elif field.dataType == T.BooleanType():
            x = x.cast("int")
        else:
            x = F.least(F.greatest(x, F.lit(0).cast("float")), F.lit(1).cast("float"))
        out.append(x.cast("float"))
    return F.array(*out)


def as_json(f: Column) -> Column:
    return F.to_json(f)


def from_json(c: Column) -> Column:
    """The features in a JSON text; null if it is broken."""
    return F.from_json(c, SCHEMA)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or unlike sizes."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def cosine_of_common(a: Column, b: Column, most: int = COMMON) -> Column:
    """As :func:`cosine`, but unlike sizes are compared in their first dimensions."""
    k = F.least(F.size(a), F.size(b), F.lit(most))
    same = F.size(a) == F.size(b)
    return F.when(same, cosine(a, b)).otherwise(cosine(F.slice(a, F.lit(1), k), F.slice(b, F.lit(1), k)))
