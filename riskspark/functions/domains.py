"""Column functions over domain names: look-alikes, homophones, name services."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.text import fuzzy_percent

# Characters that look like Latin letters, by script, and those letters.
LOOKALIKES = {
    "Cyrillic": ("аеорсхуАЕОРСХіѕһкнфвмт", "aeopcxyAEOPCXishkhfbmt"),
    "Greek": ("οαεικνρστχ", "oaeikvpstx"),
    "Armenian": ("աեոօ", "aeoo"),
    "Latin": ("ıɡƚ", "igl"),
}
FULLWIDTH = ("".join(map(chr, range(0xFF41, 0xFF5B))), "abcdefghijklmnopqrstuvwxyz")
FOLD_FROM = "".join(x for x, _ in LOOKALIKES.values()) + FULLWIDTH[0]
FOLD_TO = "".join(x for _, x in LOOKALIKES.values()) + FULLWIDTH[1]

# Spellings that sound like a brand.
HOMOPHONES = {
    "taobao": ("ta0bao", "tao-bao", "tаоbao", "taoba0", "ta0ba0"),
    "alipay": ("a1ipay", "allpay", "al1pay", "a11pay", "al1pa1"),
    "wechat": ("we1chat", "weehat", "wech4t", "weech4t"),
    "icbc": ("1cbc", "ic8c", "lcbc", "iсbc"),
    "baidu": ("ba1du", "baidü", "baіdu"),
    "jd": ("jд", "jdсom"),
    "pinduoduo": ("p1nduoduo", "pinduo-duo"),
}

# Suffixes of name services by provider in order, and risks by suffix.
WEB3 = {
    "ENS": (".eth",),
    "UNSTOPPABLE": (".crypto", ".nft", ".blockchain", ".bitcoin", ".dao", ".888", ".wallet", ".x", ".klever", ".zil", ".go"),
    "SID": (".bnb", ".arb", ".polygon", ".op"),
}
WEB3_RISK = {
    ".eth": 0.6, ".crypto": 0.7, ".nft": 0.7, ".wallet": 0.8, ".x": 0.75, ".888": 0.75, ".bitcoin": 0.8, ".blockchain": 0.8,
}
OTHER_RISK = 0.5

#: A domain that a rule may name: labels of letters, digits and hyphens, the first one not edged by hyphens.
DOMAIN_FORMAT = r"^(?!-)[a-zA-Z0-9-]{1,63}(?<!-)(\.[a-zA-Z0-9-]{1,63})*\.[a-zA-Z]{2,}$"


def folded(c: Column) -> Column:
    """Look-alike characters as the letters that they look like."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def is_visual_spoof(c: Column) -> Column:
    return folded(c) != c


@F.pandas_udf(T.BooleanType())
def is_suspicious_punycode(domains: pd.Series) -> pd.Series:
    """Whether a label in punycode is broken or unfolds to look-alikes."""
    fold = str.maketrans(FOLD_FROM, FOLD_TO)

    def suspicious(domain: str | None) -> bool | None:
        if domain is None:
            return None
        for label in domain.split("."):
            if label.startswith("xn--"):
                try:
                    plain = label[4:].encode("ascii").decode("punycode")
                except (UnicodeError, ValueError, OverflowError):
                    return True
                if plain.translate(fold) != plain:
                    return True
        return False

    return domains.map(suspicious).astype(object)


def homograph(c: Column) -> Column:
    """``VISUAL_SPOOFING``, ``PUNYCODE_SPOOFING`` or null. Only names with an ``xn--``
    label go through Python."""
    coded = F.when(F.contains(c, F.lit("xn--")), c)
    return F.when(is_visual_spoof(c), "VISUAL_SPOOFING").when(
        F.coalesce(is_suspicious_punycode(coded), F.lit(False)), "PUNYCODE_SPOOFING"
    )


def homophone_score(c: Column) -> Column:
    """Best fuzzy ratio to a spelling of a brand, as a 32-bit share."""
    low = F.lower(c)
    scores = [
        (fuzzy_percent(F.lit(v), low).cast("float") / F.lit(100).cast("float")).cast("float")
        for variants in HOMOPHONES.values()
        for v in variants
    ]
    return F.greatest(*scores)


def web3(c: Column) -> Column:
    """``provider, resolved_name`` of a name-service domain, or null."""
    low, out = F.trim(F.lower(c)), None
    for provider, suffixes in WEB3.items():
        for s in suffixes:
            name = F.struct(F.lit(provider).alias("provider"), F.substring(low, F.lit(1), F.length(low) - len(s)).alias("resolved_name"))
            out = F.when(F.endswith(low, F.lit(s)), name) if out is None else out.when(F.endswith(low, F.lit(s)), name)
    return out


def web3_risk(c: Column) -> Column:
    low, out = F.trim(F.lower(c)), None
    for s, risk in WEB3_RISK.items():
        value = F.lit(risk).cast("float")
        out = F.when(F.endswith(low, F.lit(s)), value) if out is None else out.when(F.endswith(low, F.lit(s)), value)
    return out.otherwise(F.lit(OTHER_RISK).cast("float"))


def is_domain_format(c: Column) -> Column:
    return c.rlike(DOMAIN_FORMAT)


def domain_level(c: Column) -> Column:
    """Level by characters alone: Cyrillic letters, or much variety with many digits."""
    from riskspark.functions.text import entropy

    digits = F.regexp_count(c, F.lit(r"\p{Nd}")) / F.greatest(F.length(c), F.lit(1))
    odd = c.rlike(r"[\x{0400}-\x{04FF}]") | ((entropy(c, natural=True) > 3.5) & (digits > 0.3))
    return F.when(odd, "SUSPICIOUS").otherwise("SAFE")
