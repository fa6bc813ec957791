"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct(fields: str) -> T.StructType:
    """A schema of ``name kind`` pairs, which needs no session."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in map(str.split, fields.split(","))])


DOMAINS = struct("domain string, category string, source string, addedAt bigint, confidence float")
ALERTS = struct(
    "id bigint, timestamp bigint, type string, domain string, url string, riskLevel string, userAction string"
)
USER_FEEDBACK = struct(
    "id bigint, timestamp bigint, textHash string, tokens string, modelScore float, label string, source string, features string"
)
RULES_VERSION = struct("version string")
RULES_DIFF = struct("adds array<string>, removes array<string>, signature string")
PHISH_FEED = struct("url string, domain string, verified boolean")
RULE_FILE = struct("domain string, reason string, source string")
CORPUS = struct("text string, label int, source string")
URL_CORPUS = struct("text string, label int, URL string, Domain string, Title string")

#: Values of the enumerated columns, in rank order.
CATEGORIES = ("WHITELIST", "BLACKLIST", "SUSPICIOUS", "UNKNOWN")
ALERT_TYPES = ("SCREEN_SHARE", "PHISHING_PAGE", "SUSPICIOUS_DOMAIN", "BLACKLIST_BLOCKED", "VISITED", "SMS_PHISHING")
LEVELS = ("SAFE", "SUSPICIOUS", "DANGEROUS")
FEEDBACK_LABELS = ("PHISHING", "FALSE_POSITIVE")
