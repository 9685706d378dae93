"""Identifier-aware tokens as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What an identifier is, and the parts of a compound one.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{1,79}"
PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"
# Formats that issuers publish for their keys, and the text form of private keys (RFC 7468), of signed
# tokens (RFC 7519) and of addresses with a password (RFC 3986). A private key that is cut off counts to the end.
ISSUED = {
    "private key": r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:.*?-----END [A-Z0-9 ]*PRIVATE KEY-----|.*)",
    "signed token": r"\beyJ[\w-]+\.eyJ[\w-]+\.[\w-]+",
    "address": r"\b[a-zA-Z][\w+.-]{0,40}://[^\s/:@]*:[^\s/@]+@[^\s\"'<>]+",
    "AWS": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "GitHub": r"\b(?:gh[opsur]_[A-Za-z0-9]{20,}|github_pat_\w{22,})",
    "GitLab": r"\bglpat-[\w-]{20,}",
    "Google": r"\bAIza[\w-]{35}",
    "OpenAI and alike": r"\bsk-[\w-]{20,}",
    "Slack": r"\bxox[a-z]-[A-Za-z0-9-]{10,}",
    "Stripe": r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "Vercel": r"\bvck_[\w-]{16,}",
}
#: What one proves to be somebody with, and the uses of keys that only their owner holds; names may have more before it.
PROOFS = ("credential", "passcode", "passphrase", "passwd", "password", "pwd", "secret", "token")
KEYS = ("access", "account", "api", "auth", "encryption", "master", "private", "secret", "signing")
_NAME = rf"(?:{'|'.join(PROOFS)}|(?:{'|'.join(KEYS)})[ _-]?key)s?"
#: A name is given a value in a program or a setting: all of a quoted one, or one of six characters or more.
ASSIGNED = rf"(?i){_NAME}[\"'\]]*[ \t]*(?::=|=>|[:=])[ \t]*(?:\"[^\"\n]+\"|'[^'\n]+'|[^\s\"',;)}}\]]{{6,}})"
#: A sentence tells a value. It has a digit beside a letter or a sign, so that "the token is missing" stays.
TOLD = rf"(?i){_NAME} (?:is|was|are|were|will be)(?: now| set to)?:? [\"'`]?[^\s\"'`,;]*(?:[^\s\"'`,;\d.]\d|\d[^\s\"'`,;\d.])[^\s\"'`,;]*"
#: Credentials of a request by RFC 9110: what the header holds, and a bearer's token (RFC 6750) anywhere.
HEADER = r"(?i)\bauthorization[\"']?[ \t]*[:=][ \t]*[\"']?(?:(?:basic|bearer|digest|negotiate|token)[ \t]+)?[^\s\"',;]+"
BEARER = r"(?i)\bbearer[ \t]+[\w.~+/-]{16,}=*"
SECRETS = (*ISSUED.values(), HEADER, BEARER, ASSIGNED, TOLD)
PLACEHOLDER = "[REDACTED]"


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def normalize(word: Column) -> Column:
    """Lower case without plural endings, by fixed rules: -ies to -y in words over 4, -s in words over 3 but for -ss, -us and -is."""
    return normalized(F.lower(word))


def normalized(low: Column) -> Column:
    """The normal form of a word in lower case."""
    keeps = low.endswith("ss") | low.endswith("us") | low.endswith("is")
    return F.when(low.endswith("ies") & (F.length(low) > 4), F.concat(F.substring(low, F.lit(1), F.length(low) - 3), F.lit("y"))).when(low.endswith("s") & (F.length(low) > 3) & ~keeps, F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def parts(identifier: Column) -> Column:
    return F.regexp_extract_all(identifier, F.lit(PARTS), F.lit(0))


def is_compound(identifier: Column) -> Column:
    """Whether it has several parts of two characters or more, or a capital letter."""
    several = F.size(F.filter(parts(identifier), lambda p: F.length(p) > 1)) > 1
    return several | identifier.rlike("[A-Z]")


def small_parts(identifier: Column) -> Column:
    """Its parts of two characters or more, as they are written."""
    return F.filter(parts(identifier), lambda p: F.length(p) > 1)


def terms_of(identifier: Column, small: Column) -> Column:
    """What it expands to, from its small parts."""
    whole = F.when((F.size(small) > 1) | identifier.rlike("[A-Z]"), F.array(identifier)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(whole, F.transform(F.transform(small, F.lower), normalized)))


def expand(identifier: Column) -> Column:
    """A compound identifier as it is written, and its normalised parts of two characters or more; distinct, in order. It is
    taken apart once."""
    return F.get(F.transform(F.array(small_parts(identifier)), lambda s: terms_of(identifier, s)), F.lit(0))


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, PLACEHOLDER)
    return text
