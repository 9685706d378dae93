"""Personal data by weak supervision, in DataFrame functions alone.

Regular expressions give candidate spans. Four labelers vote on each: strict form, gazetteer, context and shape.
Expectation-maximisation over the counted vote patterns estimates how reliable each labeler is, and its posteriors
train the span classifier that decides on spans beyond the stated base.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.texts import plain
from millrace.sources.tables import written

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "iban", "ssn", "person")
LABELERS = ("form", "gazetteer", "context", "shape")

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# The stated expressions of the base kinds. Possessive repeats and the look behind (\\G is the end of the
# match before) give the same leftmost matches without trying every place inside a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_-]{20,}+(?![/+=])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}
#: What a text must have before the expression of a kind runs on it.
GATES = {"email": "@", "phone": "+", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "secret": r"[A-Za-z0-9_-]{20}", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "person": PATTERNS["person"]}
# Forms that are surely right, words before a span that speak for a kind, and gazetteers.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+$",
    "ip": rf"^{_OCTET}(?:\.{_OCTET}){{3}}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9_-]{24,})$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "person": r"^\S+ \S+ \S+$",
}
CONTEXT = {
    "email": r"(?:mail|contact|write|kontakt|correo|courriel)",
    "ip": r"(?:\bip\b|address|host|server|login|adresse)",
    "card": r"(?:card|visa|master|amex|credit|karte|carte|tarjeta)",
    "phone": r"(?:phone|call|tel|mobile|fax|contact|telefon|téléphone|teléfono)",
    "secret": r"(?:token|key|secret|passw|auth|bearer|credential|schlüssel|clave)",
    "iban": r"(?:iban|account|bank|konto|compte|cuenta)",
    "ssn": r"(?:ssn|social|security|tax)",
    "person": r"(?:name|dear|sincerely|regards|called|met|nombre|nom)",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|it|nl|us|ca)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|7|2[07]|3[0-4]|36|39|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:sk[-_]|pk[-_]|gh[pousr]_|AKIA|xox|eyJ|AIza)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "ssn": r"^(?:[0-7])",
    "person": r" (?:Anna|Carlos|Claire|David|Elena|Emma|Eva|Hans|Ines|James|Jean|John|José|Juan|Karl|Laura|Louis|Lucas|Luis|Maria|Marie|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Sofia|Thomas)\b",
}
#: Beginnings of runs that count up.
COUNTING = ("0123456", "1234567")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def dull(value: Column) -> Column:
    """Whether the look speaks against a value: no digit or one digit alone, or digits that count up."""
    digits = _digits(value)
    counts_up = value.contains(COUNTING[0]) | value.contains(COUNTING[1])
    return (F.replace(digits, F.left(digits, F.lit(1))) == "") | (digits == "") | counts_up


def strict(kind: str, value: Column) -> Column:
    """Whether a value has the form that is surely right. No label of a host begins or ends with a hyphen."""
    fits = value.rlike(STRICT[kind])
    return fits & ~value.rlike(r"@-|-\.|\.-") if kind == "email" else fits


def luhn(value: Column) -> Column:
    """Whether the digits pass: every second from the right counts double, less 9 if over 9."""
    backwards = F.reverse(_digits(value))
    part = lambda i: F.substring(backwards, i, F.lit(1)).cast("int") * (2 - i % 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), lambda a, i: a + part(i) - F.when(part(i) > 9, 9).otherwise(0)) % 10 == 0


def stands(kind: str, value: Column) -> Column:
    """What a match must pass besides its expression."""
    if kind == "ip":
        return value.rlike(STRICT["ip"])
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.when(F.length(_digits(value)) <= 19, luhn(value)).otherwise(False)
    if kind == "secret":
        return value.rlike("[0-9]")
    return F.length(_digits(value)).between(9, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, value: Column, before: Column) -> list[Column]:
    """+1, 0 or -1 of each labeler."""
    vote = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)
    form, shape = strict(kind, value), dull(value)
    return [
        vote(form, ~form).alias("form"),
        vote(value.rlike(GAZETTEER[kind])).alias("gazetteer"),
        vote(F.lower(before).rlike(CONTEXT[kind])).alias("context"),
        # Names have no digits, which says nothing of them.
        vote(~shape, shape).alias("shape") if kind != "person" else F.lit(0).alias("shape"),
    ]


_SPAN = "array<struct<kind:string,start:int,end:int,size:int,form:int,gazetteer:int,context:int,shape:int>>"


#: Matches that one fold gathers; the folds of a text with more are joined.
FOLD = 256


def spans_of(kind: str, text: Column) -> Column:
    """Spans of a kind with their votes: leftmost matches that pass, counted in code points.

    A fold copies what it has gathered for each match, so matches are folded by blocks: the time grows with the matches
    and not with their square.
    """
    gate = text.contains(GATES[kind]) if kind in ("email", "phone") else text.rlike(GATES[kind])
    hits = F.when(gate, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))
    gaps = F.when(gate, F.split(text, PATTERNS[kind], -1))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    size_of = lambda x: F.length(x["gap"]) + F.length(x["hit"])

    def add(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        size = F.least(F.floor(F.length(x["hit"]) / 8), F.lit(4)).cast("int")
        votes = _votes(kind, x["hit"], F.right(x["gap"], F.lit(40)))
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), size.alias("size"), *votes)
        out = F.when(stands(kind, x["hit"]), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def fold(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), add, lambda s: s["out"])

    def place(state: Column, block: Column) -> Column:
        """The blocks with where each begins."""
        length = F.aggregate(block, F.lit(0), lambda n, x: n + size_of(x))
        begun = F.concat(state["out"], F.array(F.struct(state["at"].alias("at"), block.alias("block"))))
        return F.struct((state["at"] + length).alias("at"), begun.alias("out"))

    placed_type = "array<struct<at:int,block:array<struct<gap:string,hit:string>>>>"

    def gather(all_pairs: Column) -> Column:
        """The argument is a variable of a higher-order function, so that the matches are found once."""
        last = F.floor((F.size(all_pairs) - 1) / FOLD).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_pairs, i * FOLD + 1, F.lit(FOLD)))
        placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(placed_type).alias("out")), place, lambda s: s["out"])
        many = F.flatten(F.transform(placed, lambda b: fold(b["block"], b["at"])))
        return F.when(F.size(all_pairs) > FOLD, many).when(F.size(all_pairs) > 0, fold(all_pairs, F.lit(0)))

    spans = F.get(F.transform(F.array(pairs), gather), 0)
    return F.coalesce(spans, F.array().cast(_SPAN))


@dataclass(frozen=True)
class SpanModel:
    """Logistic weights of (feature, value); kinds, sizes and votes are the features."""

    weights: dict[tuple[str, object], float]
    offset: float

    def column(self, span: Column) -> Column:
        total = F.lit(self.offset)
        for feature in ("kind", "size", *LABELERS):
            for value, weight in sorted((str(v), w) for (f, v), w in self.weights.items() if f == feature):
                total = total + F.when(span[feature].cast("string") == value, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Two-class expectation-maximisation over vote patterns: (P(vote | class) by labeler, share of true spans,
    posterior of each pattern). Starts from the vote sums; one pseudo-count keeps all shares away from 0."""
    post = np.clip(0.5 + votes.sum(1) / (2 * votes.shape[1] + 1), 0.05, 0.95)
    for _ in range(rounds):
        true, false = counts * post, counts * (1 - post)
        prior = (true.sum() + 1) / (counts.sum() + 2)
        given = np.array([[[(w[votes[:, j] == v].sum() + 1) / (w.sum() + 3) for v in (-1, 0, 1)] for w in (true, false)] for j in range(votes.shape[1])])
        odds = np.log(prior / (1 - prior)) + sum(np.log(given[j, 0, votes[:, j] + 1] / given[j, 1, votes[:, j] + 1]) for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return given, float(prior), post


def train(patterns: list[tuple]) -> SpanModel:
    """From (kind, size, votes..., count): posteriors by kind, then one logistic classifier on them by weighted Newton
    steps. Without patterns it accepts by the votes of nobody: the offset is 0."""
    if not patterns:
        return SpanModel({}, 0.0)
    patterns = sorted(patterns)
    kinds = np.array([p[0] for p in patterns])
    votes, counts = np.array([p[2:-1] for p in patterns], int), np.array([p[-1] for p in patterns], float)
    target = np.zeros(len(patterns))
    for kind in sorted(set(kinds)):
        own = kinds == kind
        target[own] = reliabilities(votes[own], counts[own])[2]
    names = sorted({(f, v) for p in patterns for f, v in zip(("kind", "size", *LABELERS), p[:-1], strict=True)}, key=str)
    x = np.array([[1.0] + [float(dict(zip(("kind", "size", *LABELERS), p[:-1], strict=True))[f] == v) for f, v in names] for p in patterns])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (counts * (p - target)) + b
        h = (x * (counts * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.eye(len(b))
        b = b - np.clip(np.linalg.solve(h, g), -2, 2)
    return SpanModel({n: float(w) for n, w in zip(names, b[1:], strict=True)}, float(b[0]))


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, accept: float = 0.5) -> DataFrame:
    """Adds base (the stated kinds) and added (what the classifier accepts besides), arrays of spans by kind and start.

    Null and empty texts have none; texts of any length and shape are searched whole. The labelers abstain or vote on every candidate in all texts; the counted patterns,
    at most kinds x sizes x 3^labelers of them, train the model. Repeated rows are each searched; input columns base
    and added give way.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base", "added")]
    text_of = F.coalesce(plain(text), F.lit(""))
    frame = docs.select(*map(plain, kept), F.concat(*[spans_of(k, text_of) for k in BASE]).alias("base"), F.concat(*[spans_of(k, text_of) for k in EXTRA]).alias("__extra"))
    frame = written(frame, "spans")
    one = frame.select(F.explode(F.concat("base", "__extra")).alias("s")).groupBy("s.kind", "s.size", *[f"s.{n}" for n in LABELERS]).agg(F.count("*").alias("n"))
    model = train([tuple(r) for r in one.collect()])
    outside = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return frame.withColumn("added", F.filter("__extra", lambda s: (model.column(s) >= accept) & outside(s))).drop("__extra")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
