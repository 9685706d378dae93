"""URL filters in DataFrame functions alone.

Each rule is a regular expression on host and path, and is filed under the rarest of its literal tokens. The tokens
of a URL fetch its candidate rules, and only those run their expressions.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from millrace.llm.texts import plain

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules whose index judge() keeps in the plan, about a hundred bytes each; more are judged as a table.
MOST_IN_PLAN = 20_000


@dataclass(frozen=True)
class Rule:
    """A rule on host || path. pattern is for Java's engine, tokens are literals that any match has as whole tokens."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains if the path starts with `path`; a longer rule has the higher rank."""
    name = host + path
    whole = re.split(r"[^a-z0-9]+", name.lower())
    tokens = tuple(t for t in (whole if name[-1:] in "/" else whole[:-1]) if t)
    return Rule(name, verdict, r"^(?:[^/]*\.)?" + re.escape(name), tokens, 1000 + len(name))


def host_word_rule(verdict: str, words: str) -> Rule:
    """Fits hosts that have the hyphenated words as a part of one label, wherever the label stands."""
    return Rule("", verdict, rf"^(?:[^/]*[.-])?{re.escape(words)}(?:[.-][^/]*)?(?:/|$)", tuple(words.split("-")), len(words))


#: Rules of the stated list: (verdict, host, path).
STATED = [prefix_rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))]
# Hyphenated words in hosts of link farms, and of shops and sites that live by spam.
SPAM_HOSTS = """
spam-farm link-exchange link-farm link-building seo-links seo-services seo-backlinks buy-backlinks cheap-backlinks buy-followers buy-likes
buy-views buy-subscribers buy-reviews cheap-pills buy-pills diet-pills weight-loss-pills online-pharmacy canadian-pharmacy cheap-pharmacy
no-prescription buy-viagra cheap-viagra buy-cialis cheap-cialis generic-viagra generic-cialis buy-xanax buy-tramadol buy-steroids cheap-meds
free-casino online-casino casino-bonus casino-online best-casino real-money-casino online-slots free-slots slot-online slot-gacor online-poker
poker-online poker-bonus sports-betting betting-tips online-betting bet-online judi-online bingo-online roulette-online adult-cams adult-dating
adult-chat adult-videos live-cams sex-cams free-porn porn-tube porn-videos xxx-videos sex-chat escort-service escort-girls hookup-sites
payday-loans payday-loan cash-advance fast-loans instant-loans bad-credit-loans quick-cash no-credit-check get-rich make-money-fast earn-money-fast
work-from-home-jobs binary-options forex-signals crypto-doubler bitcoin-doubler free-bitcoin bitcoin-generator replica-watches replica-handbags
replica-rolex fake-watches cheap-jerseys cheap-nike cheap-jordans cheap-uggs cheap-oakley louis-vuitton-outlet michael-kors-outlet coach-outlet
ray-ban-outlet essay-writing-service buy-essay write-my-essay custom-essays term-papers-online fake-diploma buy-degree fake-passport
free-iphone free-gift-cards gift-card-generator free-robux free-vbucks cracked-software warez-download keygen-download serial-keys crack-download
torrent-download free-movies-online watch-free-movies full-movie-download mp3-download-free free-ringtones toolbar-download pc-cleaner-free
miracle-cure weight-loss-secrets lose-belly-fat penis-enlargement male-enhancement hair-loss-cure
""".split()
# What such hosts offer and how they praise it; each pair, in either order, is a rule of its own.
OFFERS = "pills meds pharmacy casino slots poker betting loans credit watches handbags sunglasses sneakers backlinks followers essays dissertations diplomas escorts webcams torrents warez keygens steroids supplements".split()
PRAISE = "cheap cheapest discount discounted wholesale replica fake bonus instant fast easy free best top top10 online buy order sale deals outlet store shop 24x7 vip".split()
SPAM_HOSTS = list(dict.fromkeys([*SPAM_HOSTS, *(f"{p}-{o}" for p in PRAISE for o in OFFERS), *(f"{o}-{p}" for p in PRAISE for o in OFFERS)]))
RULES = STATED + [host_word_rule("block", w) for w in SPAM_HOSTS]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(key: Column) -> Column:
    return F.array_distinct(F.split(F.lower(key), "[^a-z0-9]+"))


def _filed(rows: list[dict], schema: str) -> tuple[Column, int]:
    """Rows by a hash of their token, as a constant array of lists: the list of a token is found by its place alone."""
    size = max(1, 2 * len(rows))
    lists: list[list[dict]] = [[] for _ in range(size)]
    for r in rows:
        lists[zlib.crc32(r["token"].encode()) % size].append(r)
    return F.from_json(F.lit(json.dumps(lists)), f"array<array<struct<token:string{schema}>>>"), size


def _fetched(tokens: Column, index: tuple[Column, int]) -> Column:
    """The rows that are filed under any of the tokens."""
    lists, size = index
    found = F.transform(tokens, lambda t: F.filter(F.get(lists, (F.crc32(t.cast("binary")) % size).cast("int")), lambda r: r["token"] == t))
    return F.flatten(found)


def token_counts(pages: DataFrame, tokens: list[str], url: str = "url") -> dict[str, int]:
    """How many URLs have each of the rules' tokens. The tokens are those of a rule list, and so are the rows that come back."""
    if not tokens:
        return {}
    own = tokens_of(F.concat(host_of(plain(url)), path_of(plain(url))))
    met = pages.select(F.explode(_fetched(own, _filed([{"token": t} for t in tokens], ""))["token"]).alias("token"))
    counts = dict(tuple(r) for r in met.groupBy("token").count().collect())
    return {t: counts.get(t, 0) for t in tokens}


def judge(pages: DataFrame, rules: list[Rule] | None = None, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each row.

    The rule of the highest rank that fits decides; of equal ranks the later name does. rule is its name, null for
    none and for rules without a name. A null URL, or one without ://, has empty host and path, so that no rule fits
    it and the verdict is `otherwise`. Very long URLs are judged whole. Repeated rows are each judged; input columns named like an added one give way.
    A token finds its rules by its hash, so that the work for a URL doesn't grow with the number of rules.
    """
    rules = RULES if rules is None else rules
    if len(rules) > MOST_IN_PLAN:
        fields = "array<struct<name:string,verdict:string,pattern:string,tokens:array<string>,rank:int>>"
        return judge_by_table(pages, pages.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([asdict(r) for r in rules])), fields))), url, otherwise)
    kept = [c for c in pages.columns if c.lower() not in _ADDED or c == url]
    frame = pages.select(*map(plain, kept), host_of(plain(url)).alias("__host"), path_of(plain(url)).alias("__path"))
    key = F.concat("__host", "__path")
    count = token_counts(pages, sorted({t for r in rules for t in r.tokens}), url)
    rarest = lambda r: min(r.tokens, key=lambda t: (count[t], t)) if r.tokens else ""
    index = _filed([{"token": rarest(r), "rank": r.rank, "name": r.name, "verdict": r.verdict, "pattern": r.pattern} for r in rules], ",rank:int,name:string,verdict:string,pattern:string")
    fetched = F.filter(_fetched(F.array_append(tokens_of(key), F.lit("")), index), lambda r: F.regexp_like(key, r["pattern"]))
    best = F.array_max(F.transform(fetched, lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    frame = frame.withColumn("__best", best)
    rule = F.when(F.col("__best.name") != "", F.col("__best.name")).cast(StringType())
    return frame.select(*[plain(c) for c in kept if c.lower() not in _ADDED], F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(otherwise)).alias("verdict"))


_ADDED = {"host", "path", "rule", "verdict"}


def judge_by_table(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow", most_broadcast: int = 100_000) -> DataFrame:
    """judge() for any number of rules, as rows (name, verdict, pattern, tokens, rank).

    Each distinct host and path is judged once: its tokens meet the rules filed under them, and only those run. Rules
    are broadcast up to a counted `most_broadcast` and shuffled by token beyond; the results are the same. Rules without
    tokens are tried on every URL. The same cases have the same results as in judge().
    """
    kept = [c for c in pages.columns if c.lower() not in _ADDED or c == url]
    frame = pages.select(*map(plain, kept), host_of(plain(url)).alias("__host"), path_of(plain(url)).alias("__path"))
    keys = frame.select("__host", "__path").distinct()
    asked = keys.select("__host", "__path", F.explode(F.array_append(tokens_of(F.concat("__host", "__path")), F.lit(""))).alias("token"))
    asked = asked.distinct()
    filed = rules.select("*", F.explode_outer("tokens").alias("token"))
    seen = asked.join(filed.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = filed.join(seen, "token", "left").groupBy("name", "verdict", "pattern", "rank").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)), F.coalesce("token", F.lit("")).alias("token"))).alias("least"))
    index = rarest.select("name", "verdict", "pattern", "rank", F.col("least.token").alias("token"))
    if rules.limit(most_broadcast + 1).count() <= most_broadcast:
        index = F.broadcast(index)
    fits = asked.join(index, "token").filter(F.regexp_like(F.concat("__host", "__path"), F.col("pattern")))
    best = fits.groupBy("__host", "__path").agg(F.max(F.struct("rank", "name", "verdict")).alias("best"))
    rule = F.when(F.col("best.name") != "", F.col("best.name"))
    out = [F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")]
    return frame.join(best, ["__host", "__path"], "left").select(*[plain(c) for c in kept if c.lower() not in _ADDED], *out)


def oracle() -> str:
    """DuckDB's form of judge(pages) with RULES."""
    host = "translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "')"
    path = "regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
    stated = " ".join(f"WHEN (host || path) LIKE '{r.name}%' OR (host || path) LIKE '%.{r.name}%' AND regexp_matches(host || path, '^([^/]*\\.)?{r.name}') THEN '{r.name}'" for r in sorted(STATED, key=lambda r: -r.rank))
    verdicts = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in STATED)
    spam = " OR ".join(f"regexp_matches(host || path, '^([^/]*[.-])?{w}([.-][^/]*)?(/|$)')" for w in SPAM_HOSTS)
    return f"""WITH parts AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
ruled AS (SELECT page_id, host, path, CASE {stated} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN {spam} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
