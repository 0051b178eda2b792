"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` together with the literal tokens that any
matching URL must hold. Token frequencies are counted over all URLs, a rule is filed under its rarest
token, and a URL runs only the rules that its own tokens fetch.

Defined results: a null URL, or one without ``://``, has empty host and path and meets no rule; its
verdict is the method's default. Repeated rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Rules shipped to a worker at once; a longer list is applied shard by shard.
RULES_PER_SHARD = 100_000
TOKEN = r"[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is returned; the highest ``rank``, then the block verdict, wins among fitting rules."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""
    closed = path if re.search(r"[^A-Za-z0-9]$", path) else re.sub(TOKEN + "$", "", path)  # a last token may go on
    tokens = re.findall(TOKEN, host) + re.findall(TOKEN, closed)
    return Rule(host + path, verdict, rf"(?:[^/]*\.)?{re.escape(host + path)}", tuple(tokens), len(host + path))


def label_rule(word: str) -> Rule:
    """Blocks hosts with ``word`` as a whole part between dots and hyphens."""
    return Rule(word, "block", rf"(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", (word,), 0)


def pair_rule(word: str, other: str) -> Rule:
    """Blocks hosts with ``word`` as a whole part whose path holds ``other`` as a whole token."""
    part = rf"(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?/"
    return Rule(f"{word}+{other}", "block", rf"{part}(?:.*[^A-Za-z0-9])?{re.escape(other)}(?![A-Za-z0-9])", (word, other), 0)


BASE_RULES = (
    prefix_rule("allow", "com", "/"),
    prefix_rule("block", "example.com", "/en/"),
    prefix_rule("allow", "www.example.com", "/en/"),
    prefix_rule("block", "net", "/es/"),
    prefix_rule("block", "net", "/fr/"),
)
#: The method's own rules, used where no base rule fits.
BLOCK_WORDS = ("adult", "ads", "bets", "betting", "casino", "escort", "pills", "porn", "spam", "warez", "xxx")
BLOCK_PAIRS = (("blog", "sponsored"), ("forum", "login"), ("loans", "payday"), ("news", "advert"), ("shop", "cart"), ("slots", "bonus"), ("torrent", "download"))
METHOD_RULES = (*map(label_rule, BLOCK_WORDS), *(pair_rule(*p) for p in BLOCK_PAIRS))
DEFAULT_VERDICT = "allow"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, tail = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + tail


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """Frequency over all URLs of the rules' tokens; as many rows as the rules have tokens, at most."""
    vocabulary = sorted({t for r in rules for t in r.tokens})
    spark = urls.sparkSession
    known = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    address = F.regexp_extract("url", r"://([^?#]*)", 1)
    host = F.lower(F.substring_index(address, "/", 1))
    tokens = F.regexp_extract_all(F.concat(host, F.lit(" "), address), F.lit(TOKEN), 0)
    each = urls.select(F.explode(F.array_distinct(tokens)).alias("token"))
    found = each.join(F.broadcast(known), "token", "left_semi").groupBy("token").count()  # the caller's rules, whatever the table
    return {r["token"]: r["count"] for r in found.collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rarest token -> numbers of its rules; rules without a token stand under the empty token."""
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        key = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        index.setdefault(key, []).append(i)
    return index


def _better(a: tuple[int, str, str] | None, b: tuple[int, str, str] | None) -> tuple[int, str, str] | None:
    best = max((x for x in (a, b) if x), key=lambda x: (x[0], x[1] == "block", x[2]), default=None)
    return best


def judge_urls(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", shard: int = RULES_PER_SHARD) -> DataFrame:
    """(key, host, path, rank, verdict, rule) of the best fitting rule of each row, nulls where none fits.

    Rules beyond ``shard`` are applied in further passes over the rows, each keeping the best so far.
    """
    rules = list(rules)
    counts = token_counts(pages.select("url"), rules)
    out = pages.select(key, "url").withColumns({"rank": F.lit(None).cast("long"), "verdict": F.lit(None).cast("string"), "rule": F.lit(None).cast("string")})
    kind = dict(out.dtypes)[key]
    for start in range(0, max(1, len(rules)), shard):
        part = rules[start : start + shard]
        index = build_index(part, counts)

        def judge(batches: Iterator[pd.DataFrame], part=part, index=index) -> Iterator[pd.DataFrame]:
            compiled: dict[int, re.Pattern[str]] = {}
            for pdf in batches:
                rows = []
                for url, rank, verdict, rule in zip(pdf["url"], pdf["rank"], pdf["verdict"], pdf["rule"]):
                    host, path = split_url(url)
                    at = host + path
                    best = None if rule is None else (int(rank), verdict, rule)
                    if at:
                        fetched = {i for t in {"", *re.findall(TOKEN, at)} for i in index.get(t, ())}
                        for i in fetched:
                            pattern = compiled.get(i) or compiled.setdefault(i, re.compile(part[i].regex, re.DOTALL))
                            if pattern.match(at):
                                best = _better(best, (part[i].rank, part[i].verdict, part[i].name))
                    rows.append((host, path, *(best or (None, None, None))))
                made = pd.DataFrame(rows, columns=["host", "path", "rank", "verdict", "rule"], index=pdf.index).astype({"rank": "Int64"})
                yield pd.concat([pdf[[key, "url"]], made], axis=1)

        out = out.mapInPandas(judge, f"`{key}` {kind}, url string, host string, path string, rank long, verdict string, rule string")
    return out.drop("url")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules first; where none fits, the method's own rules, and allow where those don't fit either.

    Base ranks are rule lengths (4 at least), the method's are 0, so one pass settles both.
    """
    got = judge_urls(table(spark, sf_dir, "pages"), (*BASE_RULES, *METHOD_RULES))
    return got.select(
        "page_id", "host", "path",
        F.when(F.col("rank") > 0, F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )


OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*', 0, 's') ELSE '' END AS a
  FROM pages
), p AS (
  SELECT page_id, a, translate(CASE WHEN strpos(a, '/') > 0 THEN substr(a, 1, strpos(a, '/') - 1) ELSE coalesce(a, '') END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(a, '/') > 0 THEN substr(a, strpos(a, '/')) ELSE '' END AS path
  FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(host, '(^|[.-])({"|".join(BLOCK_WORDS)})([.-]|$)') THEN 'block'
       WHEN {" OR ".join(f"(regexp_matches(host, '(^|[.-]){a}([.-]|$)') AND regexp_matches(path, '[^A-Za-z0-9]{b}([^A-Za-z0-9]|$)'))" for a, b in BLOCK_PAIRS)} THEN 'block' ELSE '{DEFAULT_VERDICT}' END AS verdict
FROM r
"""
