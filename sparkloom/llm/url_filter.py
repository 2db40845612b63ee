"""URL filters by an index over literal tokens.

A rule is a regular expression over a canonical url (host, lower-cased, then path) with the literal tokens that
every match must contain.  Over all urls it is counted how frequent those tokens are, and each rule is filed
under its rarest one.  The tokens of a url fetch its candidate rules from that index, and only candidates run
their regular expression.  Host rules decide first, the longest that fits; where none fits, a url is blocked
if any pattern rule matches, and allowed otherwise.

Everything is DataFrame expressions, and urls are judged row by row, without a shuffle (the only one is that of the
token counts, which has one row per rule token and task).  A list of up to ``inline_rules`` rules travels inside the
plan.  A longer one becomes an index in one row, buckets of tokens with their rules, which is broadcast if its
measured size is at most ``index_bytes``.  A list beyond that is joined by token to the distinct urls, both sides
spread over ``SALTS`` salts, since a token may be in all urls; hot urls are joined back by a broadcast.

Edge cases: a null url, or one without ``://``, has an empty host and path, which no host rule fits; path rules
need a path that begins like theirs, so ``org/`` fits ``http://a.org/`` and not ``http://a.org``; very long urls are
matched whole; repeated rows are judged alike; an empty table gives an empty result; input columns that share a
name with a result column are replaced by it, unless it is the url column, which is refused with a ValueError.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, no_clash, stored, table

INLINE_RULES = 2_000
INDEX_BYTES = 64 << 20
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` names the rule; ``host_rule`` rules decide before pattern rules, longer ones first."""

    text: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    host_rule: bool = False


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/-_" or ord(c) > 127 else "\\" + c for c in text)


def _tokens(text: str) -> list[str]:
    out, now = [], ""
    for c in text + " ":
        if c in _UPPER + _LOWER + "0123456789":
            now += c.lower()
        elif now:
            out.append(now)
            now = ""
    return out


def host_rule(verdict: str, text: str) -> Rule:
    """A rule written ``host/path``: fits the host and its subdomains where the path begins like its own."""
    host, slash, path = text.partition("/")
    pieces = _tokens(host)
    # the rest of a path may go on inside its last token, so only tokens that end inside the rule are literal
    inner = _tokens(path) if not path or not path[-1].isalnum() else _tokens(path)[:-1]
    if not slash or not pieces:
        raise ValueError(f"a rule needs a host and a path: {text!r}")
    return Rule(text, f"(?s)^(?:[^/]*\\.)?{_literal(host)}/{_literal(path)}", tuple(dict.fromkeys(pieces + inner)), verdict, True)


#: The rules of the query, and general patterns for the urls that they leave open.
HOST_RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
PATTERN_RULES = tuple(
    Rule(f"pattern:{' '.join(tokens)}", pattern, tokens, "block")
    for pattern, tokens in (
        (r"^([^/]*\.)?spam-farm\.", ("spam", "farm")),
        (r"^([^/]*[.-])?link-farm[.-]", ("link", "farm")),
        (r"^[^/]*(^|[.-])(porn)[.-]", ("porn",)),
        (r"^[^/]*(^|[.-])(xxx)[.-]", ("xxx",)),
        (r"^[^/]*(^|[.-])casino[.-]", ("casino",)),
        (r"^[^/]*(^|[.-])viagra[.-]", ("viagra",)),
        (r"^[^/]*(^|[.-])warez[.-]", ("warez",)),
        (r"/wp-login\.php", ("wp", "login", "php")),
        (r"/cart/checkout/", ("cart", "checkout")),
        (r"/(affiliate)/", ("affiliate",)),
    )
)


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(canonical: Column) -> Column:
    return F.array_distinct(F.split(F.translate(canonical, _UPPER, _LOWER), "[^a-z0-9]+"))


def file_rules(urls: DataFrame, rules: tuple[Rule, ...], inline: bool = True) -> dict[str, list[Rule]]:
    """Each rule under its token that is rarest over the column ``tokens`` of all rows."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if inline:
        met = urls.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("token"))
    else:  # as a table, so that the plan stays small; it is as long as the list that the driver holds
        names = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
        met = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(names), "token")
    seen = {r["token"]: r["count"] for r in met.groupBy("token").count().collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t)), []).append(r)
    return index


def _rank(rule: Rule) -> int:
    """Host rules before patterns, longer before shorter."""
    return (1 << 20) * rule.host_rule + len(rule.text)


_CANDIDATE = "struct<rank: int, rule: string, verdict: string, host_rule: boolean, pattern: string>"


def _inline(canonical: Column, index: dict[str, list[Rule]]) -> Column:
    """The best matching rule, found in the row itself."""
    keys = list(index)
    lists = F.array(
        *(
            F.array(*(F.struct(F.lit(_rank(r)), F.lit(r.text), F.lit(r.verdict), F.lit(r.host_rule), F.lit(r.pattern)) for r in index[k])).cast(f"array<{_CANDIDATE}>")
            for k in keys
        )
    )
    words = F.array(*map(F.lit, keys))
    met = F.array_intersect(F.col("tokens"), words)
    candidates = F.flatten(F.transform(met, lambda t: F.element_at(lists, F.array_position(words, t).cast("int"))))
    return F.array_max(F.filter(candidates, lambda c: F.regexp_like(canonical, c["pattern"])))


_BUCKETED = f"array<array<struct<token: string, rules: array<{_CANDIDATE}>>>>"


def _in_buckets(canonical: Column, n: int) -> Column:
    """The best matching rule, found in the column ``index``, whose buckets are chosen by a token's crc32."""
    bucket = lambda t: F.get("index", (F.crc32(t.cast("binary")) % n).cast("int"))
    own = lambda t: F.flatten(F.transform(F.filter(bucket(t), lambda e: e["token"] == t), lambda e: e["rules"]))
    candidates = F.flatten(F.transform("tokens", own))
    return F.array_max(F.filter(candidates, lambda c: F.regexp_like(canonical, c["pattern"])))


def _by_index(marked: DataFrame, index: dict[str, list[Rule]], canonical: Column) -> DataFrame:
    n = max(1, len(index))
    buckets: list[list] = [[] for _ in range(n)]
    for token, rules in index.items():
        buckets[zlib.crc32(token.encode()) % n].append((token, [(_rank(r), r.text, r.verdict, r.host_rule, r.pattern) for r in rules]))
    one = marked.sparkSession.createDataFrame([(buckets,)], f"index {_BUCKETED}")
    return marked.crossJoin(F.broadcast(one)).withColumn("best", _in_buckets(canonical, n)).drop("index")  # one row


def _by_join(rows: DataFrame, index: dict[str, list[Rule]], canonical: Column) -> DataFrame:
    spark = rows.sparkSession
    urls = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    filed = spark.createDataFrame(
        [(k, _rank(r), r.text, r.verdict, r.host_rule, r.pattern) for k, rs in index.items() for r in rs],
        "token string, rank int, rule string, verdict string, host_rule boolean, pattern string",
    )
    spread = stored(filed, "url-rules").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    best = (
        urls.select("host", "path", salt.alias("salt"), F.explode(tokens_of(canonical)).alias("token"))
        .join(spread, ["token", "salt"])
        .where(F.regexp_like(canonical, F.col("pattern")))
        .groupBy("host", "path")
        .agg(F.max(F.struct("rank", "rule", "verdict", "host_rule", "pattern")).alias("best"))
    )
    keyed = stored(urls.join(best, ["host", "path"]).select(F.struct("host", "path").alias("url"), "best", "n"), "url-verdicts")
    return join_hot(rows.withColumn("url", F.struct("host", "path")), keyed, "url", "n").drop("url", "n")


def judge(
    pages: DataFrame,
    url_col: str = "url",
    rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES,
    inline_rules: int = INLINE_RULES,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """``pages`` with the columns host, path, rule (null unless a host rule fits), verdict and pattern."""
    results = ("host", "path", "rule", "verdict", "pattern")
    no_clash(url_col, results)
    names = [c for c in pages.columns if c not in results]
    inner = [f"c{i}" for i in range(len(names))]
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)), host_of(url).alias("host"), path_of(url).alias("path"))
    canonical = F.concat("host", "path")
    marked = rows.withColumn("tokens", tokens_of(canonical))
    if not rules:
        best = rows.withColumn("best", F.lit(None).cast(_CANDIDATE))
    elif len(rules) <= inline_rules:
        best = marked.withColumn("best", _inline(canonical, file_rules(marked, rules)))
    elif sum(len(r.text) + len(r.pattern) + sum(map(len, r.tokens)) + 64 for r in rules) <= index_bytes:
        best = _by_index(marked, file_rules(marked, rules, False), canonical)
    else:
        best = _by_join(rows, file_rules(marked, rules, False), canonical)
    of_host = F.col("best.host_rule")
    return best.select(
        *(F.col(i).alias(c) for c, i in zip(names, inner, strict=True)),
        "host",
        "path",
        F.when(of_host, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(~of_host, F.col("best.rule")).alias("pattern"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(rule, verdict) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')
), split AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM r
), p(name, pattern) AS (
  VALUES ('pattern:spam farm', '^([^/]*\.)?spam-farm\.'), ('pattern:link farm', '^([^/]*[.-])?link-farm[.-]'),
         ('pattern:porn', '^[^/]*(^|[.-])(porn)[.-]'), ('pattern:xxx', '^[^/]*(^|[.-])(xxx)[.-]'),
         ('pattern:casino', '^[^/]*(^|[.-])casino[.-]'), ('pattern:viagra', '^[^/]*(^|[.-])viagra[.-]'),
         ('pattern:warez', '^[^/]*(^|[.-])warez[.-]'), ('pattern:wp login php', '/wp-login\.php'),
         ('pattern:cart checkout', '/cart/checkout/'), ('pattern:affiliate', '/(affiliate)/')
), judged AS (
  SELECT page_id, host, path,
         (SELECT max({'n': length(rule), 'rule': rule, 'verdict': verdict}) FROM split
          WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best,
         (SELECT max({'n': length(name), 'name': name}) FROM p WHERE regexp_matches(host || path, pattern)) AS found
  FROM u
)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN found IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN best IS NULL THEN found.name END AS pattern
FROM judged
"""
