"""URL filter rules, indexed by their rarest literal token.

A rule is a pattern: ``||`` anchors at a host or any parent domain, ``*`` stands for anything, a leading ``@@``
turns a blocking rule into an allowing one, everything else is literal. Each rule is filed under the one of its
whole literal tokens that the fewest URLs hold, as a row of a rule table. A URL's tokens are dealt out and join that table
on the token; only the rules that they fetch run their regular expression, and the best that fits is kept for each URL.
Every URL also deals out the empty token, under which rules without a whole token are filed, so it never gets lost. All of
it is DataFrame functions. There may be any number of rules: the rule table is broadcast up to BROADCAST_RULES and joined
like any other table beyond.

Defined results: a null URL, or one without ``://``, has an empty host and path, matches no host rule and is
allowed unless a pattern fits. Repeated rows and repeated page_id are judged row by row. Columns of the input with the
names of the added columns are replaced; all others pass through, whatever their names, and are shuffled once, so select
those that are needed. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.llm.shared import ascii_lower

#: The most rules (about 200 bytes each) that are broadcast.
BROADCAST_RULES = 200_000

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """One rule. Host rules (host and path prefix) rank by length and come before pattern rules."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(action: str, name: str) -> Rule:
    """A rule like ``example.net/en/``: the host and all its subdomains, and a path prefix."""
    # A token counts as whole only if the rule fixes the characters on both of its sides.
    closed = name if re.search("[^a-z0-9]$", name.lower()) else re.sub("[A-Za-z0-9]+$", "", name)
    return Rule(name, action, "^(?:[^/]*[.])?" + re.escape(name), tuple(re.findall(TOKEN, closed.lower())), len(name))


def pattern_rule(pattern: str) -> Rule:
    """A rule in pattern syntax, matched against the whole lower-cased URL."""
    action, body = ("allow", pattern[2:]) if pattern.startswith("@@") else ("block", pattern)
    start, body = ("^[^:]*://(?:[^/]*[.])?", body[2:]) if body.startswith("||") else ("", body)
    body = body.lower()
    regex = start + ".*".join(re.escape(part) for part in body.split("*"))
    tokens = [
        m[0]
        for m in re.finditer(TOKEN, body)
        if (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and start)
        and m.end() < len(body)
        and body[m.end()] != "*"
    ]
    return Rule(pattern, action, "(?s)" + regex, tuple(tokens), 0)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(url, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def token_frequencies(pages: DataFrame, wanted: list[str], url_col: str = "url") -> dict[str, int]:
    """In how many URLs each wanted token stands. Bounded by the rules, whatever the number of pages."""
    few = pages.sparkSession.createDataFrame([(t,) for t in wanted], "wanted string")
    held = pages.select(F.explode(url_tokens(F.col(url_col))).alias("token"))
    joined = held.join(F.broadcast(few) if len(wanted) <= BROADCAST_RULES else few, F.col("token") == F.col("wanted"))
    return {row["token"]: row["n"] for row in joined.groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(rules: list[Rule], frequency: dict[str, int]) -> dict[str, list[Rule]]:
    """File each rule under its rarest token (ties: the first in the alphabet); under "" if it has no whole token."""
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        key = min(rule.tokens, key=lambda t: (frequency.get(t, 0), t), default="")
        index.setdefault(key, []).append(rule)
    return index


def rule_table(spark: SparkSession, index: dict[str, list[Rule]]) -> DataFrame:
    """The index as rows by token; every URL's empty token also meets one row that is no rule and ranks below all."""
    rows = [("", -1, True, None, None, None)]
    rows += [(key, r.rank, r.action == "allow", r.name, r.action, r.regex) for key, rules in index.items() for r in rules]
    return spark.createDataFrame(rows, "key string, rank int, allows boolean, name string, action string, regex string")


def judge_urls(pages: DataFrame, host_rules: list[Rule], pattern_rules: list[Rule], url_col: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and method_rule to every page.

    The longest fitting host rule decides. Without one, an allowing pattern rule beats a blocking one, and a URL
    that no rule fits is allowed.
    """
    rules = [*host_rules, *pattern_rules]
    wanted = sorted({t for rule in rules for t in rule.tokens})
    index = rule_table(pages.sparkSession, build_index(rules, token_frequencies(pages, wanted, url_col) if wanted else {}))
    host, path = split_url(F.col(url_col))
    added = ("host", "path", "rule", "verdict", "method_rule")
    # The input travels as one column, with the empty token only; the others carry what the rules are matched against.
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in added])
    parts = pages.select(F.monotonically_increasing_id().alias("row"), own.alias("own"), ascii_lower(F.coalesce(F.col(url_col), F.lit(""))).alias("url"), host.alias("host"), path.alias("path"))
    dealt = parts.select("*", F.explode(F.array_union(F.array(F.lit("")), url_tokens(F.col("url")))).alias("token"))
    met = dealt.join(F.broadcast(index) if len(rules) <= BROADCAST_RULES else index, F.col("token") == F.col("key"))
    fits = F.when(F.col("rank") < 0, True).when(F.col("rank") > 0, F.rlike(F.concat("host", "path"), F.col("regex"))).otherwise(F.rlike("url", F.col("regex")))
    kept = met.filter(fits).select(
        "row",
        F.when(F.col("rank") < 0, F.struct("own", "host", "path")).alias("page"),
        F.struct("rank", "allows", "name", "action").alias("best"),
    )
    judged = kept.groupBy("row").agg(F.first("page", ignorenulls=True).alias("page"), F.max("best").alias("best"))
    based = F.col("best.rank") > 0
    return judged.select(
        "page.own.*",
        "page.host",
        "page.path",
        F.when(based, F.col("best.name")).alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
        F.when(~based, F.col("best.name")).alias("method_rule"),
    )


#: The rules that the query fixes, in the form (action, host and path).
BASE_RULES = [
    host_rule("block", "net/"),
    host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"),
    host_rule("allow", "org/fr/"),
]

#: Pattern rules for the URLs that no base rule fits: pages that carry no prose of their own.
PATTERNS = """
?utm_source= &utm_source= ?utm_medium= &utm_medium= ?utm_campaign= &utm_campaign= ?gclid= &gclid= ?fbclid= &fbclid=
?phpsessid= &phpsessid= ;jsessionid= ?sessionid= &sessionid= ?sid= &sid= ?replytocom= &replytocom= ?share= &share=
?print= &print= /print/ /printable/ ?format=print &format=print ?add-to-cart= &add-to-cart= ?orderby= &orderby=
?sort= &sort= ?filter= &filter= ?lightbox= ?attachment_id= ?redirect= &redirect= ?return_to= ?returnurl= &returnurl=
/ads/ /adserver/ /advert/ /adverts/ /advertising/ /banner/ /banners/ /sponsored/ /affiliate/ /affiliates/ /promo/
/doubleclick/ /tracking/ /tracker/ /pixel/ /beacon/ /popup/ /popunder/ /clickthrough/ /redirect/ /redir/ /out.php?
/casino/ /casinos/ /gambling/ /betting/ /poker/ /slots/ /roulette/ /lottery/ /bingo/ /sportsbook/
/porn/ /xxx/ /adult/ /escort/ /escorts/ /webcam-girls/ /hookup/ /nude/ /hentai/ /viagra/ /cialis/ /payday-loans/
/login/ /login? /signin/ /sign-in/ /logout/ /register/ /signup/ /sign-up/ /password/ /forgot-password/ /account/
/my-account/ /cart/ /basket/ /checkout/ /wishlist/ /compare/ /order-tracking/ /unsubscribe/ /captcha/
/wp-admin/ /wp-login.php /wp-json/ /wp-content/uploads/ /wp-includes/ /xmlrpc.php /cgi-bin/ /phpmyadmin/ /.git/ /.env
/feed/ /rss/ /atom/ /rss.xml /feed.xml /sitemap.xml /robots.txt /search/ /search? ?s= &s= ?q= &q= /tag/ /tags/
/calendar/ /events/month/ /events/list/ /author/page/ /archive/page/ /comment-page- /404/ /error/ /test/ /staging/
||spam-farm. ||link-farm. ||ads. ||adserver. ||track. ||tracking. ||click. ||clicks. ||banner. ||analytics. ||pixel.
||login. ||auth. ||sso. ||accounts. ||cart. ||checkout. ||casino. ||poker. ||porn. ||xxx. ||cdn. ||static. ||localhost/
/download*.exe /download*.zip /get*.apk
@@||example.org/en/ @@/robots.txt-explained/ @@||docs. @@||wiki. @@||news.
"""
PATTERN_RULES = [pattern_rule(p) for p in PATTERNS.split()]


def op10_url_filters(spark, sf_dir):
    """Judge every page's URL by the base rules and, where none fits, by the pattern rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, BASE_RULES, PATTERN_RULES).select("page_id", "host", "path", "rule", "verdict")


def pattern_sql(pattern: str) -> str:
    """A pattern as a row (allows, anchored, pattern) of SQL's LIKE, the wildcard apart from escapes."""
    allows, body = (True, pattern[2:]) if pattern.startswith("@@") else (False, pattern)
    anchored, body = (True, body[2:]) if body.startswith("||") else (False, body)
    like = re.sub(r"([%_\\])", r"\\\1", body.lower()).replace("*", "%").replace("'", "''")
    return f"({str(allows).lower()}, {str(anchored).lower()}, '{like}')"


ORACLE = rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, u,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(action, name, rhost, rpath) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
patterns(allows, anchored, body) AS (VALUES {", ".join(map(pattern_sql, PATTERNS.split()))}),
urls AS (SELECT DISTINCT u, regexp_extract(u, '^[^:]*://(.*)$', 1, 's') AS rest, regexp_extract(u, '^[^:]*://([^/]*)', 1) AS site FROM split),
starts AS (SELECT u, substr(rest, i) AS tail FROM (SELECT u, rest, site, unnest(range(1, length(site) + 2)) AS i FROM urls WHERE rest <> '')
           WHERE i = 1 OR substr(site, i - 1, 1) = '.'),
fitting AS (
  SELECT u, bool_or(allows) AS allows FROM (
    SELECT u, allows FROM urls JOIN patterns ON NOT anchored AND u LIKE '%' || body || '%' ESCAPE '\'
    UNION ALL SELECT u, allows FROM starts JOIN patterns ON anchored AND tail LIKE body || '%' ESCAPE '\') GROUP BY u),
judged AS (
  SELECT s.*, f.allows,
         (SELECT arg_max(r.name, length(r.name)) FROM rules r
          WHERE (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)) AS rule
  FROM split s LEFT JOIN fitting f USING (u))
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
                 WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN allows IS NULL OR allows THEN 'allow' ELSE 'block' END END AS verdict
FROM judged
"""
