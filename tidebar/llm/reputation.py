"""URL filters by empirical-Bayes host reputation.

Labelled outcomes of pages (bad or not) are counted by host, registered domain and suffix. A host's bad rate has a beta
prior around its domain's, that one around its suffix's, and that one around the rate of all pages. How closely children
keep to their parents is estimated for each level from the data: with a parent's mean m, the correlation rho of outcomes
below one child solves sum (k - n m)^2 = sum n m (1 - m) (1 + (n - 1) rho), and the prior has 1 / rho - 1 pages of weight.
A host is blocked where the lower bound of its posterior rate exceeds a limit, so few bad pages don't block a host, and a
domain's record counts for hosts with few pages. Written rules, where one fits, win.

Counts are partly summed before they are shuffled. Wherever rows meet the table of their parent, keys with more than a
thousandth of the rows are broadcast (at most a thousand of them), so that no task gets all rows of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, joined_by

#: The rules of this query's contract, as (action, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words of a url that name what a page sells.
SPAM = ("adult", "ads", "bets", "betting", "casino", "escort", "pills", "poker", "porn", "spam", "viagra", "xxx")
#: Second-level names below which countries register domains.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, LIMIT = 1.645, 0.5  # standard deviations below the posterior mean; the rate that this bound must exceed
RHO = (1e-4, 0.5)  # bounds of the correlation, so a prior weighs 1 to 9999 pages
JUNK_SHARE = 0.3  # of the words of a junk page that hold three symbols in a row

ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SUFFIX = rf"(?:^|\.)((?:{'|'.join(SECOND)})\.[a-z][a-z]|[^.]+)\z"
DOMAIN = rf"(?:^|\.)([^.]+\.(?:(?:{'|'.join(SECOND)})\.[a-z][a-z]|[^.]+))\z"
NUMERIC = r"^(?:[0-9.]+\z|\[)"
SPAM_WORD = rf"(?:^|[^a-z])(?:{'|'.join(SPAM)})(?:[^a-z]|\z)"
HIDDEN, ENTITY, SYMBOLS, WHITE = r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", "&(?:[A-Za-z]+|#[0-9]+);", r"[!-/:-@\[-`{-~]{3}", r"[\x20\x09-\x0D]+"


def fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def address(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end. Empty without ://."""
    u = F.coalesce(url, F.lit(""))
    return fold(F.regexp_extract(u, ADDRESS, 1)), F.regexp_extract(u, ADDRESS, 2)


def registered(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without user, port and final dots; a number or a single name is its own."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")
    own = bare.rlike(NUMERIC)
    found = F.regexp_extract(bare, DOMAIN, 1)
    return F.when(own | (found == ""), bare).otherwise(found), F.when(own, bare).otherwise(F.regexp_extract(bare, SUFFIX, 1))


def outcome(url: Column, html: Column) -> Column:
    """1 for a bad page, 0 for another, null for one without words: its url names spam, or its text is junk."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), ENTITY, "&")
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    share = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: w.rlike(SYMBOLS))) / F.size(ws)))[0]
    return F.when(F.coalesce(fold(url).rlike(SPAM_WORD), F.lit(False)), 1).when(share > JUNK_SHARE, 1).when(share.isNotNull(), 0)


def concentration(children: DataFrame) -> float:
    """children (n, k, m: the parent's mean) -> the pages that the prior of this level weighs."""
    n, m = F.col("n"), F.col("m")
    v = m * (1 - m)
    found = children.where("n > 0").agg(F.sum((F.col("k") - n * m) ** 2 - n * v).alias("over"), F.sum(n * (n - 1) * v).alias("room")).first()
    rho = found["over"] / found["room"] if found["room"] else RHO[1]
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def posterior(children: DataFrame, weight: float) -> DataFrame:
    """children with `mean` and `bound`, those of the beta posterior of each bad rate."""
    a, b = F.col("k") + weight * F.col("m"), F.col("n") - F.col("k") + weight * (1 - F.col("m"))
    mean = a / (a + b)
    return children.withColumns({"mean": mean, "bound": mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))})


def host_reputation(counts: DataFrame) -> tuple[DataFrame, float, float]:
    """counts (host, domain, suffix, pages, n labelled pages, k bad ones) -> (with mean and bound; both for an unknown host)."""
    sums = lambda df, key, below, *more: df.groupBy(key, *more).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias(below))
    domains = cut(sums(counts, "domain", "hosts", "suffix"), "domains")
    suffixes = cut(sums(domains, "suffix", "domains"), "suffixes")
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.coalesce(F.sum("domains"), F.lit(0)).alias("domains"), F.coalesce(F.sum("n"), F.lit(0)).alias("labelled")).first()
    root = (whole["k"] + 1) / (whole["n"] + 2)
    level = suffixes.withColumn("m", F.lit(root))
    weight = top = concentration(level)
    suffixes = cut(posterior(level, weight).select("suffix", "domains", F.col("mean").alias("m")), "suffix-rates")
    level = cut(joined_by(domains, suffixes, "suffix", "domains", whole["domains"]).drop("domains"), "domain-level")
    domains = cut(posterior(level, concentration(level)).select("domain", "hosts", F.col("mean").alias("m")), "domain-rates")
    level = cut(joined_by(counts, domains, "domain", "hosts", counts.count()).drop("hosts"), "host-level")
    spread = Z * (root * (1 - root) / (top + 1)) ** 0.5
    return posterior(level, concentration(level)), root, root - spread


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bad: Column | None = None, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """All rows as (id, host, path, rule, verdict, mean, bound).

    rule: host and path of the longest rule that fits, or null; a rule fits its host and hosts below it, where the path
    starts with the rule's. verdict: the rule's action; else block where `bound`, the lower bound of the host's bad rate,
    exceeds the limit, and allow elsewhere. bad: a column of pages that is 1 for a bad page, 0 for a good one and null for
    one without a label; by default from url and html.

    A null url, or one without ://, has an empty host and path: it gives no evidence and is judged as a page of an unknown
    host. Null and empty html have no label. Repeated rows count, and are judged, each. Further columns are ignored; an
    empty table gives no rows. A host's rules are held in its row.
    """
    spark = pages.sparkSession
    host, path = address(F.col(url_col))
    seen = pages.select(host.alias("host"), (outcome(F.col(url_col), F.col(html_col)) if bad is None else bad).alias("bad")).where("host <> ''")
    counts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = registered(F.col("host"))
    counts = cut(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "n", "k"), "hosts")
    rated, mean, bound = host_reputation(counts)

    written = spark.createDataFrame([(h, f"{h}{p}", p, a) for a, h, p in rules], "at string, rule string, start string, action string")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = counts.select("host", F.explode(above).alias("at")).join(written, "at").groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("length"), "rule", "start", "action")).alias("rules"))
    known = cut(rated.select("host", "pages", "mean", "bound").join(fitting, "host", "left"), "reputations")

    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    met = joined_by(rows, known, "host", "pages", pages.count())
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["start"])))
    met = met.withColumns({"best": best, "mean": F.coalesce("mean", F.lit(mean)), "bound": F.coalesce("bound", F.lit(bound))})
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return met.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "mean", "bound")


_LEVEL = "rho_{0} AS (SELECT 1 / least(greatest(coalesce(sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), {2}), {1}), {2}) - 1 AS s FROM {0} WHERE n > 0)"
_MEAN = "(k + s * m) / (n + s)"
_SQL_FOLD = f"translate({{}}, '{UPPER}', '{LOWER}')"
#: The same in SQL.
ORACLE = f"""
WITH parsed AS (SELECT page_id, url, html, {_SQL_FOLD.format(f"coalesce(regexp_extract(url, '{ADDRESS}', 1), '')")} AS host, coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages),
worded AS (SELECT *, list_filter(string_split_regex(regexp_replace(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '{ENTITY}', '&', 'g'), '{WHITE}'), lambda w: w <> '') AS ws FROM parsed),
shared AS (SELECT *, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: regexp_matches(w, '{SYMBOLS}'))) / len(ws) END AS share FROM worded),
judged AS (SELECT *, CASE WHEN coalesce(regexp_matches({_SQL_FOLD.format('url')}, '{SPAM_WORD}'), false) OR share > {JUNK_SHARE} THEN 1 WHEN share IS NOT NULL THEN 0 END AS bad FROM shared),
hosts AS (SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\\z', ''), '\\.+\\z', '') AS bare, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM judged WHERE host <> '' GROUP BY host),
placed AS (SELECT *, CASE WHEN regexp_matches(bare, '{NUMERIC}') OR regexp_extract(bare, '{DOMAIN}', 1) = '' THEN bare ELSE regexp_extract(bare, '{DOMAIN}', 1) END AS domain, CASE WHEN regexp_matches(bare, '{NUMERIC}') THEN bare ELSE regexp_extract(bare, '{SUFFIX}', 1) END AS suffix FROM hosts),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM placed GROUP BY ALL), suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL),
root AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
l1 AS (SELECT * FROM suffixes, root), {_LEVEL.format('l1', *RHO)}, m1 AS (SELECT suffix, {_MEAN} AS m FROM l1, rho_l1),
l2 AS (SELECT * FROM domains JOIN m1 USING (suffix)), {_LEVEL.format('l2', *RHO)}, m2 AS (SELECT domain, {_MEAN} AS m FROM l2, rho_l2),
l3 AS (SELECT * FROM placed JOIN m2 USING (domain)), {_LEVEL.format('l3', *RHO)},
rated AS (SELECT host, {_MEAN} AS mean, n + s AS w FROM l3, rho_l3),
rules(action, h, p) AS (VALUES {', '.join(str(r) for r in RULES)}),
fits AS (SELECT j.page_id, j.url, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action FROM (SELECT DISTINCT page_id, url, host, path FROM judged) j JOIN rules ON (j.host = h OR ends_with(j.host, '.' || h)) AND starts_with(j.path, p) GROUP BY ALL)
SELECT j.page_id, j.host, j.path, f.rule, coalesce(f.action, CASE WHEN coalesce(r.mean, root.m) - {Z} * sqrt(coalesce(r.mean, root.m) * (1 - coalesce(r.mean, root.m)) / (coalesce(r.w, rho_l1.s) + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN fits f ON j.page_id IS NOT DISTINCT FROM f.page_id AND j.url IS NOT DISTINCT FROM f.url LEFT JOIN rated r ON r.host = j.host, root, rho_l1"""
