"""URL filters: rules by host and path, and trust and distrust spread over the links between hosts.

A rule fits its host and all subdomains where the url's path starts with the rule's; the longest rule wins.  Urls that
no rule fits are judged by their host: trust is a personalised PageRank that restarts at the hosts with allowed pages,
distrust one over the reversed links that restarts at the hosts with blocked pages (who links to bad hosts is
suspect).  A host restarts with the share of its pages that rules allow or block, whatever its links, and scores are in units of
a whole restart: a host whose pages are all blocked has a distrust of 1 or more, and who only links to it has ``DAMPING`` times
that at most.  Rounds go on until no score changes by more than ``TOLERANCE``, so every host that a seed reaches has one.

A host's other urls are blocked if its own blocked share exceeds its allowed share by ``MARGIN``, or if its distrust reaches
``MARGIN`` and exceeds its trust.

Rules are matched per host, not per page: hosts are split into their suffixes, which meet the rules by equality.
Links are summed per pair of hosts before anything else; the rounds move one row per host and one per pair and direction, and the
driver sees one number every ``HOPS`` rounds.  Pages meet what is known of their host under salted keys if the host is crowded, so
that no task gets all pages of one (``by_host``).

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed unless a rule says
otherwise; null html has no links; links to the own host do not count; repeated rows are judged each; extra columns
stay out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import aside, table

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING = 0.85
#: Rounds end when no score changes by more; scores are then within TOLERANCE * DAMPING / (1 - DAMPING) or so of the limit.
TOLERANCE = 1e-5
#: Rounds between two checkpoints.
HOPS = 4
MARGIN = 0.5
#: A host with more than one in so many rows is crowded; there are fewer than that.
CROWDED = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("suffix"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.explode(listed).alias("r")).select("r.*")


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        "page_id", _lower(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))


def crowded_hosts(hosts: DataFrame) -> DataFrame:
    """Of ``hosts(host, n)`` those with more than one in CROWDED rows: fewer than CROWDED hosts at any size."""
    rows = hosts.agg(F.sum("n").alias("rows")).first()["rows"] or 0
    return hosts.where(F.col("n") * CROWDED > rows).select("host")


def by_host(rows: DataFrame, facts: DataFrame, crowded: DataFrame) -> DataFrame:
    """``rows(page_id, host, path, ...)`` with ``fact``, the columns of ``facts`` of their host, if any.

    Facts of crowded hosts are broadcast.  The rows of these hosts pass the shuffle under keys that no host can have (with a
    slash), dealt by the row's hash, so that a host with a third of all rows is spread over all tasks.
    """
    fact = F.struct(*[c for c in facts.columns if c != "host"])
    few = crowded.join(facts, "host", "left").select("host", fact.alias("few"))
    marked = rows.join(F.broadcast(few), "host", "left")
    dealt = F.concat(F.lit("/"), F.pmod(F.xxhash64("page_id", "path"), F.lit(4 * CROWDED)).cast("string"))
    marked = marked.withColumn("key", F.when(F.col("few").isNull(), F.col("host")).otherwise(dealt))
    joined = marked.join(facts.select(F.col("host").alias("key"), fact.alias("fact")), "key", "left")
    return joined.withColumn("fact", F.coalesce("few", "fact")).drop("key", "few")


def by_rules(urls: DataFrame, rules: DataFrame, hosts: DataFrame, crowded: DataFrame) -> DataFrame:
    """``page_id, host, path`` with ``rule`` and ``verdict`` (null where no rule fits)."""
    labels = F.split("host", "\\.", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = hosts.where("host <> ''").select("host", F.explode(suffix).alias("suffix")).join(rules, "suffix")
    rule = F.struct(
        F.length(F.concat("suffix", "path")).alias("size"), F.concat("suffix", "path").alias("rule"), F.col("path").alias("path"), "verdict")
    fitting = fitting.groupBy("host").agg(F.collect_set(rule).alias("rules"))
    longest = F.array_max(F.filter("fact.rules", lambda r: F.col("path").startswith(r["path"])))
    judged = by_host(urls, fitting, crowded).withColumn("best", longest)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: pages of one host that link to another."""
    found = F.when(F.contains("html", F.lit("//")), F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), _lower)))
    out = pages.select(_lower(F.regexp_extract(F.coalesce("url", F.lit("")), URL, 1)).alias("src"), F.explode(found).alias("dst"))
    return out.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, good, bad, trust, distrust`` at the limit of the rounds; ``seeds(host, good, bad)`` has every host.

    Every host also moves to itself: that row carries its restart and, for the change of a round, its last scores.
    A round multiplies what is still to come by ``DAMPING`` at most, so the rounds end.
    """
    total_out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    total_in = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    weighed = edges.join(total_out, "src").join(total_in, "dst")
    none = F.lit(0.0)
    ahead = weighed.select(
        F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("out")).alias("forward"), none.alias("back"),
        none.alias("good"), none.alias("bad"), none.alias("same"))
    behind = weighed.select(F.col("dst").alias("a"), F.col("src").alias("b"), none, F.col("n") / F.col("into"), none, none, none)
    itself = seeds.select(F.col("host").alias("a"), F.col("host").alias("b"), none, none, "good", "bad", F.lit(1.0))
    moves = aside(ahead.union(behind).union(itself))
    score = seeds.select(F.col("host").alias("a"), F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    while True:
        for _ in range(HOPS):
            moved = score.select("a", "trust", "distrust").join(moves, "a").groupBy("b").agg(
                F.sum("good").alias("good"), F.sum("bad").alias("bad"),
                (F.sum("good") + DAMPING * F.sum(F.col("forward") * F.col("trust"))).alias("trust"),
                (F.sum("bad") + DAMPING * F.sum(F.col("back") * F.col("distrust"))).alias("distrust"),
                F.sum(F.col("same") * F.col("trust")).alias("trust0"), F.sum(F.col("same") * F.col("distrust")).alias("distrust0"))
            score = moved.withColumnRenamed("b", "a")
        score = aside(score)
        change = F.greatest(F.abs(F.col("trust") - F.col("trust0")), F.abs(F.col("distrust") - F.col("distrust0")))
        if (score.agg(F.max(change).alias("change")).first()["change"] or 0.0) <= tolerance:
            return score.select(F.col("a").alias("host"), "good", "bad", "trust", "distrust")


def judge(pages: DataFrame, rules: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page row."""
    urls = parts(pages)
    hosts = aside(urls.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    crowded = aside(crowded_hosts(hosts))
    judged = aside(by_rules(urls, rules, hosts, crowded))
    share = lambda v: F.avg((F.col("verdict").eqNullSafe(v)).cast("double"))
    own = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    edges = aside(links(pages))
    linked = edges.select(F.col("dst").alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad")).distinct()
    seeds = aside(own.union(linked).groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad")))
    out = by_host(judged, spread(seeds, edges), crowded)
    by_itself = F.col("fact.bad") - F.col("fact.good") >= margin
    by_links = (F.col("fact.distrust") >= margin) & (F.col("fact.distrust") > F.col("fact.trust"))
    method = F.when(by_itself | by_links, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "fact.trust", "fact.distrust")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


#: Rounds of the SQL, more than any table takes to come within TOLERANCE.
SQL_ROUNDS = 120
OP2_SQL = f"""
WITH RECURSIVE rules(verdict, suffix, rpath) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '{URL}', 2) AS path, html, row_number() OVER () AS rn FROM pages),
fit AS (SELECT u.rn, r.suffix || r.rpath AS rule, r.verdict,
               row_number() OVER (PARTITION BY u.rn ORDER BY length(r.suffix || r.rpath) DESC) AS k
        FROM u JOIN rules r ON (u.host = r.suffix OR ends_with(u.host, '.' || r.suffix)) AND starts_with(u.path, r.rpath)),
judged AS (SELECT u.rn, page_id, host, path, rule, verdict FROM u LEFT JOIN fit ON u.rn = fit.rn AND k = 1),
edges AS (SELECT src, dst, count(*) AS n FROM (
            SELECT DISTINCT rn, host AS src, unnest(list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1),
                   lambda x: translate(x, '{UPPER}', '{LOWER}'))) AS dst FROM u WHERE host <> '') WHERE src <> dst GROUP BY ALL),
w AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS fw, n / sum(n) OVER (PARTITION BY dst) AS bk FROM edges),
seeds AS (SELECT host, max(good) AS good, max(bad) AS bad FROM (
            SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS good,
                   avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM judged WHERE host <> '' GROUP BY host
            UNION ALL SELECT DISTINCT dst, 0.0, 0.0 FROM edges) GROUP BY host),
moves AS (SELECT src AS a, dst AS b, fw, 0.0::DOUBLE AS bk, 0.0::DOUBLE AS good, 0.0::DOUBLE AS bad FROM w
          UNION ALL SELECT dst, src, 0.0, bk, 0.0, 0.0 FROM w UNION ALL SELECT host, host, 0.0, 0.0, good, bad FROM seeds),
s(k, host, t, d) AS (SELECT 0, host, good::DOUBLE, bad::DOUBLE FROM seeds UNION ALL
  SELECT k + 1, b, sum(good) + {DAMPING}::DOUBLE * sum(fw * t), sum(bad) + {DAMPING}::DOUBLE * sum(bk * d)
  FROM s JOIN moves ON a = s.host WHERE k < {SQL_ROUNDS} GROUP BY k, b)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN bad - good >= {MARGIN} OR d >= {MARGIN} AND d > t THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN s ON s.host = j.host AND k = {SQL_ROUNDS} LEFT JOIN seeds ON seeds.host = j.host
"""
