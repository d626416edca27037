"""URL filter by link-graph propagation.

Explicit rules decide the pages they fit. Every other page gets the verdict of
its host, from two scores over the host graph:

* trust: personalised PageRank along the links, started from trusted hosts
  (those with at least half of their pages allowed by a rule);
* distrust: personalised PageRank along the reversed links (who links to a
  blocked site is suspect), started from blocked hosts (half blocked).

Nodes of the graph are the hosts of pages, the hosts that pages link to, the
rules' hosts, and the parent domains of all these that have a dot (of numeric
addresses none). A host without pages is a seed if a rule covers it whole, so
linking to a blocked site that was never fetched is held against a host. Edges
are the absolute links of the pages plus an edge each way between a host and its
parent domain. Scores are shares of the whole rank, in units of the mean host's
share (so mass that ends at a host without edges doesn't count against the
others). A host is blocked if its distrust reaches ``threshold`` and exceeds its
trust; all others are allowed.

Ranks are whole numbers (a total mass of 10^15 units, integer division), so
sums don't depend on the order of rows and reruns agree. Edges are summed per
(from, to) before any join; a hub's edge list is split by the skew join, a
popular target is combined on the map side. The lineage is cut by a written
table every few rounds. Only DataFrame functions.

Edge cases: NULL urls and urls without ``://`` have an empty host and path,
take no part in the graph and are allowed unless a rule fits; NULL html has no
links; rows that repeat a page_id are judged each for itself; an empty table
gives an empty result; extra columns are ignored. Without seeds the scores are
zero and the method allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import ascii_lower, skewed_join, staged, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MASS = 10 ** 15
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^/"'?#\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, or NULLs."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def parent_of(host: Column) -> Column:
    """The domain one label up if it has a dot, else NULL; numeric addresses have none."""
    up = F.regexp_extract(host, r"(?s)^[^.]*\.(.+\..+)$", 1)
    return F.when((up != "") & ~host.rlike(r"^[0-9.]+(:[0-9]*)?$"), up)


def parents(host: Column) -> Column:
    """Every proper parent domain with a dot; numeric addresses have none."""
    parts = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
                        lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts) - i + 1, F.lit(0))), "."))
    return F.when(host.rlike(r"^[0-9.]+(:[0-9]*)?$"), F.array().cast("array<string>")) \
        .otherwise(F.filter(tails, lambda x: x.rlike(r"(?s)^.+\..+$")))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts."""
    return pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to")) \
        .select("src", ascii_lower(F.regexp_replace("to", "^(?i)(https?:)?//", "")).alias("dst")) \
        .where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def graph_hosts(ruled: DataFrame, links: DataFrame, rules=RULES) -> DataFrame:
    """(host, trusted, blocked): every node of the graph with its 0/1 seeds."""
    spark = ruled.sparkSession
    paged = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("_v") == "allow").alias("good"),
                                                          F.count_if(F.col("_v") == "block").alias("bad"))
    named = spark.createDataFrame([(r[1],) for r in rules], "host string")  # one row per rule
    bare = links.select(F.col("dst").alias("host")).unionByName(named).distinct()
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("pages", "good", "bad")]
    known = paged.unionByName(bare.select("host", *zero))
    up = known.select(F.explode(parents(F.col("host"))).alias("host")).distinct().select("host", *zero)
    every = known.unionByName(up).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "good", "bad")])
    whole = rule_for(F.col("host"), F.lit("/"), rules)[1]  # a host without pages: the rule that covers all its paths
    seed = lambda n, v: F.when(F.col("pages") > 0, F.col(n) * 2 >= F.col("pages")).otherwise(F.coalesce(whole == v, F.lit(False))).cast("int")
    return every.select("host", seed("good", "allow").alias("trusted"), seed("bad", "block").alias("blocked"))


def host_edges(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, n): the links, and both directions between a host and its parent domain."""
    up = hosts.select(F.col("host").alias("src"), parent_of(F.col("host")).alias("dst")).where("dst is not null")
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("bigint"))
    return links.select("src", "dst", "n").unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def personalised_pagerank(hosts: DataFrame, edges: DataFrame, seed: str, rounds: int = 10, damping: int = 85,
                          cut_every: int = 5) -> DataFrame:
    """(host, rank): integer shares of MASS. ``hosts`` has the host and a 0/1
    seed column; each round a host passes ``damping`` percent of its rank on,
    by the weight of its links, and seeds get the rest in equal parts."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    edges = staged(skewed_join(edges, out, "src"), "trust-edges")
    seeds = hosts.agg(F.sum(seed).alias("n")).first()["n"] or 0  # one number
    base = hosts.select("host", (F.col(seed) * F.lit(MASS // max(seeds, 1))).cast("bigint").alias("start"))
    rank = base.select("host", F.col("start").alias("rank"))
    kept = F.expr(f"start * {100 - damping} div 100")
    for i in range(rounds):
        passed = skewed_join(edges, rank.where("rank > 0").withColumnRenamed("host", "src"), "src") \
            .select(F.col("dst").alias("host"), F.expr(f"cast(rank * {damping} div 100 as decimal(38,0)) * n div total").alias("got")) \
            .groupBy("host").agg(F.sum("got").cast("bigint").alias("got"))
        rank = base.join(passed, "host", "left") \
            .select("host", (kept + F.coalesce("got", F.lit(0))).cast("bigint").alias("rank"))
        if i % cut_every == cut_every - 1:
            rank = staged(rank, "trust-rank")
    return rank


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 1.0, rounds: int = 10) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust
    (the host's scores in units of the mean share)."""
    rule, rule_verdict = rule_for(F.col("host"), F.col("path"), rules)
    read = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = read.select("page_id", "host", "path", rule.alias("rule"), rule_verdict.alias("_v"))
    links = staged(host_links(read.select("host", "html")), "trust-pagelinks")
    hosts = staged(graph_hosts(ruled, links, rules), "trust-hosts")
    edges = staged(host_edges(hosts, links), "trust-links")
    trust = personalised_pagerank(hosts, edges, "trusted", rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_pagerank(hosts, back, "blocked", rounds)
    scores = trust.select("host", F.col("rank").alias("t")).join(distrust.select("host", F.col("rank").alias("d")), "host")
    scores = staged(scores.select("host", "t", "d"), "trust-scores")
    whole = scores.agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum("d").alias("d")).first()  # three numbers
    count, all_t, all_d = whole["n"], int(whole["t"] or 0), int(whole["d"] or 0)
    judged = ruled.join(scores, "host", "left")
    t, d = F.coalesce("t", F.lit(0)), F.coalesce("d", F.lit(0))
    limit = int(threshold * all_d) // max(count, 1)
    wide = lambda c, by: c.cast("decimal(19,0)") * F.lit(by).cast("decimal(18,0)")
    method = F.when((d >= limit) & (wide(d, all_t) > wide(t, all_d)) | ((d >= limit) & (d > 0) & (t == 0)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_v", method).alias("verdict"),
                         (t.cast("double") * count / max(all_t, 1)).alias("trust"), (d.cast("double") * count / max(all_d, 1)).alias("distrust"))


def op1_host_trust(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle(rounds: int = 10) -> str:
    """DuckDB SQL: the rounds unrolled, in whole numbers."""
    step = """
{n}{i} AS MATERIALIZED (
  SELECT b.host, (b.start * 15 // 100 + coalesce(g.got, 0))::BIGINT AS rank FROM {n}s b LEFT JOIN (
    SELECT {to} AS host, sum((r.rank * 85 // 100)::HUGEINT * e.n // x.total)::BIGINT AS got
    FROM edges e JOIN {n}{j} r ON r.host = e.{frm} JOIN (SELECT {frm} AS h, sum(n) AS total FROM edges GROUP BY 1) x ON x.h = e.{frm}
    WHERE r.rank > 0 GROUP BY 1) g ON g.host = b.host)"""
    rank = lambda n, col, frm, to: ",".join([f"""
{n}s AS MATERIALIZED (SELECT host, (1000000000000000 // greatest((SELECT sum({col}) FROM hosts), 1))::BIGINT * {col} AS start FROM hosts),
{n}0 AS (SELECT host, start AS rank FROM {n}s)"""] + [step.format(n=n, i=i + 1, j=i, frm=frm, to=to) for i in range(rounds)])  # noqa: E731
    return r"""
WITH p AS MATERIALIZED (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(v, h, pre) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
r AS MATERIALIZED (
  SELECT page_id, host, path, (SELECT arg_max(h || pre, len(h || pre)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) AS rule,
         (SELECT arg_max(v, len(h || pre)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) AS v
  FROM p),
links AS MATERIALIZED (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(regexp_replace(unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?\s*((?:https?:)?//[^/"''?#\s>]+)', 1)), '^(?i)(https?:)?//', ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
names(host) AS (
  SELECT host FROM r WHERE host <> '' UNION SELECT dst FROM links UNION SELECT h FROM rules),
tails AS (
  SELECT host, unnest(range(1, len(string_split(host, '.')))) AS k, string_split(host, '.') AS parts FROM names WHERE NOT regexp_matches(host, '^[0-9.]+(:[0-9]*)?$')),
nodes(host) AS MATERIALIZED (
  SELECT host FROM names UNION SELECT array_to_string(parts[k + 1:], '.') FROM tails WHERE regexp_matches(array_to_string(parts[k + 1:], '.'), '(?s)^.+\..+$')),
per AS (SELECT host, count(*) AS pages, count(*) FILTER (v = 'allow') AS good, count(*) FILTER (v = 'block') AS bad FROM r GROUP BY host),
hosts AS MATERIALIZED (
  SELECT n.host, CASE WHEN pages > 0 THEN 2 * good >= pages ELSE coalesce(w = 'allow', false) END::INT AS trusted,
         CASE WHEN pages > 0 THEN 2 * bad >= pages ELSE coalesce(w = 'block', false) END::INT AS blocked
  FROM (SELECT host, (SELECT arg_max(v, len(h || pre)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND pre = '/') AS w FROM nodes) n
  LEFT JOIN per USING (host)),
up AS (
  SELECT host AS src, regexp_extract(host, '(?s)^[^.]*\.(.+\..+)$', 1) AS dst FROM hosts
  WHERE NOT regexp_matches(host, '^[0-9.]+(:[0-9]*)?$') AND regexp_extract(host, '(?s)^[^.]*\.(.+\..+)$', 1) <> ''),
edges AS MATERIALIZED (
  SELECT src, dst, sum(n)::BIGINT AS n FROM (
    SELECT * FROM links UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY ALL),
""" + rank("t", "trusted", "src", "dst") + "," + rank("d", "blocked", "dst", "src") + f"""
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.v, CASE WHEN d.rank >= q.d // greatest(q.n, 1) AND (d.rank::HUGEINT * q.t > t.rank::HUGEINT * q.d OR (d.rank > 0 AND t.rank = 0))
                          THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN t{rounds} t ON t.host = r.host LEFT JOIN d{rounds} d ON d.host = r.host
CROSS JOIN (SELECT (SELECT count(*) FROM hosts)::BIGINT AS n, (SELECT coalesce(sum(rank), 0) FROM t{rounds})::HUGEINT AS t, (SELECT coalesce(sum(rank), 0) FROM d{rounds})::HUGEINT AS d) q
"""


ORACLE = _oracle()
