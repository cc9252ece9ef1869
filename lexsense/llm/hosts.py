"""URL filters with link-graph propagation (operator 13).

A rule (``host/path``) fits a url whose host is the rule's or a subdomain of it and whose path starts
with the rule's; the longest fitting rule decides (of equally long ones the one with the longer host, then
block). Where no rule fits, the host graph decides: personalised PageRank spreads trust along links from hosts
with allowed pages, and distrust against the links from hosts with blocked pages, and a host is blocked
when distrust has at least ``block_share`` percent of both. Hosts that neither reaches are allowed.

Edges are the links of the pages' html to other hosts (``href`` and ``src`` with a host, each once a
page) and, with weight 1, a host and its domain of two labels link each other. Scores are whole numbers of
``UNIT`` a host and round down, so that a run repeats to the last digit.

Defined results: null urls and urls without ``://`` have an empty host and path, no links and no scores; null
html has no links; repeated rows count each and come out each; extra columns are ignored; empty tables
give no rows. Work on hosts follows the number of hosts and links; the pages are joined with the host
table on the host, which adaptive execution splits for a hot host.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsense.llm.scratch import saved

UNIT = 1_000_000_000
DAMPING = 85  # percent of a score that goes on along links
ROUNDS = 16
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""[\x20\x09-\x0D"'](?:[hH][rR][eE][fF]|[sS][rR][cC])[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#"'<>\x00-\x20]+)"""
#: Rules of the query, as its contract states them.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, SMALL)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    host = lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def domain(host: Column) -> Column:
    """Last two labels of a host."""
    return F.substring_index(host, ".", -2)


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules whose host is this one or a parent of it, by an equal join on the parents."""
    own = F.regexp_extract("rule", r"^([^/]*)", 1)
    rules = rules.select(lower(own).alias("parent"), F.struct(
        F.length("rule").alias("size"), F.length(own).alias("own"), (F.col("verdict") == "block").alias("block"), "rule",
        F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("start"), "verdict").alias("r"))
    deepest = rules.agg(F.max(F.size(F.split("parent", r"\.")))).first()[0] or 1  # labels of the longest rule host
    up = F.expr(f"transform(sequence(1, least(size(split(host, '[.]')), {deepest})), k -> substring_index(host, '.', -k))")
    return (hosts.select("host", F.explode(F.array_distinct(up)).alias("parent")).join(rules, "parent")
            .groupBy("host").agg(F.collect_list("r").alias("rules")))


def fitting(rules: Column, path: Column) -> Column:
    """The deciding rule of a host's ``rules`` for a path (null: none)."""
    return F.array_max(F.filter(F.coalesce(rules, F.array().cast(
        "array<struct<size:int,own:int,block:boolean,rule:string,start:string,verdict:string>>")),
        lambda r: path.startswith(r["start"])))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b, w): links from the host of a page's url to another host; w: pages that have it."""
    host, _ = url_parts(F.col("url"))
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower))
    links = pages.where(F.col("html").isNotNull()).select(host.alias("a"), F.explode(found).alias("b"))
    return links.where("a <> '' and a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds over links (a, b, w) from seeds (host, trust, distrust).

    In a round every host keeps ``100 - damping`` percent of its seed and gets, from each neighbour, the
    damped share of the neighbour's score that the link's weight has in all its links: trust along the links,
    distrust against them. One join of the scores with the links a round serves both.
    """
    def flow(kind, source, target):
        total = links.groupBy(source).agg(F.sum("w").alias("total"))
        return links.join(total, source).select(
            F.lit(kind).alias("kind"), F.col(source).alias("host"), F.col(target).alias("to"), "w", "total")

    edges = saved(flow("trust", "a", "b").unionByName(flow("distrust", "b", "a")))
    start = seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, score)")).where("score > 0")
    start = saved(start)
    kept = start.select("host", "kind", F.expr(f"(score * {100 - damping}) div 100").alias("score"))
    scores = start
    for k in range(rounds):
        sent = edges.join(scores, ["host", "kind"]).select(F.col("to").alias("host"), "kind", F.expr(
            f"(cast(score as decimal(19,0)) * w * {damping}) div (cast(total as decimal(19,0)) * 100)").alias("score"))
        scores = kept.unionByName(sent).groupBy("host", "kind").agg(F.sum("score").alias("score")).where("score > 0")
        if k % 4 == 3:
            scores = saved(scores)  # the plan would grow with every round
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).alias(kind)
    return scores.groupBy("host").agg(score("trust"), score("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, block_share: int = 50, rounds: int = ROUNDS,
               damping: int = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages (page_id, url, html).

    ``rules``: (verdict, rule) pairs, or a table of them (verdict, rule)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, rule string")
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    links = saved(page_links(pages))
    named = reduce(DataFrame.union, [urls.select("host"), links.select("b")]).where("host <> ''").distinct()
    hosts = saved(named.join(host_rules(named, rules), "host", "left"))
    ruled = urls.join(hosts, "host", "left").select(
        "page_id", "host", "path", fitting(F.col("rules"), F.col("path")).alias("r"))
    ruled = ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    count = lambda verdict: F.count(F.when(F.col("ruled") == verdict, 1)).alias(verdict)
    seen = ruled.groupBy("host").agg(F.count("*").alias("n"), count("allow"), count("block"))
    front = fitting(F.col("rules"), F.lit("/"))["verdict"]  # a host that is only linked to counts as its front page
    share = lambda verdict: F.expr(f"coalesce(({UNIT} * `{verdict}`) div n, case front when '{verdict}' then {UNIT} else 0 end)")
    seeds = hosts.select("host", front.alias("front")).join(seen, "host", "left").select(
        "host", share("allow").alias("trust"), share("block").alias("distrust"))
    top = hosts.select("host", domain(F.col("host")).alias("up")).where("up <> host")
    edges = reduce(DataFrame.union, [links, top.select("host", "up", F.lit(1).cast("long")),
                                     top.select("up", "host", F.lit(1).cast("long"))])
    edges = edges.groupBy("a", "b").agg(F.sum("w").alias("w"))
    scores = propagate(edges, seeds, rounds, damping)
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    by_graph = F.when((distrust > 0) & (distrust * 100 >= (trust + distrust) * block_share), "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_graph).alias("verdict"),
        trust.cast("long").alias("trust"), distrust.cast("long").alias("distrust"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _round_sql(k: int) -> str:
    return f"""r{k} AS MATERIALIZED (SELECT host, kind, sum(score)::BIGINT AS score FROM (
    SELECT host, kind, (score * {100 - DAMPING}) // 100 AS score FROM r0
    UNION ALL SELECT e.target, e.kind, ((r.score::HUGEINT * e.w * {DAMPING}) // (e.total::HUGEINT * 100))::BIGINT
    FROM flow e JOIN r{k - 1} r ON r.host = e.host AND r.kind = e.kind) GROUP BY ALL HAVING sum(score) > 0)"""


OP13_SQL = rf"""
WITH rules(verdict, rule) AS (VALUES {', '.join(f"('{v}', '{r}')" for v, r in RULES)}),
ru AS (SELECT verdict, rule, regexp_extract(rule, '^([^/]*)', 1) AS rh, regexp_extract(rule, '^[^/]*(.*)$', 1) AS rp FROM rules),
p AS (SELECT row_number() OVER () AS k, page_id, html,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{SMALL}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM p JOIN ru
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k),
j AS (SELECT p.k, page_id, host, path, rule, ruled FROM p LEFT JOIN f ON f.k = p.k),
links AS (SELECT a, b, count(*) AS w FROM (SELECT DISTINCT k, host AS a, translate(unnest(regexp_extract_all(html,
    '{LINK.replace("'", "''")}', 1)), '{UPPER}', '{SMALL}') AS b FROM p) WHERE a <> '' AND a <> b GROUP BY ALL),
hosts AS (SELECT host FROM p WHERE host <> '' UNION SELECT b FROM links),
front AS (SELECT host, arg_max(verdict, length(rule)) AS front FROM hosts JOIN ru
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with('/', rp) GROUP BY host),
seen AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allow, count(*) FILTER (ruled = 'block') AS block
    FROM j GROUP BY host),
r0 AS MATERIALIZED (SELECT host, kind, score FROM (SELECT h.host, 'trust' AS kind,
      CASE WHEN n IS NULL THEN CASE front WHEN 'allow' THEN {UNIT} ELSE 0 END ELSE ({UNIT} * allow) // n END AS score
    FROM hosts h LEFT JOIN seen USING (host) LEFT JOIN front USING (host)
    UNION ALL SELECT h.host, 'distrust',
      CASE WHEN n IS NULL THEN CASE front WHEN 'block' THEN {UNIT} ELSE 0 END ELSE ({UNIT} * block) // n END
    FROM hosts h LEFT JOIN seen USING (host) LEFT JOIN front USING (host)) WHERE score > 0),
up AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS up FROM hosts),
edges AS (SELECT a, b, sum(w)::BIGINT AS w FROM (FROM links UNION ALL SELECT host, up, 1 FROM up WHERE up <> host
    UNION ALL SELECT up, host, 1 FROM up WHERE up <> host) GROUP BY ALL),
flow AS MATERIALIZED (SELECT 'trust' AS kind, a AS host, b AS target, w, sum(w) OVER (PARTITION BY a) AS total FROM edges
    UNION ALL SELECT 'distrust', b, a, w, sum(w) OVER (PARTITION BY b) FROM edges),
{', '.join(_round_sql(k) for k in range(1, ROUNDS + 1))},
s AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0)::BIGINT AS trust,
    coalesce(sum(score) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > 0
    AND distrust * 100 >= (trust + distrust) * 50 THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM j LEFT JOIN s USING (host)
"""
