"""URL filters: rules by host and path, and trust spread over the links between hosts.

A page that no rule fits is judged by its host. Trust starts at hosts most of
whose pages the rules allow and follows links; distrust starts at hosts most of
whose pages they block and follows links backwards, to the hosts that lead
there. Both are personalised PageRank over host edges: ``damping`` of the mass
of a host goes on to its neighbours, and mass at a host without any leaves the
walk. Seeds start with mass 1, so no score depends on the number of hosts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgrid.series import spread_join
from stepgrid.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""[hH][rR][eE][fF][\x20\t\r\n\f]*=[\x20\t\r\n\f]*["']?[\x20\t\r\n\f]*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'\x20\t\r\n\f<>]+)"""
SALTS = 64
DAMPING, ROUNDS = 0.85, 20
FLOOR = 0.1  # of a seed's own mass: less distrust than this blocks no host

#: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def small_letters(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return small_letters(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``verdict`` (null where no rule fits) to rows with ``host`` and ``path``.

    The rules of a host are found once per host, by joining the ends of its
    name with the rules' hosts; then pages meet the rules of their host. The
    longest rule (host and path together) wins; of equally long ones that with
    the longer host, then blocking.
    """
    rules = rules.where("host != ''").select(small_letters(F.col("host")).alias("end"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    labels = rules.agg(F.max(F.size(F.split("end", r"\.", -1)))).first()[0] or 0
    own = F.struct(
        (-F.length(F.concat("end", "path"))).alias("shorter"), (-F.length("end")).alias("host"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("soft"), "path", "verdict", F.concat("end", "path").alias("rule")
    )
    by_end = rules.groupBy("end").agg(F.array_sort(F.collect_set(own)).alias("own"))

    hosts = pages.select("host").where("host != ''").distinct()
    parts = hosts.select("host", F.split("host", r"\.", -1).alias("parts"))
    first = F.greatest(F.size("parts") - labels, F.lit(0)) + 1
    ends = parts.where(F.lit(labels) > 0).select("host", F.explode(F.transform(F.sequence(first, F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))).alias("end"))
    fitting = spread_join(ends, by_end, ["end"]).groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("own"))
    rows = spread_join(pages, fitting, ["host"], how="left")
    rows = rows.withColumn("own", F.when(F.size("own") > 0, F.try_element_at(F.filter("own", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))))
    return rows.withColumns({"rule": F.col("own.rule"), "verdict": F.col("own.verdict")}).drop("own")


def host_links(pages: DataFrame) -> DataFrame:
    """``source, target, pages``: links between different hosts, each page counted once.

    Reads absolute links of ``html``; a relative one stays on its host.
    """
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), small_letters))
    links = pages.select(F.col("host").alias("source"), F.explode(targets).alias("target"))
    return links.where("source != '' AND target != '' AND source != target").groupBy("source", "target").agg(F.count("*").alias("pages"))


def seeds_of(judged: DataFrame) -> DataFrame:
    """``host, trusted``: hosts of whose pages more than half are allowed, or blocked, by a rule."""
    hosts = judged.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")
    )
    return hosts.where("2 * allowed > n OR 2 * blocked > n").select("host", (F.col("allowed") > F.col("blocked")).alias("trusted"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` of all hosts that a walk from a seed reaches.

    Each round carries the mass of the last one over one link and is written,
    so nothing is computed twice and lineage stays short. Both directions share
    a join and an aggregate. The joins split a host with very many links, as
    both their sides are exchanged by host and salt.
    """
    out = links.groupBy("source").agg(F.sum("pages").alias("all"))
    back = links.groupBy("target").agg(F.sum("pages").alias("all"))
    ahead = spread_join(links, out, ["source"]).select(F.col("source").alias("host"), F.col("target").alias("to"), F.lit(True).alias("trusted"), (F.col("pages") / F.col("all")).alias("share"))
    behind = spread_join(links, back, ["target"]).select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(False).alias("trusted"), (F.col("pages") / F.col("all")).alias("share"))
    edges = settle(ahead.union(behind), "edges")
    mass = settle(seeds.select("host", "trusted", F.lit(1.0).alias("mass")), "mass")
    steps = [mass]
    for _ in range(rounds):
        if mass.isEmpty() or edges.isEmpty():
            break
        moved = spread_join(edges, mass, ["host", "trusted"])
        mass = settle(moved.groupBy(F.col("to").alias("host"), "trusted").agg((F.lit(damping) * F.sum(F.col("mass") * F.col("share"))).alias("mass")), "mass")
        steps.append(mass)
    whole = reduce(DataFrame.union, steps)
    part = lambda trusted: F.round(F.sum(F.when(F.col("trusted") == trusted, F.col("mass")).otherwise(0.0)), 9)
    return whole.groupBy("host").agg(part(True).alias("trust"), part(False).alias("distrust"))


def judge_pages(pages: DataFrame, rules: DataFrame, seeds: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """A verdict for each row: ``page_id, host, path, rule, verdict, trust, distrust``.

    The longest rule (``verdict, host, path``) that fits a url decides; rules
    fit their host, its subdomains, and paths that begin with theirs. Without a
    rule a page is blocked if distrust of its host is at least ``FLOOR`` and
    above its trust, else allowed. ``seeds`` (``host, trusted``) replace those
    taken from the rules.

    A null url, or one without ``://``, has empty host and path, fits no rule
    and is allowed with scores 0. Null html has no links. Repeated rows and
    null ids are kept, each with its verdict; an empty table gives no rows. Of
    the pages only page_id, url and html are read.
    """
    url = F.col("url").cast("string")
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = settle(ruled(known, rules), "judged")
    links = settle(host_links(pages.select(host_of(url).alias("host"), F.col("html").cast("string").alias("html"))), "links")
    start = seeds_of(judged) if seeds is None else seeds.where("host != ''").groupBy("host").agg(F.bool_and("trusted").alias("trusted"))
    scores = spread(links, start, damping, rounds)
    rows = spread_join(judged, scores, ["host"], how="left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    blocked = (F.col("distrust") >= FLOOR) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("verdict", F.when(blocked, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


URLS_SQL = r"""
    WITH RECURSIVE rest AS (
      SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    known AS (
      SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    rules(rule_verdict, rule_host, rule_path) AS (
      VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    numbered AS (SELECT row_number() OVER () AS row, * FROM known),
    judged AS (
      SELECT n.*, rule_host || rule_path AS rule, rule_verdict AS verdict
      FROM numbered n LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) = 1),
    targets AS (
      SELECT row, host AS source, unnest(list_distinct(regexp_extract_all(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        'href[\x20\t\r\n\f]*=[\x20\t\r\n\f]*["'']?[\x20\t\r\n\f]*(?:https?:)?//([^/?#"''\x20\t\r\n\f<>]+)', 1))) AS target FROM numbered),
    links AS (SELECT source, target, count(*) AS pages FROM targets WHERE source != '' AND target != '' AND source != target GROUP BY ALL),
    edges AS (
      SELECT source AS host, target AS goal, true AS trusted, pages / sum(pages) OVER (PARTITION BY source) AS share FROM links
      UNION ALL SELECT target, source, false, pages / sum(pages) OVER (PARTITION BY target) FROM links),
    seeds AS (
      SELECT host, count(*) FILTER (verdict = 'allow') > count(*) FILTER (verdict = 'block') AS trusted FROM judged WHERE host != '' GROUP BY 1
      HAVING 2 * count(*) FILTER (verdict = 'allow') > count(*) OR 2 * count(*) FILTER (verdict = 'block') > count(*)),
    walk AS (
      SELECT 0 AS round, host, trusted, CAST(1 AS DOUBLE) AS mass FROM seeds
      UNION ALL
      SELECT w.round + 1, e.goal, e.trusted, 0.85 * sum(w.mass * e.share) FROM walk w JOIN edges e ON e.host = w.host AND e.trusted = w.trusted
      WHERE w.round < 20 GROUP BY w.round, e.goal, e.trusted),
    scores AS (
      SELECT host, round(sum(CASE WHEN trusted THEN mass ELSE 0 END), 9) AS trust, round(sum(CASE WHEN trusted THEN 0 ELSE mass END), 9) AS distrust
      FROM walk GROUP BY 1)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) >= 0.1 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
      coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
    FROM judged LEFT JOIN scores USING (host)"""
