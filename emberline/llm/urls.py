"""URL filters by link-graph propagation, natively.

Rules name hosts (with all subdomains) and path prefixes; the longest that fits decides. For the rest, hosts
are judged by the link graph: personalised PageRank spreads trust from hosts with allowed pages along links, and
distrust from hosts with blocked pages against them. Edges are the links of the pages to other hosts, counted per host
pair; links are resolved against the page and its base. A host without links onwards hands its rank back to the seeds:
as everything that leaves the graph goes back to them alike, that is a scaling, so the ranks of a kind are made to sum
to 1. A host is blocked where distrust exceeds ``ratio`` times trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import only
from emberline.session import forget, scratch, stored

#: (verdict, rule): fixed by the contract of the query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: What is pointed at by the first href of a tag; a tag ends at < as well, so that unclosed ones cost no more than their length.
_HREF = r"""(?i)<%s\s+(?:[^<>]*?\s)?href\s*=\s*["']?\s*([^"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; without one: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def target_host(href: Column, base: Column) -> Column:
    """The host that a link leads to: its own, after a scheme and :// or after //; of a relative link ``base``; of mailto: and the like empty."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:"
    bare = F.translate(F.regexp_extract(href, r"^//([^/?#]*)", 1), UPPER, LOWER)
    return F.when(href.rlike(scheme + "//"), host_of(href)).when(href.startswith("//"), bare).when(href.rlike(scheme), F.lit("")).otherwise(base)


def linked_hosts(html: Column, host: Column) -> Column:
    """The other hosts that a page's links lead to, one for each link. A null html has none."""
    base = F.regexp_extract(html, _HREF % "base", 1)
    links = F.coalesce(F.regexp_extract_all(html, F.lit(_HREF % "a"), F.lit(1)), F.array().cast("array<string>"))

    def of(page: Column) -> Column:
        to = F.transform(page["links"], lambda x: target_host(x, page["base"]))
        return F.filter(to, lambda h: (h != F.lit("")) & (h != page["host"]))

    # an array of one, so that host and base are found once a page and not once a link
    page = F.struct(host.alias("host"), target_host(base, host).alias("base"), links.alias("links"))
    return F.flatten(F.transform(F.array(page), of))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = None
    for kind, name in sorted(rules, key=lambda r: -len(r[1])):
        domain, prefix = name.split("/", 1)
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule = F.when(fits, F.lit(name)) if rule is None else rule.when(fits, F.lit(name))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, steps: int = 4) -> DataFrame:
    """Personalised PageRank: (kind, host, rank) of seeds (kind, host, seed) along edges (kind, a, b, share).

    The mass that has not been placed yet moves on, ``steps`` edges a job, until of every kind less than ``tolerance`` is
    left. A step leaves at most ``damping`` of it, so the number of jobs is bounded by the tolerance alone.
    """
    key = ["kind", "host"]
    state = seeds.select(*key, (F.col("seed") * (1 - damping)).alias("rank"), (F.col("seed") * (1 - damping)).alias("moving"))
    spark = seeds.sparkSession
    with scratch(spark) as own:
        state, held = own.result(state, "ranks"), own.kept
    while state.agg(F.sum("moving")).first()[0] not in (None, 0.0):
        moving, parts = state.filter("moving > 0").select(*key, "moving"), [state.select(*key, "rank", F.lit(0.0).alias("moving"))]
        for k in range(steps):
            out = edges.join(moving.withColumnRenamed("host", "a"), ["kind", "a"])
            moving = out.groupBy("kind", F.col("b").alias("host")).agg(F.sum(F.col("moving") * F.col("share") * damping).alias("moving"))
            parts.append(moving.select(*key, F.col("moving").alias("rank"), (F.col("moving") if k == steps - 1 else F.lit(0.0)).alias("moving")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        with scratch(spark) as own:
            state = own.result(every.groupBy(*key).agg(F.sum("rank").alias("rank"), F.sum("moving").alias("moving")), "ranks")
        # the ranks before these are not read any more
        forget(spark, held[0])
        held = own.kept
        # what moves will place itself and all that follows from it, moving / (1 - damping) at most
        left = state.groupBy("kind").agg(F.sum("moving").alias("m")).agg(F.max("m")).first()[0] or 0.0
        if left * damping / (1 - damping) < tolerance:
            break
    return state.select(*key, "rank")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = 0.85, ratio: float = 1.0, tolerance: float = 1e-4) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path; the empty host has no edges and is allowed. Links within a
    host are no edges. A null html has no links. Repeated rows are kept and count again as links. Without evidence, or with as
    much trust as distrust, a host is allowed. Other columns play no part, whatever their names.
    """
    with scratch(pages.sparkSession) as own:
        url = F.col("url")
        rows = only(pages, "page_id", "url", "html").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        rows = stored(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), linked_hosts(F.col("html"), F.col("host")).alias("to")), "pages")
        hosts = rows.filter("host != ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
        hosts = stored(hosts, "hosts")
        linked = rows.filter("host != ''").select(F.col("host").alias("a"), F.explode("to").alias("b"))
        edges = stored(linked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "edges")

        out = edges.groupBy("a").agg(F.sum("n").alias("out"))
        into = edges.groupBy(F.col("b").alias("_b")).agg(F.sum("n").alias("into"))
        good = edges.join(out, "a").select(F.lit("good").alias("kind"), "a", "b", (F.col("n") / F.col("out")).alias("share"))
        bad = edges.join(into, edges["b"] == into["_b"]).select(F.lit("bad").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") / F.col("into")).alias("share"))
        shares = stored(good.unionByName(bad), "shares")
        some = hosts.select("host", F.explode(F.create_map(F.lit("good"), "good", F.lit("bad"), "bad")).alias("kind", "w")).filter("w > 0")
        total = some.groupBy("kind").agg(F.sum("w").alias("total"))  # two rows
        seeds = stored(some.join(F.broadcast(total), "kind").select("kind", "host", (F.col("w") / F.col("total")).alias("seed")), "seeds")
        ranks = stored(spread(shares, seeds, damping, tolerance), "scaled")
        mass = ranks.groupBy("kind").agg(F.sum("rank").alias("mass"))  # two rows
        ranks = ranks.join(F.broadcast(mass), "kind").select("kind", "host", (F.col("rank") / F.col("mass")).alias("rank"))
        trust = ranks.filter("kind = 'good'").select("host", F.col("rank").alias("trust"))
        distrust = ranks.filter("kind = 'bad'").select("host", F.col("rank").alias("distrust"))
        told = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left")
        zero = F.lit(0.0)
        told = told.select("host", (F.coalesce("distrust", zero) > F.coalesce("trust", zero) * ratio).alias("bad_host"))
        # written first, so the planner can split the pages of a host that has very many
        found = rows.join(stored(told, "told"), "host", "left")
        method = F.when(F.coalesce("bad_host", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
        return own.result(found.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict")), "judged")
