"""URL verdicts by propagation over host edges: rules first, then personalised PageRank from trusted and blocked seeds.

Hosts are nodes. Edges come from the absolute links of the pages' html, and from every host to the hosts it belongs to
(`m.a.org` to `a.org`), so that hosts without links are tied to their own domain. Trust flows along the edges from hosts
that an allow rule fits, distrust flows against them from hosts that a block rule fits. Where no rule fits a url, its
host's distrust and trust decide. Rounds go on until the scores have settled and every host that a walk reaches has one.
Everything is DataFrame work; each round's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.llm import common

#: Fixed values: (host and subdomains, path prefix, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Share of a host's trust that flows on in a round.
DAMPING = 0.85
#: Scores have settled where a round changes them by less than this in all (they sum to 1 at most), and none of them by more than RELATIVE of itself.
TOLERANCE = 1e-9
RELATIVE = 1e-6
#: A host is blocked where distrust exceeds this share of trust + distrust.
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; without :// or null: empty."""
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; without :// or null: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The fitting rule as a struct (rule, verdict), longest host + path first, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, links: distinct host edges with the number of links; no host links to itself."""
    own = host_of(pages[url_col])
    found = F.regexp_extract_all(F.coalesce(pages[html_col], F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    links = pages.select(own.alias("src"), F.explode(found).alias("link")).select("src", host_of(whole).alias("dst"))
    hosts = pages.select(own.alias("src")).distinct()
    parts = F.split("src", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    parents = hosts.filter(F.size(parts) > 2).select("src", F.explode(above).alias("dst"))
    return links.unionByName(parents).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = 8, damping: float = DAMPING, tolerance: float = TOLERANCE, relative: float = RELATIVE) -> DataFrame:
    """host, score: personalised PageRank over edges (src, dst, links) from seeds (host, seed), seed summing to 1.

    So many rounds, or where rounds is None until no host is new and the scores have settled. What a host without outgoing
    edges holds is not handed on. Hosts that no walk from a seed reaches are left out.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    shares = common.staged(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")), "host-shares")
    scores, k = seeds.select("host", F.col("seed").alias("score")), 0
    while rounds is None or k < rounds:
        k += 1
        flow = scores.join(shares, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        new = flow.unionByName(seeds.select("host", (F.col("seed") * (1 - damping)).alias("score")))
        if rounds is None:
            both = new.withColumn("old", F.lit(0.0)).unionByName(scores.select("host", F.lit(0.0).alias("score"), F.col("score").alias("old")))
            scores = common.staged(both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")), "host-scores")
            moved = F.abs(F.col("score") - F.col("old"))
            change, most = scores.agg(F.coalesce(F.sum(moved), F.lit(0.0)), F.coalesce(F.max(F.when(moved > 0, moved / F.col("score"))), F.lit(0.0))).first()
            scores = scores.select("host", "score")
            if change < tolerance and most <= relative:  # a new host changes by all of its score
                break
        else:
            scores = new.groupBy("host").agg(F.sum("score").alias("score"))
            if k % 2 == 0:
                scores = common.staged(scores, "host-scores")
    return scores


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, rounds: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page.

    A rule that fits decides (longest host + path). Else the host's scores do: block where distrust is more than threshold
    of trust + distrust, allow otherwise and where neither reaches the host. rounds: as in propagate, until settled unless given. Null urls and null html give empty
    values and no edges; repeated pages are judged each and their links count each; an empty table gives an empty result.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    host, path = host_of(rows["url"]), path_of(rows["url"])
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), rule_for(host, path, rules).alias("fit"))
    edges = common.staged(host_edges(pages, url_col, html_col), "host-edges")
    seeded = rows.filter("fit is not null").groupBy("host").agg(
        F.sum((F.col("fit.verdict") == "allow").cast("double")).alias("good"), F.sum((F.col("fit.verdict") == "block").cast("double")).alias("bad"))
    seeded = common.staged(seeded, "host-seeds")

    def scores(kind: str, along: DataFrame, name: str) -> DataFrame:
        whole = seeded.agg(F.sum(kind)).first()[0] or 1.0
        seeds = seeded.filter(F.col(kind) > 0).select("host", (F.col(kind) / whole).alias("seed"))
        return propagate(along, seeds, rounds).withColumnRenamed("score", name)

    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    judged = common.staged(scores("good", edges, "trust").join(scores("bad", back, "distrust"), "host", "full"), "host-judged")
    hosts = judged.fillna(0.0, ["trust", "distrust"]).filter("host <> ''")
    verdict = F.coalesce("fit.verdict", F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow"))
    found = rows.join(hosts, "host", "left").fillna(0.0, ["trust", "distrust"])
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
