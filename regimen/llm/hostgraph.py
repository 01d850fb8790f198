"""URL filter: prefix rules, then trust and distrust that spread over the graph of hosts. DataFrame functions only.

Trust is a personalised PageRank along links from hosts whose pages the rules allow; distrust is one against the links from hosts
whose pages they block (who links to a blocked host is suspect). A host is a seed by the share of its pages that a rule allows or
blocks, so all seeds are between 0 and 1 whatever a host's size, and the same pages ten times over give the same ranks. Links are
absolute and protocol-relative references in a page's html, plus each host's link to the nearest parent host that has pages,
which weighs as much as an average host has pages. Edges are summed per pair of hosts before any rank is computed, and a host with a
large share of all edges is joined on its own. Ranks are iterated to a tolerance, with no number of rounds given.

Defined results: a null url or one without :// has empty host and path, no rule and verdict allow; null html has no links; repeated
pages count as often as they occur and are judged alike; extra columns of pages are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.llm.base import join_counted, key_sizes, written
from regimen.llm.lines import ascii_lower

#: A hot host's pages are dealt to so many tasks when they get its verdict.
SALTS = 32
#: A host is blocked if its distrust is about twice its trust (just under 2, which sums of thirds and halves meet by rounding), and LEAST
#: at least; a host whose pages are all blocked has 1 - DAMPING = 0.15 of its own.
DAMPING, RATIO, LEAST, TOLERANCE = 0.85, 1.99, 0.011, 1e-4
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/\"'?#\s<>]+)"


def host_of(url: str) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 1))


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, 2)


def rule_of(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """The longest fitting rule as struct<rule, verdict>, else null. rules: (verdict, host, path), a bounded list of parameters."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, on, under in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col(host) == on) | F.endswith(F.col(host), F.lit("." + on))) & F.startswith(F.col(path), F.lit(under))
        found = F.when(fits, F.struct(F.lit(on + under).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts with their counts (a page counts once for each host it links to, a parent as an average host's pages)."""
    linked = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)), lambda h: ascii_lower(h))
    links = pages.select(host_of(url).alias("src"), F.explode(F.array_distinct(linked)).alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.select(host_of(url).alias("src")).where("src <> ''").groupBy("src").agg(F.count(F.lit(1)).alias("own"))
    average = hosts.agg(F.avg("own").alias("n"))
    parts = F.split("src", r"\.")
    up = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, k, F.size(parts)), ".").alias("dst")))
    suffixes = written(hosts.where(F.size(parts) > 1).select("src", F.inline(up)), "host-suffixes")
    # most hosts share a last part, which is no host: such keys, too, are counted and joined on their own
    known = suffixes.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).join(hosts.select(F.col("src").alias("dst"), F.lit(True).alias("_host")), "dst", "left")
    above = join_counted(suffixes, written(known, "suffix-counts"), ["dst"]).where("_host")
    parents = above.groupBy("src").agg(F.min_by("dst", "k").alias("dst")).crossJoin(F.broadcast(average)).select("src", "dst", "n")
    return links.union(parents).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def host_flows(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """kind, src, dst, weight: trust flows along an edge in proportion to the links out of src, distrust against it in proportion to those into dst. Each host also has an edge to itself with its own share (base) and no weight."""
    out, into = (written(edges.groupBy(end).agg(F.sum("n").alias(name), F.count(F.lit(1)).alias("m")), "edge-ends") for end, name in (("src", "n_out"), ("dst", "n_in")))
    both = join_counted(join_counted(edges, out, ["src"], "m"), into, ["dst"], "m")
    forth = both.select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("n_out")).alias("weight"))
    back = both.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("n_in")).alias("weight"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("host")).union(hosts.select("host")).distinct().join(hosts, "host", "left")
    kinds = F.array(F.struct(F.lit("trust").alias("kind"), F.coalesce("good", F.lit(0.0)).alias("base")), F.struct(F.lit("distrust").alias("kind"), F.coalesce("bad", F.lit(0.0)).alias("base")))
    own = nodes.select("host", F.inline(kinds)).select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("weight"), "base")
    return forth.union(back).withColumn("base", F.lit(None).cast("double")).unionByName(own)


def host_scores(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", html: str = "html", damping: float = DAMPING, tolerance: float = TOLERANCE, least: float = LEAST, more: int = 0) -> DataFrame:
    """host, trust, distrust of every host that has pages or links.

    Both start at (1 - damping) of a host's own share and only grow from round to round, so that no verdict can swing. Rounds end when no
    rank grows by more than tolerance times itself (times least, if it is smaller); more: rounds after that.
    """
    judged = pages.select(host_of(url).alias("host"), path_of(url).alias("path")).where("host <> ''").withColumn("verdict", rule_of(rules)["verdict"])
    share = lambda verdict: (F.count_if(F.col("verdict") == verdict) / F.count(F.lit(1))).alias({"allow": "good", "block": "bad"}[verdict])
    hosts = written(judged.groupBy("host").agg(share("allow"), share("block")), "seeds")
    edges = written(host_edges(pages, url, html), "host-edges")
    flows = written(host_flows(edges, hosts), "host-flows")
    many = written(flows.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("n")), "flow-counts")
    ranks = flows.where("base is not null").select("kind", F.col("src").alias("host"), (F.col("base") * (1 - damping)).alias("rank"), F.lit(0.0).alias("before"))
    sizes, left = key_sizes(many), 1 + more
    while left > 0:
        known = many.join(ranks.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"])
        moved = join_counted(flows, known, ["kind", "src"], sizes=sizes)
        value = F.when(F.col("base").isNotNull(), F.col("base") * (1 - damping)).otherwise(F.col("rank") * F.col("weight") * damping)
        ranks = written(moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(value).alias("rank"), F.sum(F.when(F.col("base").isNotNull(), F.col("rank"))).alias("before")), "ranks")
        grown = ranks.agg(F.max((F.col("rank") - F.col("before")) / F.greatest("rank", F.lit(least)))).first()[0]
        left -= grown is None or grown <= tolerance
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]], ratio: float = RATIO, least: float = LEAST, page_id: str = "page_id", url: str = "url", html: str = "html", **params) -> DataFrame:
    """page_id, host, path, rule, verdict: the rule's verdict, else block where the host's distrust is at least least and over ratio times its trust, else allow."""
    scores = host_scores(pages, rules, url, html, least=least, **params)
    blocked = scores.where((F.col("distrust") > ratio * F.col("trust")) & (F.col("distrust") >= least)).select(F.col("host").alias("_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    own = pages.select(page_id, host_of(url).alias("host"), path_of(url).alias("path")).withColumn("_rule", rule_of(rules))
    own = own.withColumn("_at", F.pmod(F.xxhash64(page_id), F.lit(SALTS)).cast("int"))
    joined = own.join(blocked, (own["host"] == blocked["_host"]) & (own["_at"] == blocked["_salt"]) & own["_rule"].isNull(), "left")
    return joined.select(page_id, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))
