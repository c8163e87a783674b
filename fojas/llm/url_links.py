"""URL filter: rules, and trust and distrust spread over the links between hosts.

Rules judge the URLs they fit. Their judgements also seed the link graph: a host is trusted, or blocked,
by the share of its known URLs, pages and link targets, that rules allow, or block. Trust is PageRank from
the trusted hosts along links; distrust is PageRank from the blocked hosts on the reversed graph, so it
reaches hosts that link to them. Both are read as shares of what arrives when all hosts are seeds, which
the other hosts' degrees do not shrink: a host all of whose links go to blocked hosts has distrust 1, and links
to hosts that nothing is known of dilute it. URLs no rule fits get their host's verdict: blocked when its
distrust exceeds its trust and a threshold.

The graph has one edge per pair of hosts, summed before the shuffle. Each round is a join with the
edges and a sum by host; every few rounds the scores are written, until they no longer change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fojas.llm.common import ascii_lower, written

URL = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
QUERY = r"(?s)^.*?://[^?#]*+(\?[^#]*+)"
HREF = r"""(?i)\bhref\s*+=\s*+["']?+((?:[a-z][a-z0-9+.-]*+:)?//[^"'\s>]++)"""
WRITE_EVERY = 4
TOLERANCE = 1e-3


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null where none does. Rules: (action, host/path)."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def links_of(pages: DataFrame) -> DataFrame:
    """(url, html) to (src, link): the absolute links of each page. Relative links stay on their host."""
    links = pages.filter("html is not null").select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    return links.withColumn("link", F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))


def host_edges(pages: DataFrame) -> DataFrame:
    """(url, html) to (src, dst, n): links between different hosts."""
    links = links_of(pages).select("src", host_of(F.col("link")).alias("dst"))
    return links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_seeds(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(url, html) to (host, trusted, blocked): the shares of the host's known URLs that rules allow and
    block. Known are the pages and what links of other hosts name, crawled or not; a URL counts once,
    whatever its scheme and fragment. Links to its own URLs, like relative ones, say nothing of a host."""
    targets = links_of(pages).filter(F.col("src") != host_of(F.col("link")))
    urls = pages.select("url").unionByName(targets.select(F.col("link").alias("url")))
    urls = urls.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.regexp_extract("url", QUERY, 1).alias("query"))
    urls = urls.filter("host <> ''").distinct()
    action = rule_for(F.col("host"), F.col("path"), rules)[1]
    share = lambda act: F.avg(F.coalesce((F.col("action") == act).cast("double"), F.lit(0.0)))
    return urls.withColumn("action", action).groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))


def host_ranks(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """(src, dst, n) and (host, trusted, blocked) to (host, trust, distrust), both from 0 to 1.

    Personalised PageRank: trust starts at the trusted seeds and goes along links, divided over a host's
    links out; distrust starts at the blocked seeds and goes against links, divided over a host's links in;
    ``damping`` of it goes on. A seed passes on its own rank; what arrives at it counts for the part that
    its seed leaves open. Such ranks shrink with the degrees on their way, so each is held against
    the rank that arrives when every host is a seed: ``distrust`` is the blocked seeds' share of what
    arrives at a host, beside its own seed, and ``trust`` the trusted ones'. The
    rounds go on until no rank grows by more than ``tolerance`` of itself in ``WRITE_EVERY`` of them.
    """
    if not (0 <= damping < 1 and tolerance > 0):
        raise ValueError("damping must be under 1 and tolerance over 0")
    edges = written(edges, "edges")
    steps = _steps(edges, damping)
    hosts = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).unionByName(seeds.select("host")).distinct()
    own = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit(0.0)).alias("seed")) for k, c in (("t", "trusted"), ("d", "blocked"))]))
    start = written(hosts.join(seeds, "host", "left").select("host", own), "seeds").select("kind", "host", "seed", F.col("seed").alias("v"), F.lit(1.0).alias("w"))
    scores = start
    while True:
        before = scores
        for _ in range(WRITE_EVERY):
            scores = _round(start, scores, steps)
        scores = written(scores, "scores")
        grown = scores.join(before.select("kind", "host", F.col("w").alias("old")), ["kind", "host"]).agg(F.max((F.col("w") - F.col("old")) / F.col("w"))).first()[0]
        if (grown or 0.0) <= tolerance:
            break
    # what arrives is all but the host's own start
    arrived = F.when(F.col("w") > 1, (F.col("v") - F.col("seed")) / (F.col("w") - 1)).otherwise(0.0)
    share = F.least(F.lit(1.0), F.col("seed") + (1 - F.col("seed")) * arrived)
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, share).otherwise(0.0))
    return scores.groupBy("host").agg(part("t").alias("trust"), part("d").alias("distrust"))


def _steps(edges: DataFrame, damping: float) -> DataFrame:
    """(kind, host, to, p): the part of a host's rank that goes to another."""
    total = lambda end: edges.groupBy(end).agg(F.sum("n").alias("total"))
    p = (F.lit(damping) * F.col("n") / F.col("total")).alias("p")
    steps = edges.join(total("src"), "src").select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), p)
    back = edges.join(total("dst"), "dst").select(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), p)
    return written(steps.unionByName(back), "steps")


def _round(start: DataFrame, scores: DataFrame, steps: DataFrame) -> DataFrame:
    """v, the rank from the seeds, and w, that from all hosts, one link further."""
    moved = scores.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.lit(0.0).alias("seed"), (F.col("v") * F.col("p")).alias("dv"), (F.col("w") * F.col("p")).alias("dw"))
    own = start.select("kind", "host", "seed", F.lit(0.0).alias("dv"), F.lit(0.0).alias("dw"))
    total = own.unionByName(moved).groupBy("kind", "host").agg(*[F.sum(c).alias(c) for c in ("seed", "dv", "dw")])
    more = lambda first, c: (first + (1 - F.col("seed")) * F.col(c))
    return total.select("kind", "host", "seed", more(F.col("seed"), "dv").alias("v"), more(F.lit(1.0), "dw").alias("w"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], least: float = 0.5, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, url, html) to (page_id, host, path, rule, verdict, trust, distrust), a row for each row.

    A url that no rule fits is blocked where its host's distrust is ``least`` at least and more than its trust, by more
    than the ranks' ``tolerance``. A null url, or one without ://, has neither host nor path and is allowed, as is a host that nothing
    is known of. Null and empty html has no links. Links of repeated pages count each time. An empty table
    gives no rows. Of rules equally long the later by name wins; rules are few and part of the plan. Other columns
    are not read.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    seeds = host_seeds(pages.select("url", "html"), rules)
    scores = host_ranks(host_edges(pages.select("url", "html")), seeds, damping, tolerance)
    found = rows.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > F.col("trust") + tolerance) & (F.col("distrust") >= least - tolerance)
    verdict = F.coalesce("action", F.when(bad, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
