"""URL filter: path rules first, link-graph trust and distrust for the rest.

Hosts that the rules allow are seeds of a personalised PageRank along links,
hosts that they block are seeds of the same against the links: whoever links
to a distrusted host is distrusted. Both run at once as joins of mass on edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlake.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE = 0.85, 1e-3
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without `://` or for null."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rules_by_host(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """`host, fits`: the rules of a host's own name and of the domains above it.

    `hosts` has one row per `host`. An equi-join on the ends of its name, as
    many labels long as a rule's name at most; hosts without a rule are left out.
    """
    cut = [(verdict, rule, *rule.partition("/")) for verdict, rule in rules]
    rows = [(own, slash + rest, len(rule), rule, verdict) for verdict, rule, own, slash, rest in cut]
    table = hosts.sparkSession.createDataFrame(rows, "own string, start string, size int, rule string, verdict string")
    labels = max((own.count(".") + 1 for _, _, own, _, _ in cut), default=1)
    parts = F.split("host", r"\.")
    counts = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels)))
    ends = F.transform(counts, lambda n: F.array_join(F.slice(parts, -n, n), "."))
    named = hosts.select("host", F.explode(ends).alias("own")).join(table, "own")
    return named.groupBy("host").agg(F.collect_list(F.struct("start", "size", "rule", "verdict")).alias("fits"))


def longest_rule(path: Column, fits: Column) -> Column:
    """struct(size, rule, verdict) of the longest rule whose path starts the url's, or null.

    Of equally long ones the later in the alphabet wins.
    """
    found = F.filter(fits, lambda f: path.startswith(f["start"]))
    return F.array_max(F.transform(found, lambda f: F.struct(f["size"].alias("size"), f["rule"].alias("rule"), f["verdict"].alias("verdict"))))


def host_edges(pages: DataFrame) -> DataFrame:
    """`src, dst, weight`: links between different hosts, counted per pair."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    # A link without a scheme (//host/...) takes the page's.
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    target, _ = split_url(full)
    found = links.select(F.col("host").alias("src"), target.alias("dst")).where("src <> dst and dst <> ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """`kind, host, score` from `kind, host, mass` seeds (kinds trust and distrust).

    Each round moves the mass that arrived in the last one along the edges
    (trust) or against them (distrust), times `damping`, until what arrives is
    at every host less than `tolerance` of its score, so a host reached for the
    first time always passes its mass on. A chain of n hosts takes n rounds.
    Mass of hosts without links stays there. Seeds of a kind are
    scaled to 1; no seeds or no edges are allowed.
    """
    totals = {r["kind"]: r["mass"] for r in seeds.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
    scale = F.lit(None).cast("double")
    for kind, mass in totals.items():
        scale = F.when(F.col("kind") == kind, F.lit(1.0 / mass)).otherwise(scale)
    moving = F.col("mass") * scale * (1 - damping)
    state = cut_lineage(seeds.select("kind", "host", moving.alias("score"), moving.alias("moving")))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    share = (F.col("weight") / F.col("total")).alias("share")
    moves = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), share)
    moves = moves.union(
        edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), share)
    )
    moves = cut_lineage(moves)
    while True:
        arrived = (
            state.where("moving > 0")
            .join(moves, ["kind", "host"])
            .groupBy("kind", F.col("to").alias("host"))
            .agg((F.sum(F.col("moving") * F.col("share")) * damping).alias("moving"))
        )
        both = state.select("kind", "host", "score", F.lit(0.0).alias("moving")).union(
            arrived.select("kind", "host", F.col("moving").alias("score"), "moving")
        )
        state = cut_lineage(both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving")))
        if state.where(F.col("moving") > tolerance * F.col("score")).isEmpty():
            return state.select("kind", "host", "score")


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    threshold: float = 0.5,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """`page_id, host, path, rule, verdict, trust, distrust`, one row per input row.

    `rules`: (allow or block, host/path), any number of them, joined on the
    ends of host names. A rule fits its host and all subdomains where the url's
    path starts with the rule's; a page takes the verdict of the longest one.
    Otherwise its host is blocked if distrust / (trust +
    distrust) exceeds `threshold`; a host without either is allowed, as are
    urls without a host. A host is a seed by the share of its pages that rules
    allow or block, so a host with a third of all pages counts as one host.
    Null urls and html, repeated rows and null ids are kept. Pages are reduced
    per host and per pair of hosts before any shuffle; only that smaller graph
    is iterated over.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    slim = rows.drop("html")
    fits = cut_lineage(rules_by_host(slim.select("host").distinct(), rules))
    ruled = slim.join(fits, "host", "left").withColumn("fit", longest_rule(F.col("path"), F.col("fits"))).drop("fits")
    hosts = ruled.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("fit.verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(F.col("fit.verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"),
    )
    both = F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "mass")
    seeds = cut_lineage(hosts.select("host", both).where("mass > 0").select("kind", "host", "mass"))
    edges = cut_lineage(host_edges(rows))
    scores = propagate(edges, seeds, damping, tolerance)
    wide = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    # Rounded to 13 digits, so that the order of additions can't turn a tie.
    wide = wide.select("host", *[F.format_string("%.12e", k).cast("double").alias(k) for k in ("trust", "distrust")])
    judged = ruled.join(wide, "host", "left").fillna(0.0, ["trust", "distrust"])
    doubtful = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    own = F.when(doubtful, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "trust", "distrust"
    )
