"""Crawl graph: frontier search, redirect chains, descendants.

The frontier search runs once per level of the crawl; paths and pointers double, so that a chain of any length takes a
logarithmic number of rounds. What a round leaves is stored in the shared folder: lineage stays short, and a lost
executor only repeats one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.session import cut_lineage, stored

c = F.col


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """``win_bfs_frontier``: (node, depth, parent) of every node within ``max_depth`` hops.

    The smallest parent of the previous level counts as the one that found the node.
    """
    edges = stored(edges.select("src", "dst"), "edges")  # read once per level
    found = seeds.select("node", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")).distinct()
    frontier = found
    for depth in range(1, max_depth + 1):
        reached = (
            frontier.select(c("node").alias("src")).join(edges, "src").groupBy(c("dst").alias("node")).agg(F.min("src").alias("parent"))
            .join(found.select("node"), "node", "left_anti")
            .select("node", F.lit(depth).alias("depth"), "parent")
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def redirect_chains(redirects: DataFrame, max_hops: int = 8) -> DataFrame:
    """``join_redirect_chain``: where every URL ends and how.

    ``redirects`` is (url, status, location). Result: url, hops, final_url, final_status, outcome in
    ok / error / no-location / loop / too-many / unknown.

    Paths double: a URL's next 2k stops are its next k and the next k of the last of them, so ``max_hops`` takes
    log2(max_hops) joins. A path holds ``max_hops`` stops at most, and what became of it is read off the row.
    """
    spot = "struct<url:string,st:int,loc:string>"
    steps = redirects.select("url", c("status").cast("int").alias("st"), c("location").alias("loc"))
    goes_on = c("st").between(300, 399) & c("loc").isNotNull()
    to = steps.select(c("url").alias("next"), F.struct("url", "st", "loc").alias("there"))
    unknown = F.struct(c("next").alias("url"), F.lit(None).cast("int").alias("st"), F.lit(None).cast("string").alias("loc"))
    one = F.when(c("next").isNull(), F.array().cast(f"array<{spot}>")).otherwise(F.array(F.coalesce("there", unknown)))
    paths = stored(
        steps.withColumn("next", F.when(goes_on, c("loc"))).join(to, "next", "left")
        .select("url", F.struct("url", "st", "loc").alias("start"), one.alias("path")), "redirect-paths")
    reach = 1
    while reach < max_hops:
        last = F.when(F.size("path") == reach, F.element_at("path", -1)["url"])
        on = paths.select(c("url").alias("last"), c("path").alias("more")).filter(F.size("more") > 0)
        paths = stored(
            paths.withColumn("last", last).join(on, "last", "left")
            .select("url", "start", F.concat("path", F.coalesce("more", F.array().cast(f"array<{spot}>"))).alias("path")), "redirect-paths")
        reach *= 2
    # the stops that are looked at, in order; the first with an outcome ends the walk
    stops = paths.select("url", F.concat(F.array("start"), F.slice("path", 1, max_hops)).alias("stops"))

    def outcome(x, i):
        before = F.transform(F.slice("stops", F.lit(1), i + 1), lambda y: y["url"])
        st, loc = x["st"], x["loc"]
        return (
            F.when(i >= max_hops, "too-many").when(st.isNull(), "unknown").when(~st.between(300, 399), F.when(st < 400, "ok").otherwise("error"))
            .when(loc.isNull(), "no-location").when(F.array_contains(before, loc), "loop"))

    ends = F.transform("stops", lambda x, i: F.struct(i.cast("long").alias("hops"), outcome(x, i).alias("outcome"), x["url"].alias("at"), x["st"].alias("st"), x["loc"].alias("loc")))
    end = stops.select("url", F.get(F.filter(ends, lambda x: x["outcome"].isNotNull()), F.lit(0)).alias("e"))
    return end.select(
        "url", "e.hops", F.when(c("e.outcome") == "loop", c("e.loc")).otherwise(c("e.at")).alias("final_url"),
        F.when(c("e.outcome") != "too-many", c("e.st")).alias("final_status"), "e.outcome")


def page_tree(pages: DataFrame) -> DataFrame:
    """``join_page_parent``: parent of each page; a page whose parent is unknown hangs off the root."""
    known = pages.select(c("url").alias("parent_url"), F.lit(True).alias("known")).distinct()
    j = pages.join(known, "parent_url", "left")
    return j.select("url", F.when(c("depth") == 0, F.lit(None).cast("string")).when(c("known"), c("parent_url")).otherwise(F.lit("(root)")).alias("parent"))


def descendants(tree: DataFrame) -> DataFrame:
    """``agg_descendants``: nodes below each node of (node, parent). A parent that is no node itself counts as none.

    Pointers double: after k rounds a node knows its 2^k-th ancestor and how many nodes lie less than 2^k levels below
    it. A round adds the counts of the nodes that point at a node and lets each point where its ancestor points, so a
    tree of d levels takes log2(d) + 1 rounds. Pointers that are left when 2^k exceeds the number of nodes run in a
    cycle, which is an error.
    """
    n_nodes = tree.count()
    known = tree.select(c("node").alias("parent"), F.lit(True).alias("known"))
    state = stored(tree.select("node", "parent").join(known, "parent", "left").select("node", F.when(c("known"), c("parent")).alias("up"), F.lit(1).cast("long").alias("n")), "tree")
    reach = 1
    while not state.filter(c("up").isNotNull()).isEmpty():
        if reach > n_nodes:
            raise ValueError("the tree has a cycle")
        below = state.filter(c("up").isNotNull()).groupBy(c("up").alias("node")).agg(F.sum("n").alias("more"))
        over = state.filter(c("up").isNotNull()).select(c("node").alias("up"), c("up").alias("next"))
        state = stored(
            state.join(over, "up", "left").join(below, "node", "left")
            .select("node", c("next").alias("up"), (c("n") + F.coalesce("more", F.lit(0))).alias("n")), "tree")
        reach *= 2
    return state.select("node", (c("n") - 1).alias("n_descendants"))


def crawl_source(found: DataFrame) -> DataFrame:
    """``agg_crawl_source``: sitemap, links or mixed, by how the URLs of a site were found."""
    return found.groupBy("site").agg(F.bool_or(c("via") == "sitemap").alias("s"), F.bool_or(c("via") == "links").alias("l")).select(
        "site", F.when(c("s") & c("l"), "mixed").when(c("s"), "sitemap").otherwise("links").alias("source"))
