"""Reachability in commit graphs without their closure.

Runs of commits with one parent and one child each are one chain; pointer doubling finds a commit's chain and its place there.
A walk goes from chain to chain, never from commit to commit: whoever enters a chain at its head has all of it, and at a place all
from there on. Levels, the longest way from a root, tell most pairs apart before any walk.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.sources import shared


class History(NamedTuple):
    nodes: DataFrame  # node, chain (its first node), place from 0
    links: DataFrame  # chain, place, into: a commit of one chain is a parent of the head of another


def history(edges: DataFrame, child: str = "child", parent: str = "parent") -> History:
    """The chains of a commit graph. Repeated edges count once, those with a null end are left out; a cycle raises an error."""
    one = shared.stored(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct(), "edges")
    ways = one.join(one.groupBy("c").agg(F.count(F.lit(1)).alias("_up")), "c").join(one.groupBy("p").agg(F.count(F.lit(1)).alias("_down")), "p")
    lone = F.expr("_up = 1 and _down = 1")
    nodes = one.select(F.col("c").alias("node")).union(one.select("p")).distinct()
    jumps = nodes.join(ways.where(lone).select(F.col("c").alias("node"), F.col("p").alias("up")), "node", "left")
    jumps = shared.stored(jumps.select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().cast("long").alias("place"), F.col("up").isNull().alias("done")), "jumps")
    left, rounds = jumps.where("not done").count(), 0
    limit = left.bit_length() + 2
    while left:
        # a node whose target is a head is done; others double their way
        ahead = jumps.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("place").alias("_place"))
        far = jumps.where("not done").join(ahead, "up").select("node", F.col("_up").alias("up"), (F.col("place") + F.col("_place")).alias("place"), (F.col("_place") == 0).alias("done"))
        before, jumps = jumps, shared.stored(jumps.where("done").unionByName(far), "jumps")
        shared.forget(before)
        left, rounds = jumps.where("not done").count(), rounds + 1
        if rounds > limit:
            raise ValueError("the graph has a cycle")
    nodes = jumps.select("node", F.col("up").alias("chain"), "place")
    links = ways.where(~lone).select(F.col("p").alias("node"), F.col("c").alias("into")).join(nodes, "node").select("chain", "place", "into")
    links = shared.stored(links, "links")
    shared.forget(one)
    return History(nodes, links)


def levels(graph: History) -> DataFrame:
    """chain and level, the most steps from a root to its head: chains whose parents are all settled settle in turn. A cycle raises an error.

    Each round handles the chains that are left; there are as many as the longest way has chains.
    """
    need = graph.links.groupBy(F.col("into").alias("chain")).agg(F.count(F.lit(1)).alias("need"))
    pending = graph.nodes.where("place = 0").select("chain").join(need, "chain", "left").select("chain", F.lit(0).cast("long").alias("level"), F.coalesce("need", F.lit(0)).alias("need"))
    pending, done = shared.stored(pending, "pending"), None
    while not pending.isEmpty():
        ready = pending.where("need = 0").select("chain", "level")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        found = ready.join(graph.links, "chain").groupBy(F.col("into").alias("chain")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("level") + F.col("place") + 1).alias("_level"))
        after = pending.where("need > 0").join(found, "chain", "left")
        after = after.select("chain", F.greatest("level", F.coalesce("_level", F.lit(0))).alias("level"), (F.col("need") - F.coalesce("_n", F.lit(0))).alias("need"))
        done = ready if done is None else done.unionByName(ready)
        pending = shared.stored(after, "pending")
    return shared.stored(done if done is not None else pending.select("chain", "level"), "levels")


def reach(graph: History, seeds: DataFrame, key: str) -> DataFrame:
    """key, chain, since: all that a seed (key, node) is an ancestor of, itself too, as the places of a chain from `since` on."""
    front = seeds.where("node is not null").join(graph.nodes, "node").groupBy(key, "chain").agg(F.min("place").alias("since"))
    front = seen = shared.stored(front, "front")
    while True:
        new = front.join(graph.links, "chain").where("place >= since").select(key, F.col("into").alias("chain"), F.lit(0).cast("long").alias("since")).distinct()
        new = new.join(seen.where("since = 0").select(key, "chain"), [key, "chain"], "left_anti")
        front = shared.stored(new, "front")
        if front.isEmpty():
            return seen.groupBy(key, "chain").agg(F.min("since").alias("since"))
        seen = seen.unionByName(front)


def reached_from(graph: History, seeds: DataFrame, key: str) -> DataFrame:
    """key, chain, upto: all ancestors of a seed (key, node), itself too, as the places of a chain up to `upto`."""
    front = seeds.where("node is not null").join(graph.nodes, "node").groupBy(key, "chain").agg(F.max("place").alias("upto"))
    front = seen = shared.stored(front, "front")
    while True:
        new = front.select(key, F.col("chain").alias("into")).distinct().join(graph.links, "into").groupBy(key, "chain").agg(F.max("place").alias("upto"))
        new = new.join(seen.select(key, "chain", F.col("upto").alias("_upto")).groupBy(key, "chain").agg(F.max("_upto").alias("_upto")), [key, "chain"], "left")
        front = shared.stored(new.where("_upto is null or upto > _upto").select(key, "chain", "upto", F.col("_upto").isNull().alias("_new")), "front")
        if front.isEmpty():
            return seen.groupBy(key, "chain").agg(F.max("upto").alias("upto"))
        seen, front = seen.unionByName(front.drop("_new")), front.where("_new")  # parents of a head are walked once


def live(graph: History, windows: DataFrame) -> DataFrame:
    """bug, commit: commits that have a bug's introduction among their ancestors, or are it, and not its fix (FLT-06). windows: bug, introduced, fixed (null: never)."""
    since = reach(graph, windows.select("bug", F.col("introduced").alias("node")), "bug")
    fixed = reach(graph, windows.select("bug", F.col("fixed").alias("node")), "bug").withColumnRenamed("since", "until")
    spans = since.join(fixed, ["bug", "chain"], "left").where("until is null or until > since")
    return spans.join(graph.nodes, "chain").where("place >= since and (until is null or place < until)").select("bug", F.col("node").alias("commit"))


def between(graph: History, ranges: DataFrame) -> DataFrame:
    """key, commit: commits on any way from `first` to `last`, both included; none where first is no ancestor of last (SRC-34). ranges: key, first, last."""
    down = reach(graph, ranges.select("key", F.col("first").alias("node")), "key")
    up = reached_from(graph, ranges.select("key", F.col("last").alias("node")), "key")
    return down.join(up, ["key", "chain"]).where("since <= upto").join(graph.nodes, "chain").where("place between since and upto").select("key", F.col("node").alias("commit"))


def ancestry(graph: History, pairs: DataFrame, level: DataFrame) -> DataFrame:
    """a, b, ancestor: whether a is an ancestor of b or b itself (FLT-06). Unknown commits have none; level: as levels() gives it.

    Pairs of one chain are told by place, others by level where they can be; only the rest is walked, below b's level, and a pair
    leaves the walk when it is settled.
    """
    own = graph.nodes.join(level, "chain").select("node", "chain", "place", (F.col("level") + F.col("place")).alias("level"))
    side = lambda x: own.select(*(F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in own.columns))
    known = shared.stored(pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b"), "pairs")
    told = F.when(F.col("a_chain") == F.col("b_chain"), F.col("a_place") <= F.col("b_place")).when(F.col("a_level") >= F.col("b_level"), False)
    settled = known.withColumn("ancestor", told)
    found = settled.where("ancestor").select("a", "b")
    front = shared.stored(settled.where("ancestor is null").select("a", "b", F.col("a_chain").alias("chain"), F.col("a_place").alias("since"), "b_chain", "b_place", "b_level"), "front")
    seen = front.select("a", "b", "chain")
    while not front.isEmpty():
        new = front.join(graph.links, "chain").where("place >= since").select("a", "b", F.col("into").alias("chain"), F.lit(0).cast("long").alias("since"), "b_chain", "b_place", "b_level").distinct()
        new = new.join(level, "chain").where("level <= b_level").drop("level").join(seen, ["a", "b", "chain"], "left_anti")
        new = shared.stored(new, "front")
        hits = new.where("chain = b_chain").select("a", "b")
        found, seen = found.unionByName(hits), seen.unionByName(new.select("a", "b", "chain"))
        front = shared.stored(new.join(hits, ["a", "b"], "left_anti"), "front")
    return pairs.select("a", "b").distinct().join(found.distinct().withColumn("ancestor", F.lit(True)), ["a", "b"], "left").withColumn("ancestor", F.coalesce("ancestor", F.col("a") == F.col("b")))


def best_sources(rows: DataFrame, edges: DataFrame | None = None, introduced: DataFrame | None = None) -> DataFrame:
    """bug, commit: each bug's best source (WIN-06), by the highest rank over 0.

    rows: bug, commit, rank, row (the place in the table, as csv_rows() gives it). Of equal ranks the first row counts, and a later
    one takes its place if it has the commit so far among its ancestors (edges: child, parent); a row that is neither doesn't.
    introduced: bug, introduced. The first row of the table whose commit is a prefix of that, or the other way round, wins where its rank is the bug's highest.
    """
    top = rows.where("rank > 0").join(rows.groupBy("bug").agg(F.max("rank").alias("_most")), "bug").where("rank = _most").select("bug", "commit", "row")
    top = shared.stored(top, "sources")
    steps = top.groupBy("bug").agg(F.min(F.struct("row", "commit")).alias("x")).select("bug", F.col("x.commit").alias("commit"))
    if edges is not None:
        graph = history(edges)
        after = reach(graph, top.select("commit", F.col("commit").alias("node")).distinct(), "commit")
        placed = top.join(graph.nodes.withColumnRenamed("node", "commit"), "commit").select("bug", "row", F.col("commit").alias("_commit"), "chain", "place")
        later = top.withColumnRenamed("row", "_row").join(after, "commit").join(placed, ["bug", "chain"]).where("place >= since and row > _row")
        following = later.groupBy("bug", F.col("_row").alias("row")).agg(F.min(F.struct("row", "_commit"))["row"].alias("next"))
        listed = top.join(following, ["bug", "row"], "left").groupBy("bug").agg(F.array_sort(F.collect_list(F.struct("row", "commit", "next"))).alias("x"))
        # rows in order: the one that stands gives way to its next one
        end = F.expr("aggregate(x, struct(x[0].row as at, x[0].commit as commit), (s, r) -> struct(if(r.row = s.at and r.next is not null, r.next, s.at) as at, if(r.row = s.at, r.commit, s.commit) as commit))")
        steps = listed.select("bug", end["commit"].alias("commit"))
    if introduced is None:
        return steps
    commits = rows.groupBy("commit").agg(F.min("row").alias("row"))
    wanted = introduced.where("introduced <> ''")
    from crashlens.operators import lookup

    own = lookup.prefixes(wanted.select("introduced").distinct(), commits, "introduced", "commit")
    own = wanted.join(own, "introduced").groupBy("bug").agg(F.min(F.struct("row", "commit")).alias("x")).select("bug", F.col("x.commit").alias("commit"))
    own = own.join(top, ["bug", "commit"], "left_semi").select("bug", F.col("commit").alias("_own"))
    return steps.join(own, "bug", "left").select("bug", F.coalesce("_own", "commit").alias("commit"))
