"""Connected components of an edge table, links from inverted lists, and joins that broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.shared import cut

#: Rows (of a few numbers each, so about 32 MB) up to which a side is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 500_000
#: Members up to which all pairs of a list are looked at, a bounded number for each member; longer lists have leaders first.
SHORT = 16


def lean(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, whose rows must be a few numbers each, marked for broadcast if it has at most BROADCAST_ROWS rows.

    ``rows``: a bound on them, where one is known; otherwise they are counted, so ``df`` must be cheap to count, as after :func:`cut`.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), both long: component is the smallest node reachable.

    Alternates large-star and small-star steps until only stars around the smallest nodes are left; each step joins a
    node's smallest neighbour back to its edges, so no task or driver holds a component. Every second step is written to
    the shared folder. Repeated edges and loops are allowed; an empty table gives none.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u").where("v > u or v = m")  # larger neighbours move to the smallest; each node keeps its smallest
        large = met.select(F.greatest("u", "v").alias("u"), F.when(F.col("v") > F.col("u"), F.col("m")).otherwise(F.col("v")).alias("v")).where("u <> v")
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        ends = now.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break  # every node has one smaller neighbour, which has none: these are the roots
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def connect(lists: DataFrame, may_link, prove, once=None) -> tuple[DataFrame, DataFrame]:
    """(node, component) and the proven links (a, b), from inverted ``lists`` (signature, node, pos, further attributes of the node).

    Any two nodes that link stand together in a list in which may_link() holds, a condition on pos and the attributes with
    _a and _b appended; prove(pairs) keeps the pairs (a, b, attributes) that link; once() may name the one list of several in which
    a pair counts.

    First every list is linked to its leader, the member of least pos, so a large group costs about one pair a member. What
    then spans several components goes on: of lists up to SHORT all pairs between components are tried, of longer ones a second
    leader outside the first one's component, and at last all pairs between the components that are left, the condition being
    part of the join. Pairs within a component need no proof, and no link between components is lost.
    """
    own = [c for c in lists.columns if c != "signature"]
    kept = [c for c in own if c not in ("node", "pos")]
    lists = cut(lists)

    def named(x: str, *more: str) -> list:
        return [F.col("signature"), F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in (*own[1:], *more)]]

    def leaders(of: DataFrame, *more: str) -> DataFrame:
        first = F.min(F.struct("pos", *[c for c in own if c != "pos"], *more)).alias("l")
        return of.groupBy("signature").agg(first).select("signature", F.col("l.node").alias("a"), *[F.col(f"l.{c}").alias(f"{c}_a") for c in (*own[1:], *more)])

    def judged(met: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The distinct pairs not tried before, and those of them that are proven to link; both are written."""
        turn = F.col("a") < F.col("b")
        sides = [F.when(turn, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_a") for c in kept] + [F.when(turn, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_b") for c in kept]
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *sides).dropDuplicates(["a", "b"])
        pairs = cut(pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        return pairs, cut(prove(pairs))

    def labelled(of: DataFrame, label: DataFrame, least: int) -> DataFrame:
        """The lists of more than ``least`` members that span several components, with each member's component and the list's size."""
        marked = of.join(lean(label), "node", "left").withColumn("component", F.coalesce("component", "node")).select("signature", *own, "component")
        spread = marked.groupBy("signature").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
        return cut(marked.join(spread.where(F.col("members") > least).where("low < high").select("signature", "members"), "signature"))

    all_of = F.expr("true") if once is None else once()
    tried, links = judged(lists.select(*named("b")).join(leaders(lists), "signature").where((F.col("a") != F.col("b")) & may_link()), None)
    label = cut(components(links))
    lists = labelled(lists, label, 2)
    if lists.isEmpty():
        return label, links
    apart = F.col("component_a") != F.col("component_b")
    short, long = lists.where(F.col("members") <= SHORT), lists.where(F.col("members") > SHORT)
    near = short.select(*named("a", "component")).join(short.select(*named("b", "component")), "signature").where((F.col("a") < F.col("b")) & apart & may_link() & all_of)
    first = leaders(long, "component").select("signature", F.col("component_a").alias("first"))
    second = leaders(long.join(first, "signature").where("component <> first"), "component")
    led = long.select(*named("b", "component")).join(second, "signature").where(apart & may_link())
    again, more = judged(near.unionByName(led.select(near.columns)), tried)
    links = links.unionByName(more)
    label = cut(components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b"))))
    long = labelled(long.drop("component", "members"), label, SHORT)
    if long.isEmpty():
        return label, links
    main = long.groupBy("signature", "component").count().groupBy("signature").agg(F.max(F.struct("count", "component"))["component"].alias("main"))
    left = long.join(main, "signature").where("component <> main").select(*named("a", "component"))
    met = left.join(long.select(*named("b", "component")), "signature").where(apart & may_link() & all_of)
    _, last = judged(met, tried.unionByName(again))
    return cut(components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(last.select("a", "b")))), links.unionByName(last)
