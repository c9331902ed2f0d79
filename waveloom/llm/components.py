"""Connected components of an edge table, by alternating large and small stars, and of nodes that meet in
buckets without giving all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.llm.bitmaps import flagged
from waveloom.llm.common import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v: every node points its neighbours (the larger ones, or
    the smaller ones and itself) at the smallest node it knows. Minima are joined back on the node; rows
    are pairs of longs, and a hot node's rows are split by the engine's skew join. Rows may repeat."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    if large:
        new = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether every u points at one v, which itself points nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where("out > 1 or out = 1 and into = 1").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns a, b); component is the smallest
    node that links reach. Loops and repeated edges are harmless; nulls are dropped. Every round is
    written to the shared folder, so plans stay short and lost executors cost one round at most."""
    current = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct(),
        name,
    )
    while not _settled(current):
        following = materialize(_stars(_stars(current, True), False).distinct(), name)
        discard(current)
        current = following
    # every u points at its component's smallest node, which itself is a u nowhere
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) once ``links`` (a, b) are added. Only links between components are solved: most
    of many links join what is joined already. Components are those of :func:`connected_components`."""
    placed = links
    for c in "ab":
        own = found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        placed = placed.join(own, c, "left")
    tops = placed.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    above = connected_components(tops).select(F.col("node").alias("own"), F.col("component").alias("top"))
    # a node that was in no component is its own
    return materialize(found.join(above, found["component"] == above["own"], "full").select(F.coalesce("node", "own").alias("node"), F.coalesce("top", "component").alias("component")), "components-joined")


def size_level(size: str, percent: int) -> Column:
    """A column's level of size, 0 to 63 and round again: sizes of which the smaller has ``percent`` hundredths of the larger
    or more are at most REACH levels apart."""
    # a share less, as logarithms are rounded
    return F.expr(f"cast(pmod(floor(ln({size}) * {REACH * (1 - 1e-9)} / ln(100 / {percent})), 64) as int)")


def multiple_buckets(index: DataFrame) -> DataFrame:
    """(bucket, node, a) of the rows of ``index`` (bucket, node) whose bucket holds several nodes; a is its pivot: the
    node that meets most others over all its buckets, the smallest of equals. A copy that is changed least shares
    most buckets, so most others link with it. Most buckets hold one node, however often: keys are reduced to their
    smallest and largest node map-side, and only rows behind a bitmap of the keys in which these differ are joined. Hot
    buckets are split by the skew join. If ``index`` has level (see :func:`size_level`), nodes that have no other of near size
    in a bucket leave it."""
    ends = index.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    several = materialize(ends.where("least <> most").select("bucket"), "bucket-keys")
    rows = flagged(index, F.col("bucket"), several.select(F.col("bucket").alias("key"))).where("may").drop("may")
    rows = materialize(rows.join(several, "bucket").distinct(), "bucket-rows")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *([F.expr("bit_or(shiftleft(1L, level))").alias("levels")] if "level" in rows.columns else []))
    sized = rows.join(sizes, "bucket")
    if "level" in rows.columns:
        beside = " | ".join(f"shiftleft(1L, level + {k}) | shiftleft(1L, level + {64 - k})" for k in range(1, REACH + 1))  # shifts go by 64
        sized = materialize(sized.where(f"size > bit_count(levels) or (levels & ({beside})) <> 0").select("bucket", "node", "size"), "bucket-sized")
        discard(rows)
        rows = sized.select("bucket", "node")
    meets = sized.groupBy("node").agg(F.sum("size").alias("meets"))
    pivots = rows.join(meets, "node").groupBy("bucket").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("a"))
    shared = materialize(rows.join(pivots, "bucket"), "bucket-shared")
    for held in (several, rows, sized):
        discard(held)
    return shared


#: Levels by which sizes may differ.
REACH = 3
#: Buckets of more nodes that fall into several components are taken together by their smallest node.
SMALL = 32
#: Nodes of a group that one task compares with the whole group.
PROBES = 1024
#: Further pivots of a group, each of the largest component that no pivot of it is in.
ROUNDS = 3


def bucket_components(shared: DataFrame, features: DataFrame, open_: str, verify: Callable[[DataFrame], DataFrame], closer: Callable[[DataFrame], DataFrame] | None = None, closer_open: str = "true", rounds: int = ROUNDS, pivots: int = 1, least: int = 2, sure: str = "") -> DataFrame:
    """(node, component) of nodes linked in buckets (see :func:`multiple_buckets`). features: (node, ...) of
    these nodes; open_: a condition on columns named like x_a and x_b, which every pair that links meets;
    verify keeps of such pairs (a, b) those that link.

    Each node is verified against its bucket's pivot first. Once these links are joined, only
    buckets that still hold several components give further pairs, only across components, and only open
    ones: the condition is part of the join. A pair within a component cannot change it, so none that
    could is left out. Buckets of up to ``SMALL`` nodes give at most that many pairs a row. Larger ones with one
    pivot are a group, so nodes that meet in many of them meet once. A group is held against a few further pivots, which
    join what belongs together in as many pairs as it has nodes: in each of ``rounds`` one of each of the ``pivots`` largest
    components of ``least`` nodes and more that no pivot is in. Then nodes outside its
    largest component are compared with the others, ``PROBES`` of them to a task. closer adds columns to a group's
    rows (pivot, node), and closer_open is a further condition on these. sure: what verify needs to know of a pair beyond
    its nodes, as a column of that name.
    """
    told = [F.expr(sure).alias("sure")] if sure else []
    named = [c for c in features.columns if c != "node"]
    side = lambda c, more=(): [F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in (*named, *more))]
    stars = shared.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = materialize(stars.join(features.select(side("a")), "a").join(features.select(side("b")), "b").where(open_).select("a", "b", *told), "bucket-pairs")
    found = connected_components(materialize(verify(first), "bucket-links"))
    placed = materialize(shared.join(found, "node", "left").select("bucket", "node", "a", F.coalesce("component", "node").alias("component")), "bucket-placed")
    split = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("bucket", (F.col("n") > SMALL).alias("large"))
    rows = materialize(placed.join(split, "bucket"), "bucket-split")
    discard(placed)

    small = rows.where("not large").join(features, "node")
    a, b = (small.select("bucket", F.col("component").alias(f"of_{c}"), *side(c)) for c in "ab")
    across = a.join(b, (a["bucket"] == b["bucket"]) & F.expr(f"a < b and of_a <> of_b and {open_}")).select("a", "b", *told).distinct()

    groups = rows.where("large").select(F.col("a").alias("pivot"), "node", "component").distinct()
    groups = materialize(groups, "bucket-groups")
    near = materialize(features.join(groups.select("node").distinct(), "node"), "bucket-near")
    tested, used = first, groups.select("pivot", F.col("pivot").alias("node")).distinct()
    for _ in range(rounds):
        met = used.join(found, "node", "left").select("pivot", F.coalesce("component", "node").alias("component")).distinct()
        sizes = groups.join(met, ["pivot", "component"], "left_anti").groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where(F.col("n") >= least)
        place = F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("n"), "node"))
        chosen = materialize(sizes.withColumn("place", place).where(F.col("place") <= pivots).select("pivot", F.col("node"), F.col("component").alias("own")), "bucket-pivots")
        if chosen.isEmpty():
            break
        ahead = chosen.join(near, "node").select("pivot", "own", *side("a"))
        behind = groups.join(near, "node").select("pivot", F.col("component").alias("of"), *side("b"))
        against = ahead.join(behind, (ahead["pivot"] == behind["pivot"]) & F.expr(f"of <> own and {open_}")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *told).distinct()
        against = materialize(against.join(tested, ["a", "b"], "left_anti"), "bucket-pairs")
        found = joined_components(found, materialize(verify(against), "bucket-links"))
        tested, used = tested.unionByName(against), used.unionByName(chosen.select("pivot", "node"))
        groups = materialize(groups.drop("component").join(found, "node", "left").select("pivot", "node", F.coalesce("component", "node").alias("component")), "bucket-groups")
    largest = groups.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("pivot")
    most = largest.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("settled"), F.expr(f"cast(sum(n) div {PROBES} as int)").alias("more"))
    if closer:
        groups = materialize(closer(groups), "bucket-closer")
    more = [c for c in groups.columns if c not in ("pivot", "node", "component")]
    whole = groups.join(most, "pivot").join(near, "node")
    probes = whole.where("component <> settled").select("pivot", F.expr("cast(pmod(xxhash64(node), more + 1) as int)").alias("part"), F.col("component").alias("of_a"), *side("a", more))
    others = whole.select("pivot", F.explode(F.sequence(F.lit(0), "more")).alias("part"), F.col("component").alias("of_b"), (F.col("component") == F.col("settled")).alias("calm"), *side("b", more))
    beside = probes.join(others, (probes["pivot"] == others["pivot"]) & (probes["part"] == others["part"]) & F.expr(f"of_a <> of_b and (calm or a < b) and {closer_open} and {open_}"))
    beside = beside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *told).distinct()

    rest = materialize(across.unionByName(beside).distinct().join(tested, ["a", "b"], "left_anti"), "bucket-rest")
    later = materialize(verify(rest), "bucket-links")
    for held in (first, rows, near, rest):
        discard(held)
    return joined_components(found, later)
