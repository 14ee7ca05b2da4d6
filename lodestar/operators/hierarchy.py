"""Hierarchies as edge tables (id, parent, own); a root is its own parent.

Values climb by doubling: after k steps each node knows its ancestor 2**k levels up and
the answer for what lies fewer levels away. A tree of n nodes and depth d takes log2(d)
steps over n rows, each written to the shared folder; no table of all pairs of ancestor
and descendant is made. A parent that is no node passes nothing up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..semantics import finite, settled


class TreeError(ValueError):
    """An edit that the structure does not allow, or edges that are no forest."""


def _ups(edges: DataFrame) -> DataFrame:
    return edges.select("id", F.when(F.col("id") != F.col("parent"), F.col("parent")).alias("up"))


def _climb(edges: DataFrame, start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], drop_cycles: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ups, values): ``step`` takes both and gives the values of twice the height.

    ``up`` is null once a node's ancestors are all counted. Where some are left after
    more steps than the nodes allow, there is a cycle: :class:`TreeError`, or with
    ``drop_cycles`` the result as it is, in which only such nodes still have an ``up``.
    """
    nodes, most = None, 1
    ups, values = _ups(edges), start
    while ups.where("up is not null").first():
        nodes = edges.count() if nodes is None and most >= 64 else nodes
        if nodes is not None and most > nodes:
            if drop_cycles:
                break
            raise TreeError(f"{ups.where('up is not null').first()['id']!r} never reaches a root")
        values = settled(step(ups, values))
        far = ups.select(F.col("id").alias("__mid"), F.col("up").alias("__far"))
        ups = settled(ups.join(far, F.col("up") == F.col("__mid"), "left").select("id", F.col("__far").alias("up")))
        most *= 2
    return ups, values


def _adding(ups: DataFrame, values: DataFrame) -> DataFrame:
    low = values.join(ups.where("up is not null"), "id")
    more = low.groupBy(F.col("up").alias("__to")).agg(F.sum("total").alias("__more"))
    return values.join(more, F.col("id") == F.col("__to"), "left").select("id", F.when(F.col("__more").isNotNull(), F.coalesce("total", F.lit(0.0)) + F.col("__more")).otherwise(F.col("total")).alias("total"))


def subtree_sums(edges: DataFrame) -> DataFrame:
    """(id, total): own values of each node and all below it; null where all are null."""
    return _climb(edges, edges.select("id", F.col("own").alias("total")), _adding)[1]


def subtree_max(edges: DataFrame) -> DataFrame:
    """Largest own value in each subtree and who holds it; ties go to the smaller id, nulls do not count."""

    def step(ups: DataFrame, values: DataFrame) -> DataFrame:
        low = values.join(ups.where("up is not null"), "id").select(F.col("up").alias("id"), "best")
        return values.union(low.join(values.select("id"), "id", "left_semi")).groupBy("id").agg(F.min("best").alias("best"))

    best = F.when(F.col("own").isNotNull(), F.struct((-F.col("own")).alias("less"), F.col("id").alias("holder")))
    got = _climb(edges, edges.select("id", best.alias("best")), step)[1]
    return got.select("id", (-F.col("best.less")).alias("largest"), F.col("best.holder").alias("holder"))


def top_k(edges: DataFrame, k: int, by_total: bool = False) -> DataFrame:
    """The ``k`` heaviest descendants of each node, by own value or by subtree total; ties by id."""
    weight = subtree_sums(edges).select("id", F.col("total").alias("weight")) if by_total else edges.select("id", F.col("own").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "node"))

    # One more than asked for, as a node may be among its own heaviest until the end.
    def step(ups: DataFrame, values: DataFrame) -> DataFrame:
        low = values.join(ups.where("up is not null"), "id").select(F.col("up").alias("id"), "node", "weight")
        return values.union(low).withColumn("__rank", rank).where(F.col("__rank") <= k + 1).drop("__rank")

    got = _climb(edges, weight.select("id", F.col("id").alias("node"), "weight"), step)[1]
    rows = got.where("id <> node").join(edges.select("id"), "id", "left_semi").withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.select(F.col("id").alias("root"), F.col("node").alias("id"), "weight", "rank")


def _lengthening(ups: DataFrame, values: DataFrame) -> DataFrame:
    above = values.select(F.col("id").alias("__mid"), F.col("path").alias("__path"))
    both = values.join(ups, "id").join(above, F.col("up") == F.col("__mid"), "left")
    return both.select("id", F.when(F.col("__path").isNotNull(), F.concat("__path", "path")).otherwise(F.col("path")).alias("path"))


def paths(edges: DataFrame) -> DataFrame:
    """(id, path, depth): ids from the root down to the node."""
    got = _climb(edges, edges.select("id", F.array("id").alias("path")), _lengthening)[1]
    return got.withColumn("depth", F.size("path") - 1)


def below(edges: DataFrame, node) -> DataFrame:
    """(id): ``node`` and all its descendants; none where it is no node."""

    def step(ups: DataFrame, values: DataFrame) -> DataFrame:
        above = values.where("inside").select(F.col("id").alias("__mid"))
        near = ups.join(above, F.col("up") == F.col("__mid"), "left_semi").select("id")
        return values.join(near.withColumn("__near", F.lit(True)), "id", "left").select("id", (F.col("inside") | F.coalesce("__near", F.lit(False))).alias("inside"))

    return _climb(edges, edges.select("id", (F.col("id") == F.lit(node)).alias("inside")), step)[1].where("inside").select("id")


def children(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("parent") == F.lit(node)) & (F.col("id") != F.lit(node))).select("id")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): added, removed or moved between two edge tables."""
    a, b = old.select("id", F.col("parent").alias("was")), new.select("id", F.col("parent").alias("now"))
    both = a.join(b, "id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "moved")
    return both.select("id", change.alias("change")).where("change is not null")


def check(edges: DataFrame) -> DataFrame:
    """(id, problem) of nodes that are doubled, whose parent is unknown, or that never reach a root."""
    twice = edges.groupBy("id").count().where("count > 1").select("id", F.lit("exists").alias("problem"))
    ids = edges.select(F.col("id").alias("parent")).distinct()
    orphan = edges.join(ids, "parent", "left_anti").select("id", F.lit("unknown parent").alias("problem"))
    once = edges.dropDuplicates(["id"])

    # The farthest ancestor known; a root where one is reached.
    def step(ups: DataFrame, values: DataFrame) -> DataFrame:
        above = values.select(F.col("id").alias("__mid"), F.col("top").alias("__top"))
        return values.join(ups, "id").join(above, F.col("up") == F.col("__mid"), "left").select("id", F.coalesce("__top", "up", "top").alias("top"))

    ups, tops = _climb(once, once.select("id", F.col("id").alias("top")), step, drop_cycles=True)
    roots = once.where("id = parent").select(F.col("id").alias("top"))
    reached = tops.join(ups.where("up is null"), "id").join(roots, "top", "left_semi").select("id")
    loop = once.join(reached, "id", "left_anti").join(orphan.select("id"), "id", "left_anti").select("id", F.lit("cycle or below an unknown parent").alias("problem"))
    return twice.union(orphan).union(loop)


def _refuse(rows: DataFrame, why: str) -> None:
    bad = rows.first()
    if bad is not None:
        raise TreeError(f"{bad[0]!r} {why}")


def add(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """``edges`` with new nodes ``rows`` (id, parent, own); roots are their own parents.

    An id that is there already or twice in ``rows``, a parent that is neither there nor
    among ``rows``, and an own value that is not finite raise :class:`TreeError`.
    """
    _refuse(rows.join(edges.select("id"), "id", "left_semi").select("id"), "exists")
    _refuse(rows.groupBy("id").count().where("count > 1").select("id"), "is added twice")
    known = edges.select(F.col("id").alias("parent")).union(rows.select("id"))
    _refuse(rows.join(known, "parent", "left_anti").select("parent"), "is unknown")
    _refuse(rows.where(F.col("own").isNotNull() & ~finite(F.col("own"))).select("id"), "has a value that is not finite")
    both = edges.unionByName(rows)
    _climb(rows, rows.select("id"), lambda _, values: values)  # new nodes may not be a cycle of their own
    return both


def add_root(edges: DataFrame, node, own: float = 0.0) -> DataFrame:
    kinds = {f.name: f.dataType for f in edges.schema.fields}
    row = edges.sparkSession.range(1).select(*[F.lit({"id": node, "parent": node, "own": own}.get(c)).cast(k).alias(c) for c, k in kinds.items()])
    return add(edges, row)


def own_value(edges: DataFrame, node) -> float:
    """The node's own value, 0 where it has none; an unknown node raises."""
    row = edges.where(F.col("id") == F.lit(node)).select("own").first()
    if row is None:
        raise TreeError(f"{node!r} is unknown")
    return row[0] or 0.0


def set_own(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``edges`` with the own values of ``values`` (id, own) in place; unknown ids and values that are not finite raise."""
    _refuse(values.join(edges.select("id"), "id", "left_anti").select("id"), "is unknown")
    _refuse(values.where(~finite(F.col("own"))).select("id"), "has a value that is not finite")
    new = values.select("id", F.col("own").alias("__own"))
    return edges.join(new, "id", "left").withColumn("own", F.coalesce("__own", "own")).select(*edges.columns)


def move(edges: DataFrame, node, parent) -> DataFrame:
    for one in (node, parent):
        if edges.where(F.col("id") == F.lit(one)).first() is None:
            raise TreeError(f"{one!r} is unknown")
    if node != parent and below(edges, node).where(F.col("id") == F.lit(parent)).first():
        raise TreeError(f"{parent!r} is below {node!r}")
    return edges.withColumn("parent", F.when(F.col("id") == F.lit(node), F.lit(parent)).otherwise(F.col("parent")))


def remove(edges: DataFrame, node, subtree: bool = False) -> DataFrame:
    if edges.where(F.col("id") == F.lit(node)).first() is None:
        raise TreeError(f"{node!r} is unknown")
    if subtree:
        return edges.join(below(edges, node), "id", "left_anti")
    if children(edges, node).first():
        raise TreeError(f"{node!r} has children")
    return edges.where(F.col("id") != F.lit(node))
