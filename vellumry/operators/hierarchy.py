"""Trees by parent id: ancestors, descendants, depth, paths. Level-synchronous joins, so depth is bounded by the data, not by a setting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.session import written


def _edges(nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    """(a, b): each node and its parent, if that is a node."""
    known = nodes.where(F.col(parent).isNotNull()).join(nodes.select(F.col(ident).alias("__p")), F.col(parent) == F.col("__p"), "left_semi")
    return known.select(F.col(ident).alias("a"), F.col(parent).alias("b")).where("a <> b").distinct()


def ancestors(nodes: DataFrame, start: DataFrame | None = None, ident: str = "ID", parent: str = "post_parent") -> DataFrame:
    """(ID, ancestor, distance) for every node, or those of start; a node met before ends the walk, so cycles end.

    For every node by pointer doubling: after round r chains of length 2^r are known, so rounds grow as the logarithm of the depth. For those of start by one step up a
    round, in which only their own chains take part. Rounds go on until nothing new comes, whatever the depth; each is written to the shared folder, so that
    none is computed twice.
    """
    edges = _edges(nodes, ident, parent)
    if start is not None:
        edges = written(edges, "edges")
        last = written(start.select(F.col("ID").alias("a")).distinct().join(edges, "a").select("a", "b", F.lit(1).alias("d")), "ancestors")
        known, rounds = last, 0
        while not last.isEmpty():
            rounds += 1
            up = last.alias("x").join(edges.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.d") + 1).alias("d")).where("a <> b")
            last = written(up.join(known, ["a", "b"], "left_anti").groupBy("a", "b").agg(F.min("d").alias("d")), "ancestors")
            known = known.unionByName(last)
            known = known if rounds % 8 else written(known, "ancestors")  # so that its plan stays short
        return known.select(F.col("a").alias("ID"), F.col("b").alias("ancestor"), F.col("d").alias("distance"))
    known, reach = edges.select("a", "b", F.lit(1).alias("d")), 1
    while True:
        longer = known.where(F.col("d") == reach).alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), (F.col("x.d") + F.col("y.d")).alias("d")).where("a <> b")
        known = written(known.unionByName(longer).groupBy("a", "b").agg(F.min("d").alias("d")), "ancestors")
        if known.where(F.col("d") > reach).isEmpty():
            break
        reach *= 2
    return known.select(F.col("a").alias("ID"), F.col("b").alias("ancestor"), F.col("d").alias("distance"))


def descendants(nodes: DataFrame, root: int, ident: str = "ID", parent: str = "post_parent") -> DataFrame:
    """(ID, depth) of all nodes below root, one level a round, whatever the depth; a node met before isn't met again, so cycles end."""
    down = written(nodes.select(F.col(ident).cast("long").alias("ID"), F.col(parent).cast("long").alias("P")).where("P IS NOT NULL AND P <> ID"), "edges")
    last = written(down.where((F.col("P") == root) & (F.col("ID") != root)).select("ID", F.lit(1).alias("depth")).distinct(), "descendants")
    found, depth = last, 1
    while not last.isEmpty():
        depth += 1
        below = down.join(last.select(F.col("ID").alias("P")), "P").where(F.col("ID") != root).select("ID").distinct()
        last = written(below.join(found, "ID", "left_anti").select("ID", F.lit(depth).alias("depth")), "descendants")
        found = found.unionByName(last)
        found = found if depth % 8 else written(found, "descendants")  # so that its plan stays short
    return found


def with_depth(nodes: DataFrame, ident: str = "ID", parent: str = "post_parent") -> DataFrame:
    """Add depth: the number of ancestors that are known; 0 for roots and orphans."""
    up = ancestors(nodes, None, ident, parent).groupBy("ID").agg(F.count(F.lit(1)).alias("depth"))
    return nodes.join(up.withColumnRenamed("ID", ident), ident, "left").fillna({"depth": 0})


def expected_paths(nodes: DataFrame, name: str, ident: str = "ID", parent: str = "post_parent") -> DataFrame:
    """(ID, path): names from the root down, joined by /; a node with children is a directory's index."""
    up = ancestors(nodes, None, ident, parent)
    named = up.join(nodes.select(F.col(ident).alias("ancestor"), F.col(name).alias("__name")), "ancestor")
    above = named.groupBy("ID").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("__name").alias("n")))), lambda s: s["n"]), "/").alias("dir"))
    parents = nodes.select(F.col(parent).alias("ID")).where("ID IS NOT NULL").distinct().withColumn("has_children", F.lit(True))
    x = nodes.select(F.col(ident).alias("ID"), F.col(name).alias("__own")).join(above, "ID", "left").join(parents, "ID", "left")
    base = F.concat_ws("/", "dir", "__own")
    return x.select("ID", F.when(F.col("has_children"), F.concat(base, F.lit("/index.md"))).otherwise(F.concat(base, F.lit(".md"))).alias("path"))


def parents_of_paths(files: DataFrame) -> DataFrame:
    """(ID, parent) from paths (ID, path): a file belongs to the index of its directory, an index to that of the directory above."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    index = F.col("path").endswith("/index.md")
    own = files.select("ID", F.when(index, F.regexp_extract(folder, r"^(.*)/[^/]+$", 1)).otherwise(folder).alias("__dir"))
    heads = files.where(index).select(folder.alias("__dir"), F.col("ID").alias("parent"))
    return own.join(heads, "__dir", "left").select("ID", "parent")


def recoverable(nodes: DataFrame, root: int, least: int, limit: int) -> DataFrame:
    """(ID, depth) below root with an id of at least `least`, parents first, the first `limit`. depth counts from the top of the tree; only the root's own ancestors and
    what lies below it are walked."""
    above = ancestors(nodes, nodes.where(F.col("ID") == root).select("ID")).count()
    return descendants(nodes, root).select("ID", (F.col("depth") + above).alias("depth")).where(F.col("ID") >= least).orderBy("depth", "ID").limit(limit)
