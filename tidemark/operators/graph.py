"""shortest paths between wanted pairs of an edge table, by search from both ends.

All ends of the wanted pairs are searched from at once, one layer of nodes a round. A layer row is
(side, end, node, path): the nodes passed between the end and the node, in the order of the final path.
After round r every end knows its nodes at distance r; a pair is joined by a path of 2r-1 or 2r edges if
its two ends share a node at distances (r, r-1) or (r, r). So a pair of distance d costs
layers of radius d/2 round its ends, shared by all pairs of an end.

State: in an undirected graph the neighbours of layer r lie in the layers r-1, r and r+1 only, so
the two last layers are all that is kept, of ends with an open pair. A pair is given up when
either end has no further layer: a small component ends the search for all pairs into it, however large
the other end's component is. Every round is checkpointed.

Tie rule: of equally short paths the one that is smallest as a list of nodes from src to dst. The
smallest list to a node and the smallest list from it are kept per layer row, and
the smallest joint list over the shared nodes is the smallest of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    return (e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            .where(F.col("u") != F.col("v")).distinct())


def _ends(pairs: DataFrame, end: str) -> DataFrame:
    return pairs.select(F.col(end).alias("end")).distinct()


def _grown(layer: DataFrame, before: DataFrame | None, adj: DataFrame, side: str) -> DataFrame:
    """The next layer of every end, each node with its smallest path."""
    def longer(v: Column) -> Column:
        return F.concat("path", F.array(v)) if side == "src" else F.concat(F.array(v), "path")

    out = (layer.join(adj, layer["node"] == adj["u"]).select("end", F.col("v").alias("node"), longer(F.col("v")).alias("path"))
           .groupBy("end", "node").agg(F.min("path").alias("path")))
    for known in (layer, before):
        if known is not None:
            out = out.join(known, ["end", "node"], "left_anti")
    return materialize(out)


def _met(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, path) of the pairs whose layers share a node."""
    left = a.select(F.col("end").alias("src"), "node", F.col("path").alias("to"))
    right = b.select(F.col("end").alias("dst"), "node", F.col("path").alias("on"))
    return (pairs.join(left, "src").join(right, ["dst", "node"])
            .groupBy("src", "dst").agg(F.min(F.concat("to", F.slice("on", F.lit(2), F.greatest(F.size("on") - 1, F.lit(0))))).alias("path")))


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``pairs`` (src, dst, ...) with ``hops`` and ``path``, the smallest of the shortest paths from src to dst;
    both NULL where no path joins them (or, with ``max_hops``, none that short), or an end is NULL.

    A pair of one node with itself has no hops and that node as its path, in the graph or not."""
    adj = materialize(undirected(edges))
    nodes = adj.select(F.col("u").alias("node")).distinct()
    wanted = pairs.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()
    found = [wanted.where(F.col("src") == F.col("dst")).select("src", "dst", F.array("src").alias("path"))]
    left = materialize(wanted.where(F.col("src") != F.col("dst")).join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
                       .join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    layers = {s: _ends(left, s).select("end", F.col("end").alias("node"), F.array("end").alias("path")) for s in ("src", "dst")}
    before: dict[str, DataFrame | None] = {"src": None, "dst": None}
    hops = 0
    while not left.isEmpty() and (max_hops is None or hops < max_hops):
        for side, other in (("src", "dst"), ("dst", "src")):  # one more edge on either side in turn
            hops += 1
            grown = _grown(layers[side], before[side], adj, side)
            met = materialize(_met(left, grown if side == "src" else layers["src"], layers["dst"] if side == "src" else grown))
            found.append(met)
            # a pair goes on while it is not joined and this side's end has a further layer
            left = materialize(left.join(met, ["src", "dst"], "left_anti")
                               .join(_ends(grown, "end").withColumnRenamed("end", side), side, "left_semi").select("src", "dst"))
            layers[side], before[side] = grown, layers[side]
            if hops == max_hops:
                break
        for side in ("src", "dst"):
            open_ends = _ends(left, side)
            layers[side] = layers[side].join(open_ends, "end", "left_semi")
            before[side] = before[side].join(open_ends, "end", "left_semi") if before[side] is not None else None
    all_found = found[0]
    for f in found[1:]:
        all_found = all_found.unionByName(f)
    return (pairs.join(all_found, ["src", "dst"], "left")
            .withColumn("hops", F.when(F.col("path").isNotNull(), F.size("path") - 1)))
