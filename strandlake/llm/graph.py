"""Connected components of an edge table, by the library's general contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.components import edge_components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable.

    Edges are contracted inside partitions, then in rounds of large and small stars; only minima per node
    are gathered, and the joins with them are ordinary ones that adaptive execution splits where a hub is large.
    """
    return edge_components(edges, a, b).select(F.col("v").alias("node"), "root")
