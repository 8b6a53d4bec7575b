"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a, b).

    Each round gives every id the smallest id beside it, follows that pointer once more, and
    joins the ends of the links to it; links inside a group fall away. Chains shrink
    geometrically and a star ends in one round. Hub ids are met by joins on the unique side,
    which the runtime splits, and by sums that combine on the map side. Null ends are left out.
    """
    edges = staged(links.select("a", "b").where("a <> b").distinct(), "links")
    label = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("near")), "near")
        further = near.select(F.col("id").alias("near"), F.col("near").alias("far"))
        step = staged(near.join(further, "near").select("id", F.col("far").alias("component")), "step")
        at = lambda name: step.select(F.col("id").alias(name), F.col("component").alias(f"{name}_to"))
        if label is None:
            label = step
        else:
            label = staged(
                label.join(at("component"), "component", "left").select(
                    "id", F.coalesce("component_to", "component").alias("component")
                ),
                "label",
            )
        edges = staged(
            edges.join(at("a"), "a")
            .join(at("b"), "b")
            .where("a_to <> b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .distinct(),
            "links",
        )
    return label if label is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
