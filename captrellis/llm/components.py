"""Connected components as joins: labels fall to the smallest key of the component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrellis.session import stage


def connect(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (``id, label``) after merging everything that ``edges`` (``a, b``) join.

    Labels are ids, and an id's label is the smallest id known to be in its component. Each round works on the
    graph of labels: it drops links inside a component, hooks every label to its smallest neighbour, and follows
    the hooks once more. The graph shrinks by at least half of its linked labels, so the number of rounds is
    logarithmic. Only links and labels are moved, by keys; sums are combined before each exchange.
    """
    while True:
        a = labels.selectExpr("id AS a", "label AS la")
        b = labels.selectExpr("id AS b", "label AS lb")
        links = edges.join(a, "a").join(b, "b").where("la <> lb")
        links = links.selectExpr("greatest(la, lb) AS upper", "least(la, lb) AS lower").distinct()
        links = stage(links, "component-links")
        if links.isEmpty():
            return labels
        # Every upper label hooks to its smallest neighbour; hooks always lead to smaller labels, so none circle.
        hooks = stage(links.groupBy("upper").agg(F.min("lower").alias("lower")), "component-hooks")
        while True:
            ahead = hooks.selectExpr("upper AS lower", "lower AS lowest")
            jumped = hooks.join(ahead, "lower", "left").selectExpr(
                "upper", "coalesce(lowest, lower) AS lower", "lowest IS NOT NULL AS moved"
            )
            jumped = stage(jumped, "component-jumps")
            hooks = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        labels = labels.join(hooks.withColumnRenamed("upper", "label"), "label", "left")
        labels = stage(labels.selectExpr("id", "coalesce(lower, label) AS label"), "component-labels")
