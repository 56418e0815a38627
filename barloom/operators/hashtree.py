"""A hash tree over rows in their order: one digest for all of them, and the chunks that differ.

Rows of a key are cut by their order into chunks of fixed length; a chunk's
digest is the SHA-256 of the texts of its rows, and a node's that of its
children, up to one node for a key.  Neither the layout of the rows nor the
cluster matters; a change of one row, or of the order of two, changes its chunk
and every node above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.ordinals import ordinals
from barloom.session import checkpoint_dir

SIZE, FAN = 4096, 64


def _node(rows: DataFrame, keys: list[str], level: int, child: str, text: Column, between: str, n: Column) -> DataFrame:
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(child).alias("i"), text.alias("t"))))  # as long as a chunk or the fan
    digest = F.sha2(F.array_join(F.transform(sorted_, lambda x: x["t"]), between), 256)
    return rows.groupBy(*keys, "_up").agg(digest.alias("digest"), F.sum(n).alias("n_rows")).select(*keys, F.lit(level).alias("level"), F.col("_up").alias("node"), "digest", "n_rows")


def tree(rows: DataFrame, keys: list[str], order: str, text: Column | None = None, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """keys, level (0: chunks), node, digest, n_rows; all keys have as many levels as the longest.

    `order` counts the rows of a key from 0; `text` is what is hashed of a row (by default all its columns as JSON).
    """
    checkpoint_dir(rows.sparkSession)
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}) if text is None else text
    leaves = rows.withColumns({"_up": F.floor(F.col(order) / size).cast("long"), "_text": text})
    level = _node(leaves, keys, 0, order, F.col("_text"), "\n", F.lit(1)).checkpoint()
    out, height = level, 0
    top = level.agg(F.max("node")).first()[0] or 0
    while top > 0:
        top, height = top // fan, height + 1
        level = _node(level.withColumn("_up", F.floor(F.col("node") / fan).cast("long")), keys, height, "node", F.col("digest"), "", F.col("n_rows"))
        out = out.unionByName(level)
    return out


def roots(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, digest, n_rows."""
    top = nodes.agg(F.max("level").alias("_top"))
    return nodes.join(F.broadcast(top), nodes["level"] == top["_top"]).select(*keys, "digest", "n_rows")


def root(nodes: DataFrame, keys: list[str], fan: int = FAN) -> str:
    """One digest for all keys: the root of a tree over their roots in the order of the keys."""
    placed = ordinals(roots(nodes, keys), keys, "_nth", 0)
    text = F.concat_ws("|", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), F.col("digest"), F.col("n_rows"))
    top = roots(tree(placed, [], "_nth", text, fan, fan), []).first()
    return top["digest"] if top else ""


def changed_chunks(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node: the chunks that differ, or that only one tree has."""
    a = before.where("level = 0").select(*keys, "node", F.col("digest").alias("_a"))
    b = after.where("level = 0").select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col("node").alias("_b_node"), F.col("digest").alias("_b"))
    same = F.col("node") == F.col("_b_node")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    both = a.join(b, same, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*(F.coalesce(k, f"_b_{k}").alias(k) for k in keys), F.coalesce("node", "_b_node").alias("node"))
