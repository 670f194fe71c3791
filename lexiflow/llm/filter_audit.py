"""How filters interact: what each removes first, what is redundant, and what each order of them costs.

1. One scan marks which filters every row fails; equal texts are found by digest.
2. Rows are counted by (part, filters failed, labels) before anything is shuffled: these classes, at most 2^filters * 2^labels for a part, are all that
   the orders depend on.
3. Removal ranks by a min-plus product: a mask matrix (classes x filters) and the matrix of inverse permutations (orders x filters: at which step a filter comes)
   are combined by minimum over the filters failed. The least position is the step that removes the class. Class sizes are scattered onto these steps.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, documents, staged

#: More filters would have too many orders to list: the result has filters! * filters rows for each part.
MOST_FILTERS = 7


def removal_steps(masks: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """(class, order): the step that removes rows of a class, from 1; filters + 1 if none does.

    ``masks`` (class, filter) says which filters fail, ``positions`` (order, filter) the step of each filter. A filter that does not fail adds infinity.
    """
    never = masks.shape[1] + 1
    return np.where(masks[:, None, :], positions[None, :, :], never).min(axis=2, initial=never)


def orders_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of n filters, and their inverse permutations counted from 1."""
    orders = np.array(list(permutations(range(n))), dtype=np.int64).reshape(factorial(n), n)
    return orders, np.argsort(orders, axis=1) + 1


def count_orders(masks: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """(order, step) matrices of one part: kept, removed, redundant, unique_fails, shapley, and ``lost`` (label, order, step).

    ``weights`` (1 + labels, class) has the number of rows of each class, then that of its rows with each label.
    """
    n = masks.shape[1]
    orders, positions = orders_of(n)
    steps = removal_steps(masks, positions)
    gone = np.zeros((len(weights), len(orders), n + 2), dtype=np.int64)
    at = np.broadcast_to(np.arange(len(orders)), steps.shape)
    for found, weight in zip(gone, weights, strict=True):
        np.add.at(found, (at, steps), np.broadcast_to(weight[:, None], steps.shape))
    removed = gone[0, :, 1 : n + 1]
    failing = weights[0] @ masks.astype(np.int64)
    alone = weights[0] @ (masks & (masks.sum(axis=1, keepdims=True) == 1)).astype(np.int64)
    share = np.zeros(n, dtype=np.int64)
    np.add.at(share, orders, removed)
    return {
        "kept": weights[0].sum() - removed.cumsum(axis=1), "removed": removed, "redundant": failing[orders] - removed, "unique_fails": alone[orders],
        "shapley": share[orders], "lost": gone[1:, :, 1 : n + 1],
    }


def audit(rows: DataFrame, filters: dict[str, Column], part: Column, lost: dict[str, Column]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, a column for each of ``lost``, shapley) for each part, order and step.

    ``filters`` maps one-letter names to conditions on ``rows`` that are true where a row fails; null counts as passed. ``lost`` maps column names to
    conditions whose removed rows are counted. Null parts are the empty string. Parts of any number and size: rows are counted by class before the shuffle, and a
    part is a few classes. Repeated rows count as often as they stand; an empty table gives an empty result; columns not named in a condition are not looked at.
    """
    names = list(filters)
    if not 0 < len(names) <= MOST_FILTERS or any(len(x) != 1 for x in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters with one-letter names are needed")
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    mask = sum((bit(c) * (1 << k) for k, c in enumerate(filters.values())), F.lit(0).cast("long"))
    labels = sum((bit(c) * (1 << k) for k, c in enumerate(lost.values())), F.lit(0).cast("long"))
    classes = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), labels.alias("labels")).groupBy("part", "mask", "labels").agg(F.count(F.lit(1)).alias("n"))
    letters, n, lost_names = np.array(names), len(names), list(lost)
    counted = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    fields = [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in counted])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        masks = (group["mask"].to_numpy()[:, None] >> np.arange(n)) & 1 == 1
        size, marks = group["n"].to_numpy(), group["labels"].to_numpy()
        found = count_orders(masks, np.stack([size, *(size * (marks >> k & 1) for k in range(len(lost_names)))]))
        found |= dict(zip(lost_names, found.pop("lost"), strict=True))
        orders = orders_of(n)[0]
        out = {"part": group["part"].iloc[0], "filter_order": np.repeat(["".join(x) for x in letters[orders]], n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))}
        return pd.DataFrame(out | {c: found[c].ravel() for c in counted})

    return classes.groupBy("part").applyInPandas(one, schema)


def text_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A, B, C, D, E): the five conditions of the production query for every row, over whole texts.

    A: under 50 words; B: fewer than 65 % of the words are distinct; C: over 5 % of the code points are A-Z; D: holds one of ``#$%&*|``; E: a row with a
    smaller id has the same text, null counting as empty. A null id comes after all others. A group of equal texts meets in a join that Spark can split.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    seen = docs.select(F.col(id_col).alias("id"), F.col(part_col).alias("part"), text.alias("t"), words.alias("w")).select(
        "id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("kinds"),
        (F.length("t")).alias("points"), (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]", ""))).alias("capitals"), F.col("t").rlike("[#$%&*|]").alias("D"),
    )
    flags = staged(seen.select("id", "part", "digest", (F.col("words") < 50).alias("A"), (100 * F.col("kinds") < 65 * F.col("words")).alias("B"), (100 * F.col("capitals") > 5 * F.col("points")).alias("C"), "D"), "flags")
    repeated = flags.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and least is not null").drop("n")
    later = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    return flags.join(repeated, "digest", "left").select("id", "part", "A", "B", "C", "D", later.alias("E"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = text_flags(documents(spark, sf_dir).select("doc_id", "text", "source"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    return audit(flags.join(labels, "id", "left"), {x: F.col(x) for x in "ABCDE"}, F.col("part"), {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
least AS (SELECT x, min(doc_id) AS first_id FROM t GROUP BY x),
w AS (SELECT doc_id, part, x, first_id, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t JOIN least USING (x)),
f AS (SELECT doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x),
  regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > first_id, first_id IS NOT NULL)] AS fails FROM w),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
v AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT c.*, filter_order, coalesce(list_min(list_transform(list_filter(range(1, 6), lambda k: fails[k]), lambda k: strpos(filter_order, 'ABCDE'[k]))), 6) AS gone FROM c, o),
s AS (SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS x,
  coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone < step AND fails[strpos('ABCDE', filter_order[step])]), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails[strpos('ABCDE', filter_order[step])] AND len(list_filter(fails, lambda z: z)) = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (gone = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (gone = step AND toxic), 0)::BIGINT AS toxic_lost
  FROM r, range(1, 6) k(step) GROUP BY part, filter_order, step)
SELECT * EXCLUDE (x), sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM s
"""
