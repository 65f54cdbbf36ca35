"""Chat formatting: cumulative snapshots collapse to the longest conversation logged.

Each conversation gets a hash for every prefix of its turns, each made from the one
before. A conversation whose whole hash is a proper prefix of another's is an
earlier snapshot of it and goes by an anti-join; what stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def snapshots(turns: DataFrame) -> DataFrame:
    """``conv_id, _turns, _hashes``: ordered turns and the rolling hash behind each of them.

    Hashes are SHA-256 over the hash before, the role and the text, with the
    role's length in front so that role and text can't run into each other.
    """
    said = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    step = lambda acc, t: F.sha2(
        F.concat(acc, F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256
    )
    grouped = (
        turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
        .groupBy(F.col("conv_id").cast("bigint").alias("conv_id"))
        .agg(F.array_sort(F.collect_set(said)).alias("_turns"))
    )
    rolled = F.aggregate(
        "_turns",
        F.array().cast("array<string>"),
        lambda acc, t: F.concat(
            acc, F.array(step(F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit("")), t))
        ),
    )
    return grouped.withColumn("_hashes", rolled)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_collapsed, text`` for each conversation that no other extends.

    ``turns`` has ``conv_id, turn, role, text``, one row a turn; order is by turn,
    then role, then text. Repeated rows count once. Null role or text is the empty
    string; rows without conv_id or turn are left out. Of equal conversations the
    least conv_id stays; ``n_collapsed`` counts the others equal to it. Other
    columns are dropped; no turns give no rows. One shuffle groups the turns, and the
    last join keeps that grouping; the anti-join and the count carry hashes only.
    """
    convs = snapshots(turns).withColumn("_whole", F.element_at("_hashes", -1))
    prefixes = convs.select(
        F.explode(F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - 1, F.lit(0)))).alias("_whole")
    ).distinct()
    equal = convs.groupBy("_whole").agg(F.min("conv_id").alias("conv_id"), (F.count("*") - 1).alias("n_collapsed"))
    kept = equal.join(prefixes, "_whole", "left_anti")
    text = F.array_join(
        F.transform(
            "_turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))
        ),
        "",
    )
    return convs.join(kept.select("conv_id", "n_collapsed"), "conv_id").select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), "n_collapsed", text.alias("text")
    )


ORACLE = f"""
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
steps AS (
  SELECT conv_id, count(*) OVER w AS k, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS so_far
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (
  SELECT conv_id, max(k) AS n_turns, arg_max(so_far, k) AS logged,
         (SELECT string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '' ORDER BY turn, role, text) FROM said s WHERE s.conv_id = steps.conv_id) AS text
  FROM steps GROUP BY conv_id),
proper AS (SELECT DISTINCT s.so_far FROM steps s JOIN whole w USING (conv_id) WHERE s.k < w.n_turns),
equal AS (SELECT logged, min(conv_id) AS conv_id, count(*) - 1 AS n_collapsed FROM whole GROUP BY logged)
SELECT e.conv_id, w.n_turns, e.n_collapsed, w.text FROM equal e JOIN whole w USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.so_far = e.logged)"""
