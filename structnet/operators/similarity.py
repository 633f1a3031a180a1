"""Best-hit similarity search as a join on shared grams.

A query's score against a target is the share of the query's distinct grams
(residue k-mers or word shingles) that the target contains. The best target
per query is the one with the highest score, the smallest id on a tie, and
it must reach ``min_share``. The score is exact; it is not an alignment
e-value.

The join is kept small without dropping anything:

* equal texts are searched once, and of equal targets only the smallest id
  can win;
* with ``n`` grams and a share of ``s`` at least ``t = ceil(s * n)`` must
  match. Of the *rarest* ``n - t + e`` grams of the query a qualifying target
  then contains at least ``e``. With ``e = t/2`` the most frequent grams of a
  query never join, and targets that meet it by chance are gone early;
* the few candidates left are counted over all their grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structnet.operators.staging import stage


def _runs(items: Column, k: int, separator: str) -> Column:
    """Distinct runs of k neighbours, built by k - 1 shifted element-wise joins of the array with itself."""
    runs = items
    for shift in range(1, k):
        runs = F.zip_with(runs, F.slice(items, F.lit(shift + 1), F.size(items)),
                          lambda left, right: F.concat(left, F.lit(separator), right))
    return F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))


def residue_kmers(sequence: Column, k: int = 5) -> Column:
    """Distinct k-letter pieces, without those that contain an unknown letter."""
    return F.filter(_runs(F.split(sequence, ""), k, ""), lambda p: ~p.contains("X"))


def word_shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k words, lower case, words being runs of non-space characters."""
    return _runs(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), k, " ")


def best_matches(queries: DataFrame, targets: DataFrame, query_id: str, target_id: str,
                 text: str, grams, min_share: float) -> DataFrame:
    """``query_id, hit_id, shared, score`` for every query with a match.

    ``grams`` maps the text column to an array of distinct grams.
    """
    # One id stands for all queries of equal text, so that no text travels with its grams. Texts are
    # told apart by a 256-bit digest, which keeps sort keys short.
    digest = F.sha2(text, 256).alias("digest")
    keyed = queries.select(F.col(query_id), F.col(text), digest)
    q_texts = keyed.groupBy("digest").agg(F.min(query_id).alias("query"), F.min(text).alias(text))
    t_texts = (targets.select(F.col(target_id), F.col(text), digest)
               .groupBy("digest").agg(F.min(target_id).alias("hit_id"), F.min(text).alias(text)))
    q_grams = (q_texts.select("query", grams(F.col(text)).alias("grams"))
               .select("query", F.size("grams").alias("n"), F.explode("grams").alias("gram")))
    # Only target grams that some query has matter from here on.
    t_grams = stage(t_texts.select("hit_id", F.explode(grams(F.col(text))).alias("gram"))
                    .join(q_grams.select("gram").distinct(), "gram", "left_semi"))

    # A gram no target has is the rarest of all: it takes a place in the
    # query's order but makes no candidate.
    frequency = t_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    needed = F.greatest(F.ceil(F.col("n") * F.lit(min_share)).cast("int"), F.lit(1))
    ordered = stage(q_grams.join(frequency, "gram")
                    .groupBy("query", "n")  # as many rows as one text has grams
                    .agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("known"))
                    .withColumn("needed", needed)
                    .withColumn("early", F.expr("(needed + 1) div 2").cast("int"))
                    .filter(F.size("known") >= F.col("needed")))
    rare = ordered.select("query", "early", F.explode(F.slice(
        "known", F.lit(1), F.size("known") - F.col("needed") + F.col("early"))).alias("g"))
    candidates = (rare.select("query", "early", "g.gram").join(t_grams, "gram")
                  .groupBy("query", "early", "hit_id").agg(F.count(F.lit(1)).alias("met"))
                  .filter(F.col("met") >= F.col("early")))
    shared = (candidates.select("query", "hit_id")
              .join(ordered.select("query", "n", F.explode("known.gram").alias("gram")), "query")
              .join(t_grams, ["hit_id", "gram"])
              .groupBy("query", "n", "hit_id").agg(F.count(F.lit(1)).alias("shared"))
              .withColumn("score", F.col("shared") / F.col("n"))
              .filter(F.col("score") >= min_share))
    best = (shared.groupBy("query")
            .agg(F.min_by(F.struct("hit_id", "shared", "score"),
                          F.struct(-F.col("shared"), F.col("hit_id"))).alias("b"))
            .select("query", "b.*"))
    return (keyed.select(query_id, "digest").join(q_texts.select("digest", "query"), "digest")
            .join(best, "query").select(query_id, "hit_id", "shared", "score"))
