"""Problem 1: how strongly each term marks its record among all records.

Divergence from randomness with the geometric collection model, Laplace after-effect and length-normalised frequency:

    tfn   = tf * log2(1 + c * mean length / length)
    score = (log2(1 + m) + tfn * log2((1 + m) / m)) / (tfn + 1),      m = collection frequency / records

A term found everywhere has a large m and carries little information; the division by tfn + 1 keeps a term that is
merely repeated from outgrowing a rare one. The parameter c of the length normalisation is 0.25 here: records are
short, and with a smaller c a term that occurs once, in this record alone, does not outweigh one that recurs.

Cases: records delivered twice count once; null and empty token lists and lists whose members have nothing left give
no rows (and count for neither the number of records nor the mean length); null and blank members are no terms; ties
go to the term with the higher frequency, then the rarer one, then the lesser by code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import join_skewed, pick

#: parameter of the length normalisation
C = 0.25
#: Fixed value: blanks, control characters and punctuation at either end are no part of a term.
EDGE = r"^[\p{P}\p{Z}\p{Cc}\s]+|[\p{P}\p{Z}\p{Cc}\s]+$"


def clean_term(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), EDGE, "")


def term_frequencies(df: DataFrame, id_col: str = "qid", tokens_col: str = "q_tokens") -> DataFrame:
    """(id, term, tf, length): one row a record and term. One shuffle, by record."""
    one = pick(df, **{"id": id_col, "tokens": tokens_col}).groupBy("id").agg(F.max("tokens").alias("tokens"))
    terms = F.filter(F.transform(F.filter("tokens", lambda t: t.isNotNull()), clean_term), lambda t: F.length(t) > 0)
    listed = one.select("id", terms.alias("terms")).filter(F.size("terms") > 0)
    return listed.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def distinctiveness(df: DataFrame, id_col: str = "qid", tokens_col: str = "q_tokens", c: float = C) -> DataFrame:
    """(id, term, tf, cf, score): every term of every record.

    Statistics of the few terms that hold a large part of all rows are broadcast, all others are joined by a shuffle.
    """
    tf = term_frequencies(df, id_col, tokens_col)
    n, total = tf.agg(F.countDistinct("id"), F.sum("tf")).first()
    n, total = n or 0, total or 0
    mean = total / max(n, 1)
    stats = tf.groupBy("term").agg(F.sum("tf").alias("cf"))
    m = F.col("cf") / F.lit(float(max(n, 1)))
    tfn = F.col("tf") * F.log2(F.lit(1.0) + F.lit(float(c * mean)) / F.col("length"))
    score = (F.log2(1 + m) + tfn * F.log2((1 + m) / m)) / (tfn + 1)
    return join_skewed(tf, stats, "term", "cf", total).select(F.col("id").alias(id_col), "term", "tf", "cf", score.alias("score"))


def most_distinctive(df: DataFrame, id_col: str = "qid", tokens_col: str = "q_tokens") -> DataFrame:
    """(id, term): the first term of each record by score."""
    scored = distinctiveness(df, id_col, tokens_col).withColumn("key", F.struct(F.round("score", 9).alias("s"), F.col("tf").alias("t"), (-F.col("cf")).alias("c")))
    per_key = scored.groupBy(id_col, "key").agg(F.min("term").alias("term"))
    return per_key.groupBy(id_col).agg(F.max_by("term", "key").alias("term"))
