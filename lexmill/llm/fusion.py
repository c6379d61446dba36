"""Problem 5: one order from scores on unlike scales.

Each score becomes its percentile among the scored candidates of the same query, ties averaged, and then the normal
deviate of that percentile; the order is by the weighted mean of the deviates a candidate has. Only ranks enter, so
neither range nor shape of a score matters.

Cases: candidates delivered twice count once; null and NaN scores are neither for nor against: the mean is over the
scores there are; a candidate with no score at all has a null value and comes last; ties go to the lesser item id; a
query with one candidate gives that candidate; empty tables give no rows. Queries above `split_rows` candidates are
ranked by counted, range-partitioned values instead of a window; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import scattered_ranks

#: Coefficients of Wichura's algorithm AS 241 for the normal deviate, in double precision.
NEAR_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
NEAR_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
MID_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
MID_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
FAR_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
FAR_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)

#: score column -> (weight, sign): larger is better, except rel_pos, which is better nearer 0
DEFAULT_SCORES = {"lex_scores": (1.0, 1), "bm25": (1.0, 1), "dense_cos": (1.0, 1), "rel_pos": (1.0, 0)}


def _poly(x: Column, c: tuple[float, ...]) -> Column:
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = out * x + F.lit(k)
    return out


def normal_deviate(p: Column) -> Column:
    """Inverse of the normal distribution as a column expression (0 < p < 1)."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    near = q * _poly(r, NEAR_A) / _poly(r, NEAR_B)
    t = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    mid = _poly(t - 1.6, MID_C) / _poly(t - 1.6, MID_D)
    far = _poly(t - 5.0, FAR_E) / _poly(t - 5.0, FAR_F)
    return F.when(F.abs(q) <= 0.425, near).otherwise(F.signum(q) * F.when(t <= 5.0, mid).otherwise(far))


def _oriented(name: str, sign: int) -> Column:
    v = F.col(f"`{name}`").cast("double")
    v = F.when(~F.isnan(v), v)
    return v if sign > 0 else -v if sign < 0 else -F.abs(v)


#: candidates of a query up to which it is ranked by windows in one task (some seconds and 150 MB at this number)
SPLIT_ROWS = 500_000


def fused_scores(df: DataFrame, group_col: str = "qid", item_col: str = "pos", scores: dict[str, tuple[float, int]] | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(group, item, fused): one value a candidate.

    Most queries are ranked by window functions that share one shuffle by query; queries above `split_rows` go
    another way to the same values in which no task holds a whole query. Which way a query goes is found by a join,
    so nothing about the queries is brought to the driver but whether there is a large one at all. Rows without a
    group are one group, rows without an item one item.
    """
    scores = scores or DEFAULT_SCORES
    names = list(scores)
    base = df.select(F.col(f"`{group_col}`").alias("g"), F.col(f"`{item_col}`").alias("i"), *[_oriented(n, s).alias(f"s{k}") for k, (n, (_, s)) in enumerate(scores.items())])
    vals = [f"s{k}" for k in range(len(names))]
    large = base.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > split_rows).select(F.col("g").alias("large"))
    same = F.col("g").eqNullSafe(F.col("large"))
    weights = [scores[n][0] for n in names]

    def fuse(d: DataFrame, p: list[Column]) -> DataFrame:
        top = sum((F.coalesce(normal_deviate(x) * w, F.lit(0.0)) for x, w in zip(p, weights)), F.lit(0.0))
        low = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in zip(p, weights)), F.lit(0.0))
        return d.select(F.col("g").alias(group_col), F.col("i").alias(item_col), F.when(low > 0, top / low).alias("fused"))

    def windowed(d: DataFrame) -> DataFrame:
        d = d.repartition("g").groupBy("g", "i").agg(*[F.max(v).alias(v) for v in vals])
        whole = Window.partitionBy("g")
        for v in vals:
            below = F.rank().over(whole.orderBy(v))  # nulls come first
            same = F.count("*").over(Window.partitionBy("g", v))
            nulls = F.sum(F.col(v).isNull().cast("int")).over(whole)
            d = d.withColumn(f"p{v}", F.when(F.col(v).isNotNull(), (below - 1 - nulls + same * 0.5) / F.count(v).over(whole)))
        return fuse(d, [F.col(f"p{v}") for v in vals])

    def scattered(d: DataFrame) -> DataFrame:
        # the joins below lose null keys, so a null has a stand-in: no other value is written without the leading sign
        named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"{c}k") for c in ("g", "i")]
        d = d.groupBy("g", "i").agg(*[F.max(v).alias(v) for v in vals]).select("*", *named)
        long = d.select("gk", "ik", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in range(len(vals))]), F.array(*vals))).alias("k", "v")).filter("v is not null")
        ranks = scattered_ranks(long.select("gk", "k", "v"), ["gk", "k"], "v")
        # a value that many candidates share is one row of `ranks`: it is joined to its candidates in `parts` shares
        parts = 16
        salted = long.withColumn("z", F.pmod(F.xxhash64("ik"), F.lit(parts)))
        ranks = ranks.withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        p = salted.join(ranks, ["gk", "k", "v", "z"]).withColumn("p", (F.col("n_below") + F.col("n_same") * 0.5) / F.col("n_all"))
        wide = p.groupBy("gk", "ik").agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{v}") for k, v in enumerate(vals)])
        return fuse(d.select("g", "i", "gk", "ik").join(wide, ["gk", "ik"], "left"), [F.col(f"p{v}") for v in vals])

    if not large.limit(1).count():
        return windowed(base)
    return windowed(base.join(large, same, "left_anti")).unionByName(scattered(base.join(large, same, "left_semi")))


def first_of_each(fused: DataFrame, group_col: str = "qid", item_col: str = "pos") -> DataFrame:
    """(group, item): the first candidate of each query; map-side combined, so a hot query is no burden."""
    key = F.struct(F.coalesce(F.round("fused", 9), F.lit(float("-inf"))).alias("f"), (-F.col(item_col)).alias("i"))
    return fused.groupBy(group_col).agg(F.max(key).alias("k")).select(group_col, (-F.col("k.i")).alias(item_col))


def fused_order(fused: DataFrame, group_col: str = "qid", item_col: str = "pos", top: int = 10) -> DataFrame:
    """(group, item, fused, place): the `top` first candidates of each query."""
    w = Window.partitionBy(group_col).orderBy(F.col("fused").desc_nulls_last(), item_col)
    return fused.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
