"""Measures: of triples and graphs, of texts and tool calls, thresholds for decoded probabilities."""

from __future__ import annotations

import json
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from lexmill.functions import text as T
from lexmill.operators.shared import value_ranks

NUMBER = r"-?\d+(?:[.,]\d+)?"


def prf1(pred: DataFrame, gold: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """(by..., precision, recall, f1) of distinct rows; a group empty on one side scores 0."""
    p = pred.select(*by, *keys).distinct().withColumn("__p", F.lit(1))
    g = gold.select(*by, *keys).distinct().withColumn("__g", F.lit(1))
    j = p.join(g, [*by, *keys], "full_outer").groupBy(*by).agg(F.sum(F.col("__p") * F.col("__g")).alias("tp"), F.sum("__p").alias("np"), F.sum("__g").alias("ng"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    pr = F.when(z("np") > 0, z("tp") / z("np")).otherwise(0.0)
    rc = F.when(z("ng") > 0, z("tp") / z("ng")).otherwise(0.0)
    return j.select(*by, pr.alias("precision"), rc.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def edit_distance(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ged, ged_norm): sizes of the symmetric differences of nodes and of edges; also as a share of all sizes."""

    def parts(df: DataFrame, tag: str) -> DataFrame:
        e = df.select(*by, F.concat_ws("\x01", "s", "r", "o").alias("k")).distinct().withColumn("kind", F.lit("e"))
        n = df.select(*by, F.explode(F.array("s", "o")).alias("k")).distinct().withColumn("kind", F.lit("n"))
        return e.unionByName(n).withColumn(tag, F.lit(1))

    j = parts(pred, "a").join(parts(gold, "b"), [*by, "k", "kind"], "full_outer")
    diff = F.sum(F.when(F.col("a").isNull() | F.col("b").isNull(), 1).otherwise(0))
    size = F.sum(F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)))
    return j.groupBy(*by).agg(diff.alias("ged"), F.when(size > 0, diff / size).otherwise(0.0).alias("ged_norm"))


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., n, one column a share): exact percentiles, interpolated between neighbours. Values are counted and ranked
    in ranges, so no task holds all values of a group; n counts the values that are not null."""
    r = value_ranks(df.select(*by, value), by, value)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("n_below") <= place) & (place < F.col("n_below") + F.col("n_same")), F.col(value)))

    ends = []
    for name, q in shares.items():
        place = (F.col("n_all") - 1) * F.lit(float(q))
        ends += [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi")]
    got = r.groupBy(*by).agg(F.max("n_all").alias("n"), *ends)
    part = lambda q: (F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q)))
    return got.select(*by, "n", *[(F.col(f"{k}_lo") * (1 - part(q)) + F.col(f"{k}_hi") * part(q)).alias(k) for k, q in shares.items()])


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, median, p10, p90), percentiles interpolated."""
    return percentiles(df, by, value, {"median": 0.5, "p10": 0.1, "p90": 0.9})


def exact_match(a: Column, b: Column) -> Column:
    return T.one_line(a) == T.one_line(b)


def number_fidelity(ref: Column, hyp: Column) -> Column:
    """Share of the reference's numbers, as a multiset, that the other text keeps; null without numbers."""
    r = F.regexp_extract_all(ref, F.lit(NUMBER), F.lit(0))
    h = F.regexp_extract_all(hyp, F.lit(NUMBER), F.lit(0))
    kept = F.aggregate(F.array_distinct(r), F.lit(0), lambda a, x: a + F.least(F.size(F.filter(r, lambda y: y == x)), F.size(F.filter(h, lambda y: y == x))))
    return F.when(F.size(r) > 0, kept / F.size(r))


def chrf_score(ref: str, hyp: str, order: int = 6, beta: float = 2.0) -> float:
    """Character n-gram F-score in percent: n-grams of 1 to 6 characters without white space, recall weighing twice."""
    a, b = "".join(ref.split()), "".join(hyp.split())
    total = used = 0.0
    for n in range(1, order + 1):
        x, y = Counter(a[i : i + n] for i in range(len(a) - n + 1)), Counter(b[i : i + n] for i in range(len(b) - n + 1))
        if not x and not y:
            continue
        nx, ny, same = sum(x.values()), sum(y.values()), sum((x & y).values())
        if not nx or not ny:
            continue
        p, r = same / ny, same / nx
        used += 1
        total += (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0
    return 100 * total / used if used else 0.0


@F.pandas_udf(DoubleType())
def chrf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else chrf_score(a, b) for a, b in zip(ref, hyp)])


def json_valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


@F.pandas_udf(BooleanType())
def json_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equal as JSON, whatever the order of keys."""

    def one(x: str | None, y: str | None) -> bool:
        try:
            return json.loads(x) == json.loads(y)
        except (ValueError, TypeError):
            return False

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def tool_call(c: Column) -> Column:
    """struct<name, arguments: map<string, string>>, null for what is no call."""
    parsed = F.try_parse_json(c)
    return F.struct(F.try_variant_get(parsed, "$.name", "string").alias("name"), F.try_variant_get(parsed, "$.arguments", "map<string,string>").alias("arguments"))


def call_items(c: Column) -> Column:
    """array<string>: the name and each argument, as key=value."""
    t = tool_call(c)
    args = F.transform(F.map_entries(F.coalesce(t["arguments"], F.create_map().cast("map<string,string>"))), lambda e: F.concat(F.lit("arg:"), e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.when(t["name"].isNotNull(), F.array_distinct(F.concat(F.array(F.concat(F.lit("name="), t["name"])), args)))


def call_exact(a: Column, b: Column) -> Column:
    x, y = call_items(a), call_items(b)
    return F.coalesce(F.array_sort(x) == F.array_sort(y), F.lit(False))


def call_f1(a: Column, b: Column) -> Column:
    x, y = call_items(a), call_items(b)
    same = F.size(F.array_intersect(x, y))
    return F.when(x.isNull() | y.isNull(), 0.0).otherwise(2.0 * same / (F.size(x) + F.size(y)))


def call_triples(calls: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, s, r, o): the star of a call: its root, and name, query, limit and verbosity as labelled values."""
    t = tool_call(F.col(text))
    d = calls.select(F.col(id_col).alias("id"), t.alias("t")).filter("t.name is not null")
    items = F.array(
        F.struct(F.lit("has_name").alias("r"), F.concat(F.lit("tool:"), "t.name").alias("o")),
        F.struct(F.lit("has_query").alias("r"), F.concat(F.lit("query:"), F.try_element_at("t.arguments", F.lit("query"))).alias("o")),
        F.struct(F.lit("has_limit").alias("r"), F.concat(F.lit("limit:"), F.try_element_at("t.arguments", F.lit("limit"))).alias("o")),
        F.struct(F.lit("has_verbose").alias("r"), F.concat(F.lit("bool:"), F.initcap(F.try_element_at("t.arguments", F.lit("verbose")))).alias("o")),
    )
    return d.select("id", F.lit("ROOT").alias("s"), F.explode(items).alias("x")).select("id", "s", "x.r", "x.o").filter("o is not null")


def otsu(probs: DataFrame, by: list[str], value: str = "p", bins: int = 64) -> DataFrame:
    """(by..., threshold): the cut of the histogram over [0, 1] with the largest variance between classes; of a flat
    maximum the middle, at the bin's upper edge; 0.5 for nothing."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    h = probs.filter(F.col(value).between(0, 1)).groupBy(*by, b.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    grid = probs.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    whole, run = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = grid.join(h, [*by, "bin"], "left").fillna(0.0, ["n"]).withColumn("w", F.col("n") / F.greatest(F.sum("n").over(whole), F.lit(1.0)))
    c = F.col("w") * ((F.col("bin") + 0.5) / bins)
    d = d.withColumn("omega", F.sum("w").over(run)).withColumn("mu", F.sum(c).over(run)).withColumn("all", F.sum(c).over(whole))
    d = d.withColumn("s", F.pow(F.col("all") * F.col("omega") - F.col("mu"), F.lit(2)) / F.greatest(F.col("omega") * (1 - F.col("omega")), F.lit(1e-12)))
    flat = d.withColumn("top", F.max("s").over(whole)).filter(F.col("s") >= F.col("top") - 1e-12)
    k = flat.groupBy(*by).agg(F.sort_array(F.collect_list("bin")).alias("bins"))  # at most `bins` members
    return k.select(*by, ((F.element_at("bins", F.floor(F.size("bins") / 2).cast("int") + 1) + 1) / bins).alias("threshold"))


def noise_floor(probs: DataFrame, by: list[str], value: str = "p", q: float = 0.995, margin: float = 0.05, cap: float = 0.5, relations: int | None = None) -> DataFrame:
    """(by..., threshold): the quantile of the probabilities and a margin, held to the cap."""
    if relations:
        q = min(q, 1.0 - 1.0 / relations)
    return percentiles(probs, by, value, {"q": q}).select(*by, F.least(F.col("q") + margin, F.lit(cap)).alias("threshold"))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def decoded(nodes: DataFrame, cells: DataFrame, at: float = 0.5, adjacency: float | None = None, force_first: bool = False) -> DataFrame:
    """(id, i, r, j, p, forced) from logits in rows: nodes (id, i, exist), cells (id, r, i, j, adj).

    An edge is kept if both ends are present and its probability is above the threshold; no edge joins a node to itself.
    With force_first a sample that would be empty gives its best cell by adj x exist x exist.
    """
    n = nodes.select("id", F.col("i").alias("k"), sigmoid(F.col("exist")).alias("e"))
    c = cells.filter("i <> j").select("id", "r", "i", "j", sigmoid(F.col("adj")).alias("p"))
    c = c.join(n.withColumnsRenamed({"k": "i", "e": "ei"}), ["id", "i"]).join(n.withColumnsRenamed({"k": "j", "e": "ej"}), ["id", "j"])
    kept = c.filter((F.col("ei") > at) & (F.col("ej") > at) & (F.col("p") > (at if adjacency is None else adjacency))).select("id", "i", "r", "j", "p", F.lit(False).alias("forced"))
    if not force_first:
        return kept
    best = c.groupBy("id").agg(F.max_by(F.struct("i", "r", "j", "p"), F.struct(F.round(F.col("p") * F.col("ei") * F.col("ej"), 9), -F.col("r"), -F.col("i"), -F.col("j"))).alias("b"))
    rest = best.join(kept.select("id").distinct(), "id", "left_anti").select("id", "b.i", "b.r", "b.j", "b.p", F.lit(True).alias("forced"))
    return kept.unionByName(rest)


def penalty_shrink(l2: float, rows: int, steps: int = 2_000, lr: float = 0.1) -> float:
    """What a penalty alone leaves of a weight after all steps."""
    keep = 1.0 - lr * l2 / max(rows, 1)
    if not math.isfinite(keep) or keep <= 0:
        raise ValueError("the penalty is too large for this step size and number of rows")
    return keep**steps


def l2_for_shrink(shrink: float, rows: int, steps: int = 2_000, lr: float = 0.1) -> float:
    if not 0.0 < shrink <= 1.0:
        raise ValueError("shrink must be in (0, 1]")
    return max(rows, 1) * (1.0 - shrink ** (1.0 / steps)) / lr
