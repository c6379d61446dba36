"""Problem 9: items into containers of fixed capacity with little room left.

Pattern packing. The items' lengths are counted (one row a length, at most `capacity` rows). On the driver, patterns
(a few lengths that fill a container) are enumerated from the histogram, non-negative least squares fits how often
each should be used so that together they consume the histogram, and the counts are rounded. What the fit leaves over
is fitted anew with patterns of its own, round after round, until no round fills a container; the last residuals are
packed by the same histogram, largest length first, filling each gap with the largest length that fits. The plan says,
for each length, which run of its items goes to which containers; the items look their place up by their rank within
their length. Nothing but the histogram and the plan, both bounded by the capacity, is ever on the driver.

Items longer than the capacity are cut: full containers first, the rest is an item like any other. No other item is
split. Ranks are taken in hash buckets, so no length, whatever its part of the rows, is sorted in one task.

Cases: items of length 0 (null and empty texts) need no room and are spread evenly over the containers (container null
if there is none); repeated rows are items of their own; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, prefix_sums
from .tokens import count_tokens

CAPACITY = 2_048
#: patterns offered to a fit, at most; there are as many as give each about USES containers; and rounds of fits
PATTERNS, USES, ROUNDS = 600, 4, 60
BUCKET_ROWS = 100_000
#: how a container was filled: by one item, by a pattern of the fit, from the residuals
WHOLE, FITTED, REST = "whole", "fitted", "rest"


@dataclass
class Plan:
    """runs[length] = [(first rank, last rank + 1, first container, items of this length in each container, how)]"""

    runs: dict[int, list[tuple[int, int, int, int, str]]]
    n_containers: int
    fitted: int


def enumerate_patterns(hist: np.ndarray, capacity: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """Patterns as rows of counts by length. Each begins with a length drawn by the room its items take, goes on with
    lengths drawn by their frequency, and ends with the largest length that still fits."""
    lengths = np.flatnonzero(hist[1:]) + 1
    mass = hist[lengths] * lengths
    starts = rng.choice(lengths, size=n, p=mass / mass.sum())
    draw = rng.choice(lengths, size=(n, 64), p=hist[lengths] / hist[lengths].sum())
    out = np.zeros((n, capacity + 1), np.float32)
    for i in range(n):
        room, j, k = capacity, 0, int(starts[i])
        while True:
            out[i, k] += 1
            room -= k
            if room < lengths[0]:
                break
            fits = lengths[np.searchsorted(lengths, room, "right") - 1]
            nxt = int(draw[i, j % 64])
            j += 1
            # close the gap once few documents remain to be added
            k = int(fits) if nxt > room or room - nxt < lengths[0] or j > 48 else nxt
    return np.unique(out, axis=0)


def nonnegative_fit(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """x >= 0 minimising |a.T x - h|^2 by block principal pivoting: patterns change between the active set (x = 0) and
    the passive one until every sign is right; where blocks go round in circles, one pattern changes at a time."""
    gram, rhs = a @ a.T + 1e-9 * np.eye(len(a)), a @ h
    x, y = np.zeros(len(a)), -rhs
    passive = np.zeros(len(a), bool)
    fewest, chances = len(a) + 1, 3
    for _ in range(10 * len(a) + 20):
        wrong = np.where(passive, x, y) < -1e-9
        n = int(wrong.sum())
        if not n:
            break
        if n < fewest:
            fewest, chances = n, 3
        elif chances:
            chances -= 1
        else:
            wrong = np.arange(len(a)) == np.flatnonzero(wrong)[-1]
        passive ^= wrong
        x, at = np.zeros(len(a)), np.flatnonzero(passive)
        if len(at):
            x[at] = np.linalg.solve(gram[np.ix_(at, at)], rhs[at])
        y = np.where(passive, 0.0, gram @ x - rhs)
    return np.maximum(x, 0)


def make_plan(hist: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, seed: int = 5) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for k, n in hist.items():
        if k > 0:
            left[k] = n
    rng = np.random.default_rng(seed)
    used = np.zeros(capacity + 1, np.int64)
    runs: dict[int, list[tuple[int, int, int, int, str]]] = {}
    containers = 0

    def put(lengths: np.ndarray, counts: np.ndarray, times: int, how: str) -> None:
        nonlocal containers
        for k, m in zip(lengths.tolist(), counts.tolist()):
            runs.setdefault(k, []).append((int(used[k]), int(used[k] + m * times), containers, m, how))
            used[k] += m * times
            left[k] -= m * times
        containers += times

    if left[capacity]:
        put(np.array([capacity]), np.array([1]), int(left[capacity]), WHOLE)
    fitted, least = 0, capacity
    for _ in range(rounds):
        need = float(left @ np.arange(capacity + 1)) / capacity
        if need < 2:
            break
        a = enumerate_patterns(left.astype(np.float64), capacity, int(min(PATTERNS, max(20, need // USES))), rng)
        x = nonnegative_fit(a.astype(np.float64), left.astype(np.float64))
        made = 0
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            lengths = np.flatnonzero(a[i])
            counts = a[i, lengths].astype(np.int64)
            times = int(min(np.round(x[i]), (left[lengths] // counts).min())) if lengths @ counts >= least else 0
            if times >= 1:
                put(lengths, counts, times, FITTED)
                made += times
        fitted += made
        if not made and not least:
            break
        if not made:
            least = 0  # where no pattern is full, those are taken that no item of the histogram can be added to
    # residuals: each pattern is repeated until one of its lengths runs out, so there are few of them
    while (top := np.flatnonzero(left)).size:
        room, counts = capacity, {}
        k = int(top[-1])
        while True:
            m = min(room // k, int(left[k]))
            counts[k] = m
            room -= k * m
            fits = top[(top <= room) & (top < k)]
            if not fits.size:
                break
            k = int(fits[-1])
        lengths, c = np.array(list(counts)), np.array(list(counts.values()))
        put(lengths, c, int(min(left[q] // n for q, n in counts.items())), REST)
    return Plan(runs, containers, fitted)


def pieces(lengths: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start_at, size): every item, cut only where it exceeds the capacity."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_ids") / F.lit(capacity)).cast("int"))
    cut_up = lengths.select(id_col, "n_ids", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return cut_up.select(id_col, "piece", (F.col("piece") * capacity).alias("start_at"), F.least(F.lit(capacity), F.col("n_ids") - F.col("piece") * capacity).alias("size"))


def pack_lengths(lengths: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start_at, size, container, how) from (id, n_ids); how the container was filled: whole, fitted, rest."""
    spark = lengths.sparkSession
    kind = lengths.schema[id_col].dataType.simpleString()
    items = pieces(lengths, id_col, capacity)
    hist = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # one row a length
    if not hist:
        return spark.createDataFrame([], f"`{id_col}` {kind}, piece int, start_at int, size int, container long, how string")
    plan = make_plan(hist, capacity)
    table = [(int(k), max(1, n // BUCKET_ROWS), plan.runs.get(k, [])) for k, n in hist.items()]
    where = spark.createDataFrame(table, "size int, buckets long, runs array<struct<lo:long,hi:long,first:long,each:long,how:string>>")
    hashed = items.join(F.broadcast(where), "size").withColumn("h", F.xxhash64(id_col, "piece")).withColumn("bucket", F.pmod("h", "buckets")).withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(hashed, ["size"], "bucket", ["h", id_col, "piece"], "one", "r")
    run = F.get(F.filter("runs", lambda x: (x["lo"] <= F.col("r")) & (F.col("r") < x["hi"])), 0)
    placed = ranked.withColumn("run", run)
    spare = F.col("r") % plan.n_containers if plan.n_containers else F.lit(None)
    container = F.when(F.col("size") > 0, F.col("run.first") + F.expr("(r - run.lo) div run.each")).otherwise(spare).cast("long")
    return placed.select(id_col, "piece", "start_at", "size", container.alias("container"), F.col("run.how").alias("how"))


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The same from texts, measured in tokens of a public tokenizer. The lengths are kept, the texts read once."""
    return pack_lengths(cut(count_tokens(df, id_col, text_col, path)), id_col, capacity)


def split_items(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id): items whose pieces lie in more than one container."""
    return packed.filter("size > 0").groupBy(id_col).agg(F.min("container").alias("lo"), F.max("container").alias("hi")).filter("lo < hi").select(id_col)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_pieces, n_ids, fill, fullest, n_whole, n_fitted, n_rest): how well the containers are used, and
    how many were filled by one item, by patterns of the fit and from its residuals."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("n"), F.max("how").alias("how"))
    how = [F.count_if(F.col("how") == h).alias(f"n_{h}") for h in (WHOLE, FITTED, REST)]
    return per.agg(F.count("container").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_ids"), F.round(F.sum("used") / (F.count("container") * F.lit(capacity)), 6).alias("fill"), F.max("used").alias("fullest"), *how)
