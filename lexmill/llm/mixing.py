"""Problem 4: a mix in which each source has its share.

The mix has as many characters as all documents together. The documents of a source are shuffled, anew for each
repetition, and used in that order as long as they stay within the source's target; what is then left of the target is
filled with shorter ones, the longer before the shorter, and with one more if that comes nearer. So a source that has
enough differs from its target by less than a document, whatever the size of the mix. A source that has not enough is
in the mix with each document max_repeat times, and the report says so.

The mix is laid out in slots. Slot i stands at the point frac((i + 1/2) * golden ratio); the cumulative shares of the
sources say whose slot it is, so every stretch of the mix, however short, has nearly the shares reached. A source's uses
are cut into as many equal blocks as it has slots; the n-th slot takes the n-th block. There are as many slots as give
the smallest source LEAST_SLOTS of them, and no slot is longer than `slot` characters.

Running sums are made in hash buckets, so no source, whatever its part of the rows, is sorted in one task.

Cases: names are compared without case and outer blanks; documents of no listed source, and those with null, zero or
negative sizes, are not in the mix (null sizes count 0); a source with no documents is reported with 0; specs repeated
under one name count once; empty tables give an empty mix.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, prefix_sums

GOLDEN = 0.6180339887498949
#: characters a slot, at most
SLOT = 65_536
#: slots of the smallest source, about, at least
LEAST_SLOTS = 32
#: rows a bucket of the running sums
BUCKET_ROWS = 100_000


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def _sized(docs: DataFrame, id_col: str, source_col: str, size_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), source_key(F.col(f"`{source_col}`")).alias("key"), F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0)).alias("size"))


def _specs(specs: DataFrame) -> DataFrame:
    s = specs.select(source_key(F.col("name")).alias("key"), F.col("name"), F.col("pct").cast("double").alias("pct"), F.col("max_repeat").cast("long").alias("max_repeat"))
    return s.filter("key is not null").groupBy("key").agg(F.min("name").alias("name"), F.max_by("pct", F.col("name")).alias("pct"), F.max_by("max_repeat", F.col("name")).alias("max_repeat"))


def source_supply(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars") -> list[dict]:
    """One entry a source: supply, documents, target, copies needed. As many entries as specs, so the driver holds them."""
    sized = _sized(docs, id_col, source_col, size_col)
    per = {r["key"]: r for r in sized.groupBy("key").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n")).join(F.broadcast(_specs(specs).select("key")), "key", "left_semi").collect()}
    total = sized.agg(F.sum("size")).first()[0] or 0
    out = []
    for s in sorted(_specs(specs).collect(), key=lambda r: r["key"]):
        pct, most = s["pct"] or 0.0, max(s["max_repeat"] or 0, 0)
        supply, n = (per[s["key"]]["size"], per[s["key"]]["n"]) if s["key"] in per else (0, 0)
        target = total * pct / 100
        copies = min(most, math.ceil(target / supply)) if supply and target else 0
        out.append({"key": s["key"], "name": s["name"], "pct": pct, "max_repeat": most, "supply": int(supply), "n_docs": int(n), "total": int(total), "target": target, "copies": int(copies)})
    return out


def _uses(sized: DataFrame, first: str, last: str, seed: int) -> DataFrame:
    """One row a use: repeats `first` to `last` of each document, with its place (bucket, h, id) in the shuffled order."""
    each = sized.withColumn("repeat", F.explode(F.expr(f"sequence(cast({first} as int), cast({last} as int))"))).withColumn("h", F.xxhash64("id", "repeat", F.lit(seed)))
    # a document longer than what the last repetition has to spare cannot be left out of it: these go first, the longest ahead
    needed = F.when((F.col("repeat") == F.col("copies")) & (F.col("surplus") >= 0) & (F.col("size") > F.col("surplus")), -F.length(F.bin("size"))).otherwise(0)
    return each.withColumn("bucket", F.struct("repeat", needed.alias("needed"), F.pmod("h", "buckets").alias("b")))


def _filled(uses: pa.Table) -> pa.Table:
    """The uses that fill a source's gap: longer before shorter as far as they fit, and one more if that is nearer."""
    size, bits, below = (uses[c].to_numpy() for c in ("size", "bits", "below"))
    order, gap, picks = np.lexsort((below, -bits)), uses["gap"][0].as_py(), []
    for i in order:
        if size[i] <= gap:
            picks.append(i)
            gap -= int(size[i])
    rest = order[~np.isin(order, picks)]
    if len(rest):
        i = rest[np.argmin(np.abs(size[rest] - gap))]
        if size[i] < 2 * gap:
            picks.append(i)
    out = uses.take(pa.array(picks, pa.int64()))
    start = uses["taken"][0].as_py() + np.cumsum([0, *size[picks]])[:-1] if picks else []
    return out.select(["id", "src", "name", "repeat", "size"]).append_column("start", pa.array(start, pa.int64()))


def _gap_uses(runs: DataFrame, sized: DataFrame, gaps: list[tuple], seed: int) -> DataFrame:
    """(id, src, name, repeat, size, start): the uses that follow those within the target. gaps: (src, gap, taken).

    Only uses shorter than twice the gap can bring a source nearer to its target, and of those with equally many
    bits no more than the gap holds: at most two rows for each character of the gap enter the fill.
    """
    g = F.broadcast(runs.sparkSession.createDataFrame(gaps, "src int, gap double, taken long"))
    late = runs.filter("start + size > target").drop("start").join(g, "src").filter("size < 2 * gap")
    more = _uses(sized.join(g, "src").filter("size < 2 * gap and copies < max_repeat"), "copies + 1", "least(max_repeat, copies + 1 + ceil(gap / size))", seed)
    uses = late.unionByName(more).withColumn("bits", F.length(F.bin("size")))
    near = prefix_sums(uses, ["src", "bits"], "bucket", ["h", "id"], "size", "below").filter("below < gap")
    kind = runs.schema["id"].dataType.simpleString()
    return near.select("id", "src", "name", "repeat", "size", "bits", "below", "gap", "taken").groupBy("src").applyInArrow(_filled, f"id {kind}, src int, name string, repeat int, size long, start long")


def mix_schedule(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", slot: int = SLOT, seed: int = 7, supply: list[dict] | None = None) -> DataFrame:
    """(id, name, repeat, n_chars, slot, at): every use of a document in the mix; (slot, at) is its place."""
    spark = docs.sparkSession
    supply = supply or source_supply(docs, specs, id_col, source_col, size_col)
    owners = [s for s in supply if s["pct"] > 0]
    plan = [(s["key"], k, s["name"], s["copies"], s["max_repeat"], float(s["target"]), float(s["supply"] * s["copies"] - s["target"]), max(1, s["n_docs"] * s["copies"] // BUCKET_ROWS)) for k, s in enumerate(owners) if s["copies"]]
    empty = spark.createDataFrame([], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, name string, repeat int, n_chars long, slot long, at long")
    if not plan:
        return empty
    sized = _sized(docs, id_col, source_col, size_col).filter("size > 0").join(F.broadcast(spark.createDataFrame(plan, "key string, src int, name string, copies long, max_repeat long, target double, surplus double, buckets long")), "key")
    runs = prefix_sums(_uses(sized, "1", "copies", seed), ["src"], "bucket", ["h", "id"], "size", "start")
    cols = ["id", "src", "name", "repeat", "size", "start"]
    chosen = runs.filter("start + size <= target").select(*cols)
    taken = {r["src"]: r["n"] for r in chosen.groupBy("src").agg(F.sum("size").alias("n")).collect()}
    gaps = [(k, s["target"] - taken.get(k, 0), taken.get(k, 0)) for k, s in enumerate(owners) if s["copies"] and taken.get(k, 0) < s["supply"] * s["max_repeat"]]
    if gaps := [g for g in gaps if g[1] > 0.5]:
        extra = cut(_gap_uses(runs, sized, gaps, seed))
        chosen = chosen.unionByName(extra.select(*cols))
        for r in extra.groupBy("src").agg(F.sum("size").alias("n")).collect():
            taken[r["src"]] = taken.get(r["src"], 0) + r["n"]
    if not taken:
        return empty

    whole = max(100.0, sum(s["pct"] for s in owners))
    n_slots = max(math.ceil(owners[0]["total"] / slot), math.ceil(LEAST_SLOTS * whole / min(owners[k]["pct"] for k in taken)))
    shares, run = [], 0.0
    for s in owners:
        run += s["pct"] / whole
        shares.append(run)
    u = F.expr(f"(id + 0.5D) * {GOLDEN!r}D - floor((id + 0.5D) * {GOLDEN!r}D)")
    whose = F.size(F.filter(F.array(*[F.lit(x) for x in shares]), lambda b: b <= u))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), whose.alias("src"), F.expr(f"id div {BUCKET_ROWS}").alias("bucket"), F.lit(1).alias("one")).filter(F.col("src").isin(list(taken)))
    has = {r["src"]: r["n"] for r in slots.groupBy("src").agg(F.count("*").alias("n")).collect()}
    slots = prefix_sums(slots, ["src"], "bucket", ["slot"], "one", "nth").select("slot", "src", "nth")

    sums = F.broadcast(spark.createDataFrame([(k, n, has[k]) for k, n in taken.items()], "src int, used long, slots long"))
    along = "cast(start as decimal(19, 0)) * cast(slots as decimal(19, 0))"
    blocks = chosen.join(sums, "src").withColumn("nth", F.expr(f"{along} div used")).withColumn("at", F.expr(f"({along} - cast(nth as decimal(19, 0)) * cast(used as decimal(19, 0))) div slots"))
    return blocks.join(slots, ["src", "nth"]).select(F.col("id").alias(id_col), "name", "repeat", F.col("size").alias("n_chars"), "slot", "at")


def mix_report(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", slot: int = SLOT) -> DataFrame:
    """(name, target_pct, actual_pct, n_chars, n_uses, most_repeat, short): what the mix came to, one row a source.

    short: the mix uses each document of the source max_repeat times and holds less of it than its target (compared in
    integers).
    """
    spark = docs.sparkSession
    supply = source_supply(docs, specs, id_col, source_col, size_col)
    made = mix_schedule(docs, specs, id_col, source_col, size_col, slot, supply=supply).groupBy("name").agg(F.sum("n_chars").alias("made"), F.count("*").alias("uses"), F.max("repeat").alias("most"))
    rows = [(s["name"], s["pct"], s["total"], s["n_docs"] * s["max_repeat"]) for s in supply]
    want = spark.createDataFrame(rows, "name string, target_pct double, total long, all_uses long")
    n, uses = F.coalesce("made", F.lit(0)), F.coalesce("uses", F.lit(0))
    short = (uses == F.col("all_uses")) & (n * 100 < F.col("target_pct") * F.col("total"))
    actual = F.when(F.col("total") > 0, n * 100.0 / F.col("total"))
    return want.join(made, "name", "left").select("name", "target_pct", actual.alias("actual_pct"), n.alias("n_chars"), uses.alias("n_uses"), F.coalesce("most", F.lit(0)).alias("most_repeat"), short.alias("short"))
