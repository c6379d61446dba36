"""Operators on tables: distinctive terms, mixing, fusion, vectors, packing."""

import math
import random
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexmill.llm import distinctive, fusion, mixing, packing, vectors
from lexmill.llm._common import join_skewed, prefix_sums, scattered_ranks

# ---- shared helpers ----


def test_running_sums_of_a_hot_group(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.col("id").alias("o"), (F.col("id") % 5).alias("v"), (F.col("id") / 300).cast("int").alias("b"))
    rows = sorted((r["g"], r["o"], r["v"], r["x"]) for r in prefix_sums(df, ["g"], "b", ["o"], "v", "x").collect())
    run = Counter()
    for g, _, v, x in rows:
        assert x == run[g]
        run[g] += v


def test_skewed_join_loses_nothing(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    stats = rows.groupBy("k").agg(F.count("*").alias("c"))
    got = join_skewed(rows, stats, "k", "c", 3000, share=10)
    assert got.count() == 3000 and got.filter("k = 'hot' and c = 1000").count() == 1000


def test_scattered_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), round(rng.random(), 1)) for _ in range(2000)]
    got = {(r["g"], r["v"]): (r["n_below"], r["n_same"], r["n_all"]) for r in scattered_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g, v in set(rows):
        own = [x for h, x in rows if h == g]
        assert got[g, v] == (sum(x < v for x in own), own.count(v), len(own))


# ---- distinctive terms ----


def test_distinctive_terms(spark):
    rows = [(1, ["Zork?", "zork", "the", None, " "]), (1, ["Zork?", "zork", "the", None, " "]), (2, ["the", "the", "the", "cat"]), (3, None), (4, []), (5, ["", "?!"]), (6, ["the", "zork,"]), (7, ["the", "cat"])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "qid long, q_tokens array<string>, term string")
    s = {(r["qid"], r["term"]): r for r in distinctive.distinctiveness(df).collect()}
    docs = {1: ["zork", "zork", "the"], 2: ["the", "the", "the", "cat"], 6: ["the", "zork"], 7: ["the", "cat"]}
    cf = Counter(t for d in docs.values() for t in d)
    mean = sum(map(len, docs.values())) / len(docs)
    assert set(s) == {(q, t) for q, d in docs.items() for t in d}
    for (q, t), r in s.items():
        m, f = cf[t] / len(docs), docs[q].count(t) * math.log2(1 + distinctive.C * mean / len(docs[q]))
        assert r["score"] == pytest.approx((math.log2(1 + m) + f * math.log2((1 + m) / m)) / (f + 1))
    best = {r["qid"]: r["term"] for r in distinctive.most_distinctive(df).collect()}
    assert best == {q: max((t for p, t in s if p == q), key=lambda t: s[q, t]["score"]) for q in docs}
    many = spark.createDataFrame([(i, ["the", "a", "the"] + (["zork", "zork"] if i < 3 else [f"w{i % 40}"]) + [f"u{i}"]) for i in range(200)], "qid long, q_tokens array<string>")
    top = {r["qid"]: r["term"] for r in distinctive.most_distinctive(many).collect()}
    assert top[0] == top[1] == top[2] == "zork"  # recurring and shared, above what occurs once and in one record only
    assert distinctive.most_distinctive(df.limit(0)).count() == 0


# ---- fusion ----


def brute_fusion(rows, scores):
    out, groups = {}, defaultdict(dict)
    for q, i, *v in rows:
        groups[q][i] = v
    for q, items in groups.items():
        z = defaultdict(list)
        for k, (_, sign) in enumerate(scores.values()):
            have = {i: (v[k] if sign > 0 else -abs(v[k])) for i, v in items.items() if v[k] is not None and not math.isnan(v[k])}
            for i, x in have.items():
                p = (sum(y < x for y in have.values()) + 0.5 * sum(y == x for y in have.values())) / len(have)
                z[i].append(NormalDist().inv_cdf(p))
        for i in items:
            out[q, i] = sum(z[i]) / len(z[i]) if z[i] else None
    return out


def test_fusion_equals_brute_force_both_ways(spark):
    rng = random.Random(4)
    pick = lambda: rng.choice([None, math.nan, round(rng.random(), 1), rng.random() * 1000])
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, pick(), pick(), pick(), rng.random()) for i in range(300)]
    rows += rows[:20] + [(9, 1, None, None, None, None), (9, 2, None, None, None, math.nan), (10, 5, 1.0, None, None, None)]
    names = list(fusion.DEFAULT_SCORES)
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "qid long, pos long, " + ", ".join(f"{n} double" for n in names) + ", fused double")
    want = brute_fusion(rows, fusion.DEFAULT_SCORES)
    for split in (10**6, 20):
        f = fusion.fused_scores(df, split_rows=split)
        got = {(r["qid"], r["pos"]): r["fused"] for r in f.collect()}
        assert set(got) == set(want)
        for k, v in want.items():
            assert (v is None and got[k] is None) or got[k] == pytest.approx(v, abs=1e-8)
        first = {r["qid"]: r["pos"] for r in fusion.first_of_each(f).collect()}
        assert first[9] == 1 and first[10] == 5
    assert fusion.fused_scores(df.limit(0)).count() == 0


def test_fusion_of_a_large_group_without_a_key(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, None, 1, 2]), rng.choice([None, *range(60)]), rng.random(), rng.random(), None, rng.random()) for _ in range(150)]
    rows = list({r[:2]: r for r in rows}.values())
    names = list(fusion.DEFAULT_SCORES)
    df = spark.createDataFrame(rows, "qid long, pos long, " + ", ".join(f"{n} double" for n in names))
    want = brute_fusion(rows, fusion.DEFAULT_SCORES)
    n = Counter(r[0] for r in rows)
    assert n[None] > max(n[1], n[2])
    got = {(r["qid"], r["pos"]): r["fused"] for r in fusion.fused_scores(df, split_rows=max(n[1], n[2])).collect()}
    assert got == pytest.approx(want, abs=1e-8)


# ---- mixing ----


def mix_fixture(spark, n=900):
    rng = random.Random(5)
    docs = [(i, rng.choice(["A", " a ", "a", "b", "B", "x", None]), rng.choice([None, 0, 40, 90, 200])) for i in range(n)]
    specs = [("A", 50, 3), ("b", 20, 2), ("c", 10, 4), ("d", 20, 1)]
    return (docs, specs, spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, n_chars long, slot int"), spark.createDataFrame(specs, "name string, pct int, max_repeat int"))


def test_mix_reaches_its_targets(spark):
    docs, specs, d, s = mix_fixture(spark)
    total = sum(x[2] or 0 for x in docs)
    rep = {r["name"]: r for r in mixing.mix_report(d, s, slot=512).collect()}
    for name, pct, most in specs:
        supply = sum(x[2] or 0 for x in docs if x[1] and x[1].strip().lower() == name.lower())
        assert rep[name]["short"] == (supply * most * 100 < pct * total)
        if not rep[name]["short"]:
            assert abs(rep[name]["actual_pct"] - pct) < 1.5
        assert rep[name]["most_repeat"] <= most
    uses = mixing.mix_schedule(d, s, slot=512).collect()
    assert max(Counter((u["doc_id"], u["repeat"]) for u in uses).values()) == 1
    # every stretch of the mix has nearly the target shares
    slots = sorted({u["slot"] for u in uses})
    half = [u for u in uses if u["slot"] < slots[len(slots) // 2]]
    a = sum(u["n_chars"] for u in half if u["name"] == "A") / (total / 2)
    assert abs(a - 0.5) < 0.05


def test_mix_buckets_do_not_change_shares(spark, monkeypatch):
    _, _, d, s = mix_fixture(spark)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rep = {r["name"]: r for r in mixing.mix_report(d, s, slot=512).collect()}
    assert abs(rep["A"]["actual_pct"] - 50) < 1.5


@pytest.mark.parametrize("scale", [1, 50])
def test_mix_shares_do_not_depend_on_size(spark, scale):
    """With the slot of the operator itself, sources of 1 % and a document longer than its source's target."""
    rng = random.Random(8)
    docs = [(i, rng.choice("abcd"), rng.randrange(20, 900)) for i in range(40 * scale)] + [(10**6, "e", 20_000)] + [(10**6 + i, "e", 31) for i in range(1, 30 * scale)]
    total = sum(x[2] for x in docs)
    specs = [("a", 90, 9), ("b", 5, 2), ("c", 1, 2), ("d", 1, 2), ("e", 2, 2), ("f", 1, 3)]
    d, s = spark.createDataFrame(docs, "doc_id long, source string, n_chars long"), spark.createDataFrame(specs, "name string, pct int, max_repeat int")
    uses = mixing.mix_schedule(d, s).collect()
    used = {(u["doc_id"], u["repeat"]) for u in uses}
    assert len(uses) == len(used) == len({(u["slot"], u["at"]) for u in uses})
    for name, pct, most in specs:
        got, target = sum(u["n_chars"] for u in uses if u["name"] == name), total * pct / 100
        left = [x[2] for x in docs if x[1] == name for r in range(1, most + 1) if (x[0], r) not in used]
        # no further use would bring the source nearer to its target
        assert all(abs(got + x - target) >= abs(got - target) for x in left)
        assert not left or scale == 1 or abs(got - target) < 0.01 * target
        assert bool(left) or got <= target + max(x[2] for x in docs) / 2


def test_every_stretch_of_the_mix_holds_the_shares(spark):
    """At each prefix of the slots every source has used the same part of what it has in the whole mix."""
    rng = random.Random(3)
    docs = [(i, rng.choices("abcd", (5, 3, 1, 1))[0], rng.randrange(20, 900)) for i in range(6000)]
    specs = [("a", 40, 3), ("b", 30, 3), ("c", 20, 3), ("d", 10, 3)]
    d, s = spark.createDataFrame(docs, "doc_id long, source string, n_chars long"), spark.createDataFrame(specs, "name string, pct int, max_repeat int")
    uses = mixing.mix_schedule(d, s, slot=8192).collect()
    last, whole = max(u["slot"] for u in uses) + 1, Counter()
    for u in uses:
        whole[u["name"]] += u["n_chars"]
    for share in (0.1, 0.25, 0.5, 0.75):
        part = Counter()
        for u in uses:
            part[u["name"]] += u["n_chars"] * (u["slot"] < share * last)
        assert all(abs(part[k] / whole[k] - share) < 0.03 for k in whole)


def test_mix_of_nothing(spark):
    _, _, d, s = mix_fixture(spark, 5)
    assert mixing.mix_schedule(d.limit(0), s).count() == 0 and mixing.mix_report(d.limit(0), s).count() == 4
    assert mixing.mix_report(d, s.limit(0)).count() == 0


# ---- vectors ----


def vector_fixture(spark, n=900, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    for i in range(0, n, 9):  # partners at various angles, and exact copies
        x[i] = x[(i + 6) % n] * 2 + rng.normal(size=64) * (0, 0.2, 0.5, 0.8)[i % 4]
    rows = [(i, x[i].tolist(), "ab"[i % 3 == 0]) for i in range(n)]
    rows += rows[:30] + [(n + 1, None, "a"), (n + 2, [0.0] * 64, "a"), (n + 3, [math.nan] + [1.0] * 63, "a"), (n + 4, [1.0] * 32, "a"), (n + 5, [math.inf] * 64, "a")]
    return x, spark.createDataFrame([(a, b, c, 0.5) for a, b, c in rows], "pos long, emb array<float>, encoder string, cos double")


@pytest.mark.parametrize("block", [8192, 60])
def test_pairs_lose_nothing(spark, monkeypatch, block):
    x, df = vector_fixture(spark)
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(c >= 0.9, 1))) if (i % 3 == 0) == (j % 3 == 0)}
    monkeypatch.setattr(vectors, "BLOCK", block)
    got = {(r["pos_a"], r["pos_b"]): r["cos"] for r in vectors.similar_pairs(df).collect()}
    assert len(want) > 20 and set(got) == want
    assert all(v == pytest.approx(c[k], abs=1e-6) for k, v in got.items())


def test_scan_is_the_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x = vectors.unit(rng.normal(size=(500, 64))).astype(np.float32)
    index = vectors.Index([], vectors.train_books(x), [])
    packed, _, _ = index.encode(x)
    table = np.einsum("qpd,ped->qpe", x[:20].reshape(20, vectors.PARTS, -1), index.books)
    codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(500, vectors.PARTS)
    assert np.allclose(index.scan(x[:20], packed), table[:, np.arange(vectors.PARTS), codes].sum(2), atol=1e-5)


def test_pairs_shuffle_no_vector_by_cell(spark, tmp_path):
    """Eight copies of every vector would be more than eight times the input."""
    rng = np.random.default_rng(5)
    emb = rng.normal(size=(20_000, 64)).astype(np.float32)
    emb[1::100] = emb[::100]
    path = str(tmp_path / "v.parquet")
    pq.write_table(pa.table({"pos": np.arange(20_000), "emb": pa.FixedSizeListArray.from_arrays(pa.array(emb.ravel()), 64).cast(pa.list_(pa.float32())), "encoder": ["a"] * 20_000}), path)
    df = spark.read.parquet(path)
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(x.shuffleWriteBytes() for x in (lambda xs: [xs.apply(i) for i in range(xs.size())])(store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    assert vectors.similar_pairs(df).count() == 200
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert 0 < written() - before < 4 * 20_000 * 256


def test_codes_in_cells_bound_every_pair():
    """What the cells see of two vectors differs from their product by no more than is added to it, however near the cosine."""
    rng = np.random.default_rng(8)
    x = vectors.unit(rng.normal(size=(4000, 64))).astype(np.float32)
    side = rng.normal(size=x.shape)
    side = vectors.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = (0.9 * x + math.sqrt(0.19) * side).astype(np.float32)
    books = vectors.train_books(x)
    left = x - vectors.decode(vectors.score_aware_codes(x, books), books)
    index = vectors.Index([], books, [], vectors.STEP * float(left.std()))
    near, towards, whole = [], [], []
    for v in (x, y):
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(["a"] * 4000), pa.array(v.tolist(), pa.list_(pa.float32()))], ["pos", "enc", "emb"])
        _, recs, _ = vectors._records(batch, index, 64, math.sqrt(0.19))
        near.append(index.refined(recs["code"], recs["fine"]))
        towards.append(recs["towards"].astype(float))
        whole.append(recs["whole"].astype(float))
    bound = towards[0] + towards[1] + whole[0] * whole[1]
    assert ((near[0] * near[1]).sum(1) + bound >= 0.9 - 1e-5).all() and bound.mean() < 0.06


def test_neighbours_recall(spark, sf):
    """With production parameters on 14,000 rows, where a query scans less than a tenth of them."""
    df = spark.read.parquet("/root/testdata/sf0.1/sent_vectors.parquet")
    index, _ = vectors.build_index(vectors._base(df, "pos", "emb", "encoder"), 64, 1, 1.0)
    n_cells = len(index.cells[0])
    assert n_cells > 100 and (9 + n_cells // 60) / n_cells < 0.1
    rows = {r["pos"]: (r["encoder"], r["emb"]) for r in df.collect() if r["emb"] is not None and len(r["emb"]) == 64 and np.isfinite(r["emb"]).all() and any(r["emb"])}
    got = defaultdict(list)
    for r in vectors.nearest(df).collect():
        got[r["pos"]].append((r["place"], r["neighbour"], r["cos"]))
    hits = n = 0
    for e in {v[0] for v in rows.values()}:
        ids = np.array(sorted(k for k, v in rows.items() if v[0] == e))
        x = np.array([rows[k][1] for k in ids], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for k in ids[ids % 20 == 0]:
            s = x @ x[np.searchsorted(ids, k)]
            s[np.searchsorted(ids, k)] = -2
            best = set(ids[np.argsort(-s)[:10]].tolist())
            hits += len(best & {b for _, b, _ in got[k]})
            n += 10
    assert hits / n >= 0.9
    assert all([p for p, _, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_score_aware_codes_favour_the_parallel_error():
    rng = np.random.default_rng(0)
    x = vectors.unit(rng.normal(size=(3000, 64))).astype(np.float32)
    books = vectors.train_books(x)
    r = x - vectors.decode(vectors.score_aware_codes(x, books), books)
    plain = x - vectors.decode(vectors.score_aware_codes(x, books, rounds=0), books)
    assert np.abs((r * x).sum(1)).mean() < np.abs((plain * x).sum(1)).mean()


def test_vectors_of_nothing(spark):
    _, df = vector_fixture(spark, 30)
    assert vectors.similar_pairs(df.limit(0)).count() == 0 and vectors.nearest(df.filter("emb is null")).count() == 0
    assert vectors.similar_pairs(df.filter("pos > 31")).count() == 0


# ---- packing ----


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_item_once(seed):
    rng = random.Random(seed)
    sizes = [min(2048, int(rng.paretovariate(0.7) * 60)) for _ in range(3000)] if seed else [700] * 2500 + [1] * 10
    hist = Counter(sizes)
    plan = packing.make_plan(hist)
    load = Counter()
    for k, runs in plan.runs.items():
        assert sum(hi - lo for lo, hi, *_ in runs) == hist[k] and sorted(runs)[0][0] == 0
        for lo, hi, first, each, _ in runs:
            for r in range(hi - lo):
                load[first + r // each] += k
    assert max(load.values()) <= 2048 and len(load) == plan.n_containers
    if seed:
        assert sum(sizes) / (2048 * plan.n_containers) > 0.97
        full = hist[2048]
        assert plan.fitted / (plan.n_containers - full) > 0.9 and packing.make_plan(hist, rounds=0).fitted == 0


def test_nonnegative_fit():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a = rng.integers(0, 3, (12, 30)).astype(float)
        x = np.where(rng.random(12) < 0.5, rng.random(12) * 9, 0)
        h = a.T @ x + rng.normal(size=30)
        got = packing.nonnegative_fit(a, h)
        slope = a @ (a.T @ got - h)
        assert (got >= 0).all() and (slope > -1e-4).all() and np.abs(slope[got > 1e-6]).max() < 1e-4


def test_fill_says_how(spark):
    df = spark.createDataFrame([(i, 2048 if i < 3 else 5000 if i == 3 else 100 + i % 300) for i in range(4000)], "doc_id long, n_ids int")
    packed = packing.pack_lengths(df)
    r = packing.fill_report(packed).first()
    assert r["n_whole"] + r["n_fitted"] + r["n_rest"] == r["n_containers"] and r["n_fitted"] > 0.9 * (r["n_containers"] - r["n_whole"])
    assert [x[0] for x in packing.split_items(packed).collect()] == [3]


def test_pack_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 100)
    rng = random.Random(8)
    lens = [(i, rng.choice([0, 0, 5, 300, 700, 700, 700, 2048, 2049, 5000, rng.randrange(1, 1500)])) for i in range(2000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in lens], "doc_id long, n_ids int, container string")
    rows = packing.pack_lengths(df).collect()
    load, by = Counter(), defaultdict(list)
    for r in rows:
        load[r["container"]] += r["size"]
        by[r["doc_id"]].append((r["piece"], r["start_at"], r["size"]))
    assert max(load.values()) <= 2048 and None not in load and set(by) == {a for a, _ in lens}
    for a, n in lens:
        p = sorted(by[a])
        assert sum(x[2] for x in p) == n and [x[1] for x in p] == [2048 * k for k in range(len(p))] and (len(p) == 1 or n > 2048)
    rooms: list[int] = []  # no more containers than by first fit, largest first
    for size in sorted((x for p in by.values() for _, _, x in p if x), reverse=True):
        k = next((k for k, r in enumerate(rooms) if r >= size), len(rooms))
        rooms[k : k + 1] = [(rooms[k] if k < len(rooms) else 2048) - size]
    assert len(load) <= 1.01 * len(rooms)
    assert packing.pack_lengths(df.limit(0)).count() == 0
    none = packing.pack_lengths(df.filter("n_ids = 0")).collect()
    assert none and all(r["container"] is None for r in none)
