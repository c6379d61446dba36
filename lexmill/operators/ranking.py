"""Search: postings, scores and their combination, for all questions at once.

Questions are rows. A question meets only sentences that share a token with it (posting lists), never all sentences.
Ties are broken by a sentence's place in the corpus (`pos`).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.shared import cut

#: Fixed values of the ranking.
K1, B = 1.2, 0.75
PROVENANCE_BONUS = 0.3
ENTITY_CAP, LENGTH_CENTER = 3, 25
SHORTLIST, TOKENS_A_SLOT = 60, 10
DENSE_FLOOR, DENSE_OFFSET = 0.6, 1.0
NEIGHBOURS, NEIGHBOUR_WEIGHT, CODE_REACH = 2, 0.9, 2
LOW_CONFIDENCE, VECTORS_ALONE_MOST, VECTORS_BELOW = 0.3, 0.29, 0.5
FEATURES = ("lex_norm", "lex_rank", "bm25_norm", "q_token_cov", "q_bigram_cov", "ent_hits", "provenance", "dense_cos", "dense_missing", "len_log", "rel_pos", "numeric_match")


@dataclass(frozen=True)
class Weights:
    """Fixed values of the fitted scorer: mean, scale and weight of each feature, bias, and the mean length it was fitted with."""

    mean: tuple[float, ...] = (0.4397405973436372, 0.07815566139611037, 0.3403680070646444, 0.22271375405241886, 0.02771169677499237, 0.7798472171698799, 0.4637322662786468, 0.0, 1.0, -0.5399757776089569, 0.47813730952292327, 0.06751546016733358)
    std: tuple[float, ...] = (0.21560104098480995, 0.14536801435889882, 0.19224623434708138, 0.1225136418039123, 0.07214763834653035, 0.5927792546596552, 0.49868291678251414, 1.0, 1.0, 0.5291735005478416, 0.28767247297196114, 0.2509125800068962)
    w: tuple[float, ...] = (0.19825717368172974, 0.36030978634022576, 0.6184030724475107, 0.12415647705796848, 0.22274272270935563, -0.019691069903300145, -0.2768039661594843, 0.0, 0.0, 0.0586704550041985, 0.023723697772027205, 0.06310747944699752)
    b: float = -5.078751486938966
    avgdl: float | None = 13.306361323155217
    about: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"features": list(FEATURES), "mean": list(self.mean), "std": list(self.std), "w": list(self.w), "b": self.b, "bm25_avgdl": self.avgdl, **self.about}, allow_nan=False)

    @staticmethod
    def from_json(text: str) -> Weights:
        """Checked: the features in order, as many finite numbers of each kind, no scale of zero or less."""
        import math

        d = json.loads(text)
        if tuple(d.get("features", ())) != FEATURES:
            raise ValueError("the features are not those of this scorer")
        for k in ("mean", "std", "w"):
            v = d.get(k)
            if not isinstance(v, list) or len(v) != len(FEATURES) or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in v):
                raise ValueError(f"{k} must be {len(FEATURES)} finite numbers")
        if any(x <= 0 for x in d["std"]) or not math.isfinite(d.get("b", math.nan)):
            raise ValueError("scales must be positive and the bias finite")
        rest = {k: v for k, v in d.items() if k not in ("features", "mean", "std", "w", "b", "bm25_avgdl")}
        return Weights(tuple(d["mean"]), tuple(d["std"]), tuple(d["w"]), d["b"], d.get("bm25_avgdl"), rest)


def tokenized(df: DataFrame, text: Column, unicode: bool = True) -> DataFrame:
    return df.withColumn("toks", T.tokens(text) if unicode else T.tokens_ascii(text))


def postings(sentences: DataFrame) -> DataFrame:
    """(pos, token, tf, len) from (pos, toks), partitioned by sentence."""
    return sentences.select("pos", F.size("toks").alias("len"), "toks").repartition("pos").select("pos", "len", F.explode("toks").alias("token")).groupBy("pos", "token").agg(F.count("*").cast("int").alias("tf"), F.max("len").alias("len"))


def vocabulary(sentences: DataFrame, post: DataFrame) -> DataFrame:
    """(token, df, idf): idf = ln((n + 1) / (df + 1)) + 1, n counting all sentences."""
    n = sentences.agg(F.count("*").alias("n"))
    return post.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def mean_length(sentences: DataFrame) -> DataFrame:
    """(avgdl): mean number of tokens, sentences without tokens included; 1 for none."""
    return sentences.agg(F.coalesce(F.avg(F.size("toks")), F.lit(1.0)).alias("avgdl"))


def question_tokens(questions: DataFrame, sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """(qid, token, idf, mass): each token once, tokens the corpus lacks with the idf of df = 0; mass is their sum."""
    n = sentences.agg(F.log(F.count("*") + 1.0) + 1).toDF("unseen")
    q = questions.select("qid", F.explode(F.array_distinct("toks")).alias("token"))
    q = q.join(vocab, "token", "left").join(F.broadcast(n)).select("qid", "token", F.coalesce("idf", "unseen").alias("idf"), F.col("df").isNotNull().alias("known"))
    return q.withColumn("mass", F.sum("idf").over(Window.partitionBy("qid")))


#: question tokens that go to the postings at once; more go in several passes
TOKENS_TOGETHER = 500_000


def bm25_part(avgdl: float | None = None) -> Column:
    """What a token adds to bm25, over idf, tf and len."""
    mean = F.lit(float(avgdl if avgdl is not None else Weights().avgdl))
    norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("len") / mean)
    return F.col("idf") * F.col("tf") * F.lit(K1 + 1.0) / (F.col("tf") + norm)


def text_scores(q: DataFrame, post: DataFrame, avgdl: float | DataFrame | None = None) -> DataFrame:
    """(qid, pos, lex, bm25): one pass over the matching postings gives both scores.

    The question tokens, of a size that is counted, go to the postings, which lie by sentence: so the postings of a
    frequent token are spread over all tasks, and the sums by (question, sentence) need no shuffle of the matches.
    """
    q = cut(q.select("qid", "token", "idf", "mass"))
    blocks = max(1, -(-q.count() // TOKENS_TOGETHER))
    if isinstance(avgdl, DataFrame):
        avgdl = avgdl.first()["avgdl"]
    part = bm25_part(avgdl)
    out = None
    for k in range(blocks):
        some = q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k) if blocks > 1 else q
        m = post.join(F.broadcast(some), "token").groupBy("qid", "pos").agg((F.sum("idf") / F.max("mass")).alias("lex"), F.sum(part).alias("bm25"))
        out = m if out is None else out.unionByName(m)
    return out


def asked_postings(sentences: DataFrame, questions: DataFrame) -> DataFrame:
    """`postings` of the tokens that occur in a question, without a shuffle where the sentences lie by `pos`."""
    asked = cut(questions.select(F.explode("toks").alias("token")).distinct())
    if asked.count() <= TOKENS_TOGETHER:
        asked = F.broadcast(asked)
    words = sentences.select("pos", F.size("toks").alias("len"), F.explode("toks").alias("token")).join(asked, "token", "left_semi")
    return words.groupBy("pos", "token").agg(F.count("*").cast("int").alias("tf"), F.max("len").alias("len"))


def kinds(q: DataFrame, width: DataFrame) -> DataFrame:
    """(qid, sid, width): questions with the same known tokens and as many unknown ones have the same scores everywhere; sid
    is the least qid of those. Questions without a known token are left out. q as `question_tokens`; width (qid, width)."""
    have = q.groupBy("qid").agg(F.sort_array(F.collect_set(F.when(F.col("known"), F.col("token")))).alias("have"), F.count("*").alias("n")).filter(F.size("have") > 0)
    return have.join(width, "qid").select("qid", F.min("qid").over(Window.partitionBy("have", "n")).alias("sid"), "width")


def best(q: DataFrame, post: DataFrame, kind: DataFrame, by: str = "lex", avgdl: float | DataFrame | None = None) -> DataFrame:
    """(sid, pos, <by>, rank): the first sentences, by a score of nine digits, then pos, of each kind of question; as many
    as the most that a question of the kind wants.

    Every sentence is considered, but none is met that cannot be among the first: sentences with the same asked tokens
    (for bm25 as often, and of one length) have the same score for every question, so such a group is scored once, and
    no more of it counts than its first sentences. A group is passed over only if enough sentences are strictly better.
    q as `question_tokens`, post as `asked_postings`, kind as `kinds`; post and kind are read several times.
    """
    want = kind.groupBy("sid").agg(F.max("width").alias("want"))
    most = int(kind.agg(F.max("width")).first()[0] or 0)
    own = q.filter("known").join(want.select(F.col("sid").alias("qid")), "qid", "left_semi")
    marks = post.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("token", "tf"))).alias("marks"), F.max("len").alias("len"))
    same = Window.partitionBy(*([F.col("marks")["token"]] if by == "lex" else ["marks", "len"])).orderBy("pos")
    groups = marks.withColumn("turn", F.row_number().over(same)).withColumn("gid", F.first("pos").over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    groups = cut(groups.filter(F.col("turn") <= most).select("gid", "pos", "turn", F.when(F.col("turn") == 1, F.col("marks")).alias("marks"), "len"))
    heads = groups.filter("turn = 1").select("pos", "len", "marks").repartition("pos").select("pos", "len", F.explode("marks").alias("m")).select("pos", "len", "m.token", "m.tf")
    got = text_scores(own, heads, avgdl).select(F.col("qid").alias("sid"), F.col("pos").alias("gid"), F.round(by, 9).alias(by))
    # the first of W groups, by their first sentences, are W sentences ahead of any other group
    first = Window.partitionBy("sid").orderBy(F.col(by).desc(), "gid")
    got = got.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most).join(groups.groupBy("gid").agg(F.count("*").alias("n")), "gid").join(want, "sid")
    ahead = F.expr(f"sum(n) over (partition by sid order by -{by} range between unbounded preceding and 5.0E-10D preceding)")
    got = got.withColumn("ahead", F.coalesce(ahead, F.lit(0))).filter("ahead < want")
    each = got.join(groups.select("gid", "pos", "turn"), "gid").filter("ahead + turn <= want")
    place = Window.partitionBy("sid").orderBy(F.col(by).desc(), "pos")
    return each.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most).filter("rank <= want").select("sid", "pos", by, "rank")


def spread(rows: DataFrame, kind: DataFrame) -> DataFrame:
    """Rows of each kind of question (sid, ...) for its questions (qid, sid[, width])."""
    out = rows.join(kind, "sid")
    return (out.filter("rank <= width").drop("width") if "width" in kind.columns else out).drop("sid")


def short_width() -> Column:
    return F.greatest(F.lit(SHORTLIST), F.floor(F.coalesce(F.col("budget"), F.lit(600)) / TOKENS_A_SLOT).cast("int"))


def best_shortlist(q: DataFrame, post: DataFrame, questions: DataFrame, avgdl: float | DataFrame | None = None) -> DataFrame:
    """(qid, pos, lex, bm25, rank): `shortlist` of `text_scores` of nine digits, found by `best`; bm25 is summed for these alone."""
    kind = cut(kinds(q, questions.select("qid", short_width().alias("width"))))
    top = cut(best(q, post, kind).filter("lex > 0"))
    if isinstance(avgdl, DataFrame):
        avgdl = avgdl.first()["avgdl"]
    own = q.filter("known").join(kind.select(F.col("sid").alias("qid")).distinct(), "qid", "left_semi").select(F.col("qid").alias("sid"), "token", "idf")
    held = top.select("sid", "pos").join(post, "pos").join(own, ["sid", "token"])
    bm25 = held.groupBy("sid", "pos").agg(F.round(F.sum(bm25_part(avgdl)), 9).alias("bm25"))
    return spread(top.join(bm25, ["sid", "pos"]), kind).select("qid", "pos", "lex", "bm25", "rank")


def alike(questions: DataFrame, q: DataFrame, *more: Column) -> DataFrame:
    """(qid, sid): questions that agree in all that `text_scores` and `featurized` (without entities) read of them, and in
    `more`; sid is the least qid of those. questions (qid, question, toks, ...); q as `question_tokens`."""
    have = q.groupBy("qid").agg(F.sort_array(F.collect_set(F.when(F.col("known"), F.col("token")))).alias("have"), F.count("*").alias("n"))
    d = questions.join(have, "qid", "left")
    known = F.transform("toks", lambda w: F.when(F.array_contains("have", w), w).otherwise(""))
    pairs = F.filter(T.bigrams(known), lambda p: ~(p.startswith(" ") | p.endswith(" ")))
    keys = [F.col("have"), F.col("n"), F.array_sort(F.array_distinct(pairs)), F.size(F.array_distinct(T.bigrams(F.col("toks")))), T.asks_quantity(F.col("question")), *more]
    d = d.select("qid", *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    return d.select("qid", F.min("qid").over(Window.partitionBy(*[f"k{i}" for i in range(len(keys))])).alias("sid"))


def boosted(scores: DataFrame, boost: DataFrame) -> DataFrame:
    """Adds the bonus to sentences that back a retrieved fact; those without a shared token get the bonus alone."""
    return scores.join(boost.select("qid", "pos").distinct().withColumn("prov", F.lit(1.0)), ["qid", "pos"], "full_outer").select("qid", "pos", (F.coalesce("lex", F.lit(0.0)) + F.coalesce("prov", F.lit(0.0)) * PROVENANCE_BONUS).alias("lex"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("prov", F.lit(0.0)).alias("prov"))


def ranked(df: DataFrame, score: str, k: int | Column | None = None, out: str = "rank") -> DataFrame:
    """Rank within qid by score, then pos; with k, only the first k (Spark then keeps no more than k rows a task)."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), "pos")
    r = df.withColumn(out, F.row_number().over(w))
    return r if k is None else r.filter(F.col(out) <= k)


def shortlist(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """The best max(60, budget / 10) sentences of each question with a score above 0."""
    r = ranked(scores.filter("lex > 0"), "lex")
    return r.join(questions.select("qid", short_width().alias("width")), "qid").filter("rank <= width").drop("width")


def featurized(short: DataFrame, questions: DataFrame, sentences: DataFrame) -> DataFrame:
    """The twelve features of each candidate.

    short (qid, pos, lex, bm25, rank[, prov, dense_cos, dense_available]); questions (qid, question, toks[, ents]);
    sentences (pos, text, toks, rel_pos).
    """
    have = set(short.columns)
    q = questions.select("qid", F.array_distinct("toks").alias("q_toks"), F.array_distinct(T.bigrams(F.col("toks"))).alias("q_bi"), T.asks_quantity(F.col("question")).alias("quantity"), (F.col("ents") if "ents" in questions.columns else F.array().cast("array<array<string>>")).alias("ents"))
    s = sentences.select("pos", F.col("text").rlike("[0-9]").alias("digits"), "toks", "rel_pos")
    d = short.join(s, "pos").join(q, "qid")
    whole = Window.partitionBy("qid")
    share = lambda c: F.when(F.max(c).over(whole) > 0, F.col(c) / F.max(c).over(whole)).otherwise(0.0)
    n_q, n_bi = F.size("q_toks"), F.size("q_bi")
    prov = F.col("prov") if "prov" in have else F.lit(0.0)
    avail = F.coalesce(F.col("dense_available"), F.lit(False)) if "dense_available" in have else F.lit(False)
    cos = F.coalesce(F.col("dense_cos"), F.lit(0.0)) if "dense_cos" in have else F.lit(0.0)
    return d.select(
        "qid", "pos", "rank",
        share("lex").alias("lex_norm"),
        (F.lit(1.0) / F.col("rank")).alias("lex_rank"),
        share("bm25").alias("bm25_norm"),
        F.when(n_q > 0, F.size(F.array_intersect("q_toks", "toks")) / n_q).otherwise(0.0).alias("q_token_cov"),
        F.when(n_bi > 0, F.size(F.array_intersect("q_bi", T.bigrams(F.col("toks")))) / n_bi).otherwise(0.0).alias("q_bigram_cov"),
        F.least(F.size(F.filter("ents", lambda e: (F.size(e) > 0) & (F.size(F.array_except(e, F.col("toks"))) == 0))), F.lit(ENTITY_CAP)).cast("double").alias("ent_hits"),
        prov.alias("provenance"),
        F.when(avail, cos).otherwise(0.0).alias("dense_cos"),
        F.when(avail, 0.0).otherwise(1.0).alias("dense_missing"),
        (F.log(F.greatest(F.size("toks"), F.lit(1)).cast("double")) - F.log(F.lit(float(LENGTH_CENTER)))).alias("len_log"),
        F.col("rel_pos").cast("double").alias("rel_pos"),
        F.when(F.col("quantity") & F.col("digits"), 1.0).otherwise(0.0).alias("numeric_match"),
    )


def logistic(weights: Weights | None = None) -> Column:
    """Probability of the fitted scorer, an expression over the feature columns."""
    w = weights or Weights()
    z = F.lit(w.b)
    for name, m, s, k in zip(FEATURES, w.mean, w.std, w.w):
        if k:
            z = z + (F.col(name) - F.lit(m)) / F.lit(s) * F.lit(k)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def learned(features: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(qid, pos, p, place, score, conf): score = 1 / place by p; ties keep the shortlist's order."""
    p = features.withColumn("p", logistic(weights))
    w = Window.partitionBy("qid").orderBy(F.round("p", 12).desc(), "rank")
    return p.withColumn("place", F.row_number().over(w)).select("qid", "pos", "p", "place", (F.lit(1.0) / F.col("place")).alias("score"), F.max("p").over(Window.partitionBy("qid")).alias("conf"))


def pulled_up(scores: DataFrame, sentences: DataFrame) -> DataFrame:
    """The sentence after each of the two best gets at least 0.9 of its score; in code, the two lines after it.

    scores (qid, pos, score); sentences (pos, source, sent_idx, is_prose). Shares are of the scores as they came in.
    """
    key = sentences.select("pos", "source", "sent_idx", "is_prose")
    top = ranked(scores.filter("score > 0"), "score", NEIGHBOURS).join(key, "pos")
    reach = F.when(F.col("is_prose"), 1).otherwise(CODE_REACH)
    ahead = top.select("qid", "source", "sent_idx", "score", F.explode(F.sequence(F.lit(1), reach)).alias("d"))
    lifted = ahead.select("qid", "source", (F.col("sent_idx") + F.col("d")).alias("sent_idx"), (F.col("score") * F.pow(F.lit(NEIGHBOUR_WEIGHT), F.col("d"))).alias("lift"))
    lifted = lifted.join(key.drop("is_prose"), ["source", "sent_idx"]).groupBy("qid", "pos").agg(F.max("lift").alias("lift"))
    return scores.join(lifted, ["qid", "pos"], "full_outer").select("qid", "pos", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("lift", F.lit(0.0))).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two arrays, held to [-1, 1]."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def pooled(vectors: Column, mask: Column) -> Column:
    """One unit vector from a text's token vectors: the mean of those whose mask is not 0; zero where there is none.
    vectors array<array<number>>, mask array<int>."""
    used = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m != 0, v)), lambda v: v.isNotNull())
    total = F.aggregate(used, F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    size = norm(total)
    return F.transform(total, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def unit_defects(vectors: DataFrame, emb: str = "emb", dim: int = 64) -> DataFrame:
    """(encoder, n, wrong_width, off_unit): rows of another width, and rows whose length is 0.01 or more from 1."""
    bad = F.coalesce(F.size(emb), F.lit(-1)) != dim
    off = ~bad & ~(F.abs(norm(F.col(emb)) - 1) < 0.01)
    return vectors.groupBy("encoder").agg(F.count("*").alias("n"), F.count_if(bad).alias("wrong_width"), F.count_if(off).alias("off_unit"))


def dense_scores(cos: DataFrame) -> DataFrame:
    """(qid, pos, score) of embedded rows: (cos + 1) / 2 and the bonus, kept above the floor and then lifted by 1."""
    s = (F.col("cos") + 1) / 2 + F.coalesce(F.col("prov"), F.lit(0.0)) * PROVENANCE_BONUS
    return cos.select("qid", "pos", F.when(s >= DENSE_FLOOR, s + DENSE_OFFSET).otherwise(0.0).alias("score"))


def vector_confidence(cos: Column) -> Column:
    return F.least(F.lit(VECTORS_ALONE_MOST), 1 / (1 + F.exp(-(F.lit(68.7) * (cos - 0.8) + 1.60))))


def interleaved(word: DataFrame, dense: DataFrame) -> DataFrame:
    """(qid, pos, score): the word order and the vector order in turns. word, dense: (qid, pos, score) over the same rows."""
    n = F.count("*").over(Window.partitionBy("qid"))
    j = word.select("qid", "pos", F.col("score").alias("a")).join(dense.select("qid", "pos", F.col("score").alias("b")), ["qid", "pos"], "full_outer").fillna(0.0, ["a", "b"])
    order = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.col(c).desc(), "pos")) - 1
    r = j.withColumn("ra", F.when(F.col("a") > 0, order("a")).otherwise(n)).withColumn("rb", order("b"))
    return r.select("qid", "pos", (1 / (1 + F.least("ra", "rb")) + F.lit(1e-6) / (1 + F.greatest("ra", "rb"))).alias("score"))


def vocabulary_gate(q: DataFrame) -> DataFrame:
    """(qid, known, asked, vectors_alone): whether fewer than half of a question's tokens occur in the corpus."""
    return q.groupBy("qid").agg(F.count_if("known").alias("known"), F.count("*").alias("asked")).withColumn("vectors_alone", F.col("known") < F.lit(VECTORS_BELOW) * F.col("asked"))
