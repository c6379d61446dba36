"""Queries over the provided tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import cost, prep
from lexmill.functions import text as T
from lexmill.operators import candidates, corpus, fit, graph, measures, ranking, relations, reply
from lexmill.operators.shared import cut

_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ALL)


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---- tables the operators work on; rows delivered twice count once ----


def sentences(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "sentences")
    return t.groupBy("pos").agg(*[F.max(c).alias(c) for c in t.columns if c != "pos"])


def questions(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "questions")
    return t.groupBy("qid").agg(F.max("question").alias("question"), F.max("budget").alias("budget")).filter("question is not null")


def features(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "features")
    return t.groupBy("qid", "pos").agg(*[F.max(c).alias(c) for c in t.columns if c not in ("qid", "pos")])


def with_place(t: DataFrame) -> DataFrame:
    n = t.groupBy("source").agg(F.max("sent_idx").alias("last"))
    return t.join(n, "source").withColumn("rel_pos", F.col("sent_idx") / F.greatest(F.col("last"), F.lit(1))).drop("last")


def purchases(s: SparkSession, d: str) -> DataFrame:
    """Facts of the star schema: a nation's customers buy parts of a brand; (id, s, r, o, r_lex, pattern, source, sent_idx)."""
    li, o = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), read(s, d, "orders").select("o_orderkey", "o_custkey")
    c, n, p = read(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), read(s, d, "nation").select("n_nationkey", "n_name"), read(s, d, "part").select("p_partkey", "p_brand")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("n_name").alias("s"), F.when(F.col("l_returnflag") == "R", "returns").otherwise("buys").alias("r"), F.col("p_brand").alias("o"), F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise("buys").alias("r_lex"), F.lit(None).cast("string").alias("pattern"), F.col("c_mktsegment").alias("source"), F.col("l_linenumber").alias("sent_idx"))


def searchable(s: SparkSession, d: str, unicode: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sentences with tokens, questions with tokens, postings, question tokens)."""
    # the index: written once, read by the vocabulary, the scores and the features
    t = cut(ranking.tokenized(with_place(sentences(s, d)).filter("text is not null"), F.col("text"), unicode))
    q = ranking.tokenized(questions(s, d), F.col("question"), unicode)
    post = cut(ranking.postings(t))
    return t, q, post, ranking.question_tokens(q, t, ranking.vocabulary(t, post))


def asked(s: SparkSession, d: str, unicode: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sentences with tokens, questions with tokens, postings of the questions' tokens, question tokens)."""
    t = ranking.tokenized(sentences(s, d).filter("text is not null"), F.col("text"), unicode)
    q = cut(ranking.tokenized(questions(s, d), F.col("question"), unicode))
    post = cut(ranking.asked_postings(t, q))
    return t, q, post, cut(ranking.question_tokens(q, t, ranking.vocabulary(t, post)))


def topk(q: DataFrame, toks: DataFrame, post: DataFrame, by: str, k: int, avgdl: DataFrame | None = None) -> DataFrame:
    kind = cut(ranking.kinds(toks, q.select("qid", F.lit(k).alias("width"))))
    return ranking.spread(ranking.best(toks, post, kind, by, avgdl), kind).select("qid", "pos", r6(by).alias("score"), "rank")


# ---- text ----


@query
def doc_token_count(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("n"))


@query
def doc_sha256(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", corpus.content_hash(F.col("text")).alias("sha256"))


@query
def prose_files(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "docs").select("source").distinct().select("source", T.is_prose(F.col("source")).alias("prose"))


@query
def sentence_pieces(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.posexplode(T.split_plain(F.col("text"))).alias("i", "piece")).select("doc_id", F.col("i").cast("int").alias("i"), "piece")


@query
def sentence_split(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("i", "u")).select("doc_id", "i", F.col("u.text").alias("piece"), F.col("u.start").alias("start"))


@query
def line_split(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.explode(T.split_lines(F.col("text"))).alias("u")).select("doc_id", F.col("u.text").alias("line"), F.col("u.start").cast("long").alias("start"))


@query
def upper_split(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.posexplode(T.split_upper(F.col("text"))).alias("i", "piece"))


@query
def long_chunks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.posexplode(T.chunk_long(F.col("text"))).alias("i", "piece"))


@query
def tokens_ascii(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).select("pos", F.array_join(T.tokens_ascii(F.col("text")), " ").alias("toks"))


@query
def tokens_unicode(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).select("pos", F.array_join(T.tokens(F.col("text")), " ").alias("toks"))


@query
def token_bigrams(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).select("pos", F.array_join(T.bigrams(T.tokens_ascii(F.col("text"))), "|").alias("pairs"))


@query
def singular_words(s: SparkSession, d: str) -> DataFrame:
    w = read(s, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0)))).alias("word")).distinct()
    return w.select("word", T.singular(F.col("word")).alias("one"), F.array_join(T.singular_forms(F.col("word")), ",").alias("forms"))


@query
def good_units(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").groupBy("modality").agg(F.count_if(T.good_unit(F.col("text"))).alias("good"), F.count("*").alias("n"))


@query
def shown_sections(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).select("pos", T.shown_section(F.col("section")).alias("shown"))


@query
def section_paths(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").filter("modality = 'prose' and text is not null").select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md")).alias("source"), F.col("doc_id").alias("doc_seq"), "text")
    return corpus.with_sections(corpus.sentence_table(docs), docs).select("source", "sent_idx", "section")


@query
def ingested(s: SparkSession, d: str) -> DataFrame:
    """All documents indexed for search by words: (doc_id, n_sentences, n_sections, n_tokens)."""
    suffix = F.when(F.col("modality") == "prose", ".md").otherwise(".py")
    docs = read(s, d, "documents").filter("text is not null").select(F.concat(F.lit("d"), F.col("doc_id"), suffix).alias("source"), F.col("doc_id").alias("doc_seq"), "text")
    t = ranking.tokenized(corpus.with_sections(corpus.sentence_table(docs), docs), F.col("text"))
    return t.groupBy(F.col("doc_seq").alias("doc_id")).agg(F.count("*").alias("n_sentences"), F.count_if(F.col("section") != "").alias("n_sections"), F.sum(F.size("toks")).alias("n_tokens"))


@query
def code_search_terms(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).filter("not is_prose").select("pos", T.code_terms(F.col("text"), F.col("source")).alias("terms"))


@query
def quantity_questions(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("qid", T.asks_quantity(F.col("question")).alias("quantity"))


@query
def word_sets(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("qid", F.array_join(F.array_sort(T.norm_words(F.col("question"))), " ").alias("words"))


@query
def capitalized(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).select("pos", F.array_join(T.capitalized_names(F.col("text")), "|").alias("names"))


@query
def compact_lines(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).select("pos", T.compact_line(F.col("source"), F.col("text"), T.shown_section(F.col("section"))).alias("line"), T.full_line(F.col("source"), F.col("sent_idx"), F.col("text")).alias("full_line"))


@query
def text_entropy(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).select("pos", r6(T.entropy(F.col("text"))).alias("bits"))


# ---- search ----


@query
def vocab_idf(s: SparkSession, d: str) -> DataFrame:
    t = ranking.tokenized(sentences(s, d).filter("text is not null"), F.col("text"), False)
    return ranking.vocabulary(t, ranking.postings(t)).select("token", "df", r6("idf").alias("idf"))


@query
def mean_length(s: SparkSession, d: str) -> DataFrame:
    return ranking.mean_length(ranking.tokenized(sentences(s, d).filter("text is not null"), F.col("text"), False)).select(r6("avgdl").alias("avgdl"))


@query
def lexical_topk(s: SparkSession, d: str) -> DataFrame:
    _, q, post, toks = asked(s, d, False)
    return topk(q, toks, post, "lex", 10)


@query
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    t, q, post, toks = asked(s, d, False)
    return topk(q, toks, post, "bm25", 10, ranking.mean_length(t))


@query
def lexical_topk_unicode(s: SparkSession, d: str) -> DataFrame:
    _, _, post, q = searchable(s, d, True)
    return ranking.ranked(ranking.text_scores(q, post), "lex", 10).select("qid", "pos", r6("lex").alias("score"), "rank")


@query
def boosted_topk(s: SparkSession, d: str) -> DataFrame:
    _, _, post, q = searchable(s, d, False)
    prov = features(s, d).filter("prov_flags").select("qid", "pos")
    x = ranking.boosted(ranking.text_scores(q, post), prov).withColumn("lex", F.round("lex", 9))
    return ranking.ranked(x, "lex", 10).select("qid", "pos", r6("lex").alias("score"), "rank")


def _short(s: SparkSession, d: str, unicode: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, q, post, toks = asked(s, d, unicode)
    return ranking.best_shortlist(toks, post, q), q, placed(s, d, unicode)


def placed(s: SparkSession, d: str, unicode: bool) -> DataFrame:
    return ranking.tokenized(with_place(sentences(s, d).filter("text is not null")), F.col("text"), unicode)


def _alike(s: SparkSession, d: str, unicode: bool = False, replies: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(shortlists, questions, sentences, (qid, sid)): one question of those that are alike; with `replies`, in the budget too."""
    _, q, post, toks = asked(s, d, unicode)
    kind = cut(ranking.alike(q, toks, F.coalesce("budget", F.lit(600)) if replies else ranking.short_width()))
    one = kind.filter("qid = sid").select("qid")
    q = cut(q.join(one, "qid", "left_semi"))
    return cut(ranking.best_shortlist(toks.join(one, "qid", "left_semi"), post, q)), q, placed(s, d, unicode), kind


def _spread(rows: DataFrame, kind: DataFrame) -> DataFrame:
    return ranking.spread(rows.withColumnRenamed("qid", "sid"), kind).select(*rows.columns)


@query
def shortlist(s: SparkSession, d: str) -> DataFrame:
    return _short(s, d)[0].select("qid", "pos", "rank")


@query
def candidate_features(s: SparkSession, d: str) -> DataFrame:
    short, q, t, kind = _alike(s, d)
    f = ranking.featurized(short, q, picked(t, short))
    return _spread(f.select("qid", "pos", *[r6(c).alias(c) for c in ranking.FEATURES]), kind)


def picked(t: DataFrame, rows: DataFrame) -> DataFrame:
    """The sentences that the rows name, before their tokens are made."""
    return t.join(rows.select("pos").distinct(), "pos", "left_semi")


@query
def supported_features(s: SparkSession, d: str) -> DataFrame:
    """The same with entities, facts and vectors: words of the question are its entities, the given flags and cosines stand in."""
    short, q, t = _short(s, d)
    given = features(s, d).select("qid", "pos", F.coalesce("prov_flags", F.lit(False)).cast("double").alias("prov"), "dense_cos", "dense_available")
    short = short.join(given, ["qid", "pos"], "left").withColumn("prov", F.coalesce("prov", F.lit(0.0))).withColumn("dense_cos", F.when(~F.isnan("dense_cos"), F.col("dense_cos")))
    q = q.withColumn("ents", F.transform("toks", lambda w: F.array(w)))
    f = ranking.featurized(short, q, t)
    return f.select("qid", "pos", *[r6(c).alias(c) for c in ("ent_hits", "provenance", "dense_cos", "dense_missing")])


@query
def learned_rank(s: SparkSession, d: str) -> DataFrame:
    short, q, t, kind = _alike(s, d)
    x = ranking.learned(ranking.featurized(short, q, picked(t, short)))
    return _spread(x.filter("place <= 10").select("qid", "pos", "place", r6("p").alias("p"), r6("conf").alias("conf")), kind)


def flagship(s: SparkSession, d: str) -> DataFrame:
    short, q, t, kind = _alike(s, d, True)
    x = cut(ranking.learned(ranking.featurized(short, q, picked(t, short))).filter("place <= 10"))
    return _spread(x.join(picked(sentences(s, d), x).select("pos", "source", "text"), "pos").select("qid", "place", "pos", "source", "text", r6("p").alias("p")), kind)


@query
def learned_answers(s: SparkSession, d: str) -> DataFrame:
    return flagship(s, d)


@query
def pulled_up(s: SparkSession, d: str) -> DataFrame:
    f = features(s, d).filter("not isnan(lex_scores) and lex_scores is not null").select("qid", "pos", F.col("lex_scores").alias("score"))
    return ranking.pulled_up(f, sentences(s, d)).select("qid", "pos", r6("score").alias("score"))


def _cos(c: str = "dense_cos") -> F.Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c)))


@query
def dense_scores(s: SparkSession, d: str) -> DataFrame:
    f = features(s, d).filter("dense_available and not isnan(dense_cos) and dense_cos is not null")
    c = f.select("qid", "pos", _cos().alias("cos"), F.when(F.col("prov_flags"), 1.0).otherwise(0.0).alias("prov"))
    return ranking.dense_scores(c).select("qid", "pos", r6("score").alias("score"))


@query
def interleaved(s: SparkSession, d: str) -> DataFrame:
    f = features(s, d)
    clean = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c))
    word = f.select("qid", "pos", F.coalesce(clean("lex_scores"), F.lit(0.0)).alias("score"))
    dense = f.select("qid", "pos", F.coalesce(clean("dense_cos"), F.lit(0.0)).alias("score"))
    return ranking.interleaved(word, dense).select("qid", "pos", F.round("score", 9).alias("score"))


@query
def vector_confidence(s: SparkSession, d: str) -> DataFrame:
    f = features(s, d).filter("dense_available and not isnan(dense_cos) and dense_cos is not null")
    return f.groupBy("qid").agg(F.max(_cos()).alias("c")).select("qid", r6(ranking.vector_confidence(F.col("c"))).alias("conf"))


@query
def vocabulary_gate(s: SparkSession, d: str) -> DataFrame:
    return ranking.vocabulary_gate(searchable(s, d, False)[3])


@query
def unit_check(s: SparkSession, d: str) -> DataFrame:
    v = read(s, d, "sent_vectors")
    return ranking.unit_defects(v.groupBy("pos", "encoder").agg(F.max("emb").alias("emb")))


@query
def centroid_cosines(s: SparkSession, d: str) -> DataFrame:
    """Every vector against the mean vector of each label (a bounded set of labels)."""
    v = read(s, d, "embeddings")
    c = v.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda a: a["x"]).alias("mean"))
    own = v.join(c, "label")
    return own.select("vec_id", "label", r6(ranking.cosine(F.col("embedding"), F.col("mean")) / ranking.norm(F.col("mean"))).alias("cos"))


# ---- replies ----


@query
def packed_replies(s: SparkSession, d: str) -> DataFrame:
    t = sentences(s, d).withColumn("shown", T.shown_section(F.col("section")))
    f = features(s, d).filter("not isnan(lex_scores) and lex_scores > 0").select("qid", "pos", F.col("lex_scores").alias("score"))
    return reply.packed(f, questions(s, d), t).select("qid", "line_no", "pos", "line")


@query
def reply_texts(s: SparkSession, d: str) -> DataFrame:
    short, q, t, kind = _alike(s, d, True, replies=True)
    x = cut(ranking.learned(ranking.featurized(short, q, picked(t, short))))
    every = sentences(s, d).filter("text is not null and source is not null")
    up = cut(ranking.pulled_up(x.select("qid", "pos", "score"), every))
    lines = reply.packed(up, q, picked(every, up).withColumn("shown", T.shown_section(F.col("section"))))
    return _spread(reply.rendered(lines, q, x.select("qid", "conf").distinct()).select("qid", "reply", r6("conf").alias("conf")), kind)


@query
def code_replies(s: SparkSession, d: str) -> DataFrame:
    t = sentences(s, d).withColumn("shown", T.shown_section(F.col("section")))
    f = features(s, d).filter("not isnan(lex_scores) and lex_scores > 0").select("qid", "pos", F.col("lex_scores").alias("score"))
    return reply.grouped_code(reply.packed(f, questions(s, d), t, grouped=True), t)


@query
def second_hop_names(s: SparkSession, d: str) -> DataFrame:
    t = sentences(s, d).withColumn("shown", T.shown_section(F.col("section")))
    f = features(s, d).filter("not isnan(lex_scores) and lex_scores > 0").select("qid", "pos", F.col("lex_scores").alias("score"))
    h = reply.hop_names(reply.packed(f, questions(s, d), t), questions(s, d), t)
    return h.select("qid", F.array_join("names", "|").alias("names"))


@query
def whole_corpus(s: SparkSession, d: str) -> DataFrame:
    return reply.whole_corpus(sentences(s, d).withColumn("shown", T.shown_section(F.col("section"))))


@query
def search_all_words(s: SparkSession, d: str) -> DataFrame:
    terms = s.createDataFrame([("answer budget",), ("heading path",), ("Stop LIST",), ("data.csv",), ("no such words",)], "term string")
    return reply.searched(sentences(s, d), terms)


# ---- graph ----


@query
def entity_degree(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(purchases(s, d))


@query
def top_entities(s: SparkSession, d: str) -> DataFrame:
    return graph.top_entities(purchases(s, d), 10)


@query
def edge_groups(s: SparkSession, d: str) -> DataFrame:
    return graph.edge_groups(purchases(s, d)).select("s", "r", "o", "ids", graph.cap_ids(F.col("ids")).alias("capped"))


@query
def resolve_names(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([("Brand#11",), (" brand#12 ",), ("BRAND#1",), ("nation_3",), ("rand#2",), ("x",), ("brand#13s",), ("nothing like it",), ("",)], "name string")
    return graph.resolved(names, purchases(s, d))


@query
def khop(s: SparkSession, d: str) -> DataFrame:
    start = s.createDataFrame([("Brand#11",), ("Brand#23",)], "entity string")
    return graph.neighbourhood(start, purchases(s, d), 2)


@query
def facts_of(s: SparkSession, d: str) -> DataFrame:
    return graph.facts("Brand#11", purchases(s, d))


@query
def provenance(s: SparkSession, d: str) -> DataFrame:
    e = purchases(s, d)
    sents = s.createDataFrame([], "source string, sent_idx int, text string").unionByName(read(s, d, "customer").select(F.col("c_mktsegment").alias("source")).distinct().withColumn("sent_idx", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("text", F.concat_ws(" ", F.lit("line"), F.col("sent_idx"), F.lit("of"), F.col("source"))))
    ids = e.select("id").unionByName(s.createDataFrame([(-1,), (3,), (10**12,)], "id long"))
    return graph.provenance(ids, e, sents).select("id", "status", "s", "r", "o", "source", "text")


@query
def question_entities(s: SparkSession, d: str) -> DataFrame:
    words = ranking.tokenized(sentences(s, d), F.col("text"), False).select("pos", "source", "sent_idx", F.posexplode("toks").alias("i", "token"))
    e = words.select((F.col("pos") * 1000 + F.col("i")).alias("id"), F.col("token").alias("s"), F.lit("in").alias("r"), F.col("source").alias("o"))
    return graph.question_entities(questions(s, d), e)


@query
def ppmi_graph(s: SparkSession, d: str) -> DataFrame:
    return graph.salience(graph.ppmi(purchases(s, d))).select("u", "v", "n", r6("weight").alias("weight"), r6("salience").alias("salience"))


def _regions(s: SparkSession, d: str) -> DataFrame:
    """A given partition of the entities: nations by region, brands by their first digit."""
    n = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.concat(F.lit("g"), F.col("r_regionkey")).alias("community"))
    b = read(s, d, "part").select(F.col("p_brand").alias("entity")).distinct().withColumn("community", F.concat(F.lit("g"), F.substring("entity", 7, 1)))
    return n.unionByName(b)


@query
def cohesion(s: SparkSession, d: str) -> DataFrame:
    return graph.cohesion(graph.ppmi(purchases(s, d)), _regions(s, d)).select("community", "size", r6("cohesion").alias("cohesion"))


@query
def entity_strength(s: SparkSession, d: str) -> DataFrame:
    x = graph.strength(graph.ppmi(purchases(s, d)).withColumn("weight", F.round("weight", 9)), _regions(s, d))
    return x.select("community", "entity", r6("strength").alias("strength"), "place")


@query
def communities(s: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph.ppmi(purchases(s, d)))


@query
def community_evidence(s: SparkSession, d: str) -> DataFrame:
    t = purchases(s, d).withColumn("text", F.concat_ws(" ", "s", "r", "o"))
    return graph.evidence(t, graph.ppmi(t), _regions(s, d))


@query
def summary_grounding(s: SparkSession, d: str) -> DataFrame:
    member = _regions(s, d)
    rows = member.groupBy("community").agg(F.concat_ws(" and ", F.array_sort(F.collect_list("entity"))).alias("summary"), F.lit("nation").alias("evidence"))
    known = member.select(F.explode(F.regexp_extract_all(F.lower("entity"), F.lit("[a-z]{3,}"), F.lit(0))).alias("entity")).distinct()
    return graph.grounding(rows, member, known).select("community", r6("grounding").alias("grounding"))


@query
def cooccurrence_triples(s: SparkSession, d: str) -> DataFrame:
    t = ranking.tokenized(sentences(s, d).filter("is_prose"), F.col("text"), False)
    v = ranking.vocabulary(t, ranking.postings(t)).filter("df >= 5")
    return graph.cooccurrences(t, v).groupBy("s", "o").agg(F.count("*").alias("n"))


# ---- measures ----


def _flags(s: SparkSession, d: str, flag: str) -> DataFrame:
    return purchases(s, d).filter(F.col("r") == flag).select("source", "s", F.lit("x").alias("r"), "o")


@query
def triple_f1(s: SparkSession, d: str) -> DataFrame:
    x = measures.prf1(_flags(s, d, "returns"), _flags(s, d, "buys"), ["source"], ["s", "r", "o"])
    return x.select("source", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def graph_distance(s: SparkSession, d: str) -> DataFrame:
    x = measures.edit_distance(_flags(s, d, "returns"), _flags(s, d, "buys"), ["source"])
    return x.select("source", "ged", r6("ged_norm").alias("ged_norm"))


@query
def value_percentiles(s: SparkSession, d: str) -> DataFrame:
    x = measures.summary(read(s, d, "events"), ["event_type"], "value")
    return x.select("event_type", "n", *[r6(c).alias(c) for c in ("median", "p10", "p90")])


@query
def otsu_thresholds(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 7 + F.col("l_tax") * 3).alias("p")).filter("p <= 1")
    return measures.otsu(p, ["l_returnflag"]).select("l_returnflag", r6("threshold").alias("threshold"))


@query
def noise_floors(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 7 + F.col("l_tax") * 3).alias("p"))
    return measures.noise_floor(p, ["l_returnflag"], relations=4).select("l_returnflag", r6("threshold").alias("threshold"))


@query
def decoded_edges(s: SparkSession, d: str) -> DataFrame:
    li = read(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("i"), (F.col("l_quantity") / 10 - 2).alias("exist"))
    nodes = li.groupBy("id", "i").agg(F.max("exist").alias("exist"))
    cells = nodes.alias("a").join(nodes.alias("b"), "id").select("id", F.lit(0).alias("r"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), (F.col("a.exist") * F.col("b.exist") - 1).alias("adj"))
    x = measures.decoded(nodes, cells, 0.5, 0.8, True)
    return x.select("id", "i", "r", "j", r6("p").alias("p"), "forced")


def _calls(s: SparkSession, d: str) -> DataFrame:
    """The calls in the texts of tool calls."""
    return read(s, d, "documents").filter("modality = 'toolcall'").select("doc_id", F.regexp_extract("text", r"(?s)CALL (\{.*?\})\n", 1).alias("call"))


@query
def toolcall_triples(s: SparkSession, d: str) -> DataFrame:
    return measures.call_triples(_calls(s, d), "call", "doc_id").select("id", "s", "r", "o")


@query
def toolcall_scores(s: SparkSession, d: str) -> DataFrame:
    c = _calls(s, d)
    other = F.regexp_replace("call", '"limit": [0-9]+', '"limit": 7')
    return c.select("doc_id", measures.json_valid(F.col("call")).alias("valid"), measures.call_exact(F.col("call"), other).alias("exact"), r6(measures.call_f1(F.col("call"), other)).alias("f1"), measures.json_equal(F.col("call"), other).alias("equal"))


@query
def number_fidelity(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).select("pos", r6(measures.number_fidelity(F.col("text"), F.regexp_replace("text", "[1-4]", "9"))).alias("kept"), measures.exact_match(F.col("text"), F.concat(F.lit(" "), F.regexp_replace("text", " ", "  "))).alias("same"))


@query
def chrf_scores(s: SparkSession, d: str) -> DataFrame:
    return sentences(s, d).select("pos", r6(measures.chrf(F.col("text"), F.regexp_replace("text", "[aeiou]", ""))).alias("chrf"))


# ---- preparation ----


@query
def redacted_texts(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", prep.redacted(F.col("text")).alias("text"))


@query
def spaced_digit_texts(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", prep.spaced_digits(F.col("text"), 5, F.coalesce("sonar_lang", F.lit(""))).alias("text"))


@query
def cleaned_prose(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", prep.cleaned_prose(F.col("text")).alias("text"))


@query
def surface_features(s: SparkSession, d: str) -> DataFrame:
    f = prep.surface_features(F.col("text"))
    return read(s, d, "documents").filter("text is not null").select("doc_id", *[r6(c).alias(k) for k, c in f.items()])


@query
def url_literals(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(s, d, "documents").select("doc_id", *[F.array_join(F.regexp_extract_all(t, F.lit(prep.LITERALS[k]), F.lit(0)), " ").alias(k) for k in ("url", "uuid")])


@query
def all_literals(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.explode(prep.literals(F.col("text"))).alias("kind", "found")).select("doc_id", "kind", F.explode("found").alias("literal"))


@query
def code_blocks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(prep.code_blocks(F.col("text"))).alias("i", "block"))


@query
def sanitized_code(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").filter("modality = 'code'").select("doc_id", prep.sanitized_code(F.col("text"), "python").alias("code"))


@query
def prepared_records(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", prep.prepared(F.col("text"), F.col("modality"), F.coalesce("sonar_lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("text"))


@query
def segmented_records(s: SparkSession, d: str) -> DataFrame:
    return corpus.segmented(read(s, d, "documents").withColumnRenamed("doc_id", "rec_id")).select("rec_id", F.col("unit").cast("int").alias("unit"), "text")


@query
def scanned_records(s: SparkSession, d: str) -> DataFrame:
    """Records long enough for their modality."""
    least = F.when(F.col("modality") == "toolcall", 30).otherwise(120)
    return read(s, d, "documents").filter(F.length("text") >= least).select("doc_id", "modality", F.length("text").alias("n"))


@query
def field_texts(s: SparkSession, d: str) -> DataFrame:
    q = read(s, d, "questions")
    return q.groupBy("qid").agg(F.max("q_tokens").alias("q_tokens"), F.max("budget").alias("budget")).select("qid", prep.field_text(F.col("q_tokens"), "array").alias("joined"), prep.field_text(F.col("budget"), "int").alias("budget"))


@query
def relation_labels(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").select("p_partkey", prep.clean_label(F.concat_ws(" ", F.lit("!"), "p_type", "p_name")).alias("label"))


@query
def between_labels(s: SparkSession, d: str) -> DataFrame:
    """The first word and the last one of a sentence as spans, in every other row in reverse order."""
    t = sentences(s, d).filter("text is not null")
    n = F.length("text")
    first, last = F.instr("text", " ") - 1, n - F.instr(F.reverse("text"), " ") + 1
    turned = F.col("pos") % 2 == 1
    spans = [F.when(turned, x).otherwise(y) for x, y in ((last, F.lit(0)), (n, first), (F.lit(0), last), (first, n))]
    x = t.filter(F.instr("text", " ") > 0).select("pos", prep.between_label(F.col("text"), *spans).alias("x"))
    return x.select("pos", "x.label", "x.swapped")


@query
def rebuilt_code(s: SparkSession, d: str) -> DataFrame:
    return corpus.rebuilt_code(sentences(s, d))


@query
def document_headings(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").filter("modality = 'prose' and text is not null").select(F.col("doc_id").alias("source"), "text")
    return corpus.headings(docs).select(F.col("source").alias("doc_id"), "at", "level", "title")


@query
def sequence_chunks(s: SparkSession, d: str) -> DataFrame:
    x = corpus.sequences(sentences(s, d), "source", "sent_idx", "pos", 4)
    return x.select("source", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


@query
def mix_targets(s: SparkSession, d: str) -> DataFrame:
    return corpus.doc_targets(read(s, d, "source_specs"), 12_345)


@query
def code_windows(s: SparkSession, d: str) -> DataFrame:
    return corpus.code_windows(sentences(s, d).filter("not is_prose"))


# ---- corpus ----


@query
def dedupe_status(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "documents").filter("text is not null").select(F.concat(F.lit("d"), F.col("doc_id")).alias("source"), "doc_id", "text", "modality")
    same = t.join(read(s, d, "split_docs"), "doc_id", "left_semi").select("source", corpus.content_hash(F.col("text")).alias("sha256"))
    other = t.filter("modality = 'code'").select("source", corpus.content_hash(F.upper("text")).alias("sha256"))
    return corpus.upsert_status(t, same.unionByName(other)).select("source", "status", "tokens")


@query
def dropped_source(s: SparkSession, d: str) -> DataFrame:
    t = sentences(s, d)
    lite = read(s, d, "docs").filter("lite").select("source")
    return corpus.without_sources(t, lite).select("pos", "source")


@query
def universe(s: SparkSession, d: str) -> DataFrame:
    seq = read(s, d, "docs").groupBy("source").agg(F.max("doc_seq").alias("doc_seq"))
    t = sentences(s, d).withColumnRenamed("pos", "old").join(seq, "source")
    return corpus.numbered(t).select("source", "sent_idx", F.col("pos").cast("long").alias("pos"))


@query
def valid_vectors(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "docs")
    return corpus.valid_vectors(read(s, d, "sent_vectors"), docs, docs).select("source").distinct()


@query
def corpus_statistics(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "docs").groupBy("source").agg(F.max("tokens").alias("tokens"))
    return corpus.statistics(docs, read(s, d, "sentences"), purchases(s, d), read(s, d, "sent_vectors"))


@query
def ingest_counts(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "docs").select("source", F.when(F.col("lite").isNull(), None).when(F.col("lite"), "ingested").otherwise("replaced").alias("status"), F.when(F.col("lite").isNull(), "no mode").alias("error")).distinct()
    return corpus.ingest_summary(t).select("ingested", "replaced", "unchanged", "failed", F.array_join("first_errors", "; ").alias("first_errors"))


@query
def ledger_by_tool(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.col("event_type").alias("tool"), T.token_count(F.col("props")).alias("tokens"))
    return corpus.ledger(e)


@query
def ledger_windows(s: SparkSession, d: str) -> DataFrame:
    from lexmill.streaming import live

    return live.windowed_ledger(read(s, d, "events")).select(F.col("start"), "tool", "calls", "served")


@query
def cypher_rows(s: SparkSession, d: str) -> DataFrame:
    from lexmill.sources import sinks

    return sinks.cypher(purchases(s, d))


@query
def literal_links(s: SparkSession, d: str) -> DataFrame:
    from lexmill.sources import sinks

    ents = read(s, d, "questions").select(F.col("qid").alias("key"), F.explode("q_tokens").alias("entity")).filter("entity is not null")
    lits = questions(s, d).select(F.col("qid").alias("key"), F.lit("number").alias("kind"), F.explode(F.regexp_extract_all("question", F.lit(r"\d+"), F.lit(0))).alias("literal"))
    return sinks.literal_links(ents, lits)


@query
def synthetic_calls(s: SparkSession, d: str) -> DataFrame:
    return corpus.synthetic_calls(s, 1_000)


@query
def synthetic_numbers(s: SparkSession, d: str) -> DataFrame:
    return corpus.synthetic_numbers(s, 1_000)


@query
def prose_sample(s: SparkSession, d: str) -> DataFrame:
    return candidates.prose_sample(read(s, d, "documents").filter("modality = 'prose'"), 500)


@query
def code_fragments(s: SparkSession, d: str) -> DataFrame:
    return candidates.shuffled_fragments(corpus.code_windows(sentences(s, d).filter("not is_prose")), 200)


def _mentions(s: SparkSession, d: str) -> DataFrame:
    """(rec, at, entity): words of more than six letters of the questions."""
    return questions(s, d).select(F.col("qid").alias("rec"), F.posexplode(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]{7,}"), F.lit(0))).alias("at", "entity"))


@query
def candidate_lists(s: SparkSession, d: str) -> DataFrame:
    m = _mentions(s, d)
    gold = m.filter("at < 2").groupBy("rec").agg(F.min("entity").alias("s"), F.max("entity").alias("o"))
    return candidates.candidate_lists(m, m.select("entity"), gold)


@query
def text_candidates(s: SparkSession, d: str) -> DataFrame:
    """The part of the candidates that comes from the text, which does not depend on a draw."""
    return candidate_lists(s, d).filter("from_text").select("rec", "place", "entity", "exists")


@query
def spare_entities(s: SparkSession, d: str) -> DataFrame:
    """The pool without the candidates: words of all questions that no question with a budget above 400 has."""
    rows = questions(s, d).select("budget", F.explode(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]{7,}"), F.lit(0))).alias("entity"))
    return rows.select("entity").distinct().join(rows.filter("budget > 400").select("entity").distinct(), "entity", "left_anti")


@query
def provenance_records(s: SparkSession, d: str) -> DataFrame:
    t = sentences(s, d).filter("text is not null").select(F.col("pos").alias("rec"), F.col("text").alias("sentence"), F.col("char_offset").alias("offset"))
    words = t.select("rec", F.regexp_extract_all("sentence", F.lit("[A-Za-z]{4,}"), F.lit(0)).alias("w"), "sentence").filter(F.size("w") > 1)
    spans = words.select("rec", F.explode("w").alias("entity"), "sentence").select("rec", "entity", (F.expr("instr(sentence, entity)") - 1).alias("start"), (F.expr("instr(sentence, entity)") - 1 + F.length("entity")).alias("end"))
    triples = words.select("rec", F.element_at("w", 1).alias("s"), F.lit("near").alias("r"), F.element_at("w", -1).alias("o")).unionByName(words.select("rec", F.element_at("w", 1).alias("s"), F.lit("near").alias("r"), F.lit("(memory)").alias("o")))
    return candidates.provenance_records(triples, spans, t)


@query
def code_languages(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "docs").select("source").distinct().select("source", relations.language(F.col("source")).alias("language"))


@query
def feature_scales(s: SparkSession, d: str) -> DataFrame:
    return fit.scales(features(s, d).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("lex_scores", "bm25", "dense_cos", "rel_pos")])).select("feature", r6("mean").alias("mean"), r6("std").alias("std"))


@query
def community_gate(s: SparkSession, d: str) -> DataFrame:
    x = graph.gated(graph.ppmi(purchases(s, d)), _regions(s, d))
    return x.select("community", "size", r6("cohesion").alias("cohesion"))


@query
def fact_sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences that back the facts of an entity, by question: here nations are asked for, and lines of segments are the sentences."""
    ents = s.createDataFrame([(1, "NATION_3"), (2, "Brand#11"), (3, "nobody")], "qid long, entity string")
    e = purchases(s, d).filter("pattern is null or pattern <> 'syntax'")
    t = read(s, d, "customer").select(F.col("c_mktsegment").alias("source")).distinct().withColumn("sent_idx", F.explode(F.sequence(F.lit(1), F.lit(7))))
    t = t.withColumn("pos", F.concat_ws(":", "source", "sent_idx"))
    return graph.boost_sentences(ents, e, t)


@query
def candidate_spans(s: SparkSession, d: str) -> DataFrame:
    """First mentions of the tokens of the questions' vocabulary in sentences."""
    t = sentences(s, d).filter("text is not null").select(F.col("pos").alias("sent"), F.posexplode(F.split("text", " ")).alias("i", "text"))
    vocab = questions(s, d).select(F.explode(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]{4,}"), F.lit(0))).alias("token"))
    return relations.candidate_spans(t, vocab)


@query
def pooled_vectors(s: SparkSession, d: str) -> DataFrame:
    """Token vectors are the quarters of a row's vector; the third is masked."""
    v = read(s, d, "sent_vectors").groupBy("pos").agg(F.max("emb").alias("emb")).filter("size(emb) = 64 and forall(emb, x -> x is not null and not isnan(x) and abs(x) < 1e30)")
    parts = F.array(*[F.slice("emb", 16 * k + 1, 16) for k in range(4)])
    return v.select("pos", F.transform(ranking.pooled(parts, F.array(*map(F.lit, (1, 1, 0, 1)))), lambda x: F.round(x, 5) + F.lit(0.0)).alias("vector"))


@query
def decoded_files(s: SparkSession, d: str) -> DataFrame:
    """Files of several formats, made from the nations and their regions, and the texts read from them."""
    from lexmill.sources import readers

    n, r = F.col("n_name"), F.col("r_name")
    rows = read(s, d, "nation").join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    made = {
        "html": F.concat(F.lit("<html><head><script>no</script></head><body>out<article><h1>"), n, F.lit("</h1><p>in&nbsp;<b>"), r, F.lit("</b></p><table><tr><td>no</table></article></body></html>")),
        "rtf": F.concat(F.lit("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}\\f0 "), n, F.lit("\\par in "), r, F.lit("}")),
        "ipynb": F.to_json(F.struct(F.array(F.struct(F.array(n).alias("source")), F.struct(F.array(F.concat(F.lit("in "), r)).alias("source"))).alias("cells"))),
        "eml": F.concat(F.lit("Subject: "), n, F.lit("\nFrom: a@b.org\n\nin "), r),
        "txt": F.concat(n, F.lit("\nin "), r),
    }
    files = None
    for suffix, content in made.items():
        f = rows.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(f".{suffix}")).alias("source"), F.encode(content, "UTF-8").alias("content"))
        files = f if files is None else files.unionByName(f)
    return readers.decode_sources(files)


@query
def fitted_weights(s: SparkSession, d: str) -> DataFrame:
    """A scorer fitted to tell candidates that back a fact: (feature, weight)."""
    cols = ("lex_scores", "bm25", "rel_pos")
    rows = features(s, d).filter(" and ".join(f"{c} is not null and not isnan({c})" for c in cols)).select(*cols, F.coalesce("prov_flags", F.lit(False)).cast("double").alias("label"))
    w = fit.fit(rows, features=cols, shrink=0.9, steps=200)
    return s.createDataFrame([(c, float(x)) for c, x in zip(cols, w.w)] + [("bias", float(w.b))], "feature string, weight double")


@query
def dependency_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels of a made-up parse: each nation sells to the next in active or passive voice."""
    n = read(s, d, "nation").select(F.col("n_nationkey").alias("sent"), F.col("n_name").alias("name"))
    active = [("{}", "{}", "PROPN", "NNP", "nsubj", 1), ("sells", "sell", "VERB", "VBZ", "ROOT", 1), ("brands", "brand", "NOUN", "NNS", "dobj", 1)]
    passive = [("brands", "brand", "NOUN", "NNS", "nsubjpass", 2), ("are", "be", "AUX", "VBP", "auxpass", 2), ("sold", "sell", "VERB", "VBN", "ROOT", 2), ("by", "by", "ADP", "IN", "agent", 2), ("{}", "{}", "PROPN", "NNP", "pobj", 3)]
    parse = s.createDataFrame([(k, i, *row) for k, rows in enumerate((active, passive)) for i, row in enumerate(rows)], "voice int, i int, text string, lemma string, pos string, tag string, dep string, head int")
    tokens = n.join(F.broadcast(parse), F.col("sent") % 2 == F.col("voice")).select("sent", "i", *[F.when(F.col(c) == "{}", F.col("name")).otherwise(F.col(c)).alias(c) for c in ("text", "lemma")], "pos", "tag", "dep", "head")
    pairs = n.select("sent", F.when(F.col("sent") % 2 == 0, 0).otherwise(4).alias("s"), F.when(F.col("sent") % 2 == 0, 2).otherwise(0).alias("o"))
    return relations.lexicalized(tokens, pairs).select("sent", "s", "o", "label", "pattern", "swapped")


# ---- cost ----


def _models(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "part")
    return p.select("p_partkey", (F.col("p_size") * 1000.0).alias("n"), F.col("p_size").cast("double").alias("k"), F.col("p_retailprice").alias("x"))


@query
def training_cost(s: SparkSession, d: str) -> DataFrame:
    m = _models(s, d)
    a = cost.concept_training(F.col("n"), F.col("n") * 2, F.col("n") * 3, F.col("x"), F.lit(25.0), F.lit(2.0))
    g = cost.graph_training(F.col("n"), F.col("n") * 2, F.col("n") * 3, F.col("x"), F.lit(25.0), F.lit(2.0))
    t = cost.token_training(F.col("n"), F.col("x"), F.lit(25.0), F.lit(2.0))
    total = a["concept"] + a["decoder"] + a["encoder"]
    return m.select("p_partkey", F.round(total, 3).alias("total"), F.round(g["concept"] + g["decoder"] + g["encoder"], 3).alias("graph_total"), F.round(t, 3).alias("token_total"), r6(total / t).alias("ratio"))


@query
def inference_cost(s: SparkSession, d: str) -> DataFrame:
    n, x = F.col("n"), F.col("x")
    return _models(s, d).select("p_partkey", r6(cost.concept_per_token(n, n * 2, F.lit(25.0))).alias("concept"), r6(cost.token_per_token(n)).alias("token"), r6(cost.context_work(n, x, F.lit(64.0))).alias("context"), r6(cost.graph_per_concept(n, n)).alias("graph"), r6(cost.token_graph_work(n, x, True)).alias("token_graph"), r6(cost.encoder_prefill(x)).alias("prefill"), r6(cost.concept_state(x)).alias("state"), r6(cost.token_state(x, F.lit(12.0), F.lit(64.0))).alias("cache"))


@query
def roofline(s: SparkSession, d: str) -> DataFrame:
    g = cost.graph_decoder(F.col("k"), F.lit(64.0), F.lit(100.0), F.lit(8.0))
    m = _models(s, d).select("p_partkey", "x", *[c.alias(k) for k, c in g.items()])
    a = (F.col("work"), F.col("act_bytes"), F.col("weight_bytes"))
    cross = cost.crossover(*a, F.lit(30.9e12))
    return m.select("p_partkey", "params", "work", r6(cost.intensity(*a, F.col("x"))).alias("intensity"), r6(cost.weight_share(a[1], a[2], F.col("x"))).alias("share"), r6(F.when(cross < 1e15, cross)).alias("crossover"))


@query
def latency(s: SparkSession, d: str) -> DataFrame:
    x = F.col("x") / 10000
    return _models(s, d).select("p_partkey", r6(cost.mean_latency(x, F.col("k"))).alias("mean_ms"), r6(cost.copy_ceiling(F.col("k"), F.col("k") / 5)).alias("ceiling"), r6(cost.cosine_rate(F.col("k"), 50, 0.001, 5)).alias("rate"))
