"""The graph of facts: edges (id, s, r, o, ...), each with where it was read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.shared import cut

DIVIDER = "~ class-only, verify with provenance:"
#: Words never taken for entities of a summary.
GROUNDING_STOP = ("this", "that", "with", "from", "their", "there", "these", "about", "which")


def incidence(edges: DataFrame) -> DataFrame:
    """(entity, id): both ends of each edge; an edge from an entity to itself twice."""
    return edges.select(F.explode(F.array("s", "o")).alias("entity"), "id")


def degrees(edges: DataFrame) -> DataFrame:
    """(entity, degree, first_seen): incidences, and the place of the first."""
    ends = edges.select(F.posexplode(F.array("s", "o")).alias("end", "entity"), "id")
    return ends.groupBy("entity").agg(F.count("*").alias("degree"), F.min(F.col("id") * 2 + F.col("end")).alias("first_seen"))


def top_entities(edges: DataFrame, limit: int = 30, prefix: str = "") -> DataFrame:
    """(entity, degree, place): by degree, then first seen. The prefix is compared in lower case with names as they are."""
    w = Window.orderBy(F.desc("degree"), "first_seen")
    d = degrees(edges).filter(F.startswith("entity", F.lit(prefix.lower())))
    # only `limit` rows reach the single task that numbers them
    return d.orderBy(F.desc("degree"), "first_seen").limit(limit).withColumn("place", F.row_number().over(w)).select("entity", "degree", "place")


def resolved(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, entity): the entity a name means, or null.

    In turn: the trimmed name; its lower case; any name equal without case; from two characters on, names it begins, that
    begin it (from 3 characters) or hold it (from 4); last, the same without a final s. The larger degree wins, then the
    first seen. The equality steps are hash joins; only names that they do not settle meet the entities as a whole.
    """
    d = degrees(edges).cache()
    asked = names.select("name").distinct()

    def best(c: DataFrame) -> DataFrame:
        return c.groupBy("name").agg(F.max_by("entity", F.struct("tier", "degree", -F.col("first_seen"))).alias("entity"))

    def equal(q: DataFrame) -> DataFrame:
        q = q.filter(F.trim("asked") != "")
        exact = q.join(d, F.trim("asked") == F.col("entity")).withColumn("tier", F.lit(3))
        low = q.join(d, F.lower(F.trim("asked")) == F.col("entity")).withColumn("tier", F.lit(2))
        same = q.join(d, F.lower(F.trim("asked")) == F.lower("entity")).withColumn("tier", F.lit(1))
        return best(exact.unionByName(low).unionByName(same))

    def near(q: DataFrame) -> DataFrame:
        q = q.withColumn("q", F.lower(F.trim("asked"))).filter(F.length("q") >= 2)
        e = F.lower("entity")
        hit = F.startswith(e, F.col("q")) | ((F.length("entity") >= 3) & F.startswith(F.col("q"), e)) | ((F.length("q") >= 4) & F.contains(e, F.col("q")))
        return best(q.join(d, hit).withColumn("tier", F.lit(0)))

    left, found = asked.withColumn("asked", F.col("name")), None
    for _ in range(2):
        for step in (equal, near):
            got = step(left)
            found = got if found is None else found.unionByName(got)
            left = left.join(got.select("name"), "name", "left_anti")
        low = F.lower(F.trim("asked"))
        left = left.filter((F.length(low) >= 2) & low.endswith("s")).withColumn("asked", F.substring(low, F.lit(1), F.length(low) - 1))
    return asked.join(found, "name", "left")


def question_entities(questions: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """(qid, entity, place): exact hits of a question's words or their singular forms, rarest first; ties by question order."""
    words = questions.select("qid", F.posexplode(F.regexp_extract_all(F.lower("question"), F.lit(T.WORD), F.lit(0))).alias("at", "word")).filter(~F.col("word").isin(T.GENERIC))
    forms = words.select("qid", "at", F.posexplode(T.singular_forms(F.col("word"))).alias("form_at", "entity"))
    hits = forms.join(degrees(edges), "entity")
    first = hits.groupBy("qid", "at").agg(F.min_by(F.struct("entity", "degree"), "form_at").alias("h")).select("qid", "at", "h.*").filter(~F.col("entity").isin(T.GENERIC))
    once = first.groupBy("qid", "entity").agg(F.min("at").alias("at"), F.max("degree").alias("degree"))
    w = Window.partitionBy("qid").orderBy("degree", "at")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("qid", "entity", "place")


def neighbourhood(start: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(root, id, hop): edges within `hops` of each root, each once, with the hop at which it is first reached.

    One join with the incidences a hop; visited entities and edges are removed by anti-joins.
    """
    ends = cut(edges.select("id", "s", "o"))  # read by every hop, made once
    inc = incidence(ends).distinct()
    front = start.select(F.col("entity").alias("root"), F.col("entity").alias("node")).distinct()
    seen, out = front, None
    for h in range(1, hops + 1):
        step = front.join(inc, front.node == inc.entity).select("root", "node", "id")
        new = step.select("root", "id").distinct().withColumn("hop", F.lit(h))
        if out is not None:
            new = new.join(out.select("root", "id"), ["root", "id"], "left_anti")
        out = new if out is None else out.unionByName(new)
        if h < hops:
            other = step.join(ends, "id").select("root", F.when(F.col("s") == F.col("node"), F.col("o")).otherwise(F.col("s")).alias("node")).distinct()
            front = other.join(seen, ["root", "node"], "left_anti")
            seen = seen.unionByName(front)
    return out if out is not None else start.sparkSession.createDataFrame([], "root string, id long, hop int")


def edge_groups(edges: DataFrame, *by: str) -> DataFrame:
    """(by..., s, r, o, ids, first_id, line): equal facts in one line with all their ids."""
    g = edges.groupBy(*by, "s", "r", "o").agg(F.sort_array(F.collect_list("id")).alias("all"), F.min("id").alias("first_id"))
    ids = F.array_join(F.transform("all", lambda x: x.cast("string")), ",")
    return g.select(*by, "s", "r", "o", ids.alias("ids"), "first_id", F.concat_ws(" ", "s", "r", "o", F.concat(F.lit("#"), ids)).alias("line"))


def cap_ids(ids: Column, most: int = 8) -> Column:
    """The first ids of a list joined by commas, then an ellipsis."""
    parts = F.split(ids, ",")
    return F.when(F.size(parts) > most, F.concat(F.array_join(F.slice(parts, 1, most), ","), F.lit(" …"))).otherwise(ids)


def facts(root: str, edges: DataFrame, hops: int = 1, limit: int = 25) -> DataFrame:
    """(place, line): facts about an entity; lexical facts first, then a divider and the class-only ones, then how many more."""
    spark = edges.sparkSession
    near = neighbourhood(spark.createDataFrame([(root,)], "entity string"), edges, hops)
    g = edge_groups(edges.join(near, "id").withColumn("cls", F.col("r_lex").isNull() | (F.col("r_lex") == "")).select("cls", "hop", "id", "s", "r", "o"), "cls")
    total = g.count()
    shown = g.orderBy("cls", "first_id", "s", "r", "o").limit(limit)
    rows = [(0, f"{root} ({total} facts, hops={hops})")]
    n = 0
    for r in shown.select("cls", "line").collect():  # at most `limit` rows
        if r["cls"] and DIVIDER not in [x[1] for x in rows]:
            rows.append((len(rows), DIVIDER))
        rows.append((len(rows), r["line"]))
        n += 1
    if n < total:
        rows.append((len(rows), f"+{total - n} more (raise limit)"))
    return spark.createDataFrame(rows, "place int, line string")


def provenance(ids: DataFrame, edges: DataFrame, sentences: DataFrame, next_id: int | None = None) -> DataFrame:
    """(id, status, s, r, o, source, sent_idx, text): where each fact was read; an id is known, retired or unknown.

    next_id: the id the next fact would get; where it is not given, the one after the greatest id there is."""
    if next_id is None:
        top = edges.agg(F.max("id")).first()[0]
        next_id = 0 if top is None else top + 1
    e = ids.select("id").distinct().join(edges, "id", "left")
    status = F.when(F.col("s").isNotNull(), "known").when((F.col("id") >= 0) & (F.col("id") < next_id), "retired").otherwise("unknown")
    return e.join(sentences.select("source", "sent_idx", "text"), ["source", "sent_idx"], "left").select("id", status.alias("status"), "s", "r", "o", "source", "sent_idx", "text")


def boost_sentences(ents: DataFrame, edges: DataFrame, sentences: DataFrame) -> DataFrame:
    """(qid, pos): sentences of the one-hop facts of a question's entities; facts read by syntax do not count."""
    inc = edges.filter(~F.coalesce(F.col("pattern") == "syntax", F.lit(False))).select(F.explode(F.array_distinct(F.array("s", "o"))).alias("entity"), "source", "sent_idx")
    return ents.join(inc, "entity").join(sentences.select("pos", "source", "sent_idx"), ["source", "sent_idx"]).select("qid", "pos").distinct()


def pair_counts(triples: DataFrame) -> DataFrame:
    """(u, v, n): unordered pairs; an entity with itself is a pair."""
    return triples.select(F.least("s", "o").alias("u"), F.greatest("s", "o").alias("v")).groupBy("u", "v").agg(F.count("*").alias("n"))


def ppmi(triples: DataFrame) -> DataFrame:
    """(u, v, n, weight): max(0, ln((n / N) / ((n_u / Ne) (n_v / Ne)))), pairs with weight above 0; pairs of one entity
    with itself count in N and make no edge."""
    pairs = pair_counts(triples)
    ends = triples.select(F.explode(F.array("s", "o")).alias("e")).groupBy("e").agg(F.count("*").alias("c"))
    total = triples.agg(F.count("*").cast("double").alias("all_pairs"), (F.count("*") * 2).cast("double").alias("all_ends"))
    j = pairs.filter("u <> v").join(ends.toDF("u", "cu"), "u").join(ends.toDF("v", "cv"), "v").join(F.broadcast(total))
    w = F.log((F.col("n") / F.col("all_pairs")) / ((F.col("cu") / F.col("all_ends")) * (F.col("cv") / F.col("all_ends"))))
    return j.select("u", "v", "n", w.alias("weight")).filter("weight > 0")


def cohesion(weights: DataFrame, member: DataFrame) -> DataFrame:
    """(community, size, cohesion): mean weight of the edges inside each community; 0 for none. member (entity, community)."""
    inside = weights.join(member.toDF("u", "community"), "u").join(member.toDF("v", "cv"), "v").filter("community = cv")
    c = inside.groupBy("community").agg(F.avg("weight").alias("cohesion"))
    return member.groupBy("community").agg(F.count("*").alias("size")).join(c, "community", "left").fillna(0.0, ["cohesion"])


def gated(weights: DataFrame, member: DataFrame, min_size: int = 5, top_k: int = 8) -> DataFrame:
    """Communities of enough members whose cohesion reaches the mean weight of all edges; the largest first."""
    mean = weights.agg(F.avg("weight").alias("mean"))
    return cohesion(weights, member).join(F.broadcast(mean)).filter((F.col("size") >= min_size) & (F.col("cohesion") >= F.col("mean"))).drop("mean").orderBy(F.desc("size"), "community").limit(top_k)


def salience(weights: DataFrame) -> DataFrame:
    return weights.withColumn("salience", F.col("n") * F.col("weight"))


def strength(weights: DataFrame, member: DataFrame, top: int = 8) -> DataFrame:
    """(community, entity, strength, place): entities by the sum of count x weight over their neighbours."""
    ends = weights.select(F.explode(F.array("u", "v")).alias("entity"), (F.col("n") * F.col("weight")).alias("x"))
    s = ends.groupBy("entity").agg(F.sum("x").alias("strength")).join(member, "entity")
    w = Window.partitionBy("community").orderBy(F.desc("strength"), "entity")
    return s.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("community", "entity", "strength", "place")


def communities(weights: DataFrame, rounds: int = 200) -> DataFrame:
    """(entity, community) by label propagation over the weights, from the least name; deterministic.

    Each round is one join and one aggregation over the edges; the lineage is cut by a reliable checkpoint. A label
    changes only for one with more weight, and in each round only those of one half of the names (by hash, another
    half each time) change, so neighbours do not swap labels for ever. Not settled after `rounds` is an error.
    """
    arcs = cut(weights.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight").unionByName(weights.select(F.col("v").alias("a"), F.col("u").alias("b"), "weight")))
    label = arcs.select("a").distinct().select("a", F.col("a").alias("label"))
    still = 0
    for k in range(rounds):
        votes = arcs.join(label.withColumnRenamed("a", "b"), "b").groupBy("a", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("lost"), F.col("label"))).alias("best"))
        own = votes.join(label.withColumnRenamed("label", "own"), "a").filter("label = own").select("a", F.col("w").alias("kept"))
        now = label.join(best, "a").join(own, "a", "left")
        better = (-F.col("best.lost") > F.coalesce("kept", F.lit(0.0))) & (F.pmod(F.xxhash64("a", F.lit(k // 2)), F.lit(2)) == k % 2)
        now = cut(now.select("a", F.when(better, F.col("best.label")).otherwise(F.col("label")).alias("label"), better.alias("moved")))
        moved = now.filter("moved").limit(1).count()
        label = now.select("a", "label")
        still = 0 if moved else still + 1
        if still == 2:  # both halves stay
            return label.toDF("entity", "community")
    raise RuntimeError(f"communities are not settled after {rounds} rounds")


def evidence(triples: DataFrame, weights: DataFrame, member: DataFrame, edges_each: int = 12, quotes_each: int = 6) -> DataFrame:
    """(community, place, fact, quote): the most salient edges inside each community with the first triple of each pair.

    triples (id, s, r, o, text). Quotes are given for the first places only and cut to 140 characters.
    """
    inside = salience(weights).join(member.toDF("u", "community"), "u").join(member.toDF("v", "cv"), "v").filter("community = cv")
    w = Window.partitionBy("community").orderBy(F.round("salience", 9).desc(), "u", "v")
    top = inside.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= edges_each)
    first = triples.groupBy(F.least("s", "o").alias("u"), F.greatest("s", "o").alias("v")).agg(F.min(F.struct("id", "s", "r", "o", "text")).alias("t"))
    return top.join(first, ["u", "v"]).select("community", "place", F.concat(F.col("t.s"), F.lit(" -"), F.col("t.r"), F.lit("- "), F.col("t.o")).alias("fact"), F.when(F.col("place") <= quotes_each, F.substring("t.text", 1, 140)).alias("quote"))


def summary_prompt(facts: list[str], quotes: list[str]) -> str:
    return "Below are facts and quotations about one theme.\nFacts: " + "; ".join(facts) + "\nQuotations: " + " | ".join(quotes) + "\nSummarize the theme in two or three sentences. Name no entity that is not above and add nothing of your own."


def grounding(summaries: DataFrame, member: DataFrame, known: DataFrame) -> DataFrame:
    """(community, grounding): share of a summary's known entities found in its community or its evidence; 1 for none.

    summaries (community, summary, evidence); member (entity, community); known (entity).
    """
    w = summaries.select("community", F.lower("evidence").alias("ev"), F.posexplode(F.regexp_extract_all(F.lower("summary"), F.lit("[a-z]{3,}"), F.lit(0))).alias("at", "word")).filter(~F.col("word").isin(*GROUNDING_STOP))
    # a word stands for itself and for itself without its final s: both forms are joined by equality
    forms = w.withColumn("form", F.explode(F.array_distinct(F.array("word", F.regexp_replace("word", "s+$", "")))))
    k = known.select(F.col("entity").alias("form")).distinct()
    m = w.join(forms.join(k, "form", "left_semi").select("community", "at").distinct(), ["community", "at"], "left_semi")
    own = member.select("community", F.lower("entity").alias("form")).distinct()
    inside = forms.join(own, ["community", "form"], "left_semi").select("community", "at").distinct().withColumn("inside", F.lit(True))
    ok = m.join(inside, ["community", "at"], "left").withColumn("ok", F.coalesce("inside", F.lit(False)) | F.contains("ev", F.col("word")))
    share = ok.groupBy("community").agg(F.avg(F.col("ok").cast("double")).alias("grounding"))
    return summaries.select("community").join(share, "community", "left").fillna(1.0, ["grounding"])


def summarized(triples: DataFrame, llm: Callable[[str], str], min_size: int = 5, min_grounding: float = 0.75, top_k: int = 8) -> DataFrame:
    """(community, size, cohesion, summary, grounding, accepted): one call of the injected model for each gated community
    (at most top_k)."""
    w = ppmi(triples).cache()
    member = communities(w)
    gate = gated(w, member, min_size, top_k).cache()
    ev = evidence(triples, w, member).join(F.broadcast(gate.select("community")), "community")
    rows = []
    for r in ev.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("place", "fact", "quote"))).alias("e")).collect():
        fs, qs = [x["fact"] for x in r["e"]], [x["quote"] for x in r["e"] if x["quote"]]
        rows.append((r["community"], llm(summary_prompt(fs, qs)).strip(), " ".join(fs + qs)))
    s = w.sparkSession.createDataFrame(rows, "community string, summary string, evidence string")
    g = grounding(s, member, incidence(triples).select("entity"))
    return gate.join(s.drop("evidence"), "community").join(g, "community").withColumn("accepted", F.col("grounding") >= min_grounding)


#: The four relations of a tool call.
TOOL_RELATIONS = ("has_name", "has_query", "has_limit", "has_verbose")


def cooccurrences(sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """(s, r, o, source, sent_idx): a rule-based stand-in for a learned extractor: vocabulary words that follow one
    another in a sentence. sentences (source, sent_idx, toks); vocab (token)."""
    w = Window.partitionBy("source", "sent_idx").orderBy("at")
    t = sentences.select("source", "sent_idx", F.posexplode("toks").alias("at", "token")).join(vocab.select("token").distinct(), "token")
    return t.withColumn("o", F.lead("token").over(w)).filter("o is not null and o <> token").select(F.col("token").alias("s"), F.lit("near").alias("r"), "o", "source", "sent_idx")
