"""One object for a corpus: index, ask, look up."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import corpus, graph, ranking, reply
from lexmill.operators.shared import cut, numbered_rows
from lexmill.sources import readers, sinks

BUDGETS = (100, 4_000)
SCORERS = ("lexical", "dense", "learned")
#: questions whose vectors meet the corpus in one pass; more are asked in several
QUESTION_BLOCK = 2_000
CONTEXT = "Use only the passages below to answer; say so if they do not hold the answer.\n\n{reply}\n\nQuestion: {question}"
EMPTY_DOCS = "source string, doc_seq long, sha256 string, text string"
EMPTY_EDGES = "id long, s string, r string, o string, r_lex string, pattern string, source string, sent_idx int"
_ADDRESS = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*://\S+")

Encode = Callable[[list[str]], list[list[float]]]


def hashed_vectors(texts: list[str], dim: int = 64) -> list[list[float]]:
    """The stand-in encoder: a unit vector of hashed words, equal for equal words wherever it runs."""
    import hashlib

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in T.unicode_words(t or ""):
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "big") % dim] += 1.0 if h[4] & 1 else -1.0
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v] if n else v)
    return out


def checked(encode: Encode, canary: str = "The quick brown fox jumps over the lazy dog.") -> Encode:
    """The encoder, if it keeps its contract: as many rows as texts, all of one width, finite, of length one (or zero),
    and the same for the same text."""
    got = [[float(x) for x in v] for v in encode([canary, "another text", canary])]
    if len(got) != 3 or len({len(v) for v in got}) != 1 or not got[0]:
        raise ValueError("the encoder must give one vector a text, all of one width")
    norms = [sum(x * x for x in v) ** 0.5 for v in got]
    if not all(abs(n - 1) < 0.01 or n == 0 for n in norms):
        raise ValueError("the encoder must give finite vectors of length one")
    if max(abs(x - y) for x, y in zip(got[0], got[2])) > 1e-4:
        raise ValueError("the encoder gives different vectors for one text")
    return encode


def encoded(df: DataFrame, key: list[str], text: str, encode: Encode = hashed_vectors) -> DataFrame:
    """(key..., emb): vectors by an encoder that takes a list of texts; it is loaded once a partition."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[key].assign(emb=encode(b[text].fillna("").tolist()))

    return df.select(*key, text).mapInPandas(run, f"{kinds}, emb array<float>")


class Engine:
    """Paths, addresses or texts in; answers, facts and sentences out. Tables stay distributed; a step that is read more
    than once is cut off from its plan by a reliable checkpoint, so plans stay small whatever the number of steps.

    save_to: a folder for the corpus, which is loaded from it if it is there. extract: sentences (source, sent_idx,
    text) to facts (s, r, o, r_lex, pattern, source, sent_idx); it is called once for each version of a document.
    """

    def __init__(self, spark: SparkSession, *paths: str, budget: int = 300, vectors: bool = False, encode: Encode = hashed_vectors, save_to: str | None = None, extract: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.budget, self.vectors = spark, budget, vectors
        self.encode = checked(encode) if vectors else encode
        self.extract = extract
        self.docs = spark.createDataFrame([], EMPTY_DOCS)
        self.edges = spark.createDataFrame([], EMPTY_EDGES)
        self.read_sources = spark.createDataFrame([], "source string")  # those the extractor has read
        self.errors = spark.createDataFrame([], "source string, error string")
        self.next_id, self.next_seq, self._texts = 0, 1, 0
        self.calls: list[tuple[str, int]] = []
        self._index: dict[str, DataFrame] | None = None
        self._store = sinks.Versions(spark, save_to) if save_to else None
        if self._store is not None and self._store.current() is not None:
            self.load()
        for p in paths:
            self.add(p)

    # ---- writing ----

    def add(self, path_or_text: str, name: str | None = None) -> DataFrame:
        """Reads a path or an address, or takes a text under a name; (source, status, sha256, tokens)."""
        if _ADDRESS.fullmatch(path_or_text) or "\n" not in path_or_text and os.path.exists(path_or_text):
            rows = cut(readers.read_sources(self.spark, path_or_text))
            self.errors = cut(self.errors.unionByName(rows.filter("error is not null").select("source", "error")))
            return self.upsert(rows.filter("error is null").select("source", "text"))
        self._texts += 1
        return self.upsert(self.spark.createDataFrame([(name or f"text{self._texts}", path_or_text)], "source string, text string"))

    def upsert(self, incoming: DataFrame) -> DataFrame:
        """Unchanged documents stay; others are replaced or added, and the facts read in their old versions go."""
        status = cut(corpus.upsert_status(incoming, self.docs))
        new = status.filter("status <> 'unchanged'").count()
        if new:
            self._forget(status.filter("status = 'replaced'").select("source"))
            self.docs = cut(corpus.upserted(incoming, self.docs, self.next_seq))
            self.next_seq += new
            self._extract()
            self._save()
        return status

    def drop(self, source: str) -> None:
        gone = self.spark.createDataFrame([(source,)], "source string")
        self.docs = cut(corpus.without_sources(self.docs, gone))
        self._forget(gone)
        self._save()

    def _forget(self, sources: DataFrame) -> None:
        self.edges, self.read_sources = cut(corpus.without_sources(self.edges, sources)), cut(corpus.without_sources(self.read_sources, sources))
        self._index = None

    def add_edges(self, edges: DataFrame) -> None:
        """Facts of an extractor: (s, r, o, r_lex, pattern, source, sent_idx); ids are never given twice."""
        new = cut(numbered_rows(edges, ["source", "sent_idx", "s", "r", "o"], "id", self.next_id))
        self.next_id += new.count()
        self.edges = cut(self.edges.unionByName(new.select(*self.edges.columns)))

    def _extract(self) -> None:
        if self.extract is None:
            return
        unread = cut(corpus.without_sources(self.docs.select("source"), self.read_sources))
        todo = self.sentences().join(unread, "source", "left_semi")
        self.add_edges(self.extract(todo.select("source", "sent_idx", "text")))
        self.read_sources = cut(self.read_sources.unionByName(unread))

    def deep(self, extract: Callable[[DataFrame], DataFrame] | None = None, vectors: bool | None = None) -> None:
        """From now on with an extractor, with vectors, or both: what is indexed is read once more, later documents as
        they come."""
        if extract is None and self.extract is None and not vectors:
            raise RuntimeError("give an extractor or ask for vectors")
        if vectors and not self.vectors:
            self.vectors, self.encode = True, checked(self.encode)
            if self._index is not None:
                self._index["vectors"] = cut(encoded(self._index["sentences"], ["pos"], "text", self.encode))
        self.extract = extract or self.extract
        self._extract()
        self._save()

    def _save(self) -> None:
        if self._store is not None:
            state = self.spark.createDataFrame([(self.next_id, self.next_seq, self._texts)], "next_id long, next_seq long, texts long")
            self._store.write(docs=self.docs, edges=self.edges, read_sources=self.read_sources, errors=self.errors, state=state)

    def load(self) -> None:
        """The tables of the store's current version."""
        self.docs, self.edges, self.read_sources, self.errors = (self._store.read(t) for t in ("docs", "edges", "read_sources", "errors"))
        self.next_id, self.next_seq, self._texts = self._store.read("state").first()
        self._index = None

    # ---- reading ----

    def sentences(self) -> DataFrame:
        return self.index()["sentences"]

    def index(self) -> dict[str, DataFrame]:
        """Sentences, postings, vocabulary and vectors; made when first asked for, once a version of the corpus."""
        if self._index is None:
            pieces = cut(corpus.sentence_table(self.docs, chunk=True))
            s = corpus.numbered(corpus.with_sections(pieces, self.docs))
            last = pieces.groupBy("source").agg(F.max("sent_idx").alias("last"))
            s = s.join(last, "source").withColumn("rel_pos", F.col("sent_idx") / F.greatest(F.col("last"), F.lit(1))).drop("last")
            s = s.withColumn("shown", T.shown_section(F.col("section")))
            searched = F.when(F.col("is_prose"), F.col("text")).otherwise(T.code_terms(F.col("text"), F.col("source")))
            s = cut(ranking.tokenized(s, searched))
            post = cut(ranking.postings(s))
            self._index = {"sentences": s, "postings": post, "vocab": cut(ranking.vocabulary(s, post))}
            if self.vectors:
                self._index["vectors"] = cut(encoded(s, ["pos"], "text", self.encode))
        return self._index

    def _scored(self, questions: DataFrame, scorer: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """((qid, pos, score), (qid, conf) or None, (qid, entity, place) or None)."""
        ix = self.index()
        s = ix["sentences"]
        qt = cut(ranking.question_tokens(questions, s, ix["vocab"]))
        lex = ranking.text_scores(qt, ix["postings"]).withColumn("prov", F.lit(0.0))
        ents = None
        if self.next_id:  # without facts there is nothing to resolve and no sentence to prefer
            ents = cut(graph.question_entities(questions, self.edges))
            lex = ranking.boosted(lex.drop("prov"), graph.boost_sentences(ents, self.edges, s))
        lex = cut(lex)
        if scorer == "lexical" or scorer == "dense" and not self.vectors:
            return lex.select("qid", "pos", F.col("lex").alias("score")), None, ents
        dense = cut(self._dense(questions, lex)) if self.vectors else None
        if scorer == "dense":
            return dense, None, ents
        with_ents = questions if ents is None else questions.join(ents.groupBy("qid").agg(F.collect_list(T.tokens(F.col("entity"))).alias("ents")), "qid", "left").withColumn("ents", F.coalesce("ents", F.array().cast("array<array<string>>")))
        got = cut(ranking.learned(ranking.featurized(ranking.shortlist(lex, questions), with_ents, s)))
        conf, scores = got.groupBy("qid").agg(F.max("conf").alias("conf")), got.select("qid", "pos", "score")
        if dense is None:
            return scores, conf, ents
        # few known words: the vectors alone rank, and where the words found nothing their confidence stays low
        gate = cut(ranking.vocabulary_gate(qt))
        alone = gate.filter("vectors_alone").select("qid")
        rest = lambda d: d.join(alone, "qid", "left_anti")
        mixed = ranking.interleaved(rest(scores), rest(dense)).unionByName(dense.join(alone, "qid", "left_semi"))
        topic = dense.join(alone, "qid", "left_semi").groupBy("qid").agg(F.max("score").alias("best"))
        topic = topic.select("qid", F.when(F.col("best") > 0, ranking.vector_confidence(2 * (F.col("best") - ranking.DENSE_OFFSET) - 1)).otherwise(0.0).alias("topic"))
        conf = conf.join(topic, "qid", "full_outer").select("qid", F.coalesce("conf", "topic").alias("conf"))
        return mixed, conf, ents

    def _dense(self, questions: DataFrame, lex: DataFrame) -> DataFrame:
        """The questions against all vectors, a block of questions at a time: a block is small enough to go to the vectors."""
        q = cut(encoded(questions, ["qid"], "question", self.encode).withColumnRenamed("emb", "q_emb"))
        blocks = max(1, -(-q.count() // QUESTION_BLOCK))
        out = None
        for k in range(blocks):
            part = q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
            c = self.index()["vectors"].join(F.broadcast(part)).select("qid", "pos", ranking.cosine(F.col("emb"), F.col("q_emb")).alias("cos"))
            out = c if out is None else out.unionByName(c)
        return ranking.dense_scores(out.join(lex.select("qid", "pos", "prov"), ["qid", "pos"], "left"))

    def answers(self, questions: DataFrame, scorer: str = "learned", widen: bool = True, hop: bool = True, full: bool = False) -> DataFrame:
        """(qid, reply, conf) for (qid, question[, budget]): all questions in one plan. `full` replies begin with the
        entities found and their facts, and name each sentence's place; others hold the passages alone."""
        if scorer not in SCORERS:
            raise ValueError(f"unknown scorer {scorer!r}; use one of {', '.join(SCORERS)}")
        budget = F.col("budget") if "budget" in questions.columns else F.lit(None).cast("int")
        lo, hi = BUDGETS
        q = questions.select("qid", "question", F.least(F.greatest(F.coalesce(budget, F.lit(self.budget)), F.lit(lo)), F.lit(hi)).alias("budget"))
        q = cut(ranking.tokenized(q, F.col("question")))
        scores, conf, ents = self._scored(q, scorer)
        up = cut(ranking.pulled_up(scores, self.sentences()))
        if full:
            return self._full(q, up, conf, ents, scorer)
        wide = q
        if widen and conf is not None:
            wide = q.join(conf, "qid", "left").withColumn("budget", F.coalesce(reply.widened_budget(F.col("budget"), F.col("conf")), F.col("budget"))).drop("conf")
        lines = cut(reply.packed(up, wide, self.sentences(), grouped=True))
        merged = self._hopped(wide, lines, scorer) if hop else None
        shown = reply.grouped_code(lines, self.sentences()).withColumnRenamed("order", "line_no")
        if merged is not None:
            shown = shown.join(merged.select("qid"), "qid", "left_anti").unionByName(merged)
        return reply.rendered(shown, q, conf)

    def _hopped(self, q: DataFrame, lines: DataFrame, scorer: str) -> DataFrame | None:
        """(qid, line_no, line) of the questions asked again with the names their best lines bring in: both replies in
        turns, within the first one's size. None if there is no such question."""
        s = self.sentences()
        names = cut(reply.hop_names(lines, q, s))
        if not names.limit(1).count():
            return None
        again = q.join(names, "qid").select("qid", F.concat_ws(" ", F.array_join("names", " "), "question").alias("question"), F.lit(600).alias("budget"))
        again = cut(ranking.tokenized(again, F.col("question")))
        second = cut(reply.packed(ranking.pulled_up(self._scored(again, scorer)[0], s), again, s, grouped=True))
        one, two = (reply.grouped_code(x, s).withColumnRenamed("order", "line_no") for x in (lines.join(names.select("qid"), "qid", "left_semi"), second))
        cap = one.groupBy("qid").agg(F.floor((F.sum(F.length("line") + 1) + len(reply.HEAD)) / 4).alias("tokens"))
        merged = reply.within_size(reply.interleaved_lines(one, two), cap)
        return cut(merged.select("qid", F.col("order").cast("int").alias("line_no"), "line"))

    def _full(self, q: DataFrame, scores: DataFrame, conf: DataFrame | None, ents: DataFrame | None, scorer: str) -> DataFrame:
        s, none = self.sentences(), self.spark.createDataFrame([], "qid long, entity string, place int")
        ents = none if ents is None else ents
        found = ents.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entity"))), lambda x: x["entity"]), ", ").alias("names"))
        heads = q.join(found, "qid", "left").join(conf if conf is not None else q.select("qid", F.lit(None).cast("double").alias("conf")), "qid", "left")
        mark = F.when(F.col("conf").isNotNull(), F.concat(F.lit(" · p="), F.format_number("conf", 2))).otherwise("")
        heads = cut(heads.select("qid", "budget", "conf", F.concat(F.lit("entities: "), F.coalesce("names", F.lit("(none)")), mark, F.lit(f" · scorer={scorer}")).alias("line")).withColumn("head", F.length("line")))
        inc = graph.incidence(self.edges).select("entity", "id").distinct()
        near = ents.select("qid", "entity").join(inc, "entity").select("qid", "id").distinct()
        e = self.edges.join(near, "id").withColumn("cls", F.col("r_lex").isNull() | (F.col("r_lex") == ""))
        groups = graph.edge_groups(e.select("qid", "cls", "id", "s", "r", "o"), "qid", "cls")
        facts = groups.select("qid", "cls", F.col("first_id").alias("place"), F.concat_ws(" ", "s", "r", "o", F.concat(F.lit("#"), graph.cap_ids(F.col("ids")))).alias("line"))
        block = cut(reply.fact_block(facts, heads))
        used = block.groupBy("qid").agg(F.sum(F.length("line") + 1).alias("n"), F.max("line_no").alias("last"))
        body = heads.join(used, "qid", "left").select("qid", "budget", (F.col("head") + F.coalesce("n", F.lit(0)) + 3).cast("bigint").alias("head"), F.coalesce("last", F.lit(0)).alias("last"))
        d = scores.filter("score > 0").join(s.select("pos", "source", "sent_idx", "text"), "pos").join(body, "qid").withColumn("line", T.full_line(F.col("source"), F.col("sent_idx"), F.col("text")))
        d = d.select("qid", "pos", "score", "text", "line", F.length("line").cast("bigint").alias("width"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("name"), "head", F.col("budget").cast("bigint").alias("budget"))
        lines = cut(reply.folded(d, [F.col("score").desc(), F.col("pos")]))
        rule = lines.select("qid").distinct().select("qid", F.lit(10**6).alias("line_no"), F.lit("--").alias("line"))
        rows = block.select("qid", F.col("line_no").cast("int").alias("line_no"), "line").unionByName(rule).unionByName(lines.select("qid", (F.col("line_no") + 10**6).cast("int").alias("line_no"), "line"))
        text = rows.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
        out = heads.join(text, "qid", "left").join(found, "qid", "left").join(q.select("qid", "question"), "qid")
        nothing = F.col("names").isNull() & F.col("body").isNull()
        return out.select("qid", F.when(nothing, F.concat(F.lit("no material for '"), "question", F.lit("'"))).otherwise(F.concat_ws("\n", "line", "body")).alias("reply"), "conf")

    def ask(self, question: str, budget: int | None = None, scorer: str = "learned", full: bool = False, deep: bool = False) -> str:
        if deep:
            self.deep()
        return self._charged("ask", self._ask(question, budget, scorer, full))

    def _ask(self, question: str, budget: int | None, scorer: str, full: bool) -> str:
        q = self.spark.createDataFrame([(0, question, budget)], "qid long, question string, budget int")
        if not full:
            whole = reply.whole_corpus(self.sentences())
            docs = self.docs.count()
            cap = min(max(budget or self.budget, BUDGETS[0]), BUDGETS[1])
            if reply.fits_whole(whole, docs, cap):
                asked = ranking.question_tokens(ranking.tokenized(q, F.col("question")), self.sentences(), self.index()["vocab"])
                if asked.filter("known").limit(1).count():
                    body = [r["line"] for r in whole.orderBy("pos").collect()]  # no more than the budget holds
                    return "\n".join([reply.WHOLE.format(docs=docs, s="" if docs == 1 else "s"), *body])
        return self.answers(q, scorer, full=full).first()["reply"]

    def context(self, question: str, budget: int | None = None) -> str:
        return CONTEXT.format(reply=self.ask(question, budget), question=question)

    def _charged(self, tool: str, text: str) -> str:
        """Every answer that leaves is charged to its tool: a quarter of its characters."""
        self.calls.append((tool, max(1, len(text) // 4)))
        return text

    def _shown(self, tool: str, rows: DataFrame, column: str) -> DataFrame:
        rows = cut(rows)
        n = rows.agg(F.sum(F.length(column) + 1)).first()[0] or 1
        self.calls.append((tool, max(1, (n - 1) // 4)))
        return rows

    def ledger(self) -> DataFrame:
        """(tool, calls, served): what each tool has given out."""
        return corpus.ledger(self.spark.createDataFrame(self.calls, "tool string, tokens long"))

    def search(self, term: str, limit: int = 8) -> DataFrame:
        t = self.spark.createDataFrame([(term,)], "term string")
        found = reply.searched(self.sentences(), t, max(1, limit)).join(self.sentences().select("pos", "source", "sent_idx", "text"), "pos")
        return self._shown("search", found, "text").orderBy("place")

    def query(self, entity: str, hops: int = 1, limit: int = 25) -> DataFrame:
        name = graph.resolved(self.spark.createDataFrame([(entity,)], "name string"), self.edges).first()["entity"]
        if name is None:
            known = ", ".join(r["entity"] for r in graph.top_entities(self.edges, 10).collect()) or "(empty graph)"
            return self.spark.createDataFrame([(0, f"no entity matches '{entity}'. known (by degree): {known}")], "place int, line string")
        return self._shown("query", graph.facts(name, self.edges, hops, max(1, limit)), "line")

    def provenance(self, *ids: int) -> DataFrame:
        found = graph.provenance(self.spark.createDataFrame([(i,) for i in ids], "id long"), self.edges, self.sentences(), self.next_id)
        return self._shown("provenance", found, "text")

    def entities(self, prefix: str = "", limit: int = 30) -> DataFrame:
        return self._shown("entities", graph.top_entities(self.edges, max(1, limit), prefix), "entity")

    def stats(self) -> DataFrame:
        """One row: the corpus's counts, and the tokens served so far."""
        docs = self.docs.select("source", T.token_count(F.col("text")).alias("tokens"))
        none = self.spark.createDataFrame([], "source string")
        vec = self.sentences().select("source").distinct() if self.vectors else none
        return corpus.statistics(docs, self.sentences(), self.edges, vec).withColumn("served", F.lit(sum(n for _, n in self.calls)).cast("long"))
