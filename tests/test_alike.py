"""Questions that are alike are scored once, and so are sentences: the work of the search queries, and their results."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import ranking, reply
from lexmill.plans import queries as core
from lexmill.plans import sql

TOPICS = ("cache", "shard rank", "rank of the shard", "report", "shard shard index", "index budget cache")
QUESTIONS, SENTENCES = 240, 400
NAMES = ["candidate_features", "bm25_topk", "learned_answers", "lexical_topk", "reply_texts"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Many questions of few kinds, with names no sentence has; many sentences of few kinds, some with a rare token."""
    d = str(tmp_path_factory.mktemp("alike"))
    ask = [(7 * i, f"{'How many' if i % 5 == 0 else 'Where does'} n{i}x keep its {TOPICS[i % 6]}{' rare' if i % 40 == 0 else ''}?", (300, 4000, None, 1000)[i % 4]) for i in range(QUESTIONS)]
    ask += [(1, None, 300), (2, "zork plugh", 300), (3, "the of", 300), ask[3]]
    told = [(i * 3, f"d{i % 9}.{'md' if i % 2 else 'py'}", i // 9, f"The {('cache', 'shard rank', 'shard', 'index budget', 'report 7 cache cache', 'other lines', 'rank')[i % 7]} of {'many ' * (i % 3)}blocks{' rare' if i % 150 == 9 else ''}.", 0, "Guide" if i % 4 else None, i % 2 == 1) for i in range(SENTENCES)]
    told += [told[5], (5000, "e.md", 0, None, 0, None, True)]
    spark.createDataFrame(ask, "qid long, question string, budget int").write.parquet(f"{d}/questions.parquet")
    spark.createDataFrame(told, "pos long, source string, sent_idx int, text string, char_offset int, section string, is_prose boolean").write.parquet(f"{d}/sentences.parquet")
    return d


def plain(rows):
    return sorted(repr(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


def each_scored(spark, d, name):
    """What the query gives with every question scored against every sentence: by its SQL, or by the operators one by one."""
    if name in sql.oracle_sql():
        con = duckdb.connect()
        for t in ("questions", "sentences"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
        return con.execute(sql.oracle_sql()[name]).fetchall()
    t, q, post, toks = core.searchable(spark, d, True)
    scores = ranking.text_scores(toks, post).withColumn("lex", F.round("lex", 9)).withColumn("bm25", F.round("bm25", 9))
    x = ranking.learned(ranking.featurized(ranking.shortlist(scores, q), q, t))
    if name == "learned_answers":
        return x.filter("place <= 10").join(t, "pos").select("qid", "place", "pos", "source", "text", F.round("p", 6)).collect()
    up = ranking.pulled_up(x.select("qid", "pos", "score"), t)
    lines = reply.packed(up, q, t.withColumn("shown", T.shown_section(F.col("section"))))
    return reply.rendered(lines, q, x.select("qid", "conf").distinct()).select("qid", "reply", F.round("conf", 6)).collect()


@pytest.mark.parametrize("name", NAMES)
def test_alike(spark, tables, monkeypatch, name):
    want, pairs, scored = each_scored(spark, tables, name), [], ranking.text_scores

    def counted(*a):
        out = scored(*a)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(ranking, "text_scores", counted)
    got = core.queries()[name](spark, tables).collect()
    assert plain(got) == plain(want) and len({r["qid"] for r in got}) >= QUESTIONS
    assert pairs and sum(pairs) < QUESTIONS * SENTENCES / 100
