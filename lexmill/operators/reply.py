"""Replies: the best lines that fit a budget of tokens.

Packing is a fold over a question's lines in rank order. The lines stream through it, sorted by question and rank, so it
reads as many ranks as it takes and holds the lines kept of one question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.graph import DIVIDER

HEAD = "From the indexed documents, best match first:"
LOW = "Low confidence: these lines may not answer the question. If none of them states the answer, reply that the documents do not say."
WHOLE = "All of the indexed text fits here ({docs} document{s}):"
NONE = "Nothing in the indexed documents matches this question."
SKIPS = 32
#: part of a budget that facts may take
FACT_SHARE = 0.4
#: rows that are decoded at once while a question's fold goes on
STEP = 256


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows kept. Rows come by question, in rank order: qid, pos, text, line, width, file, name, head, budget.

    A line is kept if all lines so far, joined by newlines after the head, stay within the budget; a text already kept
    is passed over; a line that does not fit is skipped, and after 32 skips in a row the fold keeps no more. The first
    line of a code file also costs the file's name (`name` characters; 0 for lines that stand alone).
    """
    now, chars, skips, kept, seen, files = None, 0, 0, 0, set(), set()
    for batch in batches:
        qid, width, name, head, budget = (batch[c].to_numpy(zero_copy_only=False) for c in ("qid", "width", "name", "head", "budget"))
        texts, picks, numbers = batch["text"], [], []
        bounds = [0, *(np.flatnonzero(qid[1:] != qid[:-1]) + 1), len(qid)] if len(qid) else []
        for a, b in zip(bounds, bounds[1:]):
            if kept == skips == 0 or qid[a] != now:
                now, chars, skips, kept, seen, files = qid[a], 0, 0, 0, set(), set()
            for at in range(a, b, STEP):
                if skips >= SKIPS:
                    break
                n = min(STEP, b - at)
                for i, text, file in zip(range(at, at + n), texts.slice(at, n).to_pylist(), batch["file"].slice(at, n).to_pylist()):
                    if text in seen:
                        continue
                    longer = chars + int(width[i]) + 1 + (int(name[i]) + 1 if name[i] and file not in files else 0)
                    if max(1, (int(head[i]) + longer) // 4) > budget[i]:
                        skips += 1
                        if skips >= SKIPS:
                            break
                        continue
                    chars, skips, kept = longer, 0, kept + 1
                    seen.add(text)
                    if name[i]:
                        files.add(file)
                    picks.append(i)
                    numbers.append(kept)
        out = batch.take(pa.array(picks, pa.int64()))
        yield pa.RecordBatch.from_arrays([out["qid"], pa.array(numbers, pa.int32()), out["pos"], out["line"]], ["qid", "line_no", "pos", "line"])


def folded(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(qid, line_no, pos, line) from (qid, pos, text, line, width, file, name, head, budget) in the order given."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("qid", "pos")}
    ordered = rows.repartition("qid").sortWithinPartitions("qid", *order)
    return ordered.select("qid", "pos", "text", "line", "width", "file", "name", "head", "budget").mapInArrow(_fold, f"qid {kinds['qid']}, line_no int, pos {kinds['pos']}, line string")


def packed(scores: DataFrame, questions: DataFrame, sentences: DataFrame, default_budget: int = 600, line: Column | None = None, head: Column | None = None, grouped: bool = False) -> DataFrame:
    """(qid, line_no, pos, line): what each reply holds below its head.

    scores (qid, pos, score); questions (qid, budget); sentences (pos, source, text, shown[, is_prose]). Copies of a
    text already kept do not count as skips, so no number of ranks is enough for every question: all are offered to
    the fold. With `grouped`, code lines are measured as they stand below their file's name (see `grouped_code`).
    """
    line = line if line is not None else T.compact_line(F.col("source"), F.col("text"), F.coalesce(F.col("shown"), F.lit("")))
    code = ~F.col("is_prose") if grouped else F.lit(False)
    q = questions.select("qid", F.coalesce("budget", F.lit(default_budget)).cast("bigint").alias("budget"), (F.length(head) if head is not None else F.lit(len(HEAD))).cast("bigint").alias("head"))
    d = scores.filter("score > 0").join(sentences.select("pos", "source", "text", "shown", *(["is_prose"] if grouped else [])), "pos").join(q, "qid")
    d = d.withColumn("line", F.when(code, F.concat(F.lit("  "), T.one_line(F.col("text")))).otherwise(line)).filter("line is not null")
    d = d.select("qid", "pos", "score", "text", "line", F.length("line").cast("bigint").alias("width"), F.col("source").alias("file"), F.when(code, F.length("source") + 2).otherwise(0).cast("bigint").alias("name"), "head", "budget")
    return folded(d, [F.col("score").desc(), F.col("pos")])


def fitted_lines(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(qid, line_no, line): those of (qid, place, line) that fit below a head of (qid, head, budget); a line too long is
    passed over, not a stop."""
    d = lines.join(heads.select("qid", F.col("head").cast("bigint").alias("head"), F.col("budget").cast("bigint").alias("budget")), "qid")
    d = d.select("qid", F.col("place").alias("pos"), F.concat(F.col("place").cast("string"), F.lit(" "), F.col("line")).alias("text"), "line", F.length("line").cast("bigint").alias("width"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("name"), "head", "budget")
    return folded(d, [F.col("pos")]).select("qid", "line_no", "line")


def fact_block(facts: DataFrame, heads: DataFrame) -> DataFrame:
    """(qid, line_no, line): the facts above a reply's sentences, within FACT_SHARE of its budget: facts with words first,
    then a divider and the others, if one of them fits. facts (qid, place, line, cls); heads (qid, head, budget)."""
    share = heads.select("qid", "head", F.floor(F.col("budget") * FACT_SHARE).alias("budget"))
    words = fitted_lines(facts.filter("not cls").select("qid", "place", "line"), share)
    used = words.groupBy("qid").agg(F.sum(F.length("line") + 1).alias("n"), F.max("line_no").alias("last"))
    below = share.join(used, "qid", "left").select("qid", (F.col("head") + F.coalesce("n", F.lit(0)) + len(DIVIDER) + 1).alias("head"), "budget", F.coalesce("last", F.lit(0)).alias("last"))
    other = fitted_lines(facts.filter("cls").select("qid", "place", "line"), below).join(below.select("qid", "last"), "qid")
    divider = other.groupBy("qid").agg((F.max("last") + 1).alias("line_no")).withColumn("line", F.lit(DIVIDER))
    return words.unionByName(divider.select("qid", "line_no", "line")).unionByName(other.select("qid", (F.col("last") + 1 + F.col("line_no")).alias("line_no"), "line"))


def grouped_code(packed_lines: DataFrame, sentences: DataFrame) -> DataFrame:
    """(qid, order, line): code lines under their file's name, the file where its first line was picked, lines in file order."""
    p = packed_lines.join(sentences.select("pos", "source", "sent_idx", "text", "is_prose"), "pos")
    first = F.min("line_no").over(Window.partitionBy("qid", "source"))
    p = p.withColumn("at", F.when(F.col("is_prose"), F.col("line_no")).otherwise(first)).withColumn("sub", F.when(F.col("is_prose"), 0).otherwise(F.col("sent_idx") + 1))
    heads = p.filter("not is_prose").select("qid", "at", F.lit(0).alias("sub"), F.concat(F.lit("["), "source", F.lit("]")).alias("line")).distinct()
    rows = p.select("qid", "at", "sub", F.when(F.col("is_prose"), F.col("line")).otherwise(F.concat(F.lit("  "), T.one_line(F.col("text")))).alias("line"))
    w = Window.partitionBy("qid").orderBy("at", "sub")
    return heads.unionByName(rows).withColumn("order", F.row_number().over(w)).select("qid", "order", "line")


def whole_corpus(sentences: DataFrame) -> DataFrame:
    """(pos, line): every sentence in order; the section is named where it changes. sentences (pos, source, text, shown)."""
    w = Window.partitionBy("source").orderBy("pos")
    shown = F.coalesce("shown", F.lit(""))
    before = F.lag(F.struct("source", shown.alias("shown"))).over(w)
    same = F.coalesce((before["shown"] == shown), F.lit(False))
    return sentences.select("pos", F.when(same, F.concat(F.lit("["), "source", F.lit("] "), T.one_line(F.col("text")))).otherwise(T.compact_line(F.col("source"), F.col("text"), shown)).alias("line"))


def fits_whole(lines: DataFrame, docs: int, budget: int) -> bool:
    n = lines.agg(F.coalesce(F.sum(F.length("line") + 1), F.lit(0))).first()[0]
    return n > 0 and max(1, (n + len(WHOLE.format(docs=docs, s="" if docs == 1 else "s"))) // 4) <= budget


def rendered(packed_lines: DataFrame, questions: DataFrame, conf: DataFrame | None = None) -> DataFrame:
    """(qid, reply, conf): head and lines as one text; without lines, that nothing matches."""
    body = packed_lines.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    q = questions.select("qid")
    q = q.join(conf.select("qid", "conf"), "qid", "left") if conf is not None else q.withColumn("conf", F.lit(None).cast("double"))
    head = F.when(F.coalesce(F.col("conf") < 0.3, F.lit(False)), LOW).otherwise(HEAD)
    return q.join(body, "qid", "left").select("qid", F.when(F.col("body").isNull(), NONE).otherwise(F.concat_ws("\n", head, "body")).alias("reply"), "conf")


def widened_budget(budget: Column, conf: Column, most: int = 4_000) -> Column:
    """Twice the budget, at most 4000, where the best line is doubtful."""
    return F.when(conf < 0.3, F.least(budget * 2, F.lit(most))).otherwise(budget)


def hop_names(packed_lines: DataFrame, questions: DataFrame, sentences: DataFrame, lines: int = 2, names: int = 4) -> DataFrame:
    """(qid, names): capitalized names that the two best prose lines bring in and the question does not have."""
    top = packed_lines.filter(F.col("line_no") <= lines).join(sentences.select("pos", "text", "is_prose"), "pos")
    whole = Window.partitionBy("qid")
    top = top.withColumn("all_prose", F.min(F.col("is_prose").cast("int")).over(whole)).filter("all_prose = 1")
    each = top.select("qid", "line_no", F.posexplode(T.capitalized_names(T.one_line(F.col("text")))).alias("at", "name")).join(questions.select("qid", T.norm_words(F.col("question")).alias("asked")), "qid")
    each = each.filter((F.length("name") > 2) & (F.size(T.norm_words(F.col("name"))) > 0) & (F.size(F.array_except(T.norm_words(F.col("name")), F.col("asked"))) > 0))
    once = each.groupBy("qid", "name").agg(F.min(F.struct("line_no", "at")).alias("k"))
    return once.groupBy("qid").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), 1, names).alias("names"))


def interleaved_lines(first: DataFrame, second: DataFrame) -> DataFrame:
    """(qid, order, line): lines of two replies in turns, each line once at its first place."""
    both = first.select("qid", (F.col("line_no") * 2).alias("k"), "line").unionByName(second.select("qid", (F.col("line_no") * 2 + 1).alias("k"), "line"))
    once = both.groupBy("qid", "line").agg(F.min("k").alias("k"))
    return once.withColumn("order", F.row_number().over(Window.partitionBy("qid").orderBy("k"))).select("qid", "order", "line")


def within_size(merged: DataFrame, cap: DataFrame, head: int = len(HEAD)) -> DataFrame:
    """Lines as long as the whole stays within the token size of the first reply. cap (qid, tokens)."""
    w = Window.partitionBy("qid").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    m = merged.withColumn("chars", F.sum(F.length("line") + 1).over(w)).join(cap, "qid")
    ok = F.floor((F.col("chars") + head) / 4) <= F.col("tokens")
    return m.withColumn("bad", F.sum((~ok).cast("int")).over(w)).filter("bad = 0").select("qid", "order", "line")


def searched(sentences: DataFrame, terms: DataFrame, limit: int = 8) -> DataFrame:
    """(term, pos, place, total): sentences that hold every word of a term, in corpus order. A term's rarest use is a scan:
    the terms are few and asked together, so the sentences are read once."""
    t = terms.select("term").distinct()
    hit = sentences.select("pos", "text").join(t, T.contains_all_words(F.col("text"), F.col("term")))
    w = Window.partitionBy("term")
    return hit.withColumn("place", F.row_number().over(w.orderBy("pos"))).withColumn("total", F.count("*").over(w)).filter(F.col("place") <= limit).select("term", "pos", "place", "total")
