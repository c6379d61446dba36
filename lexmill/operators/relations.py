"""Relations read from a dependency parse that the caller supplies as rows, and facts read from source code."""

from __future__ import annotations

import ast
import bisect
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.prep import clean_label


def verb_labels(tokens: DataFrame) -> DataFrame:
    """(sent, i, label, neg): lemma, particles, and whether it is negated. tokens (sent, i, text, lemma, pos, tag, dep, head)."""
    kids = tokens.groupBy("sent", F.col("head").alias("i")).agg(F.sort_array(F.collect_list(F.when(F.col("dep") == "prt", F.struct("i", F.lower("text").alias("t"))))).alias("prt"), F.max((F.col("dep") == "neg").cast("int")).alias("neg"))
    v = tokens.select("sent", "i", F.lower("lemma").alias("lemma")).join(kids, ["sent", "i"], "left")
    parts = F.concat_ws("_", "lemma", F.array_join(F.transform(F.coalesce("prt", F.array()), lambda x: x["t"]), "_"))
    return v.select("sent", "i", F.regexp_replace(parts, "_$", "").alias("label"), (F.coalesce("neg", F.lit(0)) == 1).alias("neg"))


def lexicalized(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sent, s, o, label, pattern, swapped): the relation between two head tokens of a sentence, by the first of seven
    patterns that fits, tried as given and then with the ends exchanged. pairs (sent, s, o)."""
    t = tokens.select("sent", "i", F.lower("lemma").alias("lemma"), "pos", "tag", "dep", "head")
    both = pairs.select("sent", "s", "o", F.col("s").alias("p"), F.col("o").alias("q"), F.lit(False).alias("swapped")).unionByName(pairs.select("sent", "s", "o", F.col("o").alias("p"), F.col("s").alias("q"), F.lit(True).alias("swapped")))

    def side(a: str, key: str) -> DataFrame:
        return t.select("sent", F.col("i").alias(key), F.col("lemma").alias(f"{a}_lemma"), F.col("pos").alias(f"{a}_pos"), F.col("tag").alias(f"{a}_tag"), F.col("dep").alias(f"{a}_dep"), F.col("head").alias(f"{a}_head"))

    d = both.join(side("p", "p"), ["sent", "p"]).join(side("q", "q"), ["sent", "q"])
    d = d.join(side("ph", "p_head"), ["sent", "p_head"], "left").join(side("qh", "q_head"), ["sent", "q_head"], "left")
    reduced = t.filter("dep = 'acl' and pos = 'VERB' and tag = 'VBN'").groupBy("sent", F.col("head").alias("p")).agg(F.min("i").alias("acl"))
    d = d.join(reduced, ["sent", "p"], "left")
    prep = (F.col("q_dep") == "pobj") & (F.col("qh_dep") == "prep")
    governor = F.when(prep, F.col("qh_head"))
    agent = F.when((F.col("p_dep") == "pobj") & (F.col("ph_dep") == "agent"), F.col("ph_head"))
    passive = F.when(F.col("p_dep") == "nsubjpass", F.col("p_head")).otherwise(F.col("acl"))
    subject = F.col("p_dep") == "nsubj"
    pattern = (
        F.when((F.col("q_dep") == "nsubjpass") & (F.col("q_head") == agent), 1)
        .when(subject & F.col("q_dep").isin("dobj", "obj") & (F.col("q_head") == F.col("p_head")), 2)
        .when(subject & (governor == F.col("p_head")) & F.col("ph_pos").isin("VERB", "AUX"), 3)
        .when(governor == passive, 4)
        .when(subject & (F.col("q_dep") == "attr") & (F.col("q_head") == F.col("p_head")) & (F.col("ph_lemma") == "be"), 5)
        .when(F.col("p_pos").isin("NOUN", "PROPN") & (governor == F.col("p")), 6)
        .when((F.col("q_dep") == "compound") & (F.col("q_head") == F.col("p")), 7)
    )
    verb = F.when(pattern == 1, agent).when(pattern == 4, passive).otherwise(F.col("p_head"))
    d = d.withColumn("pattern", pattern).filter("pattern is not null").withColumn("verb", verb)
    v = verb_labels(tokens).select("sent", F.col("i").alias("verb"), F.col("label").alias("v"), "neg")
    d = d.join(v, ["sent", "verb"], "left")
    not_ = F.when(F.col("neg"), F.lit("not_")).otherwise(F.lit(""))
    spoken = F.concat(not_, F.col("v"), F.when(F.col("pattern").isin(3, 4), F.concat(F.lit("_"), F.col("qh_lemma"))).otherwise(F.lit("")))
    label = F.when(F.col("pattern") == 5, F.concat(not_, F.lit("is_a"))).when(F.col("pattern") == 6, clean_label(F.col("qh_lemma"))).when(F.col("pattern") == 7, F.lit("compound")).otherwise(clean_label(spoken))
    d = d.withColumn("label", label).filter("label <> ''")
    w = Window.partitionBy("sent", "s", "o").orderBy("swapped", "pattern")
    return d.withColumn("k", F.row_number().over(w)).filter("k = 1").select("sent", "s", "o", "label", "pattern", "swapped")


def candidate_spans(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(sent, entity, i): first mention of each vocabulary word among a sentence's tokens; a word counts as it is, or
    without a final s or es. tokens (sent, i, text); vocab (token)."""
    w = F.lower(F.regexp_replace("text", r"^\W+|\W+$", ""))
    forms = F.array_distinct(F.filter(F.array(w, F.when(w.endswith("s"), F.expr("substring(lower(regexp_replace(text, '^\\\\W+|\\\\W+$', '')), 1, length(lower(regexp_replace(text, '^\\\\W+|\\\\W+$', ''))) - 1)")), F.when(w.endswith("es"), F.expr("substring(lower(regexp_replace(text, '^\\\\W+|\\\\W+$', '')), 1, length(lower(regexp_replace(text, '^\\\\W+|\\\\W+$', ''))) - 2)"))), lambda x: x.isNotNull()))
    t = tokens.select("sent", "i", F.posexplode(forms).alias("k", "entity")).join(vocab.select(F.col("token").alias("entity")).distinct(), "entity")
    best = t.groupBy("sent", "i").agg(F.min_by("entity", "k").alias("entity"))
    return best.groupBy("sent", "entity").agg(F.min("i").alias("i"))


#: Grammars by suffix.
GRAMMARS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "m": "objc", "mm": "objc", "dart": "dart", "scala": "scala", "lua": "lua", "sh": "bash", "bash": "bash", "ex": "elixir",
    "exs": "elixir", "hs": "haskell", "jl": "julia", "r": "r", "vue": "vue", "svelte": "svelte", "gradle": "groovy", "groovy": "groovy", "zig": "zig",
}


def language(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    pairs = F.create_map(*[F.lit(x) for kv in GRAMMARS.items() for x in kv])
    return F.try_element_at(pairs, suffix)


def python_edges(text: str, source: str, starts: list[int] | None = None) -> list[tuple[str, str, str, int]]:
    """(s, r, o, line) of a Python file: what it defines, contains, calls, imports and inherits; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    module = os.path.basename(source)
    lines = text.splitlines(keepends=True)
    at = [0]
    for ln in lines:
        at.append(at[-1] + len(ln))
    out: dict[tuple[str, str, str, int], None] = {}

    def row(node: ast.AST) -> int:
        n = node.lineno - 1
        return n if starts is None else max(0, bisect.bisect_right(starts, at[n] + node.col_offset) - 1)

    def edge(s: str, r: str, o: str | None, node: ast.AST) -> None:
        if o and s != o:
            out.setdefault((s, r, o, row(node)))

    def last_name(node: ast.AST) -> str | None:
        return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None

    todo: list[tuple[ast.AST, str]] = [(tree, module)]
    while todo:
        node, scope = todo.pop()
        inner = scope
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            edge(scope, "defines" if scope == module else "contains", node.name, node)
            for base in getattr(node, "bases", []):
                edge(node.name, "inherits", last_name(base), base)
            inner = node.name
        elif isinstance(node, ast.Call):
            edge(scope, "calls", last_name(node.func), node)
        elif isinstance(node, ast.Import):
            for a in node.names:
                edge(module, "imports", a.name, node)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                edge(module, "imports", f"{node.module or ''} {a.name}".strip(), node)
        todo += [(c, inner) for c in reversed(list(ast.iter_child_nodes(node)))]
    return list(out)


def code_edges(files: DataFrame) -> DataFrame:
    """(source, s, r, o, sent_idx) from (source, text): Python files by their syntax tree; other languages give none here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, *e) for s, t in zip(b["source"], b["text"]) if t for e in python_edges(t, s)]
            yield pd.DataFrame(rows, columns=["source", "s", "r", "o", "sent_idx"])

    return files.filter(language(F.col("source")) == "python").select("source", "text").mapInPandas(run, "source string, s string, r string, o string, sent_idx int")
