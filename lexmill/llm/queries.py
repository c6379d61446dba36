"""Queries pN_... of the training-data operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import distinctive, fusion, languages, lookalikes, markup, mixing, packing, sentences, tokens, vectors


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.most_distinctive(_read(spark, d, "questions"))


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    s = distinctive.distinctiveness(_read(spark, d, "questions"))
    return s.select("qid", "term", "tf", "cf", F.round("score", 6).alias("score"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Rows delivered twice once."""
    return _read(spark, d, "sentences").groupBy("pos").agg(F.max("text").alias("text"), F.max("section").alias("section"), F.max("is_prose").alias("is_prose"))


def _splitter(spark: SparkSession, d: str) -> sentences.Model:
    delivered = _read(spark, d, "sentences").filter("is_prose")
    return sentences.splitter(_read(spark, d, "lang_refs"), delivered, _read(spark, d, "documents"))


def _tagged(df: DataFrame, tab: str, id_col: str) -> DataFrame:
    return df.withColumnRenamed(id_col, "rec_id").select(F.lit(tab).alias("tab"), "*")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    model = _splitter(spark, d)
    docs = _read(spark, d, "documents").select("doc_id", "text").join(_read(spark, d, "split_docs").select("doc_id"), "doc_id", "left_semi")
    sents = _read(spark, d, "sentences").filter("is_prose").select("pos", "text")
    both = _tagged(sentences.split_units(docs, model), "documents", "doc_id").unionByName(_tagged(sentences.split_units(sents, model, "pos"), "sentences", "pos"))
    return both.filter("unit > 0").select("tab", "rec_id", F.col("start_at").cast("long").alias("start_at")).distinct()


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    model = _splitter(spark, d)
    docs, sents = _read(spark, d, "documents"), _sentences(spark, d)
    return _tagged(sentences.split_units(docs, model), "documents", "doc_id").unionByName(_tagged(sentences.split_units(sents, model, "pos"), "sentences", "pos"))


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").filter("modality = 'prose'").select("doc_id", "text")
    # each heading path is read once, however many sentences stand below it
    paths = _read(spark, d, "sentences").filter("section is not null").select("section").distinct()
    cleaned = markup.clean_texts(paths.withColumn("path", F.col("section")), "section", "path", " \u203a ")
    sents = _read(spark, d, "sentences").select("pos", "section").distinct().join(cleaned, "section", "left").drop("section")
    sents = sents.withColumns({c: F.coalesce(c, F.array().cast(sents.schema[c].dataType)) for c in ("blocks", "notations")})
    return _tagged(markup.clean_texts(docs), "documents", "doc_id").unionByName(_tagged(sents, "sentences", "pos"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select("tab", "rec_id", F.explode("notations").alias("markup")).distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_read(spark, d, "documents"), _read(spark, d, "source_specs")).filter("short").select("name")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(_read(spark, d, "documents"), _read(spark, d, "source_specs"))


def p4_schedule(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_schedule(_read(spark, d, "documents"), _read(spark, d, "source_specs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_of_each(fusion.fused_scores(_read(spark, d, "features")))


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fused_scores(_read(spark, d, "features")).withColumn("fused", F.round("fused", 6) + F.lit(0.0))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(_read(spark, d, "sent_vectors")).select("pos_a", "pos_b")


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(_read(spark, d, "sent_vectors"))


def _profiles(spark: SparkSession, d: str) -> tuple[languages.Profiles, dict[str, str]]:
    docs = _read(spark, d, "documents").filter("modality = 'prose'").select(F.col("sonar_lang").alias("label"), "text")
    samples = _read(spark, d, "samples").filter("category in ('prose', 'num')").select(F.col("lang").alias("label"), "text")
    return languages.train(_read(spark, d, "lang_refs"), [docs, samples])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    profiles, labels = _profiles(spark, d)
    docs = _read(spark, d, "documents").filter("modality = 'prose'")
    samples = _read(spark, d, "samples").filter("category in ('prose', 'num')").select("sample_id", "text", "lang").distinct()
    a = languages.missing_languages(docs, profiles, labels, "doc_id", "text", "sonar_lang")
    b = languages.missing_languages(samples, profiles, labels, "sample_id", "text", "lang")
    return _tagged(a, "documents", "doc_id").unionByName(_tagged(b, "samples", "sample_id"))


def p7_stretches(spark: SparkSession, d: str) -> DataFrame:
    profiles, _ = _profiles(spark, d)
    samples = _read(spark, d, "samples").groupBy("sample_id").agg(F.max("text").alias("text"))
    a = languages.language_stretches(_read(spark, d, "documents"), profiles)
    b = languages.language_stretches(samples, profiles, "sample_id")
    return _tagged(a, "documents", "doc_id").unionByName(_tagged(b, "samples", "sample_id"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(_read(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_items(packing.pack_texts(_read(spark, d, "documents")))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(_read(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack_texts(_read(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_pairs(_read(spark, d, "documents")).toDF("doc_a", "doc_b")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_classes(_read(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_forms(_read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import re

    return {k: v for k, v in sorted(globals().items()) if re.match(r"p\d+_", k)}
