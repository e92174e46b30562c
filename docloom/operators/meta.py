"""Metadata of findings: vocabulary tags, candidate normalisation, keyword overviews, vocabulary coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx


def vocabulary_table(spark: SparkSession, vocabularies: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """``kind``, ``label``, ``pattern``: each label with itself and its synonyms as patterns."""
    rows = [(k, label, p) for k, v in vocabularies.items() for label, syn in v.items() for p in dict.fromkeys((label, *syn))]
    return spark.createDataFrame(rows, "kind string, label string, pattern string")


def tag(df: DataFrame, text: str, vocabularies: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """``df`` with an array column of sorted labels for each vocabulary, found as substrings of the text."""
    return df.withColumns({kind: tx.labels(F.coalesce(text, F.lit("")), v) for kind, v in vocabularies.items()})


def best_candidates(names: DataFrame, canon: DataFrame, name: str = "name", label: str = "label", above: float = 0.6) -> DataFrame:
    """``name``, ``label``, ``score``: for each distinct name the canonical label of highest token-set cosine, if above ``above``.

    Only pairs that share a token are formed, by a join on the token. Ties go to the lower label. Names without a token
    or a close enough label are left out.
    """
    a = names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("t", tx.token_set("name"))
    b = canon.select(F.col(label).alias("label")).where("label is not null").distinct().withColumn("u", tx.token_set("label"))
    x = a.select("name", F.size("t").alias("nt"), F.explode("t").alias("token"))
    y = b.select("label", F.size("u").alias("nu"), F.explode("u").alias("token"))
    shared = x.join(y, "token").groupBy("name", "label").agg(F.count("*").alias("both"), F.first("nt").alias("nt"), F.first("nu").alias("nu"))
    scored = shared.select("name", "label", (F.col("both") / F.sqrt(F.col("nt").cast("double") * F.col("nu"))).alias("score")).where(F.col("score") > above)
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("m"))
    return best.select("name", F.col("m.label").alias("label"), (-F.col("m.s")).alias("score"))


def keyword_overview(df: DataFrame, key: str, keywords: str, top: int = 6) -> DataFrame:
    """``key``, ``overview``: the first ``top`` of the sorted different keywords of a key's rows."""
    each = df.select(key, F.explode(keywords).alias("k")).where("k is not null").distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("k"))
    return each.withColumn("r", rank).where(F.col("r") <= top).groupBy(key).agg(F.array_sort(F.collect_list("k")).alias("overview"))


def word_report(df: DataFrame, text: str, patterns: Sequence[str], top: int = 30, pattern: str = "[가-힣]{2,}") -> DataFrame:
    """``word``, ``n``, ``known``: the ``top`` most frequent words; known if a vocabulary pattern has the word in it. Ties by word."""
    words = df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    joined = "\n".join(patterns)
    return words.orderBy(F.desc("n"), "word").limit(top).withColumn("known", F.lit(joined).contains(F.col("word")))


def missing_words(report: DataFrame, least: int = 2, top: int = 20) -> DataFrame:
    return report.where((~F.col("known")) & (F.col("n") >= least)).orderBy(F.desc("n"), "word").limit(top)
