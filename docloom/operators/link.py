"""Linking table rows to findings of the same report, and folding the links back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx

CODE, ITEM, REASON, KEEP = 5.0, 2.0, 1.0, 2.0
REVIEW = (3.0, 6.0)


def _classes(df: DataFrame, key: str, reason, side: str) -> tuple[DataFrame, DataFrame]:
    """Classes of rows that must score alike (one report, code, item and reason tokens), and who is in them."""
    sig = df.where(f"{key} is not null and doc_id is not null").select(
        F.col(key).alias("member"), "doc_id", F.nullif("code", F.lit("")).alias("code"), F.array_sort(tx.token_set("item")).alias("item"), F.array_sort(F.array_distinct(reason)).alias("reason")
    )
    what = ("doc_id", F.coalesce("code", F.lit("")), "item", "reason")
    twice = F.concat_ws(":", F.hex(F.xxhash64(F.lit(side), *what)), F.hex(F.xxhash64(F.lit(side + "2"), *what)))  # 128 bits, so that no strangers meet
    sig = sig.withColumn("class", twice).dropDuplicates(["member"])
    return sig.groupBy("class").agg(*[F.first(c, True).alias(c) for c in ("doc_id", "code", "item", "reason")], F.count("*").alias("n")), sig.select("member", "class")


def link_classes(rows: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between classes of rows and classes of findings, and the membership of both.

    Score: 5 for an equal code, twice the Jaccard similarity of the items, plus that of the reasons; links of 2
    or more count. Without an equal code an item similarity of a half or more is needed for that, so candidates
    are pairs of one report with an equal code or with an equal token in the prefixes of their sorted item tokens
    that two sets of such a similarity must share.
    Links: row_class, finding_class, score (rounded to 3), code_mismatch, needs_review.
    """
    a, in_a = _classes(rows, "row_id", tx.token_set("reason_kw_raw"), "r")
    b, in_b = _classes(findings, "finding_id", tx.token_set(F.array_join("reason_kw_norm", " ")), "f")
    keys = lambda df: df.select("class", "doc_id", F.explode(F.array_distinct(F.concat(F.when(F.col("code").isNotNull(), F.array(F.concat(F.lit("c"), "code"))).otherwise(F.array().cast("array<string>")), F.transform(F.slice("item", 1, F.greatest(F.lit(1), F.size("item") - F.ceil(F.size("item") / 2).cast("int") + 1)), lambda t: F.concat(F.lit("t"), t))))).alias("k"))
    pairs = keys(a).withColumnRenamed("class", "row_class").join(keys(b).withColumnRenamed("class", "finding_class"), ["doc_id", "k"]).select("row_class", "finding_class").distinct()
    x = a.select(F.col("class").alias("row_class"), F.col("code").alias("c1"), F.col("item").alias("i1"), F.col("reason").alias("r1"))
    y = b.select(F.col("class").alias("finding_class"), F.col("code").alias("c2"), F.col("item").alias("i2"), F.col("reason").alias("r2"))
    full = pairs.join(x, "row_class").join(y, "finding_class")
    same = F.coalesce(F.col("c1") == F.col("c2"), F.lit(False))
    score = F.when(same, CODE).otherwise(0.0) + F.lit(ITEM) * tx.jaccard("i1", "i2") + F.lit(REASON) * tx.jaccard("r1", "r2")
    links = full.withColumn("score", score).where(F.col("score") >= KEEP)
    differ = F.coalesce(F.col("c1") != F.col("c2"), F.lit(False))
    links = links.select("row_class", "finding_class", F.round("score", 3).alias("score"), differ.alias("code_mismatch"), ((F.col("score") >= REVIEW[0]) & (F.col("score") < REVIEW[1])).alias("needs_review"))
    return links, in_a, in_b


def link_pairs(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """All links, class members written out: map_id, row_id, finding_id, score, code_mismatch, needs_review."""
    links, in_a, in_b = link_classes(rows, findings)
    a, b = in_a.select(F.col("member").alias("row_id"), F.col("class").alias("row_class")), in_b.select(F.col("member").alias("finding_id"), F.col("class").alias("finding_class"))
    out = links.join(a, "row_class").join(b, "finding_class")
    return out.select(F.concat("row_id", F.lit("→"), "finding_id").alias("map_id"), "row_id", "finding_id", "score", "code_mismatch", "needs_review")


def link_summary(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each linked table row: number of links, of mismatches, of doubtful ones, and the best score."""
    links, in_a, in_b = link_classes(rows, findings)
    size = in_b.groupBy(F.col("class").alias("finding_class")).agg(F.count("*").alias("n"))
    per = links.join(size, "finding_class").groupBy("row_class").agg(
        F.sum("n").alias("links"), F.sum(F.when(F.col("code_mismatch"), F.col("n")).otherwise(0)).alias("mismatches"), F.sum(F.when(F.col("needs_review"), F.col("n")).otherwise(0)).alias("doubtful"), F.max("score").alias("best")
    )
    return in_a.join(per, F.col("class") == F.col("row_class")).select(F.col("member").alias("row_id"), "links", "mismatches", "doubtful", "best")


def fold_links(findings: DataFrame, links: DataFrame, key: str = "finding_id") -> DataFrame:
    """Each finding's key with its sorted row ids and whether any link has differing codes; [] and false without links."""
    per = links.groupBy(key).agg(F.array_sort(F.collect_set("row_id")).alias("row_ids"), F.bool_or("code_mismatch").alias("code_mismatch"))
    out = findings.select(key).where(F.col(key).isNotNull()).distinct().join(per, key, "left")
    return out.select(key, F.coalesce("row_ids", F.array().cast("array<string>")).alias("row_ids"), F.coalesce("code_mismatch", F.lit(False)).alias("code_mismatch"))


def child_count(parents: DataFrame, children: DataFrame, key: str, child: str) -> DataFrame:
    """Each parent key with its number of different children, 0 without."""
    n = children.where(F.col(child).isNotNull()).select(key, child).distinct().groupBy(key).agg(F.count("*").alias("n"))
    return parents.select(key).where(F.col(key).isNotNull()).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def with_title(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """Findings with the title of their report; the report's id where the title is null, blank or the report is missing."""
    titles = reports.where(tx.strip("title") != "").groupBy("doc_id").agg(F.max("title").alias("t"))
    return findings.join(titles, "doc_id", "left").withColumn("doc_title", F.coalesce("t", "doc_id")).drop("t")
