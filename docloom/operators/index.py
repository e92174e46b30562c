"""Full-text index tables and BM25 over them or over the text itself.

``postings`` is the index: one row for each field, term and document. ``bm25`` scores straight from text columns in
one pass for ad-hoc queries (term counts by array functions, statistics in one aggregate); ``bm25_index`` reads only
the postings of the query's terms.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import text as tx
from docloom.operators import link, ordered, store
from docloom.runtime import materialize, spread

K1, B = 1.2, 0.75


def analyzed(c: Column | str, bigrams: bool = False) -> Column:
    """Lower-case tokens; with ``bigrams`` each Hangul token's pairs of syllables as well, in place of a morphological analysis."""
    t = F.transform(tx.tokens(c), F.lower)
    if not bigrams:
        return t
    pairs = F.flatten(F.transform(F.filter(t, lambda x: x.rlike("^[가-힣]{3,}$")), lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x) - 1), lambda i: x.substr(i, F.lit(2)))))
    return F.concat(t, pairs)


def postings(df: DataFrame, key: str, fields: Sequence[str], bigrams: bool = False) -> DataFrame:
    """``field``, ``term``, ``id``, ``tf``, ``dl`` (tokens of the field). Null keys and empty fields give no row."""
    parts = [df.where(F.col(key).isNotNull()).select(F.lit(f).alias("field"), F.col(key).alias("id"), analyzed(f, bigrams).alias("t")) for f in fields]
    t = reduce(lambda a, b: a.unionByName(b), parts)
    return t.select("field", "id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("field", "term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def field_stats(df: DataFrame, key: str, fields: Sequence[str], bigrams: bool = False) -> DataFrame:
    """``field``, ``docs`` (rows with a token), ``avgdl``."""
    parts = [df.where(F.col(key).isNotNull()).select(F.lit(f).alias("field"), F.size(analyzed(f, bigrams)).alias("dl")) for f in fields]
    t = reduce(lambda a, b: a.unionByName(b), parts).where("dl > 0")
    return t.groupBy("field").agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf / (tf + F.lit(K1) * (1 - F.lit(B) + F.lit(B) * dl / avgdl))


def write_index(df: DataFrame, key: str, fields: Sequence[str], path: str, bigrams: bool = False, parts: int = 64) -> None:
    """Postings clustered by term (a query reads few row groups) and field statistics, written under ``path``."""
    p = postings(df, key, fields, bigrams)
    p.repartitionByRange(parts, "field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/postings")
    field_stats(df, key, fields, bigrams).write.mode("overwrite").parquet(f"{path}/stats")


def bm25_index(posted: DataFrame, stats: DataFrame, terms: Sequence[str], boosts: Mapping[str, float]) -> DataFrame:
    """``id``, ``field``, ``score``: each document's boosted score in each field, from an index; only documents with a term."""
    hit = posted.where(F.col("term").isin([t.lower() for t in dict.fromkeys(terms)]) & F.col("field").isin(list(boosts)))
    df = hit.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    each = hit.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")  # as many rows as query terms and fields
    part = _idf(F.col("docs"), F.col("df")) * _saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return each.groupBy("id", "field").agg((F.sum(part) * F.element_at(boost, F.col("field"))).alias("score"))


def bm25(df: DataFrame, key: str, terms: Sequence[str], boosts: Mapping[str, float], each_term: bool = False, at: str | None = None) -> DataFrame:
    """BM25 of ``terms`` in the fields of ``boosts``.

    With ``at`` rows of one key are one record, that with the greatest ``at``: it is chosen among counts, so texts
    aren't shuffled for it; those of one or two small files are spread over the cores before they are tokenised.

    Returns ``id`` and ``score``, the best boosted field score of each row with a term (``each_term``: also ``term``, one row a
    matching term). No terms give no rows; null fields have no tokens. The texts are read once: the pass that
    writes out the rows with a term observes the statistics of all rows on its way.
    """
    terms = list(dict.fromkeys(t for q in terms for t in [q.lower()] if t))
    fields = list(boosts)
    kind = df.schema[key].dataType.simpleString()
    if not terms or not fields:
        return df.sparkSession.createDataFrame([], f"id {kind}, {'term string, ' if each_term else ''}score double")
    src = spread(df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, *([at] if at else []), *fields])))  # tokens cost more than the scan
    toks = src.select(F.col(key).alias("id"), (F.col(at) if at else F.lit(0)).alias("at"), *[_lowered(f).alias(f"t{i}") for i, f in enumerate(fields)])
    count = lambda i, t: F.size(f"t{i}") - F.size(F.array_remove(F.col(f"t{i}"), t))
    names = [f"tf{i}_{j}" for i in range(len(fields)) for j in range(len(terms))]
    tf = toks.select("id", "at", *[F.size(f"t{i}").alias(f"dl{i}") for i in range(len(fields))], *[count(i, t).alias(f"tf{i}_{j}") for i in range(len(fields)) for j, t in enumerate(terms)])
    if at:
        tf = store.first_wins(tf, ["id"], [F.desc("at")])
    seen = Observation()
    watched = tf.observe(
        seen,
        *[F.count_if(F.col(f"dl{i}") > 0).alias(f"n{i}") for i in range(len(fields))],
        *[F.sum(F.col(f"dl{i}").cast("long")).alias(f"len{i}") for i in range(len(fields))],
        *[F.count_if(F.col(n) > 0).alias(f"df{n[2:]}") for n in names],
    )
    hit = materialize(watched.where(reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names])), "bm25")
    got = seen.get

    def score(i: int, j: int) -> Column:
        n, t = got[f"n{i}"] or 0, F.col(f"tf{i}_{j}")
        if not n:
            return F.lit(0.0)
        idf = math.log(1 + (n - got[f"df{i}_{j}"] + 0.5) / (got[f"df{i}_{j}"] + 0.5))
        return F.when(t > 0, F.lit(idf) * _saturation(t, F.col(f"dl{i}"), F.lit(got[f"len{i}"] / n))).otherwise(0.0)

    def best(js: Sequence[int]) -> Column:
        per = [reduce(lambda a, b: a + b, [score(i, j) for j in js]) * F.lit(float(boosts[f])) for i, f in enumerate(fields)]
        return F.greatest(*per) if len(per) > 1 else per[0]

    if not each_term:
        return hit.select("id", best(range(len(terms))).alias("score"))
    each = F.array(*[F.struct(F.lit(t).alias("term"), best([j]).alias("score")) for j, t in enumerate(terms)])
    return hit.select("id", F.explode(each).alias("x")).select("id", "x.term", "x.score").where("score > 0")


def _lowered(c: Column | str) -> Column:
    """Lower-case tokens by functions that compile: joined, lowered and split again."""
    t = tx.tokens(c)
    return F.when(F.size(t) > 0, F.split(F.lower(F.array_join(t, " ")), " ")).otherwise(F.array().cast("array<string>"))


def finding_documents(findings: DataFrame, reports: DataFrame, links: DataFrame, rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """One denormalised document for each finding: title, order in its report, row ids and their codes, chunk count."""
    one = findings.where("finding_id is not null").groupBy("finding_id").agg(F.max(F.struct("ingested_at", *[c for c in findings.columns if c not in ("finding_id", "ingested_at")])).alias("s")).select("finding_id", "s.*") if "ingested_at" in findings.columns else findings
    titled = link.with_title(one, reports)
    folded = link.fold_links(one, links)
    codes = links.join(rows.where("code is not null").select("row_id", "code").distinct(), "row_id").groupBy("finding_id").agg(F.array_sort(F.collect_set("code")).alias("codes_from_rows"))
    counts = link.child_count(one, chunks, "finding_id", "chunk_id").withColumnRenamed("n", "chunk_count")
    out = ordered.numbered(titled, ["doc_id"], ["start_line", "finding_id"], "finding_order").join(folded, "finding_id", "left").join(codes, "finding_id", "left").join(counts, "finding_id", "left")
    return out.withColumns({"item_norm": tx.bare_item("item"), "codes_from_rows": F.coalesce("codes_from_rows", F.array().cast("array<string>")), "overview_keywords": F.array_join(F.coalesce("reason_kw_norm", F.array().cast("array<string>")), " ")})


def law_documents(laws: DataFrame, version: str = schemas.VERSION) -> DataFrame:
    """Laws as they are indexed: one row a law, the default version where there is none, and the text that is searched."""
    text = F.concat_ws("\n", *[F.nullif(tx.strip(c), F.lit("")) for c in ("law_name", "law_content")])
    return laws.where("law_id is not null").withColumns({"extraction_version": F.coalesce("extraction_version", F.lit(version)), "text": text})


def chunk_documents(chunks: DataFrame, longest: int = 32766) -> DataFrame:
    """Chunks as they are indexed: texts filled in, a line range where both ends are known, and whether the text is short enough for exact matching."""
    fill = lambda c: F.coalesce(F.nullif(tx.strip(c), F.lit("")), tx.strip("text"))
    span = F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), F.struct(F.col("start_line").alias("gte"), F.col("end_line").alias("lte")))
    return chunks.withColumns({"text_norm": fill("text_norm"), "text_raw": fill("text_raw"), "line_range": span, "exact": F.octet_length("text") <= longest})
