"""Hybrid retrieval: keyword document sets, BM25 and vector legs, reciprocal rank fusion, cut-offs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import vector as vx
from docloom.operators import index as ix
from docloom.operators import store
from docloom.runtime import materialize


def top(df: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The ``k`` highest rows; equal scores by key. Planned as a distributed top-k, not as a sort."""
    return df.orderBy(F.desc(score), key).limit(k)


def keyword_documents(findings: DataFrame, words: Sequence[str], key: str, doc: str, boosts: Mapping[str, float], hits: int = 50) -> DataFrame:
    """``term``, ``doc_id``, ``score``: for each keyword the documents of its ``hits`` best rows, with their best score."""
    s = ix.bm25(findings, key, words, boosts, each_term=True)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "id"))
    best = s.withColumn("r", rank).where(F.col("r") <= hits)  # planned as a limit per group before the shuffle
    return best.join(findings.select(F.col(key).alias("id"), F.col(doc).alias("doc_id")).distinct(), "id").groupBy("term", "doc_id").agg(F.max("score").alias("score"))


def document_set(found: DataFrame, words: int, cap: int = 30) -> DataFrame:
    """``doc_id``: documents that all keywords have in common; if there are none, those of any keyword, at most ``cap`` by score.

    With a single keyword its documents. ``found`` comes from :func:`keyword_documents`, which has bounded it.
    """
    per = found.groupBy("doc_id").agg(F.countDistinct("term").alias("terms"), F.max("score").alias("score"))
    if words < 2:
        return per.select("doc_id")
    marked = per.withColumn("all", F.col("terms") >= words)
    marked = marked.withColumn("any_all", F.max("all").over(Window.partitionBy()))  # at most hits x keywords rows
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "doc_id"))
    return marked.withColumn("r", rank).where(F.when(F.col("any_all"), F.col("all")).otherwise(F.col("r") <= cap)).select("doc_id")


def conditions(equals: Mapping[str, object] | None = None, within: Mapping[str, Sequence] | None = None, overlaps: Mapping[str, Sequence] | None = None, any_of: Sequence[Mapping[str, object]] = ()) -> Column:
    """A filter: columns equal to a value, in a list, arrays that share a value with a list, and one of ``any_of`` (each a set of equal values). Empty parts pass all."""
    parts = [F.col(c) == F.lit(v) for c, v in (equals or {}).items() if v is not None]
    parts += [F.col(c).isin(list(v)) for c, v in (within or {}).items() if v]
    parts += [F.arrays_overlap(F.col(c), F.array(*map(F.lit, v))) for c, v in (overlaps or {}).items() if v]
    either = [conditions(x) for x in any_of if x]
    if either:
        parts.append(reduce(lambda a, b: a | b, either))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def bool_search(df: DataFrame, key: str, must: Sequence[str], should: Sequence[str], boosts: Mapping[str, float], minimum: int = 0, where: Column | None = None, at: str | None = None) -> DataFrame:
    """``id``, ``score``: rows with all ``must`` words and ``minimum`` of the ``should`` words; the scores of all words that match add up.

    Each word counts by its best field. Without must-words and with a minimum of 0 one word has to match all the same.
    """
    low = lambda ws: list(dict.fromkeys(w.lower() for w in ws if w))
    need, may = low(must), low(should)
    each = ix.bm25(df if where is None else df.where(where), key, [*need, *may], boosts, each_term=True, at=at)
    per = each.groupBy("id").agg(F.sum("score").alias("score"), F.count_if(F.col("term").isin(need)).alias("m"), F.count_if(F.col("term").isin(may)).alias("s"))
    return per.where((F.col("m") == len(need)) & (F.col("s") >= minimum)).select("id", "score")


def vector_top(vectors: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "vector", least: float | None = None, at: str | None = None) -> DataFrame:
    """``id``, ``score``: the ``k`` most similar rows by exact cosine, of at least ``least``. Unusable vectors match nothing.

    Whole batches are multiplied with the query, so vectors leave the scan as scores. With ``at`` rows of one key are one
    record, that with the greatest ``at``; else each task keeps the ``k`` best of a batch.
    """
    src = vectors.select(F.col(key).alias("id"), (F.col(at) if at else F.lit(0)).alias("at"), F.when(F.size(vector) == len(query), F.col(vector).cast("array<double>")).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    s = src.mapInArrow(vx.scorer(query, k if at is None else None, least), f"id {kinds['id']}, at {kinds['at']}, score double")
    if at:
        s = store.first_wins(s, ["id"], [F.desc("at")]).where(F.col("score").isNotNull())
    s = s.select("id", "score")
    return top(s if least is None else s.where(F.col("score") >= least), k)


def rrf(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of bounded ranked lists (``id``, ``score``): ``id``, ``score``, and ``r0``, ``r1``.. the ranks in each list.

    Ranks count from 1 by score, then id. Order for cutting: score, then rank in the first list, in the second...
    """
    ranked = [d.select("id", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "id")).alias(f"r{i}")) for i, d in enumerate(lists)]
    out = reduce(lambda a, b: a.join(b, "id", "full"), ranked)
    part = [F.coalesce(1 / (F.lit(float(k)) + F.col(f"r{i}")), F.lit(0.0)) for i in range(len(lists))]
    return out.select("id", reduce(lambda a, b: a + b, part).alias("score"), *[f"r{i}" for i in range(len(lists))])


def fused_top(fused: DataFrame, n: int) -> DataFrame:
    ranks = sorted(c for c in fused.columns if c[0] == "r" and c[1:].isdigit())
    return fused.orderBy(F.desc("score"), *[F.col(r).asc_nulls_last() for r in ranks], "id").limit(n)


def relative_cut(df: DataFrame, share: float = 0.5, score: str = "score") -> DataFrame:
    """Rows of at least ``share`` of the highest score."""
    best = df.agg(F.max(score).alias("_best"))
    return df.crossJoin(F.broadcast(best)).where(F.col(score) >= F.lit(share) * F.col("_best")).drop("_best")


def keyword_frequency(df: DataFrame, words: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """One row, a column n0, n1.. for each keyword: the rows that have it in any of the text columns, in one pass."""
    has = lambda w: reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(t), F.lit(w)), F.lit(False)) for t in texts])
    return df.agg(*[F.count_if(has(w)).alias(f"n{i}") for i, w in enumerate(words)]) if words else df.sparkSession.createDataFrame([], "n0 long").limit(0)


@dataclass(frozen=True)
class Hybrid:
    """Settings of a hybrid search."""

    boosts: Mapping[str, float]
    text_k: int = 150
    vector_k: int = 150
    rrf_k: int = 60
    least: float = 0.35
    n: int = 100


def hybrid_search(df: DataFrame, key: str, terms: Sequence[str], vectors: DataFrame | None, vector_key: str, query: Sequence[float] | None, s: Hybrid, where: Column | None = None, at: str | None = None, vector_at: str | None = None) -> DataFrame:
    """``id``, ``score``, ``r0``, ``r1``: text and vector legs fused. Without vectors or a query vector the text leg alone, with its BM25 scores.

    ``where`` holds for both legs: the vector leg is joined with the rows that pass. The legs' cuts are part of the meaning.
    ``at`` and ``vector_at`` tell which of several rows of a key counts; the filter is then for tables without repeats.
    """
    kept = df if where is None else df.where(where)
    text = top(ix.bm25(kept, key, terms, s.boosts, at=at), s.text_k)
    if vectors is None or query is None:
        return top(text, s.n)
    v = vectors if where is None else vectors.join(kept.select(F.col(key).alias(vector_key)).distinct(), vector_key, "left_semi")
    return fused_top(rrf(text, vector_top(v, query, s.vector_k, vector_key, least=s.least, at=vector_at), k=s.rrf_k), s.n)


@dataclass(frozen=True)
class Expansion:
    """Words a query must have, should have, may have, and their boosts."""

    must: Sequence[str] = ()
    should: Sequence[str] = ()
    related: Sequence[str] = ()
    weights: Mapping[str, float] = field(default_factory=dict)
    must_boost: float = 3.0
    other_boost: float = 1.5

    def boost(self, word: str) -> float:
        return self.weights.get(word, self.must_boost if word in self.must else self.other_boost)

    def words(self) -> list[str]:
        return list(dict.fromkeys([*self.must, *self.should, *self.related]))


FINDING_FIELDS = {"item": 1.0, "reasons": 0.8, "item_detail": 0.5}


def retrieve_findings(findings: DataFrame, query_terms: Sequence[str], e: Expansion, vectors: DataFrame | None = None, query: Sequence[float] | None = None, where: Column | None = None, text_k: int = 150, vector_k: int = 150, least: float = 0.65, n: int = 30, used: int = 3, hits: int = 50, cap: int = 30) -> DataFrame:
    """``id``, ``score`` of the best findings.

    Without must-words: BM25 of the query. With them: the documents of the first ``used`` must-words (all of them in
    common, else any), and the boosted sum over all words of each word's best field. Two must-words or more add
    the vector leg. With a document set, results below half of the best score are cut.
    """
    rows = findings.withColumn("reasons", F.array_join(F.coalesce("reason_kw_norm", F.array().cast("array<string>")), " "))
    if where is not None:
        rows = rows.where(where)
    words = [w for w in e.must if w][:used]
    if not words:
        return top(ix.bm25(rows, "finding_id", query_terms, {"item": 2.0, "reasons": 1.0, "item_detail": 1.0}), min(n, text_k))
    # at most used x hits rows, and used twice by what follows
    docs = materialize(document_set(keyword_documents(rows, words, "finding_id", "doc_id", {"item": 2.0, "reasons": 1.5, "item_detail": 1.0}, hits), len(words), cap), "document-set")
    kept = rows.join(F.broadcast(docs), "doc_id", "left_semi")  # at most used x hits documents
    each = ix.bm25(kept, "finding_id", e.words(), FINDING_FIELDS, each_term=True)
    boost = F.create_map(*[F.lit(x) for w in e.words() for x in (w.lower(), float(e.boost(w)))])
    text = top(each.groupBy("id").agg(F.sum(F.col("score") * F.element_at(boost, F.col("term"))).alias("score")), text_k)
    if len(e.must) < 2 or vectors is None or query is None:
        return relative_cut(top(text, n))
    v = vectors.join(kept.select("finding_id").distinct(), "finding_id", "left_semi")
    fused = fused_top(rrf(text, vector_top(v, query, vector_k, "finding_id", least=least)), n)
    return relative_cut(fused).select("id", "score")


def retrieve_sections(chunks: DataFrame, found: DataFrame, queries: Mapping[str, Sequence[str]], vectors: DataFrame | None = None, query: Sequence[float] | None = None, least: float = 0.35, text_k: int = 300, vector_k: int = 300, n: int = 300) -> DataFrame:
    """``section``, ``id``, ``score``: for each section its best chunks of the found findings (``finding_id``); a chunk counts once, first section wins."""
    parts = []
    for i, (section, terms) in enumerate(queries.items()):
        mine = chunks.where(F.col("section") == section).join(found.select("finding_id").distinct(), "finding_id", "left_semi")
        v = None if vectors is None else vectors.where(F.col("section") == section)
        got = hybrid_search(mine, "chunk_id", terms, None if v is None else v.join(mine.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunk_id", query, Hybrid({"text": 2.0, "text_norm": 1.0, "item": 1.0}, text_k, vector_k, 60, least, n))
        parts.append(got.select(F.lit(i).alias("o"), F.lit(section).alias("section"), "id", "score"))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    first = F.row_number().over(Window.partitionBy("id").orderBy("o"))
    return both.withColumn("f", first).where("f = 1").select("section", "id", "score")


def with_text(hits: DataFrame, chunks: DataFrame, short: int = 10) -> DataFrame:
    """Hits (id, text..) whose text is missing or shorter than ``short`` get the chunk's."""
    t = chunks.join(hits.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").groupBy(F.col("chunk_id").alias("id")).agg(F.max(F.coalesce("text", "text_norm")).alias("_t"))
    return hits.join(t, "id", "left").withColumn("text", F.when(F.coalesce(F.char_length("text"), F.lit(0)) < short, F.col("_t")).otherwise(F.col("text"))).drop("_t")


def diversify(hits: DataFrame, group: str, n: int, weight: float = 0.65) -> DataFrame:
    """Maximal marginal relevance within each query's bounded hit list (``id``, ``score``, ``vector``): ``group``, ``id``, ``pick`` from 1."""

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        f = f.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        x = np.array(f["vector"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near, left, out = np.zeros(len(f)), list(range(len(f))), []
        while left and len(out) < n:
            best = max(left, key=lambda i: (weight * f["score"].iloc[i] - (1 - weight) * (near[i] if out else 0), -i))
            out.append(best)
            left.remove(best)
            near = np.maximum(near, x @ x[best]) if len(out) > 1 else x @ x[best]
        return pd.DataFrame({group: f[group].iloc[out].to_numpy(), "id": f["id"].iloc[out].to_numpy(), "pick": range(1, len(out) + 1)})

    kinds = dict(hits.dtypes)
    return hits.groupBy(group).applyInPandas(pick, f"`{group}` {kinds[group]}, id {kinds['id']}, pick int")
