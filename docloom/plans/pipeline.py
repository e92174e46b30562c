"""Batch jobs: raw files to tables, tables to index, a question to a packed context."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import text as tx
from docloom.operators import chunk, link, meta, parse, rank, retrieve, store
from docloom.runtime import materialize
from docloom.sources import files


@dataclass(frozen=True)
class Tables:
    reports: DataFrame
    table_rows: DataFrame
    findings: DataFrame
    row_finding_map: DataFrame
    chunks: DataFrame
    law_references: DataFrame


def parse_reports(raw: DataFrame, layouts: DataFrame, now: Column, strict: bool = False) -> Tables:
    """The six tables from Markdown (path, md) and layout JSON (stem, json). One lazy plan; nothing is collected."""
    docs = parse.with_ids(raw, strict)
    ls = parse.lines(docs)
    rows, found = parse.table_rows(ls), parse.findings(ls)
    laws = parse.layout_laws(docs.select("doc_id", files.stem("path").alias("stem")).join(layouts, "stem").select("doc_id", "json"))
    title = tx.strip(F.regexp_extract("md", r"(?m)^#\s+(.+)$", 1))
    reports = docs.select("doc_id", F.nullif(title, F.lit("")).alias("title"), F.col("path").alias("source_path"))
    return Tables(reports, rows, found, link.link_pairs(rows, found), chunk.chunk_findings(found, docs, now), parse.law_references(ls, laws, now))


def report_meta(docs: DataFrame, found: DataFrame, rows: DataFrame, vocabularies: Mapping[str, Mapping[str, Sequence[str]]], patterns: Sequence[str] = (), industries: Sequence[tuple] = ()) -> DataFrame:
    """Metadata of each report: tags of its findings, entities, industry (by words of its overview or a prefix of its codes), and the keyword overview of its rows."""
    texts = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\n", "item", F.array_join("reason_kw_norm", " ")))), "\n").alias("t"), F.array_sort(F.collect_set("code")).alias("codes"))
    base = docs.select("doc_id", parse.overview("md").alias("overview")).join(texts, "doc_id", "left")
    out = meta.tag(base, "t", vocabularies)
    if patterns:
        out = out.withColumn("entities", tx.entities(F.concat_ws("\n", "overview", "t"), patterns))
    if industries:
        out = out.withColumn("_i", tx.first_case("overview", industries, "codes")).withColumns({"industry": F.col("_i")["label"], "industry_confidence": F.col("_i")["confidence"]}).drop("_i")
    kw = meta.keyword_overview(rows.withColumn("k", tx.keywords("reason_kw_raw")), "doc_id", "k")
    return out.join(kw.withColumnRenamed("overview", "overview_keywords"), "doc_id", "left").drop("t")


#: Columns that tell where in the input a row stands: of several with a key the first in the input counts.
_PLACE = ("doc_id", "line_number", "start_line", "section_order", "chunk_order")


def ingest(spark: SparkSession, root: str, out: str, now: Column) -> None:
    """Parse all reports below ``root`` and upsert the tables under ``out``; any failure is raised."""
    t = parse_reports(files.read_markdown(spark, root), files.read_layouts(spark, root), now)
    for name, key in schemas.KEYS.items():
        df = getattr(t, name)
        store.upsert(df, f"{out}/{name}", [key], [F.col(c).asc_nulls_last() for c in (*_PLACE, *sorted(set(df.columns) - {key, *_PLACE})) if c in df.columns and dict(df.dtypes)[c] in ("string", "int")])


Embed = Callable[[list[str]], Sequence[Sequence[float]]]


def embedding_text(kind: str) -> Column:
    """What is embedded of a finding, chunk or law."""
    if kind == "finding":
        kw = F.array_join(F.slice(F.coalesce("reason_kw_norm", F.array().cast("array<string>")), 1, 6), ", ")
        return F.concat_ws("\n", F.nullif(tx.strip("item_detail"), F.lit("")), F.when(kw != "", F.concat(F.lit("핵심키워드: "), kw)))
    if kind == "chunk":
        return tx.strip(F.coalesce(F.nullif("text_norm", F.lit("")), "text"))
    return F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(c))) for n, c in (("종류", "law_type"), ("법령", "law_name"), ("내용", "law_content"))])


#: What goes with the vector of each kind of record.
PAYLOADS = {
    "finding": ("finding_id", ("finding_id", "doc_id", "code", "item", "item_detail", "start_line", "end_line")),
    "chunk": ("chunk_id", ("chunk_id", "finding_id", "doc_id", "section", "section_order", "chunk_order", "code", "item", "page", "start_line", "end_line")),
    "law": ("law_id", ("law_id", "finding_id", "doc_id", "law_type", "law_name", "page", "line_number")),
}


def points(df: DataFrame, kind: str, vectors: DataFrame | None = None) -> DataFrame:
    """``id``, ``point_id``, ``text``, ``payload`` (JSON without nulls) of findings, chunks or laws, and their ``vector`` where given (key, vector)."""
    key, names = PAYLOADS[kind]
    out = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), tx.uuid_of(key).alias("point_id"), embedding_text(kind).alias("text"), store.payload(*names).alias("payload"))
    return out if vectors is None else out.join(vectors.select(F.col(key).alias("id"), "vector"), "id")


def embed(df: DataFrame, key: str, text: Column, load: Callable[[], Embed], known: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """``key``, ``point_id``, ``text_hash``, ``vector``: blank texts are skipped, and texts whose hash ``known`` (key, text_hash) has already.

    ``load`` makes the model in each Python worker once a partition.
    """
    src = df.select(F.col(key).cast("string").alias(key), text.alias("_t")).where(F.col(key).isNotNull() & (tx.strip("_t") != "")).withColumn("text_hash", tx.text_hash("_t"))
    if known is not None:
        src = src.join(known.select(key, "text_hash"), [key, "text_hash"], "left_anti")

    def run(frames):
        model = load()
        for f in frames:
            out = []
            for i in range(0, len(f), batch):
                out += [list(map(float, v)) for v in model(f["_t"].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({key: f[key], "text_hash": f["text_hash"], "vector": out})

    got = src.mapInPandas(run, f"`{key}` string, text_hash string, vector array<float>")
    return got.select(key, tx.uuid_of(key).alias("point_id"), "text_hash", "vector")


def answer_context(findings: DataFrame, chunks: DataFrame, terms: Sequence[str], e: retrieve.Expansion, sections: Mapping[str, Sequence[str]], finding_vectors: DataFrame | None = None, chunk_vectors: DataFrame | None = None, query: Sequence[float] | None = None, budget: int = 4000) -> DataFrame:
    """The packed context of a question, a row a piece: findings, their chunks by section, blocks, context.

    Hits, chunks of hits and blocks are bounded by the cuts of the search; they are written out in between, so that
    the plans stay small and nothing is searched twice.
    """
    hits = materialize(retrieve.retrieve_findings(findings, terms, e, finding_vectors, query), "hits")
    ids = hits.select(F.col("id").alias("finding_id"))
    got = retrieve.retrieve_sections(chunks, ids, sections, chunk_vectors, query)
    got = materialize(got.withColumnRenamed("id", "chunk_id"), "section-hits")
    mine = chunks.drop("section").join(F.broadcast(got.select("chunk_id")), "chunk_id", "left_semi")  # at most n hits a section
    full = materialize(got.join(mine.dropDuplicates(["chunk_id"]), "chunk_id"), "hit-chunks")
    names = list(sections)
    per = [rank.block_scores(full.where(F.col("section") == s)) for s in names]
    blocks = rank.join_sections(per[0], per[1]) if len(per) > 1 else per[0]
    docs = full.select("finding_id", "doc_id").distinct()
    best = materialize(rank.accept(blocks.join(docs, "finding_id")).where("accepted").select("finding_id", F.col("rank").alias("block_rank")), "blocks")
    pieces = rank.merge_adjacent(rank.first_chunks(full.join(F.broadcast(best), "finding_id", "left_semi"))).join(F.broadcast(best), "finding_id")
    pieces = pieces.withColumns({"q": F.lit(0), "place": rank.section_place("section")})
    return rank.pack_context(pieces, "q", ["block_rank", "place", "first_order", "section"], budget)


__all__ = ["Tables", "answer_context", "embed", "embedding_text", "ingest", "parse_reports", "points", "report_meta"]
