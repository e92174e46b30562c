"""Queries of the training-data operators; ``__spark_entry__`` adds them if this subpackage is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import bpe, langid, lookalike, packing, splitting, vectors
from docloom.runtime import table


def _vector_tables(spark: SparkSession, d: str) -> dict:
    return {"chunks_vectors": (table(spark, d, "chunks_vectors"), "chunk_id"), "findings_vectors": (table(spark, d, "findings_vectors"), "finding_id")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.found(_vector_tables(spark, d))


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of any cosine, for the query set of one row in 50 (by a hash of the key) against all rows."""
    out = None
    for name, (df, key) in _vector_tables(spark, d).items():
        base = vectors.usable(df, key)
        near = vectors.nearest(base, base.where("pmod(xxhash64(id), 50) = 0"))
        near = near.select(F.lit(name).alias("tbl"), F.col("id_a").alias("key"), F.col("id_b").alias("neighbour"), F.round("cos", 6).alias("cos"), "rank")
        out = near if out is None else out.unionByName(near)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "chunks"), table(spark, d, "findings"), table(spark, d, "item_ref"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every chunk text and finding item."""
    chunks, findings, ref = (table(spark, d, t) for t in ("chunks", "findings", "item_ref"))
    counts = lookalike.code_points([(chunks, "text"), (findings, "item"), (ref, "item")])
    a = lookalike.one_form(chunks, "text", counts, ["chunk_id"]).select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("row_key"), "form")
    b = lookalike.one_form(findings, "item", counts, ["finding_id"]).select(F.lit("findings").alias("tbl"), F.col("finding_id").alias("row_key"), "form")
    return a.unionByName(b).distinct()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every chunk text, with its rows and spellings: membership in place of pairs."""
    chunks = table(spark, d, "chunks")
    counts = lookalike.code_points([(chunks, "text")])
    return lookalike.classes(chunks, "chunk_id", "text", "created_at", counts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("piece_no = 1").select("tbl", "row_key", "span_no")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_all(table(spark, d, "chunks"), table(spark, d, "findings"))


def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized text and span: its size by its pieces, whether they follow each other, stay within the limits and overlap as they must."""
    p = p5_pieces(spark, d)
    w = Window.partitionBy("tbl", "row_key", "span_no").orderBy("piece_no")
    text = F.col("tbl") == "chunks"
    last_end, last_start = F.lag("end").over(w), F.lag("start").over(w)
    p = p.select(
        "tbl",
        "row_key",
        "span_no",
        "piece_no",
        F.when(text, F.col("end") - F.col("own_start")).otherwise(F.col("end") - F.col("own_start") + 1).alias("own"),
        F.when(text, (F.col("n_words") <= 800) & (F.col("n_chars") <= 6000)).otherwise(F.col("end") - F.col("start") < 120).alias("fits"),
        F.coalesce(F.col("own_start") == last_end + F.when(text, 0).otherwise(1), F.lit(True)).alias("follows"),
        F.when(last_end.isNull(), F.col("start") == F.col("own_start"))
        .when(text, (F.col("start") < F.col("own_start")) & (F.col("own_start") - F.col("start") <= 300))
        .otherwise(F.col("start") == F.greatest(last_start, F.col("own_start") - 10))
        .alias("repeats"),
    )
    return p.groupBy("tbl", "row_key", "span_no").agg(F.sum("own").alias("size"), F.every("fits").alias("fits"), F.every("follows").alias("follows"), F.every("repeats").alias("repeats"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, decoded from its ids."""
    return bpe.decode_column(p6_ids(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: their number, their tokens, and the share of unused space."""
    c = packing.pack_documents(table(spark, d, "documents")).groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return c.agg(
        F.count("*").alias("containers"),
        F.sum("t").alias("tokens"),
        (1 - F.sum("t") / (F.count("*") * F.lit(packing.CAPACITY))).alias("unused"),
    )


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, containers over the capacity, texts split without need, and texts whose pieces don't follow each other."""
    c = p7_containers(spark, d)
    by = c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max(F.col("start_token") + F.col("n_tokens")).alias("e"))
    docs = by.agg(F.count("*").alias("docs"), F.count_if((F.col("t") <= packing.CAPACITY) & (F.col("n") > 1)).alias("split_small"), F.count_if(F.col("t") != F.col("e")).alias("gaps"))
    over = c.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > packing.CAPACITY).alias("over_full"))
    return docs.crossJoin(over)  # one row each


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_labels(table(spark, d, "documents"), table(spark, d, "lang_codes"))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language in every document, with a confidence."""
    docs = table(spark, d, "documents")
    return langid.label_segments(docs, langid.fit_on(docs, table(spark, d, "lang_codes")))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages of every document, with confidence and share of the text."""
    return langid.document_languages(p8_segments(spark, d))


def p8_covered(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a language, each with whether its segments lie in the text in order and its confidences are shares."""
    docs = table(spark, d, "documents")
    s = p8_segments(spark, d).join(docs.select("doc_id", F.char_length("text").alias("size")), "doc_id")
    before = F.lag("end", 1, 0).over(Window.partitionBy("doc_id").orderBy("seg_no"))
    s = s.select("doc_id", ((F.col("start") >= before) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("size")) & F.col("confidence").between(0, 1)).alias("ok"))
    return s.groupBy("doc_id").agg(F.every("ok").alias("ok"))


QUERIES = {f.__name__: f for f in (p1_found, p1_nearest, p3_found, p3_forms, p3_classes, p5_found, p5_pieces, p5_whole, p6_ids, p6_decoded, p7_containers, p7_fill, p7_whole, p8_found, p8_segments, p8_languages, p8_covered)}
_WS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _near_sql(tbl: str) -> str:
    """Brute force over all pairs of a table; small tables only."""
    return f"""select '{tbl}' tbl, least(a, b) key_a, greatest(a, b) key_b from (
  select a, b, c, row_number() over (partition by a order by c desc, b) r from (
    select u.k a, w.k b, list_inner_product(u.v, w.v) / (u.n * w.n) c from {tbl}_v u join {tbl}_v w on u.k <> w.k)) where r <= 5 and c >= 0.92"""


def _usable_sql(tbl: str, key: str) -> str:
    return f"""{tbl}_l as (select {key} k, vector::double[] v from {tbl} where {key} is not null qualify row_number() over (partition by {key} order by upserted_at desc nulls last) = 1),
{tbl}_v as (select k, v, sqrt(list_inner_product(v, v)) n from {tbl}_l where len(v) = 64 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_inner_product(v, v) > 0)"""


ORACLES: dict[str, str] = {
    "p1_found": f"with {_usable_sql('chunks_vectors', 'chunk_id')}, {_usable_sql('findings_vectors', 'finding_id')} select distinct * from ({_near_sql('chunks_vectors')} union all {_near_sql('findings_vectors')})",
    "p5_found": f"""with c as (select distinct 'chunks' tbl, chunk_id row_key, 0 span_no from chunks where chunk_id is not null and (length(text) > 6000 or len(regexp_extract_all(text, '[^{_WS}]+')) > 800)),
f as (select finding_id, unnest(section_spans) s, unnest(generate_series(1, len(section_spans)))::int i from findings where finding_id is not null)
select * from c union all select distinct 'findings', finding_id, i from f where s.end_line - s.start_line + 1 > 120""",
    "p5_whole": f"""with c as (select chunk_id, max(length(text)) n from chunks where chunk_id is not null and (length(text) > 6000 or len(regexp_extract_all(text, '[^{_WS}]+')) > 800) group by 1),
f as (select distinct finding_id, i, s.end_line - s.start_line + 1 n from (select finding_id, unnest(section_spans) s, unnest(generate_series(1, len(section_spans)))::int i from findings where finding_id is not null))
select 'chunks' tbl, chunk_id row_key, 0 span_no, n::bigint size, true fits, true follows, true repeats from c union all select 'findings', finding_id, i, n::bigint, true, true, true from f where n > 120""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p7_whole": "select count(*) filter (where length(text) > 0) docs, 0::bigint split_small, 0::bigint gaps, 0::bigint over_full from documents where doc_id is not null",
    "p8_covered": f"select doc_id, true ok from documents where regexp_matches(text, '[^{_WS}]')",
}
