"""Section text to overlapping chunks of whole segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schemas
from docloom.functions import text as tx

LEAST, MOST, SHARE, LEAST_OVERLAP = 400, 800, 0.12, 50


def overlap_groups(counts: Sequence[int], least: int = LEAST, most: int = MOST, share: float = SHARE, least_overlap: int = LEAST_OVERLAP) -> list[tuple[int, int]]:
    """(first, end) of the segments of each chunk, given the words of each segment.

    A chunk is closed before a segment that would lift it over ``most`` words, if it has ``least`` already, and as soon as
    it has ``most``. The next one starts with the shortest run of its last whole segments that has ``share`` of its
    words, and at least ``least_overlap``. Chunks can so exceed ``most``: segments are never cut here.
    """
    out: list[tuple[int, int]] = []
    first, fresh, size = 0, 0, 0  # the open chunk is counts[first:i]; from fresh on it has segments no chunk has yet

    def close(end: int) -> None:
        nonlocal first, fresh, size
        if fresh >= end:
            return
        out.append((first, end))
        goal, first, size = max(int(size * share), least_overlap), end, 0
        while first > out[-1][0] and size < goal:
            first -= 1
            size += counts[first]
        fresh = end

    for i, n in enumerate(counts):
        if i > first and size + n > most and size >= least:
            close(i)
        size += n
        if size >= most:
            close(i + 1)
    close(len(counts))
    return out


def join_segments(segments: Sequence[str] | None) -> list[str]:
    """Chunks of an array of segments, joined by blank lines; null gives none."""
    segs = [s for s in segments if s] if segments is not None else []
    return ["\n\n".join(segs[a:b]) for a, b in overlap_groups([len(s.split()) for s in segs])]


def with_chunks(df: DataFrame, segments: str, name: str = "chunks") -> DataFrame:
    """``df`` with the array of chunks of its array of segments in its place; runs in Arrow batches."""
    keep = [c for c in df.columns if c != segments]
    src = df.select(*keep, segments)
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(name, T.ArrayType(T.StringType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([join_segments(s) for s in b.column(len(keep)).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], got], names=[*keep, name])

    return src.mapInArrow(run, schema)


def segments_of(text: Column | str, separator: str = "\n\n") -> Column:
    return tx.fixed_segments(tx.paragraphs(text, separator), MOST)


def chunk_texts(df: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """``key``, ``chunk_order``, ``text``: the chunks of each text. Null and blank texts give no row."""
    got = with_chunks(df.where(F.col(key).isNotNull()).select(key, segments_of(text, separator).alias("segments")), "segments")
    return got.select(key, F.posexplode("chunks").alias("chunk_order", "text"))


def chunk_findings(findings: DataFrame, docs: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Chunks of the sections of each finding; a finding none of whose sections gives one is chunked as a whole (section ``전체``).

    ``docs`` has doc_id and md. Findings without lines, and blank sections, give no chunk. Line numbers of a chunk are
    those of its section.
    """
    kind = "array<struct<name:string,start_line:int,end_line:int,t:string>>"

    def part(name: Column, start: Column, end: Column, lines: Column) -> Column:
        return F.struct(name.alias("name"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), tx.joined_lines(lines, start, end).alias("t"))

    def parts(f: Column, lines: Column) -> Column:
        spans = F.transform(F.coalesce(f["section_spans"], F.array().cast(schemas.SPANS)), lambda s: part(s["name"], s["start_line"], s["end_line"], lines))
        whole = F.array(part(F.lit("전체"), f["start_line"], f["end_line"], lines))
        usable = (f["start_line"] > 0) & (f["end_line"] > 0)
        some = lambda x: F.exists(x, lambda s: tx.strip(s["t"]) != "")
        return tx.once(spans.cast(kind), lambda x: F.when(some(x), x).when(usable, whole.cast(kind)).otherwise(F.array().cast(kind)))

    # a document meets all its findings in one row, so that it is cut into lines once and not for every section
    f = F.struct("finding_id", "code", "item", "section_spans", "start_line", "end_line")
    per = findings.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(f).alias("fs")).join(docs.select("doc_id", "md"), "doc_id")
    cut = tx.once(F.split("md", "\n"), lambda lines: F.transform("fs", lambda f: F.struct(f["finding_id"].alias("finding_id"), f["code"].alias("code"), f["item"].alias("item"), parts(f, lines).alias("parts"))))
    base = per.select("doc_id", F.explode_outer(cut).alias("f"))  # outer: else the texts are made once more to filter by
    rows = base.select("f.finding_id", "doc_id", "f.code", "f.item", F.posexplode("f.parts").alias("section_order", "s"))
    rows = with_chunks(rows.select("finding_id", "doc_id", "code", "item", "section_order", F.col("s.name").alias("name"), F.col("s.start_line").alias("a"), F.col("s.end_line").alias("b"), segments_of("s.t").alias("segments")), "segments")
    rows = rows.select("*", F.posexplode("chunks").alias("chunk_order", "text")).where(tx.strip("text") != "")
    section = F.col("name")
    meta = F.format_string("[META] doc:%s | finding:%s | code:%s | section:%s", "doc_id", "finding_id", F.coalesce("code", F.lit("")), section)
    return rows.select(
        F.format_string("%s@%02d-%02d", "finding_id", "section_order", "chunk_order").alias("chunk_id"),
        "finding_id",
        "doc_id",
        section.alias("section"),
        "section_order",
        "chunk_order",
        "code",
        "item",
        tx.bare_item("item").alias("item_norm"),
        F.lit(None).cast("int").alias("page"),
        F.col("a").alias("start_line"),
        F.col("b").alias("end_line"),
        "text",
        tx.plain_text("text").alias("text_norm"),
        F.col("text").alias("text_raw"),
        meta.alias("meta_line"),
        F.lit(schemas.VERSION).alias("extraction_version"),
        (created_at if created_at is not None else F.lit(None).cast("timestamp")).alias("created_at"),
    )
