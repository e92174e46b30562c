"""Anchored Markdown to tables: rows, findings with their sections, and law references.

All of it is windows over the lines of a document: ``lead`` gives the ends of blocks, a running ``last`` the finding a
line belongs to. The only shuffle is by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import text as tx

ROW_ANCHOR = r"<!--\s*row_id:\s*(\S+?)\s*-->"
FINDING_ANCHOR = r"<!--\s*finding_id:\s*(\S+?)\s*-->"
PLACEHOLDER = r"\[law_table#(\d+)\]"
SECTION = r"^#{3,5}\s*(?:\d+\.\s*)?(조사착안|조사기법)"
CIRCLED = "①②③④⑤⑥⑦⑧⑨"


def document_id(md: Column | str) -> Column:
    """The front matter's doc_id; empty if there is none."""
    return F.regexp_extract(tx._col(md), r'doc_id:\s*"([^"]+)"', 1)


def with_ids(raw: DataFrame, strict: bool = True) -> DataFrame:
    """``doc_id``, ``path``, ``md`` of raw Markdown files. Without a doc_id: an error if ``strict``, else the row is left out."""
    md = F.regexp_replace("md", "^﻿", "")
    got = raw.select(document_id(md).alias("doc_id"), "path", md.alias("md"))
    if strict:
        return got.withColumn("doc_id", F.when(F.col("doc_id") != "", F.col("doc_id")).otherwise(F.raise_error(F.concat(F.lit("no doc_id in "), F.coalesce("path", F.lit("?"))))))
    return got.where("doc_id <> ''")


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no`` (from 1), ``line``, ``n_lines``."""
    cut = F.split("md", "\n")
    # counted before the lines are rows: beside posexplode, every line would cut its whole document again
    sized = docs.select("doc_id", F.size(cut).alias("n_lines"), "md")
    return sized.select("doc_id", "n_lines", F.posexplode(cut).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), "line", "n_lines")


def _cells(c: Column) -> Column:
    inner = F.regexp_replace(tx.strip(c), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), tx.strip)


def table_rows(line_table: DataFrame) -> DataFrame:
    """Rows of the tables whose lines carry a row anchor; lines without a pipe or with fewer than four cells give none."""
    left = F.substring_index("line", "<!--", 1)
    cells = _cells(left)
    number = F.regexp_extract(F.translate(F.col("c")[0], CIRCLED, "123456789"), r"\d+", 0)
    code = F.regexp_extract(F.col("c")[2], r"\d{5}", 0)
    return (
        line_table.withColumn("row_id", F.regexp_extract("line", ROW_ANCHOR, 1))
        .where((F.col("row_id") != "") & left.contains("|"))
        .withColumn("c", cells)
        .where(F.size("c") >= 4)
        .select("row_id", "doc_id", number.try_cast("int").alias("row_no"), F.col("c")[1].alias("item"), F.nullif(code, F.lit("")).alias("code"), F.col("c")[3].alias("reason_kw_raw"), F.col("line_no").alias("line_number"))
    )


def _in_findings(line_table: DataFrame) -> DataFrame:
    """Lines with the finding they belong to (null before the first) and the line of its anchor."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.nullif(F.regexp_extract("line", FINDING_ANCHOR, 1), F.lit(""))
    return line_table.withColumn("anchor", anchor).withColumns({"finding_id": F.last("anchor", True).over(w), "start_line": F.last(F.when(F.col("anchor").isNotNull(), F.col("line_no")), True).over(w)})


def findings(line_table: DataFrame, stopwords=tx.KEYWORD_STOPWORDS) -> DataFrame:
    """Findings with code, detail, keywords and section spans.

    A block goes from its anchor's line to the line before the next anchor. The code is that after ``코드`` in
    the block, else its first separate five digits, else the anchor's. Of several sections of a name the
    first counts, but each section ends where the next one of any name begins.
    """
    at = _in_findings(line_table).where("finding_id is not null")
    key = ["doc_id", "finding_id", "start_line"]
    block = at.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"), F.max("line_no").alias("end_line"), F.first("n_lines").alias("n_lines"))
    block = block.withColumn("block", F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    # sections: (name, start) in order; the end is the next start - 1
    heads = F.filter(F.transform("ls", lambda x: F.struct(F.regexp_extract(x["line"], SECTION, 1).alias("name"), x["line_no"].alias("start_line"))), lambda x: x["name"] != "")
    block = block.withColumn("heads", heads)
    last = F.when(F.col("end_line") == F.col("n_lines"), F.col("end_line") - 1).otherwise(F.col("end_line"))
    spans = F.transform(
        "heads",
        lambda x, i: F.struct(x["name"].alias("name"), x["start_line"].alias("start_line"), F.coalesce(F.get(F.col("heads"), i + 1)["start_line"] - 1, last).cast("int").alias("end_line")),
    )
    block = block.withColumn("spans", spans)
    firsts = F.filter("spans", lambda x, i: F.array_position(F.transform("spans", lambda y: y["name"]), x["name"]) == i + 1)
    # the finding's table: lines before the first section
    before = F.filter("ls", lambda x: (F.size("heads") == 0) | (x["line_no"] < F.col("heads")[0]["start_line"]))
    body = F.filter(before, lambda x: x["line_no"] > F.col("start_line"))

    def cell_after(word: str) -> Column:
        hits = F.filter(F.transform(F.filter(body, lambda x: x["line"].contains("|") & x["line"].contains(word)), lambda x: _cells(x["line"])), lambda c: F.exists(c, lambda y: y.contains(word)))
        row = F.get(hits, F.lit(0))
        place = F.array_position(F.transform(row, lambda y: y.contains(word)), True)
        return F.when(place > 0, F.nullif(tx.strip_tags(F.get(row, place.cast("int"))), F.lit("")))

    block = block.withColumns({"item_detail": cell_after("적출"), "gist": cell_after("적출요지")})
    head = F.substring_index(F.col("ls")[0]["line"], "<!--", 1)
    item = F.when(head.contains("적출"), F.expr("substr(substring_index(ls[0].line, '<!--', 1), instr(substring_index(ls[0].line, '<!--', 1), '적출') + 2)")).otherwise(head)
    named = F.regexp_extract("block", r"코드\s*[:：]?\s*(\d{5})(?!\d)", 1)
    # the anchor itself is no text of the block
    free = F.regexp_extract(F.regexp_replace("block", "<!--.*?-->", ""), r"(?<![\p{L}\p{N}_])\d{5}(?![\p{L}\p{N}_])", 0)
    own = F.regexp_extract("finding_id", r"#F(\d{5})#", 1)
    code = F.coalesce(*[F.nullif(c, F.lit("")) for c in (named, free, own)])
    return block.select(
        "finding_id",
        "doc_id",
        tx.strip(F.regexp_replace(item, r"^[#\s]+|#", "")).alias("item"),
        "item_detail",
        code.alias("code"),
        tx.keywords(F.coalesce("gist", "item_detail"), stopwords).alias("reason_kw_norm"),
        F.transform(firsts, lambda x: x["name"]).alias("sections_present"),
        firsts.alias("section_spans"),
        "start_line",
        "end_line",
    )


def layout_laws(layouts: DataFrame) -> DataFrame:
    """``doc_id``, ``n``, and the law items of layout JSON (``doc_id``, ``json``), numbered through the pages of a document."""
    items = layouts.select("doc_id", F.explode(F.from_json("json", schemas.LAYOUT_JSON)).alias("p", "items")).select("doc_id", F.regexp_extract("p", r"(\d+)$", 1).try_cast("int").alias("page"), F.posexplode("items").alias("seq", "x"))
    laws = items.where("x.type = 'law_table'")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq"))
    on = F.coalesce(F.nullif(F.regexp_extract("x.path", r"page_(\d+)", 1), F.lit("")).try_cast("int"), F.col("page"))
    return laws.select("doc_id", n.alias("n"), on.alias("page"), "x.law_type", "x.law_name", "x.law_content", "x.bbox")


def law_references(line_table: DataFrame, laws: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Placeholders of laws with the finding they stand in and the layout item they point to.

    Placeholders whose item is missing are left out and don't count; ``law_order`` counts within a finding and is 0
    outside of any.
    """
    at = _in_findings(line_table).withColumn("n", F.regexp_extract("line", PLACEHOLDER, 1).try_cast("int")).where("n is not null")
    got = at.join(laws, ["doc_id", "n"])
    order = F.row_number().over(Window.partitionBy("doc_id", "finding_id").orderBy("line_no"))
    return got.select(
        F.format_string("%s#L%d", "doc_id", "n").alias("law_id"),
        "finding_id",
        "doc_id",
        "law_type",
        "law_name",
        "law_content",
        "page",
        F.col("line_no").alias("line_number"),
        "bbox",
        F.when(F.col("finding_id").isNull(), 0).otherwise(order).alias("law_order"),
        F.lit(schemas.VERSION).alias("extraction_version"),
        (created_at if created_at is not None else F.lit(None).cast("timestamp")).alias("created_at"),
    )


def overview(md: Column | str, head: str = "## 적출", most: int = 2000) -> Column:
    """The text before the first finding, else its first ``most`` characters."""
    md = tx._col(md)
    return F.when(md.contains(head), F.substring_index(md, head, 1)).otherwise(F.substring(md, 1, most))


def missing_anchors(line_table: DataFrame, parsed: DataFrame, pattern: str, key: str) -> DataFrame:
    """Anchors of the text that no parsed row has: a check of the parser, empty when all is well."""
    ids = line_table.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias(key))
    return ids.join(parsed.select(key), key, "left_anti")


def report_id(filename: Column | str) -> Column:
    """``YYYY{S|H}-NNN-n`` from a file name, else the name without its ending; the number is padded to three digits."""
    name = F.regexp_replace(F.substring_index(tx._col(filename), "/", -1), r"\.[^.]*$", "")
    pattern = r"(\d{4})[\s_]*([sShH상하])[^\d-]*-(\d+)-(\d+)"
    half = F.when(F.regexp_extract(name, pattern, 2).isin("s", "S", "상"), "S").otherwise("H")
    number = F.regexp_extract(name, pattern, 3)
    padded = F.when(F.char_length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return F.when(F.regexp_extract(name, pattern, 0) != "", F.concat(F.regexp_extract(name, pattern, 1), half, F.lit("-"), padded, F.lit("-"), F.regexp_extract(name, pattern, 4))).otherwise(name)
