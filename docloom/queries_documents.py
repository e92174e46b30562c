"""Queries of the document chain: reports written as Markdown, layouts and boxes, parsed back, and searches of several legs; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as g
from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.operators import cells, chunk, index, layout, link, meta, parse, rank, retrieve, store
from docloom.plans import pipeline, question
from docloom.queries import _AREA, _BOX, _CH, _CV, _FI, _HITS, _INT, _KEY, _LW, _QV, _STOP, _TOK, _TR, _WS, QUERY_VECTOR, TAGS, _bm25_sql, _boxes, _hits, _strip, _words, query, records
from docloom.runtime import table, work_folder
from docloom.sources import files

_DOC = "^[A-Za-z0-9-]+$"  # in SQL, where a line break at the end doesn't match
_DOC_ID, _ID = r"^[A-Za-z0-9-]+\z", r"(?U)^\S+\z"


def _clean(c: str):
    """A cell's text: what a Markdown table or a head would read as its own becomes a blank."""
    return tx.strip(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)[|<>#\s]+", " "))


def _clean_sql(c: str) -> str:
    return _strip(f"regexp_replace(coalesce({c}, ''), '[|<>#{_WS}]+', ' ', 'g')")


def _kw_sql(x: str) -> str:
    kept = f"list_filter({_TOK.format(x)}, lambda x: length(x) >= 2 and x not in ({_STOP}))"
    return f"array_to_string(list_filter({kept}, lambda x, i: list_position({kept}, x) = i)[1:6], ',')"


# ---- reports as Markdown, all rows of all reports


@query(sql="select doc_id, unnest(generate_series(1, len(l)))::int line_no, unnest(l) line, len(l)::int n_lines from (select 'D' || doc_id doc_id, string_split('---' || chr(10) || 'doc_id: \"D' || doc_id || '\"' || chr(10) || '---' || chr(10) || text, chr(10)) l from documents where text is not null)")
def markdown_lines(spark, d):
    """Every document's text as a Markdown file with front matter, its id read back, and its lines."""
    key = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    raw = table(spark, d, "documents").where("text is not null").select(F.concat(key, F.lit(".md")).alias("path"), F.concat(F.lit('---\ndoc_id: "'), key, F.lit('"\n---\n'), F.col("text")).alias("md"))
    return parse.lines(parse.with_ids(raw))


def _row_markdown(spark, d) -> DataFrame:
    """The table rows of each report as a Markdown table with anchors; ``doc_id``, ``md``."""
    r = records(spark, d, "table_rows").where(F.col("doc_id").rlike(_DOC_ID) & F.col("row_id").rlike(_ID))
    code = F.when(F.col("code").rlike("^[0-9]{5}$"), F.col("code")).otherwise(F.lit(""))
    line = F.concat(F.lit("| "), F.coalesce(F.col("row_no").cast("string"), F.lit("")), F.lit(" | "), _clean("item"), F.lit(" | "), code, F.lit(" | "), _clean("reason_kw_raw"), F.lit(" | <!-- row_id: "), "row_id", F.lit(" -->"))
    body = r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_id", line.alias("l")))).alias("ls"))
    head = F.concat(F.lit('---\ndoc_id: "'), "doc_id", F.lit('"\n---\n\n| 연번 | 조사항목 | 코드 | 적출요지 |\n| --- | --- | --- | --- |\n'))
    return body.select("doc_id", F.concat(head, F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n")).alias("md"))


@query(sql=f"""with {_TR} select row_id, doc_id, row_no, {_clean_sql('item')} item, case when regexp_full_match(code, '[0-9]{{5}}') then code end code, {_clean_sql('reason_kw_raw')} reason_kw_raw,
(6 + row_number() over (partition by doc_id order by row_id))::int line_number from tr where regexp_matches(doc_id, '{_DOC}') and regexp_matches(row_id, '^[^{_WS}]+$')""")
def markdown_round_trip(spark, d):
    """All table rows written as anchored Markdown and parsed back, with the lines they stand in."""
    return parse.table_rows(parse.lines(_row_markdown(spark, d)))


@query(sql="select null::varchar doc_id, null::varchar row_id where false")
def missing_anchors(spark, d):
    """Row anchors of the written Markdown that the parser didn't turn into rows: none."""
    ls = parse.lines(_row_markdown(spark, d))
    return parse.missing_anchors(ls, parse.table_rows(ls), parse.ROW_ANCHOR, "row_id")


def _finding_markdown(spark, d) -> DataFrame:
    """The findings of each report as Markdown with heads, anchors, a table and two sections; ``doc_id``, ``path``, ``md``."""
    f = records(spark, d, "findings").where(F.col("doc_id").rlike(_DOC_ID) & F.col("finding_id").rlike(_ID)).withColumn("kw", F.array_join("reason_kw_norm", " "))
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("finding_id"))
    f = f.select("doc_id", "finding_id", i.alias("i"), _clean("item").alias("item"), _clean("item_detail").alias("detail"), _clean("kw").alias("kw"), F.when(F.col("code").rlike("^[0-9]{5}$"), F.concat(F.lit("코드: "), "code")).otherwise(F.lit("")).alias("code"))
    head = F.concat(F.lit("### 적출 "), F.col("i").cast("string"), F.lit(". "), "item", F.lit(" <!-- finding_id: "), "finding_id", F.lit(" -->"))
    block = F.concat_ws("\n", head, F.concat(F.lit("| 적출요지 | "), "detail", F.lit(" |")), F.lit(""), F.lit("#### 1. 조사착안"), "kw", F.lit(""), F.lit("#### 2. 조사기법"), "code", F.lit(""))
    md = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))).alias("bs"))
    return md.select("doc_id", F.concat("doc_id", F.lit("_layout.md")).alias("path"), F.concat(F.lit('---\ndoc_id: "'), "doc_id", F.lit('"\n---\n\n'), F.array_join(F.transform("bs", lambda x: x["b"]), "\n"), F.lit("\n")).alias("md"))


_FM = f"""{_FI}, b0 as (select doc_id, finding_id, row_number() over (partition by doc_id order by finding_id) i, count(*) over (partition by doc_id) n, {_clean_sql('item')} item, {_clean_sql('item_detail')} detail,
{_clean_sql("array_to_string(reason_kw_norm, ' ')")} kw, case when regexp_full_match(code, '[0-9]{{5}}') then '코드: ' || code else '' end code from fi where regexp_matches(doc_id, '{_DOC}') and regexp_matches(finding_id, '^[^{_WS}]+$')),
b1 as (select *, concat_ws(chr(10), '### 적출 ' || i || '. ' || item || ' ', '| 적출요지 | ' || detail || ' |', '', '#### 1. 조사착안', kw, '', '#### 2. 조사기법', code, '') t, (9 * i - 4)::int a from b0),
pf as (select *, {_strip("i || '. ' || item")} named, coalesce(nullif(regexp_extract(t, '코드[ \\t\\n\\r]*[:：]?[ \\t\\n\\r]*(\\d{{5}})(?:[^\\d]|$)', 1), ''), nullif(regexp_extract(t, '(?:^|[^\\pL\\pN_])(\\d{{5}})(?:$|[^\\pL\\pN_])', 1), ''), nullif(regexp_extract(finding_id, '#F(\\d{{5}})#', 1), '')) own_code from b1)"""


def _parsed(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = parse.with_ids(_finding_markdown(spark, d))
    return docs, parse.findings(parse.lines(docs))


@query(sql=f"""with {_FM} select finding_id, doc_id, named item, nullif(detail, '') item_detail, own_code code, {_kw_sql('detail')} keywords, '조사착안,조사기법' sections,
'조사착안:' || (a + 3) || '-' || (a + 5) || ',조사기법:' || (a + 6) || '-' || (a + 8) spans, a start_line, (a + 8 + case when i = n then 1 else 0 end)::int end_line from pf""")
def parsed_findings(spark, d):
    """All findings written as Markdown and parsed back: code, detail, keywords, sections with their lines."""
    _, f = _parsed(spark, d)
    spans = F.array_join(F.transform("section_spans", lambda x: F.format_string("%s:%d-%d", x["name"], x["start_line"], x["end_line"])), ",")
    return f.select("finding_id", "doc_id", "item", "item_detail", "code", F.array_join("reason_kw_norm", ",").alias("keywords"), F.array_join("sections_present", ",").alias("sections"), spans.alias("spans"), "start_line", "end_line")


@query(sql=f"""with {_FM}, s as (select *, 0 o, '조사착안' section, '#### 1. 조사착안' h, kw body, a + 3 x, a + 5 y from pf union all select *, 1, '조사기법', '#### 2. 조사기법', code, a + 6, a + 8 from pf)
select finding_id || '@0' || o || '-00' chunk_id, section, {_strip("h || chr(10) || body")} as text, coalesce(nullif(item, ''), named) item_norm, '[META] doc:' || doc_id || ' | finding:' || finding_id || ' | code:' || coalesce(own_code, '') || ' | section:' || section meta_line, x::int start_line, y::int end_line from s""")
def chunked_findings(spark, d):
    """The sections of all written findings as chunks, with ids and heads."""
    docs, f = _parsed(spark, d)
    return chunk.chunk_findings(f, docs).select("chunk_id", "section", "text", "item_norm", "meta_line", "start_line", "end_line")


def _law_documents(spark, d) -> tuple[DataFrame, DataFrame]:
    """Laws of each report as lines with finding anchors and placeholders, and as layout JSON: (doc_id, md), (doc_id, json)."""
    law = records(spark, d, "law_references").where(F.col("doc_id").rlike(_DOC_ID) & (F.col("finding_id").isNull() | F.col("finding_id").rlike(_ID)))
    w = Window.partitionBy("doc_id").orderBy(F.col("finding_id").asc_nulls_first(), "law_id")
    law = law.select("doc_id", "finding_id", "law_type", "law_name", "law_content", F.row_number().over(w).alias("n"), F.lag("finding_id").over(w).alias("before"))
    mark = F.concat(F.lit("[law_table#"), F.col("n").cast("string"), F.lit("]"))
    line = F.when(F.col("finding_id").isNotNull() & ~F.col("finding_id").eqNullSafe(F.col("before")), F.concat(F.lit("### 적출 <!-- finding_id: "), "finding_id", F.lit(" -->\n"), mark)).otherwise(mark)
    md = law.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))).alias("ls"))
    md = md.select("doc_id", F.concat(F.lit('---\ndoc_id: "'), "doc_id", F.lit('"\n---\n\n'), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("md"))
    items = law.select("doc_id", F.lit(1).alias("page"), F.col("n").alias("y0"), F.lit(0).alias("x0"), F.lit("law_table").alias("type"), "law_type", "law_name", "law_content")
    return md, store.to_layout_json(items)


_LQ = f"""{_LW}, l0 as (select * from lw where regexp_matches(doc_id, '{_DOC}') and (finding_id is null or regexp_matches(finding_id, '^[^{_WS}]+$'))),
l1 as (select *, row_number() over (partition by doc_id order by finding_id nulls first, law_id) n, case when finding_id is not null then dense_rank() over (partition by doc_id, finding_id is null order by finding_id) else 0 end k, row_number() over (partition by doc_id, finding_id order by law_id) o from l0)"""


@query(sql=f"with {_LQ} select doc_id || '#L' || n law_id, finding_id, doc_id, law_type, law_name, law_content, 1 page, (4 + n + k)::int line_number, (case when finding_id is null then 0 else o end)::int law_order from l1")
def law_placeholders(spark, d):
    """Placeholders of laws between the findings of a report, joined with the laws of its layout JSON."""
    md, js = _law_documents(spark, d)
    return parse.law_references(parse.lines(md), parse.layout_laws(js)).select("law_id", "finding_id", "doc_id", "law_type", "law_name", "law_content", "page", "line_number", "law_order")


@query(sql=f"with {_LQ} select doc_id, n::int n, law_type, law_name, law_content from l1")
def layout_json_export(spark, d):
    """Laws written as layout JSON, one object a report, and read back with all they hold."""
    return parse.layout_laws(_law_documents(spark, d)[1]).select("doc_id", "n", "law_type", "law_name", "law_content")


# ---- tables of a page


def _region_texts(spark, d) -> DataFrame:
    """Table rows as the text of regions of at most 40 lines: ``doc_id``, ``page``, ``t``."""
    cell = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    r = records(spark, d, "table_rows").where("doc_id is not null and row_no is not null")
    line = F.concat_ws("  ", F.lit("①"), cell(_clean("item")), cell(_clean("code")), cell(_clean("reason_kw_raw")))
    r = r.select("doc_id", "row_no", F.floor(F.col("row_no") / 40).alias("page"), "row_id", line.alias("l"))
    return r.groupBy("doc_id", "page").agg(F.concat_ws("\n", F.lit("연번  조사항목  코드  적출요지"), F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row_id", "l"))), lambda x: x["l"])).alias("t"))


def _cell_sql(c: str) -> str:
    return f"coalesce(nullif({_clean_sql(c)}, ''), '-')"


_RT = f"{_TR}, c0 as (select doc_id, floor(row_no / 40)::bigint page, row_no, row_id, {_cell_sql('item')} item, {_cell_sql('code')} code, {_cell_sql('reason_kw_raw')} reason from tr where doc_id is not null and row_no is not null), c1 as (select *, row_number() over (partition by doc_id, page order by row_no, row_id) i from c0)"


@query(sql=f"""with {_RT} select doc_id, page, '| 연번 | 조사항목 | 코드 | 적출요지 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| ① | ' || item || ' | ' || code || ' | ' || reason || ' | <!-- row_id: ' || doc_id || '#R' || i || ' -->', chr(10) order by i) md from c1 group by 1, 2""")
def table_reflow(spark, d):
    """The text of table regions made Markdown tables with row anchors."""
    return _region_texts(spark, d).select("doc_id", "page", layout.as_markdown_table("t", "doc_id").alias("md"))


@query(sql=f"""with {_RT}, f as (select doc_id, min(page) page from c0 group by 1), m as (select doc_id, i, {_strip("regexp_replace(item, '[①-⑳]', '', 'g')")} item, code from c1 join f using (doc_id, page))
select doc_id, row_number() over (partition by doc_id order by i)::int n, item, code from m where length(item) > 1 and not regexp_matches(item, '^[0-9]+$')""")
def major_items(spark, d):
    """The items and codes of the first table of each report."""
    t = _region_texts(spark, d).select("doc_id", F.col("page").alias("seq"), layout.as_markdown_table("t", "doc_id").alias("md"))
    return layout.major_items(t)


@query(sql=f"""with {_FM}, q as (select doc_id, i, item, coalesce(nullif(detail, ''), '없음') detail, kw, coalesce(own_code, '') c from pf)
select doc_id, '---' || chr(10) || 'doc_id: "' || doc_id || '"' || chr(10) || '---' || chr(10) || chr(10) || '## Ⅱ.조사노하우' || chr(10) || chr(10) || string_agg('### 적출 ' || i || '. ' || item || ' <!-- finding_id: ' || doc_id || '#F' || c || '#F' || i || ' -->' || chr(10) || chr(10)
|| '| | |' || chr(10) || '|---|---|' || chr(10) || '| 적출 | ' || detail || ' |' || chr(10) || chr(10) || '#### 1. 조사착안' || chr(10) || chr(10) || '내용 ' || kw || ' 확인하였음' || chr(10), chr(10) order by i) md from q group by doc_id""")
def assembled_documents(spark, d):
    """Layout items of all findings, in reading order, put together as the Markdown of their reports."""
    f = _parsed(spark, d)[1].select("finding_id", F.coalesce("code", F.lit("")).alias("code"))
    src = records(spark, d, "findings").where(F.col("doc_id").rlike(_DOC_ID) & F.col("finding_id").rlike(_ID)).withColumn("kw", F.array_join("reason_kw_norm", " "))
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("finding_id"))
    src = src.select("doc_id", "finding_id", i.alias("i"), _clean("item").alias("item"), F.coalesce(F.nullif(_clean("item_detail"), F.lit("")), F.lit("없음")).alias("detail"), _clean("kw").alias("kw")).join(f, "finding_id")
    item = lambda place, kind, text: F.struct((F.col("i") * 10 + place).cast("double").alias("y"), F.lit(kind).alias("type"), text.alias("content"))
    each = F.array(item(0, "yellow_table", F.concat(F.lit("적출  "), "detail")), item(1, "text", F.lit("1. 조사착안")), item(2, "text", F.concat(F.lit("내용 "), "kw", F.lit(" 확인하였음"))))
    items = src.select("doc_id", F.explode(each).alias("x")).unionByName(src.select("doc_id").distinct().select("doc_id", F.struct(F.lit(0.0).alias("y"), F.lit("text").alias("type"), F.lit("Ⅱ.조사노하우").alias("content")).alias("x")))
    items = items.select("doc_id", F.lit(1).alias("page"), g.box(F.lit(0.0), F.col("x.y"), F.lit(100.0), F.col("x.y") + 5).alias("box"), "x.type", "x.content")
    return layout.assemble_documents(items, src.select("doc_id", F.col("i").alias("n"), "item", "code"))


# ---- boxes


@query(sql=f"with {_BOX} select a.page, a.n, a.k from b a where a.n > 2 and not exists (select 1 from b where b.n <= 2 and a.page = b.page and {_INT} / ({_AREA.format('a')} + {_AREA.format('b')} - {_INT}) >= 0.5)")
def covered_tables(spark, d):
    b = _boxes(spark, d)
    return layout.drop_covered_tables(b.where("n > 2"), b.where("n <= 2"), ["page"], 0.5).select("page", "n", "k")


def _pair(f: str, a: str, b: str) -> str:
    inter = f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    size = lambda x: f"(({x}.x1 - {x}.x0) * ({x}.y1 - {x}.y0))"
    return {"inter": inter, "iou": f"({inter}) / ({size(a)} + {size(b)} - ({inter}))", "within": f"({inter}) / {size(b)} >= 0.5", "small": f"({size(b)} < 0.2 * {size(a)} and {inter} > 0.5 * {size(b)})"}[f]


_S = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"
_MERGED = f"""{_BOX}, r as (select page, list({_S} order by n, k) rest, []::struct(x0 double, y0 double, x1 double, y1 double)[] done from b group by page
union all select page, case when p = 0 then rest[2:] else list_transform(rest[2:], lambda x, i: case when i = p then {{'x0': least(x.x0, h.x0), 'y0': least(x.y0, h.y0), 'x1': greatest(x.x1, h.x1), 'y1': greatest(x.y1, h.y1)}} else x end) end, case when p = 0 then list_append(done, h) else done end
from (select *, rest[1] h, coalesce(list_position(list_transform(rest[2:], lambda x: {_pair('iou', 'x', 'rest[1]')} > 0.5), true), 0) p from r where len(rest) > 0)),
m as (select page, done, list_transform(list_sort(list_transform(done, lambda x, i: {{'a': -((x.x1 - x.x0) * (x.y1 - x.y0)), 'i': i}})), lambda y: done[y.i]) s from r where len(rest) = 0),
t as (select page, len(done) merged, s, []::struct(x0 double, y0 double, x1 double, y1 double)[] kept from m
union all select page, merged, s[2:], case when len(list_filter(kept, lambda q: {_pair('within', 'q', 's[1]')} or {_pair('small', 'q', 's[1]')})) > 0 then kept else list_append(kept, s[1]) end from t where len(s) > 0)"""


@query(sql=f"with recursive {_MERGED} select page, merged::int merged, len(kept)::int kept from t where len(s) = 0")
def greedy_box_merge(spark, d):
    """Boxes of a page merged greedily, and what of them isn't contained in a larger one."""
    b = _boxes(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", "k", "box"))).alias("l"))
    m = b.select("page", g.merge_boxes(0.5)(F.transform("l", lambda x: x["box"])).alias("m"))
    return m.select("page", F.size("m").alias("merged"), F.size(g.drop_contained_boxes()("m")).alias("kept"))


@query(sql=f"""with recursive {_BOX}, p as (select page, list({_S} order by n, k) filter (where n % 2 = 1) f, list({_S} order by n, k) filter (where n % 2 = 0) t from b group by page),
r as (select page, coalesce(f, []) f, coalesce(t, []) t, 0 kept from p
union all select page, f[2:], case when x then t else list_filter(t, lambda q: not ({_pair('within', 'h', 'q')})) end, case when x then kept else kept + 1 end
from (select *, f[1] h, len(list_filter(t, lambda q: {_pair('within', 'q', 'f[1]')})) > 0 x from r where len(f) > 0))
select page, kept::int as first, len(t)::int as tables from r where len(f) = 0""")
def settled_boxes(spark, d):
    """Boxes of two kinds of a page (odd and even lines), of which those inside the other kind go."""
    b = _boxes(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", "k", "box"))).alias("l"))
    kind = lambda odd: F.transform(F.filter("l", lambda x: x["n"] % 2 == odd), lambda x: x["box"])
    return b.select("page", g.settle_boxes()(kind(1), kind(0)).alias("s")).select("page", F.size("s.first").alias("first"), F.size("s.tables").alias("tables"))


# ---- chunks


@query(sql=f"""with recursive p as (select doc_id, unnest(generate_series(1, len(l))) i, unnest(l) para from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: {_strip('x')} <> '') l from documents where doc_id is not null and text is not null)),
w as (select doc_id, i, {_strip('para')} para, {_words('para')} w from p),
g as (select doc_id, i, 0 j, para s, len(w) n from w where len(w) <= 800 union all select doc_id, i, j, array_to_string(w[j + 1:j + 800], ' '), len(w[j + 1:j + 800]) from (select doc_id, i, w, unnest(generate_series(0, len(w) - 1, 800)) j from w where len(w) > 800)),
c as (select doc_id, list(s order by i, j) s, list(n::int order by i, j) cnt from g group by 1),
r as (select doc_id, cnt, 0 i, 0 f, 0 fresh, 0 size, []::int[][] outs from c
union all
select doc_id, cnt, i + 1, case when done then f3 else f2 end, case when done then i + 1 else fresh2 end, case when done then coalesce(list_sum(cnt[f3 + 1:i + 1]), 0)::int else size2 end, case when done then list_append(outs2, [f2, i + 1]) else outs2 end
from (select *, size2 >= 800 and fresh2 < i + 1 done, coalesce(list_max(list_filter(range(f2, i + 1), lambda z: list_sum(cnt[z + 1:i + 1]) >= greatest(floor(size2 * 0.12::double), 50))), f2)::int f3
 from (select doc_id, cnt, i, case when shut then fa else f end f2, case when shut then i else fresh end fresh2, (case when shut then coalesce(list_sum(cnt[fa + 1:i]), 0) else size end + cnt[i + 1])::int size2, case when shut then list_append(outs, [f, i]) else outs end outs2
  from (select *, i > f and size + cnt[i + 1] > 800 and size >= 400 and fresh < i shut, coalesce(list_max(list_filter(range(f, i), lambda z: list_sum(cnt[z + 1:i]) >= greatest(floor(size * 0.12::double), 50))), f)::int fa from r where i < len(cnt))))),
e as (select doc_id, case when fresh < len(cnt) then list_append(outs, [f, len(cnt)::int]) else outs end outs from r where i = len(cnt)),
u as (select doc_id, unnest(outs) o, unnest(generate_series(0, len(outs) - 1)) k from e)
select doc_id, k::int chunk_order, array_to_string(s[o[1] + 1:o[2]], chr(10) || chr(10)) as text from u join c using (doc_id)""")
def overlap_chunks(spark, d):
    return chunk.chunk_texts(table(spark, d, "documents"), "doc_id", "text", "\n")


# ---- questions


def _tokens_sql(x: str, f: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda t: t <> ''), lambda t: {f}), ' ')"


def _plain_sql(x: str) -> str:
    """A query cleaned: white space, marks, abbreviations, noise words, particles."""
    masks = x
    for pattern, name in ((r"\d{6}-\d{7}", "[주민번호]"), (r"\d{3}-\d{2}-\d{5}", "[사업자번호]"), (r"\d{4}-\d{4}-\d{4}-\d{4}", "[카드번호]"), (r"\d{2,3}-\d{3,4}-\d{4}", "[전화번호]")):
        masks = f"regexp_replace({masks}, '\\b{pattern}\\b', '{name}', 'g')"
    word = r"\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}Ⓐ-ⓩ"
    out = f"lower({_strip(f"regexp_replace({masks}, '[{_WS}]+', ' ', 'g')")})"
    out = _strip(f"regexp_replace({out}, '[^{word}{_WS}가-힣]', ' ', 'g')")
    short = " ".join(f"when '{a.lower()}' then '{b}'" for a, b in tx.ABBREVIATIONS.items())
    out = _tokens_sql(f"regexp_replace({out}, '[{_WS}]', ' ', 'g')", f"case t {short} else t end")
    out = f"regexp_replace({out}, '{'|'.join(tx.COMPOUND_NOISE)}', '', 'g')"
    noise = ", ".join(f"'{w}'" for w in tx.WORD_NOISE)
    out = f"array_to_string(list_transform(string_split({out}, ' '), lambda t: case when t in ({noise}) then '' else t end), ' ')"
    for p in tx.PARTICLES:
        out = f"regexp_replace({out}, '([가-힣]){p} +', '\\1 ', 'g')"
    return _strip(f"regexp_replace({out}, '[{_WS}]+', ' ', 'g')")


@query(sql=f"with {_FI} select finding_id, {_plain_sql('item')} q from fi")
def preprocess_query(spark, d):
    """Finding items cleaned as queries are."""
    return records(spark, d, "findings").select("finding_id", tx.preprocess_query("item").alias("q"))


_HINTING = ", ".join(f"'{w}'" for ws in question.SECTION_HINTS.values() for w in ws)
_VOCABULARY = {"domain": {"계좌": ["통장"], "비용": ["외주", "접대"]}, "action": {"누락": ["승인누락"], "허위": ["가공", "허위작성"]}}


def _named_sql(v: dict) -> str:
    return "array_to_string(list_filter([" + ", ".join("case when " + " or ".join(f"contains(p, '{x}')" for x in (k, *syn)) + f" then '{k}' end" for k, syn in sorted(v.items())) + "], lambda x: x is not null), ',')"


@query(sql=f"""with {_FI}, a as (select finding_id, coalesce(item, '') || case when finding_id like '%1' then ' 무엇인지 알려줘' else ' 방법 사례를 찾아줘' end q, coalesce(code, '') c from fi), b as (select finding_id, q || ' ' || c q from a),
e as (select finding_id, lower(q) low, {_plain_sql('q')} p from b),
s as (select *, coalesce(nullif(regexp_extract(p, '(?:^|[^0-9])([0-9]{{5}})(?:$|[^0-9])', 1), ''), null) code, {_named_sql(_VOCABULARY['domain'])} as domain, {_named_sql(_VOCABULARY['action'])} as action,
 array_to_string(list_filter([{', '.join("case when " + " or ".join(f"contains(p, '{w}')" for w in ws) + f" then '{k}' end" for k, ws in question.SECTION_HINTS.items())}], lambda x: x is not null), ',') sections,
 list_filter(string_split(p, ' '), lambda w: length(w) > 1 and w not in ({_HINTING})) m0 from e),
u as (select *, list_filter(m0, lambda w, i: list_position(m0, w) = i) m, case when {' or '.join(f"contains(low, '{w}')" for w in question.EXPLAIN)} then 'explain' else 'search' end intent from s),
f as (select *, len(list_filter(string_split(domain, ','), lambda x: x <> '' and not list_contains(m, x))) + len(list_filter(string_split(action, ','), lambda x: x <> '' and not list_contains(m, x))) related from u),
z as (select *, round(least(1.0::double, greatest(0.3::double * (code is not null)::int + 0.2::double * (domain <> '')::int + 0.25::double * (action <> '')::int + 0.1::double * (sections <> '')::int, case when len(m) >= 2 then 0.7::double when len(m) = 1 then 0.5::double else 0.0::double end + case when related >= 3 then 0.1::double else 0.0::double end)), 6) confidence from f)
select finding_id, p plain, intent, code, domain, action, sections, array_to_string(m, ',') must, confidence, case when len(m) = 0 and (confidence < 0.4 or (code is null and domain = '' and action = '')) then 'clarify' else intent end route from z""")
def question_plans(spark, d):
    """Finding items as questions, planned by rule: intent, slots, must-words, confidence, route."""
    ask = F.when(F.col("finding_id").endswith("1"), " 무엇인지 알려줘").otherwise(" 방법 사례를 찾아줘")
    q = records(spark, d, "findings").select(F.col("finding_id").alias("q"), F.concat(F.coalesce("item", F.lit("")), ask, F.lit(" "), F.coalesce("code", F.lit(""))).alias("text"))
    p = question.plans(q, _VOCABULARY)
    return p.select(F.col("q").alias("finding_id"), "plain", "intent", "code", *[F.array_join(c, ",").alias(c) for c in ("domain", "action", "sections", "must")], "confidence", "route")


# ---- metadata, index, points


_INDUSTRIES = [([["매출", "출고"], ["누락"]], "유통", 0.8, "312"), ([["외주"]], "제조", 0.7, "313")]


@query(sql=f"""with {_FI}, {_TR}, f as (select * from fi where doc_id is not null), o as (select doc_id, string_agg(coalesce(item, ''), chr(10) order by finding_id) o from f group by 1),
t as (select doc_id, string_agg(x, chr(10) order by x) t from (select doc_id, concat_ws(chr(10), item, array_to_string(reason_kw_norm, ' ')) x from f) group by 1), c as (select doc_id, list(distinct code) cs from f where code is not null group by 1),
k0 as (select doc_id, list_filter({_TOK.format("coalesce(reason_kw_raw, '')")}, lambda x: length(x) >= 2 and x not in ({_STOP})) l from tr where doc_id is not null), k1 as (select distinct doc_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:6]) k from k0),
k as (select doc_id, string_agg(k, ',' order by k) overview from (select *, row_number() over (partition by doc_id order by k) r from k1) where r <= 6 group by 1),
v as (select o.doc_id, lower(o) o, t, coalesce(cs, []) cs from o join t using (doc_id) left join c using (doc_id)),
i as (select *, case when ((contains(o, '매출') or contains(o, '출고')) and contains(o, '누락')) or len(list_filter(cs, lambda x: x like '312%')) > 0 then 1 when contains(o, '외주') or len(list_filter(cs, lambda x: x like '313%')) > 0 then 2 else 0 end r from v)
select i.doc_id, array_to_string(list_filter([{', '.join("case when " + " or ".join(f"contains(t, '{p}')" for p in (n, *syn)) + f" then '{n}' end" for n, syn in sorted(TAGS.items()))}], lambda x: x is not null), ',') tags,
case r when 1 then '유통' when 2 then '제조' end industry, case r when 1 then 0.8::double when 2 then 0.7::double else 0.0::double end industry_confidence, coalesce(k.overview, '') overview_keywords from i left join k on k.doc_id = i.doc_id""")
def report_meta(spark, d):
    """Tags, industry and overview of every report that has findings."""
    f = records(spark, d, "findings").where("doc_id is not null")
    docs = f.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finding_id", F.coalesce("item", F.lit("")).alias("i")))), lambda x: x["i"]), "\n"), F.lit("## 적출")).alias("md"))
    m = pipeline.report_meta(docs, f, records(spark, d, "table_rows").where("doc_id is not null"), {"tags": TAGS}, industries=_INDUSTRIES)
    return m.select("doc_id", F.array_join("tags", ",").alias("tags"), "industry", "industry_confidence", F.coalesce(F.array_join("overview_keywords", ","), F.lit("")).alias("overview_keywords"))


@query(sql=f"""with {_LW} select law_id, coalesce(extraction_version, 'v0.5.0') extraction_version, concat_ws(chr(10), nullif({_strip('law_name')}, ''), nullif({_strip('law_content')}, '')) as text from lw""")
def law_documents(spark, d):
    return index.law_documents(records(spark, d, "law_references")).select("law_id", "extraction_version", "text")


def _uuid_sql(x: str) -> str:
    m = f"md5({x})"
    return f"concat_ws('-', substr({m}, 1, 8), substr({m}, 9, 4), substr({m}, 13, 4), substr({m}, 17, 4), substr({m}, 21, 12))"


def _held_sql(kind: str) -> str:
    return " + ".join(f"({c} is not null)::int" for c in pipeline.PAYLOADS[kind][1])


@query(sql=f"""with {_FI}, {_CH}, {_LW} select 'finding' kind, finding_id id, {_uuid_sql('finding_id')} point_id, concat_ws(chr(10), nullif({_strip('item_detail')}, ''), case when coalesce(array_to_string(reason_kw_norm[1:6], ', '), '') <> '' then '핵심키워드: ' || array_to_string(reason_kw_norm[1:6], ', ') end) as text, doc_id, ({_held_sql('finding')})::int held from fi
union all select 'chunk', chunk_id, {_uuid_sql('chunk_id')}, {_strip("coalesce(nullif(text_norm, ''), text)")}, doc_id, ({_held_sql('chunk')})::int from ch
union all select 'law', law_id, {_uuid_sql('law_id')}, concat_ws(chr(10), '종류: ' || law_type, '법령: ' || law_name, '내용: ' || law_content), doc_id, ({_held_sql('law')})::int from lw""")
def vector_points(spark, d):
    """What is stored of every finding, chunk and law in a vector collection: id, text and a payload without nulls."""
    parts = [pipeline.points(records(spark, d, t), kind).withColumn("kind", F.lit(kind)) for kind, t in (("finding", "findings"), ("chunk", "chunks"), ("law", "law_references"))]
    p = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return p.select("kind", "id", "point_id", "text", F.get_json_object("payload", "$.doc_id").alias("doc_id"), F.size(F.json_object_keys("payload")).alias("held"))


@query(sql=f"""with {_FI}, p as (select finding_id id, unnest(list_transform({_TOK.format('item')}, lambda x: lower(x))) term from fi), s as (select count(distinct id) n, count(*)::double / count(distinct id) a from p), l as (select id, count(*) dl from p group by 1),
q as (select id, term, count(*) tf from p where term in ('매출', '수수료') group by 1, 2), v as (select term, count(*) df from q group by 1)
select id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) score from q join v using (term) join l using (id), s group by 1""")
def index_search(spark, d):
    """A search through a written index: postings clustered by term, of which the query's are read."""
    path = work_folder(spark, "index")
    index.write_index(records(spark, d, "findings"), "finding_id", ["item"], path)
    got = index.bm25_index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), ["매출", "수수료"], {"item": 1.0})
    return got.select("id", F.round("score", 6).alias("score"))


# ---- searches


@query(sql=f"with {_FI}, {_bm25_sql('fi', 'finding_id', 'item', ['수수료', '귀속착오', '누락'], 'a')}, x as (select id, sum(part) score, count(*) filter (where term = '수수료') m, count(*) filter (where term <> '수수료') s from a group by 1) select id, round(score, 6) score from x where m = 1 and s >= 1")
def bool_search(spark, d):
    """A word that must be there, and one of two others."""
    got = retrieve.bool_search(table(spark, d, "findings"), "finding_id", ["수수료"], ["귀속착오", "누락"], {"item": 1.0}, minimum=1, at="ingested_at")
    return got.select("id", F.round("score", 6).alias("score"))


@query(sql=f"with {_CH} select chunk_id from ch where section = '조사기법' and (code = '31322' or chunk_order = 0 or (section_order = 1 and code = '31215'))")
def filtered_chunks(spark, d):
    """A filter of values that must hold, and of groups of which one must."""
    c = records(spark, d, "chunks")
    return c.where(retrieve.conditions({"section": "조사기법"}, any_of=[{"code": "31322"}, {"chunk_order": 0}, {"section_order": 1, "code": "31215"}])).select("chunk_id")


def _fields_sql(name: str, rows: str, key: str, boosts: dict, terms: list[str], per_term: bool = False) -> str:
    """CTEs ending in ``name``: id, score (and term): the best boosted field."""
    parts = [_bm25_sql(rows, key, f, terms, f"{name}_{i}") for i, f in enumerate(boosts)]
    t = ", term" if per_term else ""
    union = " union all ".join(f"select id{t}, {float(b)}::double * sum(part) s from {name}_{i} group by id{t}" for i, b in enumerate(boosts.values()))
    return f"{', '.join(parts)}, {name} as (select id{t}, max(s) score from ({union}) group by id{t})"


def _top_sql(name: str, of: str, k: int) -> str:
    return f"{name} as (select id, score, row_number() over (order by score desc, id) r from {of} qualify r <= {k})"


_COSINE = f"list_inner_product(v, {_QV}) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product({_QV}, {_QV})))"


def _latest_vectors(tbl: str, key: str, name: str) -> str:
    return f"{name}0 as (select {key} id, section, vector::double[] v from {tbl} where {key} is not null qualify row_number() over (partition by {key} order by upserted_at desc nulls last) = 1), {name} as (select id, section, {_COSINE} score from {name}0 where len(v) = 64)"


def _fused_sql(name: str, a: str, b: str, n: int) -> str:
    return f"{name}_f as (select coalesce({a}.id, {b}.id) id, coalesce(1.0 / (60 + {a}.r), 0)::double + coalesce(1.0 / (60 + {b}.r), 0)::double score, {a}.r r0, {b}.r r1 from {a} full join {b} on {a}.id = {b}.id), {name} as (select id, score from {name}_f order by score desc, r0 nulls last, r1 nulls last, id limit {n})"


_SECTIONS = {"조사착안": ["거래처", "원장"], "조사기법": ["전표"]}


def _section_sql() -> str:
    fields = {"text": 2.0, "text_norm": 1.0, "item": 1.0}
    out = [f"with {_FI}, {_CH}, {_bm25_sql('fi', 'finding_id', 'item', ['매출'], 'k')}, top30 as (select id from k order by part desc, id limit 30), {_latest_vectors('chunks_vectors', 'chunk_id', 'vv')}"]
    for i, (s, terms) in enumerate(_SECTIONS.items()):
        out.append(f"m{i} as (select * from ch where section = '{s}' and finding_id in (select id from top30))")
        out.append(_fields_sql(f"t{i}", f"m{i}", "chunk_id", fields, terms))
        out.append(_top_sql(f"tt{i}", f"t{i}", 300))
        out.append(f"v{i} as (select id, score from vv where section = '{s}' and id in (select chunk_id from m{i}) and score >= 0.0 and not isnan(score))")
        out.append(_top_sql(f"vt{i}", f"v{i}", 300))
        out.append(_fused_sql(f"h{i}", f"tt{i}", f"vt{i}", 300))
    union = " union all ".join(f"select {i} o, '{s}' section, id, score from h{i}" for i, s in enumerate(_SECTIONS))
    return ", ".join(out) + f" select section, id, round(score, 6) score from ({union}) qualify row_number() over (partition by id order by o) = 1"


@query(sql=_section_sql())
def section_retrieval(spark, d):
    """The best chunks of two sections among the findings of one keyword."""
    found = retrieve.top(index.bm25(table(spark, d, "findings"), "finding_id", ["매출"], {"item": 1.0}, at="ingested_at"), 30).select(F.col("id").alias("finding_id"))
    got = retrieve.retrieve_sections(records(spark, d, "chunks"), found, _SECTIONS, records(spark, d, "chunks_vectors"), QUERY_VECTOR, least=0.0)
    return got.select("section", "id", F.round("score", 6).alias("score"))


def _findings_sql() -> str:
    docs = {"item": 2.0, "reasons": 1.5, "item_detail": 1.0}
    words = ["매출", "수수료", "보조금", "계좌"]
    boost = "case term when '매출' then 3.0 when '수수료' then 3.0 else 1.5 end"
    vec = f"fv0 as (select finding_id id, vector::double[] v from findings_vectors where finding_id is not null qualify row_number() over (partition by finding_id order by upserted_at desc nulls last) = 1), fv as (select id, {_COSINE} score from fv0 where len(v) = 64)"
    return ", ".join(
        [
            f"with {_FI}, f as (select *, coalesce(array_to_string(reason_kw_norm, ' '), '') reasons from fi)",
            _fields_sql("a", "f", "finding_id", docs, ["매출", "수수료"], per_term=True),
            "k as (select term, id, score, row_number() over (partition by term order by score desc, id) r from a)",
            "kd as (select term, doc_id, max(score) score from k join fi on fi.finding_id = k.id where r <= 50 group by 1, 2), pd as (select doc_id, count(distinct term) t, max(score) s from kd group by 1)",
            "ds as (select doc_id from pd qualify case when (select count(*) from pd where t >= 2) > 0 then t >= 2 else row_number() over (order by s desc, doc_id) <= 30 end)",
            "kept as (select * from f where doc_id in (select doc_id from ds))",
            _fields_sql("b", "kept", "finding_id", {"item": 1.0, "reasons": 0.8, "item_detail": 0.5}, words, per_term=True),
            f"bs as (select id, sum(score * ({boost})::double) score from b group by 1)",
            _top_sql("bt", "bs", 150),
            vec,
            "fw as (select id, score from fv where id in (select finding_id from kept) and score >= 0.1 and not isnan(score))",
            _top_sql("vt", "fw", 150),
            _fused_sql("h", "bt", "vt", 30),
        ]
    ) + " select id, round(score, 6) score from h where score >= 0.5 * (select max(score) from h)"


@query(sql=_findings_sql())
def retrieve_findings(spark, d):
    """The best findings for two must-words, one that should be there and a related one."""
    e = retrieve.Expansion(must=("매출", "수수료"), should=("보조금",), related=("계좌",))
    got = retrieve.retrieve_findings(records(spark, d, "findings"), ["매출", "수수료"], e, records(spark, d, "findings_vectors"), QUERY_VECTOR, least=0.1)
    return got.select("id", F.round("score", 6).alias("score"))


@query(sql=f"""with recursive fv0 as (select finding_id id, vector::double[] v from findings_vectors where finding_id is not null qualify row_number() over (partition by finding_id order by upserted_at desc nulls last) = 1),
fv as (select id, v, sqrt(list_inner_product(v, v)) n, {_COSINE} score from fv0 where len(v) = 64), t as (select id, v, n, score from fv where score is not null and not isnan(score) order by score desc, id limit 100),
s as (select list(struct_pack(id := id, score := score, v := list_transform(v, lambda y: y / n)) order by score desc, id) l from t),
r as (select 0 step, []::int[] taken from s
union all select step + 1, list_append(taken, list_reduce(list_filter(range(1, len(l) + 1)::int[], lambda i: not list_contains(taken, i)), lambda p, q: case when m[q] > m[p] then q else p end)) from (
 select step, taken, l, list_transform(l, lambda x: 0.65 * x.score - 0.35 * case when len(taken) > 0 then list_max(list_transform(taken, lambda j: list_inner_product(x.v, l[j].v))) else 0 end) m from r, s where step < least(20, len(l))))
select 0 q, l[taken[k]].id id, k::int pick from (select taken, unnest(generate_series(1, len(taken))) k from r order by step desc limit (select least(20, len(l)) from s)), s where len(taken) = least(20, len(l))""")
def mmr_diversify(spark, d):
    """20 of the 100 findings nearest to a vector, chosen so that they differ."""
    hits = records(spark, d, "findings_vectors").where(F.size("vector") == 64).select(F.lit(0).alias("q"), F.col("finding_id").alias("id"), vx.cosine("vector", vx.literal(QUERY_VECTOR)).alias("score"), "vector").where("score is not null and not isnan(score)")
    return retrieve.diversify(retrieve.top(hits, 100), "q", 20)


@query(sql=f"with {_CH}, w(word) as (values ('거래처'), ('원장'), ('전표')) select word, (select count(*) from ch where contains(text, word)) n from w")
def keyword_block_counts(spark, d):
    return rank.keyword_block_counts(records(spark, d, "chunks"), "text", ["거래처", "원장", "전표"])


@query(sql=f"with {_HITS} select chunk_id, round(0.6::double * score + 0.3::double * coalesce(section_order, 0) + 0.1::double * coalesce(chunk_order, 0), 6) score from h")
def blended_scores(spark, d):
    return _hits(spark, d).select("chunk_id", F.round(rank.blend({"score": 0.6, "section_order": 0.3, "chunk_order": 0.1}), 6).alias("score"))


# ---- stores


@query(sql="select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25")
def first_rows(spark, d):
    """A limit after an order: planned as a top-k of each task."""
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)


@query(sql="select 'now' state, c_custkey, c_name || case when c_custkey % 3 = 0 then '*' else '' end as name from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0 union all select 'before', c_custkey, c_name from customer where c_custkey % 2 = 0")
def store_round_trip(spark, d):
    """A table made, filled, backed up, upserted; one cleared, one deleted and made anew; a vector collection with its settings."""
    at = work_folder(spark, "stores")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    store.create_if_absent(spark, f"{at}/t", "c_custkey long, name string")
    store.upsert(c.where("c_custkey % 2 = 0"), f"{at}/t", ["c_custkey"], ["name"])
    store.create_if_absent(spark, f"{at}/t", "c_custkey long, name string")  # is there: stays as it is
    store.back_up(spark, f"{at}/t", f"{at}/before")
    store.upsert(c.where("c_custkey % 3 = 0").withColumn("name", F.concat("name", F.lit("*"))), f"{at}/t", ["c_custkey"], ["name"])
    store.upsert(c.limit(0), f"{at}/t", ["c_custkey"], ["name"])
    for other in ("cleared", "anew"):
        store.back_up(spark, f"{at}/t", f"{at}/{other}")
    store.clear(spark, [f"{at}/cleared", f"{at}/absent"])
    store.recreate(spark, f"{at}/anew", "c_custkey long, name string")
    store.ensure_collection(spark, f"{at}/points", 64)
    assert store.ensure_collection(spark, f"{at}/points", 64)["index_from"] == 20_000 and not store.exists(spark, f"{at}/absent")
    here = files.Vectors(spark, f"path:{at}", "t").read()
    out = here.withColumn("state", F.lit("now")).unionByName(spark.read.parquet(f"{at}/before").withColumn("state", F.lit("before")))
    for other in ("cleared", "anew"):
        out = out.unionByName(spark.read.parquet(f"{at}/{other}").withColumn("state", F.lit(other)))
    return out.select("state", "c_custkey", "name")


@query(sql="select count(*)::bigint as \"rows\", 1::bigint files from chunks")
def table_files(spark, d):
    """Rows and files of a table (the test tables are one file each)."""
    return files.table_size(table(spark, d, "chunks")).select("rows", "files")


@query(sql=f"""with {_TR}, {_FM}, a as (select row_id, doc_id, nullif(case when regexp_full_match(code, '[0-9]{{5}}') then code end, '') code from tr where regexp_matches(doc_id, '{_DOC}') and regexp_matches(row_id, '^[^{_WS}]+$'))
select row_id, count(*) n from a join pf on a.doc_id = pf.doc_id and a.code = pf.own_code group by 1""")
def parsed_links(spark, d):
    """Rows and findings of the written Markdown, parsed and linked: the links of each row with an equal code, counted by classes."""
    rows = parse.table_rows(parse.lines(_row_markdown(spark, d)))
    found = _parsed(spark, d)[1]
    links, in_a, in_b = link.link_classes(rows, found)
    codes = lambda df, key, c: df.select(F.col(key).alias("member"), F.col("code").alias(c))
    a = in_a.join(codes(rows, "row_id", "c1"), "member").groupBy("class").agg(F.first("c1").alias("c1"))
    b = in_b.join(codes(found, "finding_id", "c2"), "member").groupBy("class").agg(F.first("c2").alias("c2"), F.count("*").alias("n"))
    equal = links.join(a, F.col("row_class") == a["class"]).join(b, F.col("finding_class") == b["class"]).where("c1 = c2").groupBy("row_class").agg(F.sum("n").alias("n"))
    return in_a.join(equal, F.col("class") == F.col("row_class")).select(F.col("member").alias("row_id"), "n")


@query(sql=f"with w as (select unnest(regexp_extract_all(text, '[가-힣]{{2,}}')) word from documents), c as (select word, count(*) n from w group by 1 order by n desc, word limit 30) select word, n from c where not contains('{' '.join(p for k, v in TAGS.items() for p in (k, *v))}', word) and n >= 2 order by n desc, word limit 20")
def missing_words(spark, d):
    """Frequent words that no vocabulary has."""
    return meta.missing_words(meta.word_report(table(spark, d, "documents"), "text", [p for k, v in TAGS.items() for p in (k, *v)])).select("word", "n")




def _lengths():
    """A stand-in for a model: the characters, blanks and first code point of a text."""
    return lambda texts: [[len(t), t.count(" "), ord(t[0])] for t in texts]


@query(sql=f"""with {_FI}, t as (select finding_id, concat_ws(chr(10), nullif({_strip('item_detail')}, ''), case when coalesce(array_to_string(reason_kw_norm[1:6], ', '), '') <> '' then '핵심키워드: ' || array_to_string(reason_kw_norm[1:6], ', ') end) t from fi)
select finding_id, {_uuid_sql('finding_id')} point_id, substr(sha256(t), 1, 16) text_hash, length(t)::double as chars, (length(t) - length(replace(t, ' ', '')))::double blanks, unicode(t)::double as first from t where {_strip('t')} <> '' and not finding_id like '%1'""")
def embedded_findings(spark, d):
    """Texts of all findings through a model hook in batches; those whose text is known already (ids that end in 1) are left out."""
    f = records(spark, d, "findings")
    text = pipeline.embedding_text("finding")
    known = f.where("finding_id like '%1'").select("finding_id", tx.text_hash(text).alias("text_hash"))
    e = pipeline.embed(f, "finding_id", text, _lengths, known)
    return e.select("finding_id", "point_id", "text_hash", *[F.col("vector")[i].cast("double").alias(n) for i, n in enumerate(("chars", "blanks", "first"))])


@query(sql=f"""with {_FI}, t as (select finding_id, list_transform({_TOK.format("coalesce(item, '')")}, lambda x: lower(x)) l from fi),
b as (select finding_id, list_concat(l, flatten(list_transform(list_filter(l, lambda x: regexp_full_match(x, '[가-힣]{{3,}}')), lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2))))) l from t)
select term, count(distinct finding_id) df, count(*) cf from (select finding_id, unnest(l) term from b) group by 1""")
def syllable_pairs(spark, d):
    """Term statistics of an index with pairs of syllables, by which parts of compounds are found."""
    p = index.postings(records(spark, d, "findings"), "finding_id", ["item"], bigrams=True)
    return index.term_stats(p).select("term", "df", F.col("cf").cast("long").alias("cf"))


_TOP20 = f"{_CV}, g as (select id, score from vs where score is not null and not isnan(score) and id in (select chunk_id from cv where section = '조사기법')), x as (select id, row_number() over (order by score desc, id) r from g)"


@query(sql=f"with {_TOP20} select id from x where r <= 20")
def cells_exact(spark, d):
    """A search with a filter through the cell index that reads all cells: what a scan finds."""
    return _cells(spark, d, 10**6).select("id")


@query(sql=f"with {_TOP20} select count(*) k, true as enough from x where r <= 20")
def cells_recall(spark, d):
    """The same search reading three quarters of the cells, as its vector is unlike all rows: whether it has 9 of 10 of what all cells give."""
    some = _cells(spark, d, None).select("id", F.lit(1).alias("hit"))
    return _cells(spark, d, 10**6).join(some, "id", "left").agg(F.count("*").alias("k"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def _cells(spark, d, probe: int | None) -> DataFrame:
    rows = cells.usable(table(spark, d, "chunks_vectors").select("chunk_id", "section", "vector", "upserted_at"), "chunk_id", "vector", 64, "upserted_at")
    at = cells.write(rows, work_folder(spark, "cells"), key="chunk_id")
    return cells.search(spark, at, QUERY_VECTOR, 20, "chunk_id", probe=probe or max(1, len(at.centres) * 3 // 4), where=F.col("section") == "조사기법")
