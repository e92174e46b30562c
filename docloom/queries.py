"""Queries of the core library and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as g
from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.operators import chunk, index, layout, link, meta, ordered, orphans, packed, parse, rank, retrieve, store
from docloom.plans import pipeline
from docloom.runtime import table
from docloom.schemas import KEYS
from docloom.sources import files
from docloom.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f=None, *, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows where there is one."""

    def add(g):
        QUERIES[g.__name__] = g
        if sql:
            ORACLES[g.__name__] = sql
        return g

    return add(f) if f else add


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_values(spark, d).where("packed").select("tbl", "row_key", "pos", "val")


@query
def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every field, whether packed or alone."""
    return packed.reasons(table(spark, d, "table_rows"), table(spark, d, "findings"))


_LIST_MARK = "[①-⑳⑴-⒛㉠-㉻❶-❿➀-➉㈀-㈞]|[0-9가-하ㄱ-ㅎ][.)．）]"


@query(sql=f"""with t as (select row_id, arg_max(coalesce(reason_kw_raw, ''), ingested_at) v from table_rows where row_id is not null group by 1), f as (select finding_id, arg_max(coalesce(reason_kw_norm, []), ingested_at) v from findings where finding_id is not null group by 1),
s as (select 'table_rows' tbl, row_id row_key, v s from t union all select 'findings', finding_id, array_to_string(v, chr(10)) from f)
select tbl, row_key, letters from (select tbl, row_key, s, regexp_replace(regexp_replace(s, '(?i)<\\s*/?\\s*(br|p|div|li|tr|td)\\b[^<>]*>', chr(10), 'g'), '[^\\pL\\pN]|[ㆍᆞ]', '', 'g') letters from s) where letters <> '' and not regexp_matches(s, '{_LIST_MARK}')""")
def p2_letters(spark: SparkSession, d: str) -> DataFrame:
    """The letters and figures of all values of a field, in order, which are those of the field: nothing is lost, added or moved.

    Fields with what may be a list mark are left out, as list marks are no part of a value.
    """
    fields = packed.reason_fields(table(spark, d, "table_rows"), table(spark, d, "findings"))
    listed = fields.where(F.col("s").rlike(_LIST_MARK)).select("tbl", "row_key")
    vals = packed.unpack(fields).groupBy("tbl", "row_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda x: F.regexp_replace(x["val"], r"[^\p{L}\p{N}]", "")), "").alias("letters"))
    return vals.where("letters <> ''").join(listed, ["tbl", "row_key"], "left_anti")


_REPORT_TABLES = ("chunks", "law_references", "table_rows", "findings", "reports")

_P4 = """
with k as (
  select 'chunks' tbl, chunk_id row_key, 'findings' parent, finding_id ref, created_at t from chunks
  union all select 'law_references', law_id, 'findings', finding_id, created_at from law_references
  union all select 'table_rows', row_id, 'reports', doc_id, ingested_at from table_rows
  union all select 'findings', finding_id, 'reports', doc_id, ingested_at from findings),
r as (
  select tbl, row_key, arg_max(parent, t) parent, min(t) t,
    lower(trim(coalesce(arg_max(coalesce(ref, ''), t), ''), ' ' || chr(9) || chr(10) || chr(13))) ref
  from k where row_key is not null group by 1, 2),
q as (
  select 'findings' parent, lower(trim(finding_id, ' ' || chr(9) || chr(10) || chr(13))) ref, ingested_at t, deleted_at d from findings
  union all select 'reports', lower(trim(doc_id, ' ' || chr(9) || chr(10) || chr(13))), ingested_at, deleted_at from reports),
p as (
  select parent, ref, min(t) t, arg_max(case when d is null then 0 else 1 end, t) gone from q where ref <> '' group by 1, 2),
o as (
  select r.tbl, r.row_key, strftime(r.t, '%Y-%m') ym,
    case when p.ref is null then 'missing' when gone = 1 then 'deleted' when p.t > r.t then 'late' end kind
  from r left join p on r.parent = p.parent and r.ref = p.ref where r.ref <> '')
"""


def _orphan_state(spark: SparkSession, d: str):
    return orphans.report_references(*(table(spark, d, t) for t in _REPORT_TABLES))


@query(sql=_P4 + "select tbl, row_key, ym, kind from o where kind is not null")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(_orphan_state(spark, d))


@query(sql=_P4 + "select tbl, ym, kind, count(*) n from o where kind is not null group by 1, 2, 3")
def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.counts(_orphan_state(spark, d))


_P4_CUT = """with m as (select epoch_us(min(t)) lo, epoch_us(max(t)) hi from (select created_at t from chunks where chunk_id is not null union all select created_at from law_references where law_id is not null
  union all select ingested_at from table_rows where row_id is not null union all select ingested_at from findings where finding_id is not null)),
cut as (select make_timestamp((lo + (hi - lo) * i // 3)::bigint) until from m, (values (1), (2)) v(i) union all select null),
""" + (
    _P4.replace("with k as", "k as")
    .replace("  select tbl, row_key, arg_max(parent, t)", "  select until, tbl, row_key, arg_max(parent, t)")
    .replace("from k where row_key is not null group by 1, 2)", "from k join cut on cut.until is null or k.t is null or k.t <= cut.until where row_key is not null group by 1, 2, 3)")
    .replace("  select parent, ref, min(t) t, arg_max(case", "  select until, parent, ref, min(t) t, arg_max(case")
    .replace("from q where ref <> '' group by 1, 2)", "from q join cut on cut.until is null or q.t is null or q.t <= cut.until where ref <> '' group by 1, 2, 3)")
    .replace("  select r.tbl,", "  select r.until, r.tbl,")
    .replace("on r.parent = p.parent", "on r.until is not distinct from p.until and r.parent = p.parent")
)


@query(sql=_P4_CUT + "select until, tbl, ym, kind, count(*) n from o where kind is not null group by 1, 2, 3, 4")
def p4_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The counts as they were after each batch of arrivals: orphans appear, are resolved and reopen."""
    return orphans.snapshots(*orphans.report_tables(*(table(spark, d, t) for t in _REPORT_TABLES)))


# ---- document analytics and retrieval, each over whole tables

_AT = {"chunks": "created_at", "law_references": "created_at", "table_rows": "ingested_at", "findings": "ingested_at", "reports": "ingested_at", "chunks_vectors": "upserted_at", "findings_vectors": "upserted_at"}
_KEY = KEYS | {"chunks_vectors": "chunk_id", "findings_vectors": "finding_id"}


def records(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table with one row a key: the latest."""
    return store.first_wins(table(spark, d, name).where(F.col(_KEY[name]).isNotNull()), [_KEY[name]], [F.desc(_AT[name])])


def _rec(name: str, alias: str) -> str:
    return f"{alias} as (select * from {name} where {_KEY[name]} is not null qualify row_number() over (partition by {_KEY[name]} order by {_AT[name]} desc nulls last) = 1)"


_CH, _FI, _TR, _RP, _LW = (_rec(n, a) for n, a in (("chunks", "ch"), ("findings", "fi"), ("table_rows", "tr"), ("reports", "rp"), ("law_references", "lw")))
_WS = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOK = "regexp_extract_all({}, '[가-힣A-Za-z0-9]+')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{_WS}]+')"


def _tokset(x: str) -> str:
    return f"list_distinct({_TOK.format(x)})"


def _jac(a: str, b: str) -> str:
    return f"case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) else 0.0 end"


# text


@query(sql=f"select doc_id, len({_TOK.format("coalesce(text, '')")})::int n_tokens from documents")
def tokenize_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.tokens("text")).alias("n_tokens"))


@query(sql=f"select doc_id, coalesce(len({_words('text')}), 0)::int n_words from documents")
def whitespace_token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count("text").alias("n_words"))


_STOP = ", ".join(f"'{w}'" for w in tx.KEYWORD_STOPWORDS)


@query(sql=f"""with {_TR}, t as (select row_id, list_filter({_TOK.format("coalesce(reason_kw_raw, '')")}, lambda x: length(x) >= 2 and x not in ({_STOP})) l from tr)
select row_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:6], ',') keywords from t""")
def reason_keywords(spark, d):
    return records(spark, d, "table_rows").select("row_id", F.array_join(tx.keywords("reason_kw_raw"), ",").alias("keywords"))


TAGS = {"계좌": ["통장", "현금인출"], "매출": ["출고", "판매"], "비용": ["외주", "운반비", "접대"], "증빙": ["세금계산서", "명세"]}


@query(sql=f"""with {_CH}, v(label, pattern) as (values {', '.join(f"('{k}', '{p}')" for k, v in TAGS.items() for p in (k, *v))})
select chunk_id, coalesce((select string_agg(label, ',' order by label) from (select distinct label from v where contains(coalesce(text, ''), pattern))), '') tags from ch""")
def tag_substring_match(spark, d):
    return records(spark, d, "chunks").select("chunk_id", F.array_join(tx.labels(F.coalesce("text", F.lit("")), TAGS), ",").alias("tags"))


RULES = [([["계좌", "bank"], ["배우자", "representative"]], "account", 0.8), ([["세금계산서", "invoice"]], "invoice", 0.75), ([["창고", "warehouse", "almacén"]], "stock", 0.7)]


@query(sql="""select doc_id, case when (contains(t, '계좌') or contains(t, 'bank')) and (contains(t, '배우자') or contains(t, 'representative')) then 'account'
  when contains(t, '세금계산서') or contains(t, 'invoice') then 'invoice' when contains(t, '창고') or contains(t, 'warehouse') or contains(t, 'almacén') then 'stock' end as label,
  case when (contains(t, '계좌') or contains(t, 'bank')) and (contains(t, '배우자') or contains(t, 'representative')) then 0.8::double
  when contains(t, '세금계산서') or contains(t, 'invoice') then 0.75::double when contains(t, '창고') or contains(t, 'warehouse') or contains(t, 'almacén') then 0.7::double else 0.0::double end confidence
from (select doc_id, lower(coalesce(text, '')) t from documents)""")
def case_cascade_classify(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_case("text", RULES).alias("c")).select("doc_id", "c.label", "c.confidence")


@query(sql=f"""with {_CH} select chunk_id, {_strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '-[ \\t\\n\\x{{b}}\\f\\r]*[0-9]+[ \\t\\n\\x{{b}}\\f\\r]*-', ' ', 'g'), '(?m)^#{{1,6}}[ \\t\\n\\x{{b}}\\f\\r]*', '', 'g'), '[{_WS}]+', ' ', 'g'), '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g')")} plain from ch""")
def normalize_text_col(spark, d):
    return records(spark, d, "chunks").select("chunk_id", tx.plain_text("text").alias("plain"))


@query(sql=r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b\d{6}-\d{7}\b', '[주민번호]', 'g'), '\b\d{3}-\d{2}-\d{5}\b', '[사업자번호]', 'g'), '\b\d{4}-\d{4}-\d{4}-\d{4}\b', '[카드번호]', 'g'), '\b\d{2,3}-\d{3,4}-\d{4}\b', '[전화번호]', 'g') masked from documents""")
def mask_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.mask_numbers("text").alias("masked"))


@query(sql=r"""with t as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[가-힣]')) h, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}Ⓐ-ⓩ]')) w from documents)
select doc_id, case when w = 0 then 'unknown' when h > w * 0.3::double then 'ko' else 'en' end script from t""")
def detect_script(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.script_of("text").alias("script"))


@query(sql="select count(*) filter (where contains(text, '세금계산서')) n0, count(*) filter (where contains(text, '계좌')) n1, count(*) filter (where contains(text, 'invoice')) n2 from documents")
def keyword_frequency(spark, d):
    return retrieve.keyword_frequency(table(spark, d, "documents"), ["세금계산서", "계좌", "invoice"], ["text"])


@query(sql="select doc_id, ((length(text) - length(replace(text, '원장', ''))) / 2)::int n from documents")
def occurrence_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.occurrences("text", "원장").alias("n"))


_PATTERNS = [p for k, v in TAGS.items() for p in (k, *v)]


@query(sql="""with w as (select unnest(regexp_extract_all(text, '[가-힣]{2,}')) word from documents),
c as (select word, count(*) n from w group by 1 order by n desc, word limit 30)
select word, n, contains('""" + " ".join(_PATTERNS) + "', word) known from c")
def vocab_coverage_topn(spark, d):
    return meta.word_report(table(spark, d, "documents"), "text", _PATTERNS)


@query(sql=f"""with a as (select distinct item as name, {_tokset('item')} t from findings where item is not null), b as (select distinct item as label, {_tokset('item')} u from item_ref),
s as (select name, label, len(list_intersect(t, u)) / sqrt(len(t)::double * len(u)) score from a, b where len(t) > 0)
select name, arg_min(label, {{'s': -score, 'l': label}}) as label, round(max(score), 6) score from s where score > 0.6 group by 1""")
def best_candidate(spark, d):
    return meta.best_candidates(table(spark, d, "findings"), table(spark, d, "item_ref"), "item", "item").select("name", "label", F.round("score", 6).alias("score"))


@query(sql=f"select code, item, round(max({_jac('t', 'u')}), 6) jaccard from (select code, item, {_tokset('item')} t from item_ref), (select {_tokset('item')} u from findings where item is not null) group by 1, 2")
def set_similarity(spark, d):
    """Each reference item's highest Jaccard similarity to an item of a finding; the reference has a fixed few rows."""
    ref = table(spark, d, "item_ref").select("code", "item", tx.token_set("item").alias("t"))
    got = table(spark, d, "findings").select(tx.token_set("item").alias("u"), F.col("item").alias("i")).where("i is not null").select("u").distinct()
    keys = ref.select("code", "item", "t", F.explode("t").alias("k")).join(got.select("u", F.explode("u").alias("k")), "k").select("code", "item", tx.jaccard("t", "u").alias("j"))
    best = keys.groupBy("code", "item").agg(F.round(F.max("j"), 6).alias("b"))
    return ref.select("code", "item").join(best, ["code", "item"], "left").select("code", "item", F.coalesce("b", F.lit(0.0)).alias("jaccard"))


@query(sql="select doc_id, substr(sha256(text), 1, 16) hash, concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)) uuid from (select doc_id, text, md5(text) m from documents)")
def text_hash_uuid(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.text_hash("text").alias("hash"), F.when(F.col("text").isNotNull(), tx.uuid_of("text")).otherwise(F.lit("")).alias("uuid"))


@query(sql=f"with {_TR} select row_id, {_strip("regexp_replace(regexp_replace(reason_kw_raw, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')")} plain from tr")
def strip_tags(spark, d):
    return records(spark, d, "table_rows").select("row_id", tx.strip_tags("reason_kw_raw").alias("plain"))


@query(sql=f"""with {_FI}, b as (select finding_id, item, {_strip(f"regexp_replace(item, '^[{_WS}]*[0-9]+[{_WS}]*[.)][{_WS}]*', '')")} r from fi) select finding_id, case when r <> '' then r else item end item from b""")
def bare_items(spark, d):
    return records(spark, d, "findings").select("finding_id", tx.bare_item("item").alias("item"))


# lines, sections, chunks


@query(sql=f"with {_CH}, l as (select chunk_id, string_split(text, chr(10)) s from ch where text is not null) select chunk_id, unnest(generate_series(1, len(s)))::int line_no, unnest(s) line from l")
def line_explode(spark, d):
    ls = parse.lines(records(spark, d, "chunks").select(F.col("chunk_id").alias("doc_id"), F.col("text").alias("md")))
    return ls.select(F.col("doc_id").alias("chunk_id"), "line_no", "line")


@query(sql=f"""with {_CH}, s as (select chunk_id, generate_subscripts(string_split(text, chr(10)), 1) p, unnest(string_split(text, chr(10))) para from ch),
w as (select chunk_id, p, {_words('para')} w from s where {_strip('para')} <> '')
select chunk_id, count(*)::int segments, sum(len(x))::int n_words, max(len(x))::int longest from (select chunk_id, w[i + 1:i + 800] x from (select chunk_id, w, unnest(generate_series(0, len(w) - 1, 800)) i from w)) group by 1""")
def fixed_window_segments(spark, d):
    s = records(spark, d, "chunks").select("chunk_id", F.explode(tx.fixed_segments(tx.paragraphs("text", "\n"))).alias("s")).select("chunk_id", tx.word_count("s").alias("n"))
    return s.groupBy("chunk_id").agg(F.count("*").cast("int").alias("segments"), F.sum("n").cast("int").alias("n_words"), F.max("n").alias("longest"))


@query(sql=r"""with r as (select distinct source_path p from reports where source_path is not null), b as (select p, regexp_replace(regexp_replace(p, '^.*/', ''), '\.[^.]*$', '') n from r),
x as (select p, n, regexp_extract(n, '(\d{4})[\s_]*([sShH상하])[^\d-]*-(\d+)-(\d+)', ['y', 'h', 'k', 'm']) g from b)
select p source_path, case when g.y <> '' then g.y || case when g.h in ('s', 'S', '상') then 'S' else 'H' end || '-' || case when length(g.k) < 3 then lpad(g.k, 3, '0') else g.k end || '-' || g.m else n end report_id from x""")
def doc_id_parse(spark, d):
    return table(spark, d, "reports").select("source_path").where("source_path is not null").distinct().withColumn("report_id", parse.report_id("source_path"))


@query(sql="""with a as (select user_id, event_id, ts, event_type, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id) anchor from events)
select event_id, anchor, row_number() over (partition by user_id, anchor order by ts, event_id) n from a where event_type = 'purchase'""")
def law_forward_fill(spark, d):
    """Forward fill and a running count, as laws get their finding: purchases by the user's last signup."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("own"))
    e = ordered.carried(e, ["user_id"], ["ts", "event_id"], "own", "anchor").where("event_type = 'purchase'")
    return ordered.numbered(e, ["user_id", "anchor"], ["ts", "event_id"]).select("event_id", "anchor", "n")


# links


@query(sql=f"""with {_TR}, {_FI}, a as (select row_id, doc_id, nullif(code, '') code, {_tokset("coalesce(item, '')")} i, {_tokset("coalesce(reason_kw_raw, '')")} r from tr where doc_id is not null),
b as (select finding_id, doc_id, nullif(code, '') code, {_tokset("coalesce(item, '')")} i, {_tokset("coalesce(array_to_string(reason_kw_norm, ' '), '')")} r from fi where doc_id is not null),
s as (select row_id, finding_id, coalesce(a.code <> b.code, false) differ, case when a.code = b.code then 5.0 else 0.0 end::double + 2.0::double * {_jac('a.i', 'b.i')} + {_jac('a.r', 'b.r')} score from a join b using (doc_id))
select row_id, count(*)::bigint links, count(*) filter (where differ)::bigint mismatches, count(*) filter (where score >= 3 and score < 6)::bigint doubtful, round(max(score), 3) best from s where score >= 2 group by 1""")
def jaccard_link(spark, d):
    return link.link_summary(records(spark, d, "table_rows"), records(spark, d, "findings"))


@query(sql="""with f as (select distinct finding_id from findings where finding_id is not null), m as (select finding_id, string_agg(distinct row_id, ',' order by row_id) row_ids, bool_or(code_mismatch) mm from row_finding_map group by 1)
select finding_id, coalesce(row_ids, '') row_ids, coalesce(mm, false) code_mismatch from f left join m using (finding_id)""")
def link_fold(spark, d):
    return link.fold_links(table(spark, d, "findings"), table(spark, d, "row_finding_map")).withColumn("row_ids", F.array_join("row_ids", ","))


@query(sql="select f.finding_id, count(distinct c.chunk_id) n from (select distinct finding_id from findings where finding_id is not null) f left join chunks c on c.finding_id = f.finding_id group by 1")
def chunk_count(spark, d):
    return link.child_count(table(spark, d, "findings"), table(spark, d, "chunks"), "finding_id", "chunk_id")


@query(sql=f"""with {_FI}, t as (select doc_id, max(title) t from reports where {_strip('title')} <> '' group by 1) select finding_id, coalesce(t, doc_id) doc_title from fi left join t using (doc_id)""")
def title_lookup(spark, d):
    return link.with_title(records(spark, d, "findings"), table(spark, d, "reports")).select("finding_id", "doc_title")


@query(sql=f"""with {_FI}, {_TR}, t as (select doc_id, max(title) t from reports where {_strip('title')} <> '' group by 1), m as (select finding_id, string_agg(distinct row_id, ',' order by row_id) row_ids from row_finding_map group by 1),
c as (select finding_id, string_agg(distinct tr.code, ',' order by tr.code) codes from row_finding_map join tr using (row_id) where tr.code is not null group by 1), n as (select finding_id, count(distinct chunk_id) n from chunks group by 1)
select finding_id, coalesce(t, doc_id) doc_title, row_number() over (partition by doc_id order by start_line nulls first, finding_id) finding_order, coalesce(row_ids, '') row_ids, coalesce(codes, '') codes, coalesce(n, 0) chunk_count, coalesce(array_to_string(reason_kw_norm, ' '), '') overview_keywords
from fi left join t using (doc_id) left join m using (finding_id) left join c using (finding_id) left join n using (finding_id)""")
def finding_documents(spark, d):
    f = index.finding_documents(table(spark, d, "findings"), table(spark, d, "reports"), table(spark, d, "row_finding_map"), table(spark, d, "table_rows"), table(spark, d, "chunks"))
    return f.select("finding_id", "doc_title", "finding_order", F.array_join("row_ids", ",").alias("row_ids"), F.array_join("codes_from_rows", ",").alias("codes"), "chunk_count", "overview_keywords")


@query(sql=f"""with {_CH} select chunk_id, coalesce(nullif({_strip('text_norm')}, ''), {_strip('text')}) text_norm, case when start_line is not null and end_line is not null then start_line end gte, case when start_line is not null and end_line is not null then end_line end lte, octet_length(encode(text)) <= 32766 as exact from ch""")
def chunk_documents(spark, d):
    return index.chunk_documents(records(spark, d, "chunks")).select("chunk_id", "text_norm", F.col("line_range.gte").alias("gte"), F.col("line_range.lte").alias("lte"), "exact")


@query(sql=f"""with {_TR}, t as (select doc_id, row_id, list_filter({_TOK.format("coalesce(reason_kw_raw, '')")}, lambda x: length(x) >= 2 and x not in ({_STOP})) l from tr where doc_id is not null),
k as (select distinct doc_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:6]) k from t), r as (select *, row_number() over (partition by doc_id order by k) r from k)
select doc_id, string_agg(k, ',' order by k) overview from r where r <= 6 group by 1""")
def keyword_overview(spark, d):
    rows = records(spark, d, "table_rows").where("doc_id is not null").withColumn("k", tx.keywords("reason_kw_raw"))
    return meta.keyword_overview(rows, "doc_id", "k").withColumn("overview", F.array_join("overview", ","))


# boxes: a page is an order, its lines are the boxes


def _boxes(spark, d):
    x0, y0 = F.col("l_quantity"), F.round(F.col("l_discount") * 100, 6)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n"), g.box(x0, y0, x0 + 10 + F.col("l_linenumber"), F.round(y0 + 5 + F.col("l_tax") * 100, 6)).alias("box"))


_BOX = "b as (select l_orderkey page, l_partkey k, l_linenumber n, l_quantity x0, round(l_discount * 100, 6) y0, l_quantity + 10 + l_linenumber x1, round(round(l_discount * 100, 6) + 5 + l_tax * 100, 6) y1 from lineitem)"
_INT = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"


@query(sql=f"""with {_BOX}, p as (select a.page, {_INT} i, {_AREA.format('a')} aa, {_AREA.format('b')} ab from b a join b on a.page = b.page and (a.n < b.n or (a.n = b.n and a.k < b.k)))
select page, count(*) pairs, round(max(case when aa + ab - i > 0 then i / (aa + ab - i) else 0 end), 6) best from p group by 1""")
def box_iou_pairs(spark, d):
    """For each page the pairs of its few boxes, and their highest overlap."""
    a = _boxes(spark, d)
    b = a.select("page", *[F.col(c).alias(f"_{c}") for c in ("k", "n", "box")])
    p = a.join(b, "page").where("n < _n or (n = _n and k < _k)")
    return p.groupBy("page").agg(F.count("*").alias("pairs"), F.round(F.max(g.iou("box", "_box")), 6).alias("best"))


@query(sql=f"""with {_BOX} select b.page, b.n, b.k, count(*) n_within from b a join b on a.page = b.page and (a.n <> b.n or a.k <> b.k) where {_INT} / {_AREA.format('b')} >= 0.8 group by 1, 2, 3""")
def containment_pairs(spark, d):
    a = _boxes(spark, d)
    o = a.select("page", *[F.col(c).alias(f"_{c}") for c in ("k", "n", "box")])
    p = a.join(o, "page").where("n <> _n or k <> _k").where(g.contains("_box", "box"))
    return p.groupBy("page", "n", "k").agg(F.count("*").alias("n_within"))


@query(sql=f"""with {_BOX} select a.page, a.n, a.k from b a where a.n > 2 and not exists (select 1 from b where b.n <= 2 and a.page = b.page and ({_INT} / {_AREA.format('a')} >= 0.08 or {_INT} / ({_AREA.format('a')} + {_AREA.format('b')} - {_INT}) >= 0.1))""")
def box_anti_overlap(spark, d):
    b = _boxes(spark, d)
    return layout.drop_covered_text(b.where("n > 2"), b.where("n <= 2"), ["page"]).select("page", "n", "k")


@query(sql="""with h as (select l_suppkey doc, round(l_tax * 100 + l_quantity, 1) h, min(l_orderkey) f, count(*) c from lineitem where l_tax * 100 + l_quantity between 5 and 50 group by 1, 2)
select s.doc, coalesce(arg_max(h, {'c': c, 'f': -f, 'h': -h}), 12.0)::double height from (select distinct l_suppkey doc from lineitem) s left join h on h.doc = s.doc group by 1""")
def modal_height(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_tax") * 100 + F.col("l_quantity")).alias("height"), F.col("l_orderkey").alias("seq"))
    return layout.modal_height(b, ["doc"])


@query(sql=f"with {_BOX} select page, n, k, row_number() over (partition by page order by y0, x0, n, k) place from b")
def reading_order_rank(spark, d):
    b = _boxes(spark, d).withColumn("item_seq", F.struct("n", "k"))
    return layout.reading_order(b, ["page"]).select("page", "n", "k", F.col("place").cast("long").alias("place"))


# layout texts


@query(sql=r"""with t as (select doc_id, coalesce(text, '') t from documents), c as (select doc_id, regexp_replace(t, '[""" + _WS + r"""]+', '', 'g') c, regexp_replace(coalesce(list_filter(list_transform(string_split(t, chr(10)), lambda x: """ + _strip("x") + r"""), lambda x: x <> '')[1], ''), '[""" + _WS + r"""]+', '', 'g') h from t)
select doc_id, case when regexp_matches(h, '^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]') or (contains(c, '조사우수사례') and contains(c, '평가보고서')) then null when starts_with(c, '법령') or starts_with(c, '예규') or starts_with(c, '판례') then 'law'
when (contains(c, '적출') and contains(c, '항목코드')) or starts_with(h, '개인') or starts_with(h, '법인') or (contains(h, '연번') and contains(h, '조사항목') and contains(h, '코드')) then 'yellow' else 'blue' end kind from c""")
def table_classify(spark, d):
    return table(spark, d, "documents").select("doc_id", layout.table_class("text").alias("kind"))


@query(sql=f"""with {_LW} select law_id, case when contains(t[1], '예규') then '예규' when contains(t[1], '판례') then '판례' else '법령' end law_type, {_strip("coalesce(t[2], '')")} law_name, {_strip("coalesce(array_to_string(t[3:], chr(10)), '')")} law_content
from (select law_id, string_split({_strip("concat_ws(chr(10), law_type, law_name, law_content)")}, chr(10)) t from lw where law_type in ('법령', '예규', '판례'))""")
def law_info(spark, d):
    t = records(spark, d, "law_references").where(F.col("law_type").isin(*layout.LAW_KINDS)).select("law_id", layout.law_parts(F.concat_ws("\n", "law_type", "law_name", "law_content")).alias("p"))
    return t.select("law_id", "p.law_type", "p.law_name", "p.law_content")


# index and search


@query(sql=f"with {_FI} select term, count(*) tf, finding_id id from (select finding_id, lower(unnest({_TOK.format('item')})) term from fi) group by 1, 3")
def postings(spark, d):
    return index.postings(records(spark, d, "findings"), "finding_id", ["item"]).select("term", "tf", "id")


@query(sql=f"with t as (select len({_TOK.format("coalesce(text, '')")}) dl from documents) select 'text' field, count(*) docs, round(avg(dl), 6) avgdl from t where dl > 0")
def field_stats(spark, d):
    return index.field_stats(table(spark, d, "documents"), "doc_id", ["text"]).withColumn("avgdl", F.round("avgdl", 6))


TERMS = ["세금계산서", "계좌", "warehouse", "원장"]


def _bm25_sql(table_sql: str, key: str, col: str, terms: list[str], name: str) -> str:
    ts = ", ".join(f"('{t}')" for t in terms)
    return f"""{name}_t as (select {key} id, list_transform({_TOK.format(f"coalesce({col}, '')")}, lambda x: lower(x)) l from {table_sql}), {name}_s as (select count(*) n, avg(len(l)) a from {name}_t where len(l) > 0),
{name}_q as (select id, term, len(list_filter(l, lambda x: x = term)) tf, len(l) dl from {name}_t, (values {ts}) v(term)), {name}_d as (select term, count(*) df from {name}_q where tf > 0 group by 1),
{name} as (select id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a)) part from {name}_q join {name}_d using (term), {name}_s where tf > 0)"""


@query(sql=f"with {_bm25_sql('documents', 'doc_id', 'text', TERMS, 'm')} select id, round(sum(part), 6) score from m group by 1 order by sum(part) desc, id limit 20")
def bm25_topk(spark, d):
    s = index.bm25(table(spark, d, "documents"), "doc_id", TERMS, {"text": 1.0})
    return retrieve.top(s, 20).withColumn("score", F.round("score", 6))


@query(sql=f"""with {_FI}, f as (select *, array_to_string(reason_kw_norm, ' ') reasons from fi), {_bm25_sql('f', 'finding_id', 'item', ['수수료', '매출'], 'a')}, {_bm25_sql('f', 'finding_id', 'item_detail', ['수수료', '매출'], 'b')}, {_bm25_sql('f', 'finding_id', 'reasons', ['수수료', '매출'], 'c')},
u as (select id, 2.0 * sum(part) s from a group by 1 union all select id, 0.5 * sum(part) from b group by 1 union all select id, sum(part) from c group by 1)
select id, round(max(s), 6) score from u group by 1""")
def multi_match_max(spark, d):
    f = records(spark, d, "findings").withColumn("reasons", F.array_join("reason_kw_norm", " "))
    return index.bm25(f, "finding_id", ["수수료", "매출"], {"item": 2.0, "item_detail": 0.5, "reasons": 1.0}).withColumn("score", F.round("score", 6))


@query(sql=f"with {_FI}, p as (select finding_id, lower(unnest({_TOK.format('item')})) term from fi), x as (select distinct * from p where term in ('수수료', '매출')), n as (select count(distinct finding_id) n from fi) select term, count(*) df from x group by 1")
def index_lookup(spark, d):
    """Document frequencies of query terms from the postings alone."""
    return index.term_stats(index.postings(records(spark, d, "findings"), "finding_id", ["item"])).where(F.col("term").isin("수수료", "매출")).select("term", "df")


_KD = f"""{_FI}, {_bm25_sql('fi', 'finding_id', 'item', ['매출', '보조금'], 'a')}, k as (select term, id, part, row_number() over (partition by term order by part desc, id) r from a),
kd as (select term, doc_id, max(part) score from k join fi on fi.finding_id = k.id where r <= 50 group by 1, 2), pd as (select doc_id, count(distinct term) t, max(score) s from kd group by 1)"""


def _keyword_docs(spark, d):
    return retrieve.keyword_documents(records(spark, d, "findings"), ["매출", "보조금"], "finding_id", "doc_id", {"item": 1.0})


@query(sql=f"with {_KD} select doc_id from pd where t >= 2 or not exists (select 1 from pd where t >= 2) qualify t >= 2 or row_number() over (order by s desc, doc_id) <= 30")
def keyword_docs_intersection(spark, d):
    return retrieve.document_set(_keyword_docs(spark, d), 2)


@query(sql=f"with {_KD} select doc_id from pd order by s desc, doc_id limit 30")
def union_fallback(spark, d):
    """The documents of any keyword, as taken when three keywords have none in common."""
    return retrieve.document_set(_keyword_docs(spark, d), 3)


@query(sql=f"with {_KD} select term, doc_id, round(score, 6) score from kd")
def keyword_documents(spark, d):
    return _keyword_docs(spark, d).withColumn("score", F.round("score", 6))


# a fixed query vector
QUERY_VECTOR = [round(((i * 37 + 11) % 64) / 64 - 0.5, 4) for i in range(64)]
_QV = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::double[]"
_COS = f"list_inner_product(v, {_QV}) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product({_QV}, {_QV})))"


@query(sql=f"with e as (select vec_id, embedding::double[] v from embeddings where len(embedding) = 64) select vec_id id, round({_COS}, 6) score from e where {_COS} >= 0.0 order by {_COS} desc, vec_id limit 20")
def vector_topk(spark, d):
    return retrieve.vector_top(table(spark, d, "embeddings"), QUERY_VECTOR, 20, "vec_id", "embedding", 0.0).withColumn("score", F.round("score", 6))


@query(sql=f"with e as (select vec_id, embedding::double[] v from embeddings where len(embedding) = 64 and label in (1, 2)) select vec_id id, round({_COS}, 6) score from e order by {_COS} desc, vec_id limit 10")
def vector_filtered(spark, d):
    e = table(spark, d, "embeddings").where(retrieve.conditions(within={"label": [1, 2]}))
    return retrieve.vector_top(e, QUERY_VECTOR, 10, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(sql="select vec_id, round(sqrt(list_inner_product(v, v)), 6) norm, round(v[1] / (sqrt(list_inner_product(v, v)) + 1e-12), 6) first from (select vec_id, embedding::double[] v from embeddings)")
def vector_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vx.norm("embedding"), 6).alias("norm"), F.round(vx.normalized("embedding")[0], 6).alias("first"))


_CV = "cv as (select * from chunks_vectors where chunk_id is not null qualify row_number() over (partition by chunk_id order by upserted_at desc nulls last) = 1), e as (select chunk_id, vector::double[] v from cv where len(vector) = 64), vs as (select chunk_id id, " + _COS + " score from e), vt as (select id, row_number() over (order by score desc, id) r1 from vs where score is not null and not isnan(score) and score >= 0.1 order by r1 limit 150)"
_HY = f"{_CH}, {_bm25_sql('ch', 'chunk_id', 'text', ['세금계산서', '계좌'], 'm')}, tt as (select id, row_number() over (order by sum(part) desc, id) r0 from m group by 1 order by r0 limit 150), {_CV}, fu as (select coalesce(tt.id, vt.id) id, coalesce(1.0 / (60 + r0), 0)::double + coalesce(1.0 / (60 + r1), 0)::double score, r0, r1 from tt full join vt on tt.id = vt.id)"


def _legs(spark, d):
    text = retrieve.top(index.bm25(table(spark, d, "chunks"), "chunk_id", ["세금계산서", "계좌"], {"text": 1.0}, at="created_at"), 150)
    return text, retrieve.vector_top(table(spark, d, "chunks_vectors"), QUERY_VECTOR, 150, "chunk_id", least=0.1, at="upserted_at")


@query(sql=f"with {_HY} select id, round(score, 6) score, r0::int r0, r1::int r1 from fu")
def rrf_fusion(spark, d):
    return retrieve.rrf(*_legs(spark, d)).withColumn("score", F.round("score", 6))


@query(sql=f"with {_HY}, o as (select * from fu order by score desc, r0 nulls last, r1 nulls last, id limit 100) select id, round(score, 6) score from o")
def hybrid_search(spark, d):
    s = retrieve.Hybrid({"text": 1.0}, 150, 150, 60, 0.1, 100)
    got = retrieve.hybrid_search(table(spark, d, "chunks"), "chunk_id", ["세금계산서", "계좌"], table(spark, d, "chunks_vectors"), "chunk_id", QUERY_VECTOR, s, at="created_at", vector_at="upserted_at")
    return got.select("id", F.round("score", 6).alias("score"))


@query(sql=f"with {_HY}, o as (select * from fu order by score desc, r0 nulls last, r1 nulls last, id limit 100) select id, round(score, 6) score from o where score >= 0.9 * (select max(score) from o)")
def relative_cutoff(spark, d):
    got = retrieve.fused_top(retrieve.rrf(*_legs(spark, d)), 100)
    return retrieve.relative_cut(got, 0.9).select("id", F.round("score", 6).alias("score"))


@query
def answer_context(spark, d):
    """From query words to a packed context, in one plan."""
    e = retrieve.Expansion(must=("매출",), related=("수수료",))
    return pipeline.answer_context(records(spark, d, "findings"), records(spark, d, "chunks"), ["매출"], e, {"조사착안": ["거래처", "원장"], "조사기법": ["전표", "계좌"]})


# ranking; a chunk's score is made of its lines and words, so that it is the same everywhere

_HITS = f"{_CH}, h as (select chunk_id, finding_id, doc_id, section, section_order, chunk_order, start_line, end_line, text, (abs(coalesce(end_line, 0) - coalesce(start_line, 0)) % 17)::double / 16 + (length(chunk_id) % 5)::double / 10 score from ch where finding_id is not null)"


def _hits(spark, d):
    score = F.abs(F.coalesce("end_line", F.lit(0)) - F.coalesce("start_line", F.lit(0))) % 17 / F.lit(16.0) + F.char_length("chunk_id") % 5 / F.lit(10.0)
    return records(spark, d, "chunks").where("finding_id is not null").withColumn("score", score)


@query(sql=f"with {_HITS}, b as (select *, row_number() over (partition by finding_id, section order by score desc, chunk_id) r from h) select finding_id, section, chunk_id, round(score, 6) score from b where r = 1")
def best_per_section(spark, d):
    return rank.best_per_section(_hits(spark, d)).select("finding_id", "section", "chunk_id", F.round("score", 6).alias("score"))


_BS = "b as (select *, row_number() over (partition by finding_id, section order by score desc, chunk_id) r from h), t as (select finding_id, doc_id, score, row_number() over (partition by finding_id order by score desc, chunk_id) q from b where r = 1), s as (select finding_id, avg(score) score from t where q <= 3 group by 1)"


@query(sql=f"with {_HITS}, {_BS} select finding_id, round(score, 6) score from s")
def block_scores(spark, d):
    return rank.block_scores(_hits(spark, d)).withColumn("score", F.round("score", 6))


@query(sql=f"""with {_HITS}, x as (select finding_id, max(score) filter (where section = '조사착안') s0, max(score) filter (where section = '조사기법') s1 from h where section in ('조사착안', '조사기법') group by 1)
select finding_id, round(0.5 * coalesce(s0, 0) + 0.5 * coalesce(s1, 0), 6) score from x where (s0 is not null and s1 is not null) or (select count(*) from x where s0 is not null and s1 is not null) < 2""")
def intersect_or_blend(spark, d):
    h = _hits(spark, d)
    a, b = (rank.block_scores(h.where(F.col("section") == s), k=1) for s in ("조사착안", "조사기법"))
    return rank.join_sections(a, b).select("finding_id", F.round("score", 6).alias("score"))


_AC = f"{_HITS}, {_BS}, o as (select s.finding_id, m.doc_id, round(s.score, 6) score from s join (select finding_id, min(doc_id) doc_id from h group by 1) m using (finding_id)), k as (select *, row_number() over (order by score desc, finding_id) rank from o), c as (select *, row_number() over (partition by doc_id order by rank) dd from k), n as (select *, sum(case when dd <= 1 then 1 else 0 end) over (order by rank) nn from c), z as (select *, dd <= 1 and nn <= 20 ok from n), l as (select max(rank) r from z where ok)"


def _accepted(spark, d):
    h = _hits(spark, d)
    docs = h.groupBy("finding_id").agg(F.min("doc_id").alias("doc_id"))
    best = rank.block_scores(h).join(docs, "finding_id").withColumn("score", F.round("score", 6))
    return rank.accept(best, per_doc=1, n=20)


@query(sql=f"with {_AC} select rank, doc_id, finding_id, score from z where ok")
def doc_cap_topn(spark, d):
    return _accepted(spark, d).where("accepted").select("rank", "doc_id", "finding_id", "score")


@query(sql=f"with {_AC} select doc_id, finding_id from z, l where not ok and (rank < r or (select count(*) from z where ok) < 20)")
def excluded_blocks(spark, d):
    return _accepted(spark, d).where("not accepted").select("doc_id", "finding_id")


@query(sql=f"""with {_CH}, u as (select * from ch where finding_id is not null and chunk_order is not null qualify row_number() over (partition by finding_id, section, chunk_order order by chunk_id) = 1),
i as (select *, chunk_order - row_number() over (partition by finding_id, section order by chunk_order) g from u)
select finding_id, section, min(chunk_order)::int first_order, count(*)::int n, arg_min(start_line, chunk_order) start_line, sum(length(text))::bigint + count(*) - 1 n_chars from i where section is not null group by finding_id, section, g""")
def merge_adjacent(spark, d):
    c = store.first_wins(records(spark, d, "chunks").where("finding_id is not null and chunk_order is not null and section is not null"), ["finding_id", "section", "chunk_order"], ["chunk_id"])
    return rank.merge_adjacent(c).select("finding_id", "section", "first_order", "n", "start_line", F.char_length("text").cast("long").alias("n_chars"))


@query(sql=f"""with {_CH}, p as (select doc_id, chunk_id, floor(coalesce(length(text), 0) / 4)::bigint c, row_number() over (partition by doc_id order by chunk_id) seq, sum(floor(coalesce(length(text), 0) / 4)::bigint) over (partition by doc_id order by chunk_id rows unbounded preceding) s from ch where doc_id is not null)
select doc_id, chunk_id, c::bigint cost, seq::int seq, s::bigint spent from p where s - c < 4000""")
def token_budget_pack(spark, d):
    """A context for every report, of its chunks in order."""
    return rank.pack_context(records(spark, d, "chunks").where("doc_id is not null"), "doc_id", ["chunk_id"]).select("doc_id", "chunk_id", "cost", "seq", "spent")


@query(sql=f"with {_CH}, r as (select *, row_number() over (partition by finding_id order by section_order, chunk_order, chunk_id) r from ch where finding_id is not null) select finding_id, chunk_id, coalesce(page::varchar, '-') page, start_line from r where r = 1")
def citations_distinct(spark, d):
    c = records(spark, d, "chunks").where("finding_id is not null")
    first = rank.references(c, [F.col(x).asc_nulls_last() for x in ("section_order", "chunk_order", "chunk_id")])
    return rank.citations(first).select("finding_id", "chunk_id", "page", "start_line")


@query(sql=f"with {_CH}, r as (select *, row_number() over (partition by finding_id, section order by section_order, chunk_order, chunk_id) r from ch where finding_id is not null) select chunk_id, case section when '조사기법' then 1 when '과세논리' then 2 when '증빙 및 리스크' then 3 when '조사착안' then 4 else 99 end place from r where r <= 3")
def first_section_chunks(spark, d):
    c = records(spark, d, "chunks").where("finding_id is not null")
    return rank.first_chunks(c).select("chunk_id", rank.section_place("section").alias("place"))


_REL = f"{_HITS}, q as (select doc_id query, (length(chunk_id) + coalesce(chunk_order, 0)) % 4 rel, row_number() over (partition by doc_id order by score desc, chunk_id) rank from h where doc_id is not null)"


def _ranked(spark, d):
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id"))
    return _hits(spark, d).where("doc_id is not null").select(F.col("doc_id").alias("query"), ((F.char_length("chunk_id") + F.coalesce("chunk_order", F.lit(0))) % 4).alias("rel"), r.alias("rank"))


@query(sql=f"with {_REL}, i as (select *, row_number() over (partition by query order by rel desc, rank) i from q) select query, round(coalesce(sum(case when rank <= 10 then rel / log2(rank + 1) end) / nullif(sum(case when i <= 10 then rel / log2(i + 1) end), 0), 0), 6) ndcg from i group by 1")
def ndcg_at_10(spark, d):
    return rank.ndcg_at(_ranked(spark, d)).withColumn("ndcg", F.round("ndcg", 6))


@query(sql=f"with {_REL} select query, max(case when rank <= 3 and rel > 2 then 1 else 0 end)::int hit from q group by 1")
def hit_at_k(spark, d):
    return rank.hit_at(_ranked(spark, d).withColumn("rel", F.when(F.col("rel") > 2, 1).otherwise(0)), 3)


@query(sql=f"with {_HITS}, x as (select doc_id, finding_id, count(distinct section) filter (where section in ('조사착안', '조사기법')) c from h where doc_id is not null group by 1, 2), p as (select doc_id, count(*) filter (where c = 2) n from x group by 1) select round(avg(case when n >= 2 then 1.0 else 0.0 end), 6)::double rate from p")
def intersection_rate(spark, d):
    h = _hits(spark, d).where("doc_id is not null")
    both = h.groupBy(F.col("doc_id").alias("query"), "finding_id").agg((F.count_distinct(F.when(F.col("section").isin("조사착안", "조사기법"), F.col("section"))) == 2).alias("both"))
    return rank.common_rate(both).withColumn("rate", F.round("rate", 6))


# stores and streams


@query(sql="""with b as (select * from (select *, 0 seq from orders where o_orderkey % 2 = 0 union all select *, 1 from orders where o_orderkey % 4 = 0)), n as (select o_orderkey, round(o_totalprice + case when seq = 0 then 1 else 9 end, 2) p, row_number() over (partition by o_orderkey order by seq, o_totalprice, o_custkey) r from b)
select o_orderkey, round(o_totalprice, 2) p from orders where o_orderkey % 3 <> 0 and o_orderkey % 2 <> 0 union all select o_orderkey, p from n where r = 1""")
def upsert_merge(spark, d):
    o = table(spark, d, "orders")
    batch = o.where("o_orderkey % 2 = 0").withColumn("seq", F.lit(0)).unionByName(o.where("o_orderkey % 4 = 0").withColumn("seq", F.lit(1)))
    batch = batch.select("o_orderkey", F.round(F.col("o_totalprice") + F.when(F.col("seq") == 0, 1).otherwise(9), 2).alias("p"), "seq", F.col("o_totalprice").alias("t"), "o_custkey")
    target = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.round("o_totalprice", 2).alias("p"))
    return store.merge(target, batch, ["o_orderkey"], ["seq", "t", "o_custkey"]).select("o_orderkey", "p")


@query(sql="select finding_id, min(chunk_id) chunk_id from chunks group by 1")
def dedup_first_wins(spark, d):
    return store.first_wins(table(spark, d, "chunks").select("finding_id", "chunk_id"), ["finding_id"], ["chunk_id"])


@query(sql="select c_custkey, c_name, null::int tier, null::varchar note from customer")
def schema_evolve(spark, d):
    return store.evolve(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), {"tier": "int", "note": "string", "c_name": "string"}, ["c_acctbal"])


@query(sql="select event_id, cast(json_extract_string(props, '$.k') as int) k, '{\"k\":' || json_extract_string(props, '$.k') || '}' again from events")
def json_roundtrip(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "struct<k:int>"))
    return e.select("event_id", "p.k", store.payload("p.k").alias("again"))


@query(sql=r"select distinct 'postgresql://u@' || replace(replace(doc_id, ' ', ''), '#', '') || '.example:' || (5000 + length(doc_id)) || '/db' dsn, replace(replace(doc_id, ' ', ''), '#', '') || '.example' host, (5000 + length(doc_id))::int port, 'db' as path from reports where regexp_matches(doc_id, '^[A-Za-z0-9-]+$')")
def dsn_parse(spark, d):
    r = table(spark, d, "reports").where("doc_id rlike '^[A-Za-z0-9-]+$'").select(F.concat(F.lit("postgresql://u@"), "doc_id", F.lit(".example:"), (F.lit(5000) + F.char_length("doc_id")).cast("string"), F.lit("/db")).alias("dsn")).distinct()
    return r.select("dsn", files.dsn_columns("dsn").alias("p")).select("dsn", "p.host", "p.port", "p.path")


@query(sql=f"""with {_FI}, k as (select finding_id, {_strip('item_detail')} t, coalesce(array_to_string(reason_kw_norm[1:6], ', '), '') w from fi) select finding_id, concat_ws(chr(10), nullif(t, ''), case when w <> '' then '핵심키워드: ' || w end) text from k""")
def embedding_text(spark, d):
    return records(spark, d, "findings").select("finding_id", pipeline.embedding_text("finding").alias("text"))


@query(sql="select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def event_windows(spark, d):
    return ingest.event_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(sql="""with l as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end s from events), g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) i from l) select user_id, min(ts) as start, count(*) n from g group by user_id, i""")
def event_sessions(spark, d):
    return ingest.sessions(table(spark, d, "events"))


@query(sql="select c.chunk_id, c.finding_id from (select distinct chunk_id, finding_id from chunks) c where c.finding_id is not null and not exists (select 1 from findings f where f.finding_id = c.finding_id)")
def missing_parents(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "finding_id").where("finding_id is not null").distinct()
    return c.join(table(spark, d, "findings").select("finding_id"), "finding_id", "left_anti").select("chunk_id", "finding_id")


@query(sql=f"with {_CH}, {_RP} select ch.chunk_id, length(text)::int n_chars, rp.title from ch left join rp using (doc_id)")
def lookup_by_id(spark, d):
    c = records(spark, d, "chunks").select("chunk_id", "doc_id", F.char_length("text").alias("n_chars"))
    return files.by_id(records(spark, d, "reports"), c, "doc_id", ["title"]).select("chunk_id", "n_chars", "title")


# further boxes, lines and texts


@query(sql=f"with {_BOX} select page, n, k, case when x1 - x0 < 30 then least(600 - 10, floor(600 * 0.8))::double else x1 end x1, round(x0 * 0.5, 6) half, (x1 - x0) * (y1 - y0) >= 600 and (x1 - x0) * (y1 - y0) <= 114000 and greatest(x1 - x0, y1 - y0) < least(x1 - x0, y1 - y0) * 50 and y1 - y0 >= 6 plausible, y1 - y0 >= 9 tall from b")
def box_expand_filter(spark, d):
    """Narrow boxes widened, boxes scaled, and which are plausible regions of a page of 600 by 200."""
    b = _boxes(spark, d)
    return b.select("page", "n", "k", g.widened("box", F.lit(600.0), narrow=30)["x1"].alias("x1"), F.round(g.scaled("box", 0.5)["x0"], 6).alias("half"), layout.plausible_region("box", F.lit(120000.0), height=6.0).alias("plausible"), layout.tall_enough("box", 9.0).alias("tall"))


@query(sql=f"with {_BOX}, c as (select page, n, k, greatest(0, round_even(x0 * 2, 0))::int x0, greatest(0, round_even(y0 * 2, 0))::int y0, least(100, round_even(x1 * 2, 0))::int x1, least(30, round_even(y1 * 2, 0))::int y1 from b) select page, n, k, case when x1 > x0 and y1 > y0 then x0 end x0, case when x1 > x0 and y1 > y0 then y1 end y1, format('page_{{:03d}}/law_{{:03d}}.png', n, n) as name from c")
def crop_rectangles(spark, d):
    c = _boxes(spark, d).withColumn("c", g.crop("box", 2.0, F.lit(100), F.lit(30)))
    return c.select("page", "n", "k", "c.x0", "c.y1", layout.crop_name("law", "n", "n").alias("name"))


@query(sql=f"with {_BOX} select page, n, k, y1 > 15 * 0.9 and length(trim(l)) < 10 and regexp_matches(l, '[0-9]') footer, contains(c, '단위:') or contains(c, '원)') or (x0 > 60 * 0.7 and length(trim(l)) < 15 and regexp_matches(l, '[()]')) unit from (select *, ' (' || n || case when n = 3 then '원)' else '' end as l, '(' || n || case when n = 3 then '원)' else '' end as c from b)")
def noise_blocks(spark, d):
    b = _boxes(spark, d).withColumn("l", F.concat(F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 3, "원)").otherwise("")))
    return b.select("page", "n", "k", layout.is_footer("box", "l", F.lit(15.0)).alias("footer"), layout.is_unit_label("box", "l", F.lit(60.0)).alias("unit"))


@query(sql=f"""with {_BOX}, l as (select page, n, k, x0, x1, y0, y1 from b where n = 1), t as (select l.page, l.k, l.y0, l.y1, list_sort(list_distinct(list(b.y0) filter (where b.y0 is not null))) ys from l left join b on b.page = l.page and b.n > 1 and b.y0 >= l.y0 and b.y1 <= l.y1 group by l.page, l.k, l.y0, l.y1, l.x0, l.x1),
u as (select page, k, y0, y1, case when len(ys) > 1 then ys else [y0] end ys from t) select page, k, (i - 1)::int part, case when i = 1 then y0 else ys[i] end y0, case when i < len(ys) then ys[i + 1] else y1 end y1 from (select *, unnest(generate_series(1, len(ys))) i from u)""")
def law_box_slices(spark, d):
    b = _boxes(spark, d)
    laws = b.where("n = 1").select("page", "k", "box")
    blocks = b.where("n > 1").join(laws.select("page", "k").distinct().withColumnRenamed("k", "_k"), "page").select("page", F.col("_k").alias("k"), "box", F.lit("법령").alias("text"))
    s = layout.law_slices(laws, blocks, ["page", "k"])
    return s.select("page", "k", "part", F.col("box")["y0"].alias("y0"), F.col("box")["y1"].alias("y1"))


@query(sql=f"with {_CH} select chunk_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) part, case when contains(text, chr(10) || '## ') then string_split(text, chr(10) || '## ')[1] else substr(text, 1, 2000) end overview from ch where text is not null")
def lines_and_overview(spark, d):
    c = records(spark, d, "chunks").where("text is not null")
    return c.select("chunk_id", tx.lines_between("text", F.lit(2), F.lit(4)).alias("part"), parse.overview("text", "\n## ").alias("overview"))


@query(sql=r"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[가-힣]{2,}(?:은행|증권|보험|카드)') || regexp_extract_all(coalesce(text, ''), 'Lurano|Kymbra|Halvern')))[1:10], ',') names from documents")
def entity_names(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.entities("text", ["[가-힣]{2,}(?:은행|증권|보험|카드)", "Lurano|Kymbra|Halvern"]), ",").alias("names"))


@query(sql="select kind, label, pattern from (values " + ", ".join(f"('tags', '{k}', '{p}')" for k, v in TAGS.items() for p in (k, *v)) + ") v(kind, label, pattern)")
def vocabulary_long(spark, d):
    return meta.vocabulary_table(spark, {"tags": TAGS})


@query(sql=f"with {_CH} select chunk_id, case when contains(text, '계좌') and contains(text, '원장') then 'full' when contains(text, '계좌') or contains(text, '원장') then 'partial' else 'none' end m from ch")
def block_keyword_match(spark, d):
    return records(spark, d, "chunks").select("chunk_id", rank.match("text", ["계좌", "원장"]).alias("m"))


@query(sql=f"with {_CH} select chunk_id id, case when length(coalesce(text_norm, '')) < 10 then text else text_norm end as text from ch")
def text_backfill(spark, d):
    c = records(spark, d, "chunks")
    return retrieve.with_text(c.select(F.col("chunk_id").alias("id"), F.col("text_norm").alias("text")), c.select("chunk_id", "text", F.lit(None).cast("string").alias("text_norm"))).select("id", "text")


@query(sql=f"with {_AC}, x as (select z.doc_id, finding_id, score, row_number() over (partition by z.doc_id order by score desc, finding_id) b, count(*) over (partition by z.doc_id) c from z, l where not ok and (rank < r or (select count(*) from z where ok) < 20)), f as (select doc_id, max(c) c, row_number() over (order by -max(score), arg_min(finding_id, b)) o, string_agg(finding_id, ',' order by b) filter (where b <= 3) items from x group by 1) select doc_id, items, greatest(c - 3, 0) more from f where o <= 2")
def excluded_summary(spark, d):
    return rank.excluded_summary(_accepted(spark, d).where("not accepted")).withColumn("items", F.array_join("items", ","))


@query(sql=f"with {_FI} select count(*)::bigint as \"rows\" from fi")
def table_rows_count(spark, d):
    return records(spark, d, "findings").agg(F.count("*").alias("rows"))


@query(sql=f"with {_CV}, f as (select id, score, row_number() over (order by score desc, id) r from vs where score is not null and not isnan(score)) select id, round(score, 6) score from f where r <= 50")
def chunk_vector_topk(spark, d):
    return retrieve.vector_top(table(spark, d, "chunks_vectors").where("chunk_id is not null"), QUERY_VECTOR, 50, "chunk_id", at="upserted_at").withColumn("score", F.round("score", 6))
