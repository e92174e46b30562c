"""Page layout: classifying boxes by their text, dropping what overlaps or is noise, laws, and Markdown from the items."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import geometry as g
from docloom.functions import text as tx

# Words by which table regions are told apart.
LAW_KINDS = ("법령", "예규", "판례")
ROMAN = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ"
REPORT_TITLE = ("조사우수사례", "평가보고서")
CASE_TERMS = ("적출", "항목코드")
CASE_PREFIXES = ("개인", "법인")
CASE_HEADER = ("연번", "조사항목", "코드")
UNIT_WORDS = ("단위:", "(단위", "백만원)", "천원)", "억원)", "원)", "(백만원", "(천원", "(억원")


def _any(words: Sequence[str], f) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | f(w)
    return out


def _all(words: Sequence[str], f) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & f(w)
    return out


def table_class(text: Column | str) -> Column:
    """``law``, ``yellow`` (case tables), ``blue`` (others), or null for headings and report titles that are no table."""
    t = F.coalesce(tx._col(text), F.lit(""))
    compact = F.regexp_replace(t, r"(?U)\s+", "")
    head = F.coalesce(F.get(F.filter(F.transform(F.split(t, "\n"), tx.strip), lambda x: x != ""), F.lit(0)), F.lit(""))
    head = F.regexp_replace(head, r"(?U)\s+", "")
    return (
        F.when(head.rlike(f"^[{ROMAN}]") | _all(REPORT_TITLE, compact.contains), F.lit(None).cast("string"))
        .when(_any(LAW_KINDS, compact.startswith), "law")
        .when(_all(CASE_TERMS, compact.contains) | _any(CASE_PREFIXES, head.startswith) | _all(CASE_HEADER, head.contains), "yellow")
        .otherwise("blue")
    )


def plausible_region(b: Column | str, page_area: Column | str, least: float = 0.005, most: float = 0.95, aspect: float = 50, height: float = 0.0) -> Column:
    """Whether a detected region is neither too small, too large, too thin nor too low."""
    b, page = tx._col(b), tx._col(page_area)
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    return (g.area(b) >= page * least) & (g.area(b) <= page * most) & (F.greatest(w, h) < F.least(w, h) * aspect) & (h >= height)


def tall_enough(b: Column | str, least: float = 24.0) -> Column:
    b = tx._col(b)
    return b["y1"] - b["y0"] >= least


def without_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], condition) -> DataFrame:
    """Rows of ``a`` (column box) that no row of ``b`` with equal keys overlaps by ``condition(a.box, b.box)``: an anti-join on the page, not over all boxes."""
    r = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("box").alias("_box"))
    on = condition(F.col("box"), F.col("_box"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(r, on, "left_anti")


def drop_covered_tables(tables: DataFrame, yellow: DataFrame, keys: Sequence[str], above: float = 0.9) -> DataFrame:
    return without_overlap(tables, yellow, keys, lambda a, b: g.iou(a, b) >= above)


def drop_covered_text(blocks: DataFrame, regions: DataFrame, keys: Sequence[str], overlap: float = 0.08, iou: float = 0.10) -> DataFrame:
    return without_overlap(blocks, regions, keys, lambda a, b: (g.overlap_ratio(a, b) >= overlap) | (g.iou(a, b) >= iou))


def is_footer(b: Column | str, text: Column | str, page_height: Column | str) -> Column:
    """Short text with a digit in the lowest tenth of the page."""
    t = tx.strip(text)
    return (tx._col(b)["y1"] > tx._col(page_height) * 0.9) & (F.char_length(t) < 10) & t.rlike(r"\d")


def is_unit_label(b: Column | str, text: Column | str, page_width: Column | str, tables: Column | str | None = None) -> Column:
    """Units of a table: by a word, or short text in brackets at the right, just above a table (or anywhere if none are given)."""
    b, t = tx._col(b), tx._col(text)
    compact = F.regexp_replace(t, r"(?U)\s+", "")
    right = (b["x0"] > tx._col(page_width) * 0.7) & (F.char_length(tx.strip(t)) < 15) & t.rlike(r"[()]")
    near = F.lit(True)
    if tables is not None:
        s = tx._col(tables)
        near = F.when(F.coalesce(F.size(s), F.lit(0)) > 0, F.exists(s, lambda x: (b["y1"] >= x["y0"] - 30) & (b["y1"] <= x["y0"]))).otherwise(True)
    return _any(UNIT_WORDS, compact.contains) | (right & near)


def modal_height(blocks: DataFrame, keys: Sequence[str], height: str = "height", seq: str = "seq", least: float = 5, most: float = 50, default: float = 12.0) -> DataFrame:
    """``keys``, ``height``: the most frequent height to one decimal; of equally frequent ones the first seen, then the lower; ``default`` if none is plausible."""
    h = blocks.withColumn("_h", F.when(F.col(height).between(least, most), F.round(height, 1)))
    n = h.groupBy(*keys, "_h").agg(F.count("*").alias("c"), F.min(seq).alias("f"))
    best = n.groupBy(*keys).agg(F.max_by("_h", F.when(F.col("_h").isNotNull(), F.struct("c", (-F.col("f")).alias("f"), (-F.col("_h")).alias("h")))).alias("height"))
    return best.select(*keys, F.coalesce("height", F.lit(default)).alias("height"))


def law_slices(boxes: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Law boxes cut at each text block inside them that holds the word for a law: ``keys``, ``part``, ``box``.

    ``boxes``: keys, box; ``blocks``: keys, box, text. A box with fewer than two such blocks stays whole.
    """
    inside = boxes.select(*keys, F.col("box").alias("b")).join(blocks.where(F.col("text").contains(LAW_KINDS[0])).select(*keys, F.col("box").alias("t")), list(keys))
    inside = inside.where((F.col("t")["y0"] >= F.col("b")["y0"]) & (F.col("t")["y1"] <= F.col("b")["y1"]))
    tops = inside.groupBy(*keys, "b").agg(F.array_sort(F.collect_set(F.col("t")["y0"])).alias("ys"))
    cut = boxes.select(*keys, F.col("box").alias("b")).join(tops, [*keys, "b"], "left")
    ys = F.when(F.size("ys") > 1, F.col("ys")).otherwise(F.array(F.col("b")["y0"]))
    cut = cut.withColumn("ys", ys).select(*keys, "b", "ys", F.posexplode("ys").alias("part", "y"))
    y0 = F.when(F.col("part") == 0, F.col("b")["y0"]).otherwise(F.col("y"))
    y1 = F.coalesce(F.get("ys", F.col("part") + 1), F.col("b")["y1"])
    return cut.select(*keys, "part", g.box(F.col("b")["x0"], y0, F.col("b")["x1"], y1).alias("box"))


def law_parts(text: Column | str) -> Column:
    """Struct (law_type, law_name, law_content): kind from the first line, then the name's line, then the rest."""
    t = tx.strip(text)
    ls = F.split(t, "\n")
    first = F.coalesce(F.get(ls, F.lit(0)), F.lit(""))
    kind = F.when(first.contains(LAW_KINDS[1]), LAW_KINDS[1]).when(first.contains(LAW_KINDS[2]), LAW_KINDS[2]).otherwise(LAW_KINDS[0])
    skip = F.when(tx.strip(first).isin(*LAW_KINDS), 1).otherwise(0)
    name = tx.strip(F.coalesce(F.get(ls, skip), F.lit("")))
    rest = tx.strip(F.array_join(F.slice(ls, skip + 2, F.greatest(F.size(ls) - skip - 1, F.lit(0))), "\n"))
    return F.struct(kind.alias("law_type"), name.alias("law_name"), rest.alias("law_content"))


def reading_order(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("box")["y0"], F.col("box")["x0"], *[c for c in ("item_seq",) if c in items.columns]))
    return items.withColumn("place", r)


def crop_name(prefix: str, page: Column | str, n: Column | str) -> Column:
    return F.format_string(f"page_%03d/{prefix}_%03d.png", tx._col(page), tx._col(n))


# ---- text of a table region to a Markdown table; a pure function of the text, so one Arrow function

_NUMERAL = re.compile("[①-⑳]")


def _pipe(cells: Sequence[str]) -> str:
    return "| " + " | ".join(cells) + " |"


def _grid(header: Sequence[str], rows: Sequence[Sequence[str]], notes: Sequence[str] | None = None) -> str:
    width = max([len(header), *map(len, rows)]) if rows else len(header)
    pad = lambda r: [*r, *[""] * (width - len(r))]
    body = [_pipe(pad(r)) + (notes[i] if notes and notes[i] else "") for i, r in enumerate(rows)]
    return "\n".join([_pipe(pad(header)), "|" + " --- |" * width, *body])


def _case_table(rows: list[list[str]]) -> str:
    left, right = [], []
    for r in rows:
        a, rest = re.sub(r"^v\s*", "", r[0]), r[1:]
        if not a.replace(".", "").isdigit():
            left.append(a)
        right += rest
    return "\n".join(["| | |", "|---|---|", _pipe([left[0] if left else "", "<br>".join([*right, *left[1:]])])])


def _numbered(rows: list[str], doc_id: str | None) -> str:
    words = " ".join(rows).split()
    start = next(i for i, w in enumerate(words) if _NUMERAL.match(w))
    header = words[:4] if start >= 4 else ["연번", "조사항목", "코드", "적출요지"]
    groups: list[list[str]] = []
    for w in words[start:]:
        if _NUMERAL.match(w):
            groups.append([w])
        else:
            groups[-1].append(w)
    out = []
    for gr in groups:
        head, rest = (gr[0][0], [gr[0][1:], *gr[1:]]) if len(gr[0]) > 1 else (gr[0], gr[1:])
        rest = [w for w in rest if w]
        at = next((i for i, w in enumerate(rest) if re.fullmatch(r"\d{3,6}", w)), len(rest))
        out.append([head, " ".join(rest[:at]), rest[at] if at < len(rest) else "", " ".join(rest[at + 1 :])])
    return _grid(header, out, _anchors(header, out, doc_id))


def _anchors(header: Sequence[str], rows: Sequence[Sequence[str]], doc_id: str | None) -> list[str] | None:
    if doc_id is None or [h.replace(" ", "") for h in header[:3]] != list(CASE_HEADER):
        return None
    out, n = [], 0
    for r in rows:
        named = len(r) > 1 and r[1].strip()
        n += bool(named)
        out.append(f" <!-- row_id: {doc_id}#R{n} -->" if named else "")
    return out


def _columns(cells: list[str]) -> int | None:
    """Number of columns in which single cells make the likeliest table: many cells, a header of words, data with figures."""

    def figure(x: str) -> bool:
        return bool(re.search(r"\d", x))

    best, top = None, -1
    for c in range(2, min(12, len(cells)) + 1):
        if len(cells) % c or len(cells) // c < 2:
            continue
        score = len(cells) + sum(not figure(x) for x in cells[:c]) + sum(figure(x) for x in cells[c:])
        if score > top:
            best, top = c, score
    return best


def markdown_table(text: str | None, doc_id: str | None = None) -> str:
    """A region's text as a Markdown table; text that is none comes back as it is, null and blank text as an empty string."""
    rows = [[c for c in re.split(r"\s{2,}|\t", line.strip()) if c] for line in (text or "").splitlines() if line.strip()]
    if not rows:
        return ""
    if CASE_TERMS[0] in rows[0][0] and len(rows[0]) > 1:
        return _case_table(rows)
    if all(len(r) == 1 for r in rows):
        single = [r[0] for r in rows]
        if any(_NUMERAL.search(x) for x in single):
            return _numbered(single, doc_id) if any(_NUMERAL.match(w) for w in " ".join(single).split()) else text
        c = _columns(single)
        if c is None:
            return text
        rows = [single[i : i + c] for i in range(0, len(single), c)]
    return _grid(rows[0], rows[1:], _anchors(rows[0], rows[1:], doc_id))


@F.pandas_udf(T.StringType())
def as_markdown_table(text: pd.Series, doc_id: pd.Series) -> pd.Series:
    return pd.Series([markdown_table(t if isinstance(t, str) else None, d if isinstance(d, str) else None) for t, d in zip(text, doc_id)])


def major_items(tables: DataFrame) -> DataFrame:
    """``doc_id``, ``n``, ``item``, ``code`` from the first Markdown table of each document that has the three header words.

    ``tables``: doc_id, seq, md. Numerals are stripped; items that are figures or single characters are left out.
    """
    first = tables.where(_all(CASE_HEADER, F.col("md").contains)).groupBy("doc_id").agg(F.min_by("md", "seq").alias("md"))
    rows = first.select("doc_id", F.posexplode(F.split("md", "\n")).alias("i", "l")).where((F.col("i") >= 2) & F.col("l").contains("|"))
    cells = F.transform(F.split(F.regexp_replace(F.substring_index("l", "<!--", 1), r"^\s*\||\|\s*$", ""), r"\|"), tx.strip)
    rows = rows.withColumn("c", cells).where(F.size("c") >= 3)
    item = tx.strip(F.regexp_replace(F.get("c", F.lit(1)), "[①-⑳]", ""))  # rows with fewer cells may be read before they are left out
    rows = rows.select("doc_id", "i", item.alias("item"), F.get("c", F.lit(2)).alias("code")).where((F.char_length("item") > 1) & ~F.col("item").rlike(r"^\d+$"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")).alias("n"), "item", "code")


# ---- a document's items, in reading order, to Markdown

# What a paragraph ends with, and what an entry of a list begins with.
_ENDS = (".", "!", "?", "임", "음", "함")
_MARKS = ("-", "•", "○", "◦", "▪", "▫", "※", "◎", "●", "◆", "◇", "■", "□", "▲", "△", "▶", "▷", "*")
# Section titles and their Markdown heads.
TITLES = (("조사성과(결과)", "## Ⅰ.조사성과(결과)", False), ("조사노하우", "## Ⅱ.조사노하우", True))
HEADS = (("가.조사대상개요", "### 가. 조사대상개요"), ("나.적출성과", "### 나. 적출성과"))
STEPS = (("1. 조사착안", "#### 1. 조사착안"), ("2. 조사기법", "#### 2. 조사기법"))


def assemble(doc_id: str, items: Sequence[tuple[str, str]], majors: Sequence[tuple[str, str]]) -> str:
    """Markdown of one document; ``items`` are (type, text) in reading order, ``majors`` the (item, code) of its case tables."""
    items = [(k, (t or "").strip()) for k, t in items]
    items = [(k, t) for k, t in items if t or k == "law_table"]
    out, held = ["---", f'doc_id: "{doc_id}"', "---", ""], []
    tips, cases, laws, i = False, 0, 0, 0

    def put(*ls: str) -> None:
        flush()
        out.extend([*ls, ""])

    def flush() -> None:
        if held:
            out.extend([" ".join(held), ""])
            held.clear()

    while i < len(items):
        kind, t = items[i]
        nxt = items[i + 1][1] if i + 1 < len(items) else ""
        one, two = t.replace(" ", ""), (t + nxt).replace(" ", "")
        title = next((x for x in TITLES if t and t[0] in ROMAN and kind not in ("law_table", "yellow_table") and (x[0] in one or (len(one) <= 2 and x[0] in nxt.replace(" ", "")))), None)
        if title:
            put(title[1])
            i += 1 if title[0] in one else 2
            tips, cases = title[2], 0 if title[2] else cases
            continue
        head = next((h for h in HEADS if kind not in ("law_table", "yellow_table") and (h[0] in one or (len(one) <= 3 and two.startswith(h[0])))), None)
        if head:
            put(head[1])
            i += 1 if head[0] in one else 2
            continue
        if kind == "law_table":
            laws += 1
            put(f"[law_table#{laws}]")
        elif kind == "yellow_table":
            md = markdown_table(t, doc_id)
            if tips and md.startswith("| | |") and cases < len(majors):
                name, code = majors[cases]
                cases += 1
                put(f"### 적출 {cases}. {name} <!-- finding_id: {doc_id}#F{code}#F{cases} -->")
            put(md)
        elif step := next((s for p, s in STEPS if t.startswith(p)), None):
            put(step)
        elif t.startswith("<") and ">" in t:
            put(t)
        else:
            if t.startswith(_MARKS):
                flush()
            held.append(t)
            if t.endswith(_ENDS):
                flush()
        i += 1
    flush()
    return "\n".join(out)


def assemble_documents(items: DataFrame, majors: DataFrame) -> DataFrame:
    """``doc_id``, ``md`` from layout items (doc_id, page, box, type, content) and major items (doc_id, n, item, code).

    A document is one task's group: its length is bounded by what one file holds.
    """
    order = F.array_sort(F.collect_list(F.struct("page", F.col("box")["y0"].alias("y"), F.col("box")["x0"].alias("x"), F.coalesce("type", F.lit("")).alias("k"), F.coalesce("content", F.lit("")).alias("t"))))
    docs = items.where("doc_id is not null").groupBy("doc_id").agg(order.alias("items"))
    m = majors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "item", "code"))).alias("majors"))

    @F.pandas_udf("string")
    def build(d: pd.Series, its: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([assemble(a, [(x["k"], x["t"]) for x in b], [(x["item"], x["code"]) for x in c] if c is not None else []) for a, b, c in zip(d, its, ms)])

    return docs.join(m, "doc_id", "left").select("doc_id", build("doc_id", "items", "majors").alias("md"))
