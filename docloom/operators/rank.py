"""From chunk hits to evidence blocks, a packed context, references and retrieval metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import ordered
from docloom.runtime import materialize

# The order in which sections come in a context; others come last.
SECTION_ORDER = {"조사기법": 1, "과세논리": 2, "증빙 및 리스크": 3, "조사착안": 4}


def best_per_section(hits: DataFrame, block: str = "finding_id", section: str = "section", key: str = "chunk_id") -> DataFrame:
    """The best hit of each section of each block; equal scores by key."""
    r = F.row_number().over(Window.partitionBy(block, section).orderBy(F.desc("score"), key))
    return hits.withColumn("_r", r).where("_r = 1").drop("_r")


def block_scores(hits: DataFrame, block: str = "finding_id", k: int = 3, key: str = "chunk_id") -> DataFrame:
    """``block``, ``score``: mean of the ``k`` best sections' scores."""
    r = F.row_number().over(Window.partitionBy(block).orderBy(F.desc("score"), key))
    return best_per_section(hits, block, key=key).withColumn("_r", r).where(F.col("_r") <= k).groupBy(block).agg(F.avg("score").alias("score"))


def join_sections(a: DataFrame, b: DataFrame, block: str = "finding_id", least: int = 2, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """``block``, ``score``, ``both``: blocks that both sections found if there are ``least`` of them, else blocks of either.

    The score is the weighted sum, a missing side counting 0. The number in common is an aggregate joined back, so
    nothing is collected.
    """
    x = a.select(block, F.col("score").alias("s0")).join(b.select(block, F.col("score").alias("s1")), block, "full")
    both = F.col("s0").isNotNull() & F.col("s1").isNotNull()
    n = x.agg(F.count_if(both).alias("n"))
    score = F.lit(weights[0]) * F.coalesce("s0", F.lit(0.0)) + F.lit(weights[1]) * F.coalesce("s1", F.lit(0.0))
    return x.crossJoin(F.broadcast(n)).where((F.col("n") < least) | both).select(block, score.alias("score"), both.alias("both"))


def keyword_roles(words: Sequence[str]) -> tuple[str | None, list[str]]:
    """Document-level keyword and block-level keywords: one keyword is a block's, of several the first is the document's."""
    return (None, list(words)) if len(words) < 2 else (words[0], list(words[1:]))


def match(text: Column | str, words: Sequence[str]) -> Column:
    """``full``, ``partial`` or ``none``: how many of the keywords are in the text; no keywords match fully."""
    t = F.col(text) if isinstance(text, str) else text
    if not words:
        return F.lit("full")
    n = reduce(lambda a, b: a + b, [F.coalesce(t.contains(w), F.lit(False)).cast("int") for w in words])
    return F.when(n == len(words), "full").when(n > 0, "partial").otherwise("none")


def accept(blocks: DataFrame, doc: str = "doc_id", key: str = "finding_id", per_doc: int = 2, n: int = 3) -> DataFrame:
    """The best ``n`` blocks with at most ``per_doc`` of a document, and the blocks passed over on the way to the last of them.

    Adds ``accepted`` and ``rank`` (among all blocks; null for the passed-over ones). If fewer than n could be
    accepted, all others count as passed over. Equal scores by key; blocks without a score stay out. No block list is
    sorted as a whole: documents are cut to their best, of which the best n are taken.
    """
    b = materialize(blocks.where(F.col("score").isNotNull()), "blocks")
    place = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))
    mine = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), key))
    best = b.withColumn("_d", mine).where(F.col("_d") <= per_doc).orderBy(F.desc("score"), key).limit(n)
    best = best.agg(F.array_sort(F.collect_list(place)).alias("_t"))  # one row of at most n places
    each = b.crossJoin(F.broadcast(best)).withColumn("_p", F.size(F.filter("_t", lambda t: t < place)))  # accepted blocks before this one
    per = each.groupBy("_p").agg(F.count("*").alias("c")).withColumn("_n", F.sum("c").over(Window.orderBy("_p")))  # at most n + 1 rows
    each = each.withColumn("accepted", F.array_contains(F.transform("_t", lambda t: t["k"]), F.col(key)))
    passed = (F.size("_t") < n) | (F.col("_p") < n)
    out = each.where((F.size("_t") > 0) & (F.col("accepted") | passed)).join(F.broadcast(per.select("_p", "_n")), "_p")
    return out.withColumn("rank", F.when(F.col("accepted"), F.col("_n"))).select(*b.columns, "accepted", "rank")


def keyword_block_counts(blocks: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """``word``, ``n``: in how many blocks each keyword occurs; ``blocks`` are those on the way to the last accepted one."""
    names = [f"n{i}" for i in range(len(words))]
    one = blocks.agg(*[F.count_if(F.coalesce(F.col(text).contains(w), F.lit(False))).alias(n) for w, n in zip(words, names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(n).alias("n")) for w, n in zip(words, names)])).alias("x")).select("x.word", "x.n")


def blend(scores: Mapping[str, float]) -> Column:
    """Weighted sum of score columns, missing ones counting 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w)) for c, w in scores.items()], F.lit(0.0))


def merge_adjacent(chunks: DataFrame, block: str = "finding_id", pairs: bool = False) -> DataFrame:
    """Chunks of a block and section that follow each other joined by line breaks.

    Returns block, section, first_order, n, text, start_line, end_line. ``pairs`` joins at most two, as islands cut
    into twos; the default joins whole islands. Chunks of one order number are one.
    """
    w = Window.partitionBy(block, "section").orderBy("chunk_order")
    c = chunks.dropDuplicates([block, "section", "chunk_order"])
    c = c.withColumn("_i", F.col("chunk_order") - F.row_number().over(w))
    if pairs:
        c = c.withColumn("_p", F.floor((F.row_number().over(Window.partitionBy(block, "section", "_i").orderBy("chunk_order")) - 1) / 2))
    keys = [block, "section", "_i"] + (["_p"] if pairs else [])
    g = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk_order", "text", "start_line", "end_line"))).alias("m"))
    return g.select(
        block,
        "section",
        F.col("m")[0]["chunk_order"].alias("first_order"),
        F.size("m").alias("n"),
        F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"),
        F.col("m")[0]["start_line"].alias("start_line"),
        F.element_at("m", -1)["end_line"].alias("end_line"),
    )


def section_place(section: Column | str, order: Mapping[str, int] = SECTION_ORDER) -> Column:
    s = F.col(section) if isinstance(section, str) else section
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), s), F.lit(99))


def first_chunks(chunks: DataFrame, block: str = "finding_id", n: int = 3) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(block, "section").orderBy("section_order", "chunk_order", "chunk_id"))
    return chunks.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def pack_context(pieces: DataFrame, group: str, order: Sequence[str], budget: int = 4000, text: str = "text") -> DataFrame:
    """Pieces that fit a token budget (a fourth of their characters each), in order, with ``seq``, ``cost`` and ``spent``.

    A piece is kept while what came before it costs less than the budget. ``group`` is the question, so several
    contexts are packed at once; a group may hold any share of the rows. ``order`` should be total within a group.
    """
    p = pieces.withColumn("cost", F.floor(F.coalesce(F.char_length(text), F.lit(0)) / 4).cast("long"))
    p = ordered.running_sum(p, [group], order, "cost", "spent").where(F.col("spent") - F.col("cost") < budget)
    return p.withColumn("seq", F.row_number().over(Window.partitionBy(group).orderBy(*[F.col(c).asc_nulls_first() for c in order])))


def citations(pieces: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    return pieces.select("doc_id", "finding_id", chunk, F.coalesce(F.col("page").cast("string"), F.lit("-")).alias("page"), "start_line", "end_line", "section", "text")


def references(cited: DataFrame, order: Sequence[str], block: str = "finding_id") -> DataFrame:
    """The first citation of each block."""
    r = F.row_number().over(Window.partitionBy(block).orderBy(*order))
    return cited.withColumn("_r", r).where("_r = 1").drop("_r")


def excluded_summary(excluded: DataFrame, doc: str = "doc_id", key: str = "finding_id", docs: int = 2, blocks: int = 3) -> DataFrame:
    """``doc``, ``items``, ``more``: of the documents with the best blocks the first blocks, and how many more there are."""
    n = excluded.groupBy(doc).agg(F.count("*").alias("n"), F.min(F.struct((-F.col("score")).alias("s"), key)).alias("f")).orderBy("f").limit(docs)
    e = excluded.join(F.broadcast(n), doc).withColumn("_b", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), key))).where(F.col("_b") <= blocks)
    g = e.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_b", key))).alias("l"), F.first("n").alias("n"), F.first("f").alias("f"))
    return g.orderBy("f").select(doc, F.transform("l", lambda x: x[key]).alias("items"), F.greatest(F.col("n") - blocks, F.lit(0)).alias("more"))


def hit_at(ranked: DataFrame, k: int, query: str = "query", relevance: str = "rel") -> DataFrame:
    """``query``, ``hit``: 1 if one of the first ``k`` (column rank) is relevant."""
    return ranked.groupBy(query).agg(F.max(F.when((F.col("rank") <= k) & (F.col(relevance) > 0), 1).otherwise(0)).alias("hit"))


def ndcg_at(ranked: DataFrame, k: int = 10, query: str = "query", relevance: str = "rel") -> DataFrame:
    """``query``, ``ndcg``: discounted gain of the first ``k`` over that of the best order; 0 without any relevant row."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(relevance), "rank"))
    gain = lambda rank: F.sum(F.coalesce(relevance, F.lit(0)) / F.log2(F.col(rank) + 1.0))
    best = ranked.withColumn("_i", place).where(F.col("_i") <= k).groupBy(query).agg(gain("_i").alias("i"))  # k rows a query leave each task
    got = ranked.where(F.col("rank") <= k).groupBy(query).agg(gain("rank").alias("d"))
    return best.join(got, query, "left").select(query, F.when(F.col("i") > 0, F.coalesce("d", F.lit(0.0)) / F.col("i")).otherwise(F.lit(0.0)).alias("ndcg"))


def common_rate(pairs: DataFrame, query: str = "query", least: int = 2) -> DataFrame:
    """``rate``: share of queries whose two sections have ``least`` blocks in common (column both)."""
    n = pairs.groupBy(query).agg(F.count_if("both").alias("n"))
    return n.agg(F.avg(F.when(F.col("n") >= least, 1.0).otherwise(0.0)).alias("rate"))
