"""Cutting oversized texts and line spans into pieces, by content-defined chunking.

A gear hash rolls over the code points; where its lowest bits are zero lies a landmark. From the last cut
on, the first landmark between the least and the greatest size is taken and snapped to the nearest natural
boundary of that window (end of a paragraph, line or sentence; else a gap between words; else the landmark itself). Where
the window holds no landmark, its last natural boundary is cut at. A cut depends only on the text near it
and on the cut before, so an edit changes the pieces around it and the later cuts fall into step again. No piece's own
part but the last is below the least size.

Spans of lines are cut likewise: where the lines' text is given, a line whose hash has its lowest bits zero is a landmark, and
blank lines and lines before a heading are natural boundaries. Where it isn't, all lines are alike: then cuts lie at fixed
distances from the span's first line, so that lines that come or go above it move none, and snap to the sections that begin in it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Unicode's White_Space property, as a character class for Java and Python.
SPACE = "\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = regex.compile(f"[^{SPACE}]+")
PARAGRAPH = regex.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*| ")
LINE = regex.compile(r"\r\n?|\n| |\u0085|<br\s*/?>", regex.I)
#: A sentence ends after its stop and closing marks; a Latin full stop only before white space, the end or an Asian letter.
SENTENCE = regex.compile(r"[。！？｡．]+[\p{Pe}\p{Pf}\"']*\s*|[.!?]+[\p{Pe}\p{Pf}\"']*(?:\s+|(?=[\p{Hangul}\p{Han}\p{Hiragana}\p{Katakana}]))")


@dataclass(frozen=True)
class Limits:
    words: int = 800
    chars: int = 6000
    overlap_words: int = 50
    overlap_chars: int = 300
    least_words: int = 300  # no landmark is looked for before so many words or characters
    least_chars: int = 2400
    landmark_bits: int = 9


def _gear(codes: np.ndarray, span: int = 32) -> np.ndarray:
    """At each position a hash of the ``span`` code points that end there."""
    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        out, step = z.copy(), 1
        while step < span:  # doubling: the hash of 2n code points from two hashes of n
            out[step:] = out[step:] + out[:-step] * np.uint64(pow(3, step, 2**64))
            step *= 2
        return out


def is_oversized(text: str, limits: Limits = Limits()) -> bool:
    return len(text) > limits.chars or sum(1 for _ in WORD.finditer(text)) > limits.words


def cut_points(text: str, limits: Limits = Limits()) -> list[int]:
    """Ends of the pieces' own parts (without overlaps), the last one the length of the text."""
    n = len(text)
    starts = np.zeros(n + 1, np.int32)
    inside = np.zeros(n + 1, bool)
    for m in WORD.finditer(text):
        starts[m.start() + 1] = 1
        inside[m.start() + 1 : m.end()] = True
    count = np.cumsum(starts)  # words that start before a position
    natural = np.unique(np.array([m.end() for p in (PARAGRAPH, LINE, SENTENCE) for m in p.finditer(text)] + [0], np.int64))
    gaps = np.flatnonzero(starts[1:])  # a word starts here
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = _gear(codes)
    marks = np.flatnonzero((mixed >> np.uint64(40)) & np.uint64((1 << limits.landmark_bits) - 1) == 0) + 1
    most_words, most_chars = limits.words - limits.overlap_words, limits.chars - limits.overlap_chars
    combining = regex.compile(r"\p{M}|‍")

    def reach(s: int, words: int, chars: int) -> int:
        """Farthest end with at most so many words and characters from s on."""
        have = count[s] - (1 if inside[s] else 0)
        e = int(np.searchsorted(count, have + words, "right")) - 1
        return min(n, s + chars, max(e, s + 1))

    def between(a: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return a[np.searchsorted(a, lo) : np.searchsorted(a, hi, "right")]

    cuts, s = [], 0
    while True:
        hi = reach(s, most_words, most_chars)
        if hi >= n:
            cuts.append(n)
            return cuts
        lo = max(s + 1, min(reach(s, limits.least_words, limits.least_chars), hi))
        mark = between(marks, lo, hi)
        goal = int(mark[0]) if len(mark) else hi
        for kind in (natural, gaps):
            near = between(kind, lo, hi)
            if len(near):
                e = int(near[np.abs(near - goal).argmin()])
                break
        else:
            e = goal
            while e > lo and e < n and combining.match(text[e]):
                e -= 1
        cuts.append(e)
        s = e


def pieces(text: str, limits: Limits = Limits()) -> list[tuple[int, int, int]]:
    """(start, own start, end) of each piece; a piece is text[start:end], of which text[start:own start] repeats the piece before."""
    out: list[tuple[int, int, int]] = []
    at = 0
    for end in cut_points(text, limits):
        start = at
        if out:
            before = text[out[-1][0] : at]
            words = [m.start() for m in WORD.finditer(before)]
            back = words[-limits.overlap_words] if len(words) >= limits.overlap_words else 0
            start = out[-1][0] + max(back, len(before) - limits.overlap_chars)
        out.append((start, at, end))
        at = end
    return out


PIECES = "row_key string, span_no int, piece_no int, start long, own_start long, end long, n_words int, n_chars int, text string"


def split_texts(df: DataFrame, key: str, text: str, order: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Pieces of every text over the limits, a row each: offsets in code points, sizes and the piece itself.

    Texts within the limits, null texts and null keys give no row. Rows with one key are one record: the one
    with the greatest ``order``, then the greatest text. Words are runs without Unicode white space.
    """
    src = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).cast("string").alias("t"), (F.col(order) if order else F.lit(0)).alias("o"))
    # words are only counted where a text is long enough to have too many
    words = F.size(F.regexp_extract_all("t", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    long = F.when(F.char_length("t") > limits.chars, True).when(F.char_length("t") > 2 * limits.words, words > limits.words).otherwise(False)
    src = src.where(F.col("row_key").isNotNull() & long).groupBy("row_key").agg(F.max(F.struct("o", "t")).alias("s")).select("row_key", "s.t")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = pieces(t, limits)
                for i in range(0, len(p), 1000):
                    part = p[i : i + 1000]
                    cut = [t[x:z] for x, _, z in part]
                    cols = [[k] * len(part), [0] * len(part), list(range(i + 1, i + 1 + len(part))), *map(list, zip(*part)), [len(WORD.findall(c)) for c in cut], [len(c) for c in cut], cut]
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return src.mapInArrow(run, PIECES)


def span_pieces(start: int, end: int, most: int = 120, overlap: int = 10, least: int = 60, marks: Sequence[int] = (), natural: Sequence[int] = ()) -> Iterator[tuple[int, int, int]]:
    """(first line, first own line, last line) of each piece of a span of lines.

    ``marks`` are the landmark lines and ``natural`` the lines after which a cut is natural, both in order.
    """
    at, before = start, None
    while True:
        first = at if before is None else max(before, at - overlap)
        hi = at + (most - overlap) - 1
        if hi >= end:
            yield first, at, end
            return
        lo = at + least - 1
        mark = bisect_left(marks, lo)
        goal = marks[mark] if mark < len(marks) and marks[mark] <= hi else hi
        near = natural[bisect_left(natural, lo) : bisect_right(natural, hi)]
        last = min(near, key=lambda x: (abs(x - goal), x)) if near else goal
        yield first, at, last
        before, at = first, last + 1


def line_marks(lines: DataFrame, key: str, line_no: str = "line_no", line: str = "line", bits: int = 5) -> DataFrame:
    """``row_key``, ``marks`` and ``natural`` (arrays of line numbers) of the lines of each key, by their text."""
    text = F.coalesce(F.trim(F.col(line)), F.lit(""))
    nxt = F.lead(text).over(Window.partitionBy(key).orderBy(line_no))
    one = lines.select(F.col(key).cast("string").alias("row_key"), F.col(line_no).cast("long").alias("n"), (text == "").alias("blank"), nxt.startswith("#").alias("last"), (F.pmod(F.xxhash64(text), F.lit(1 << bits)) == 0).alias("mark"))
    one = one.withColumns({"mark": F.col("mark") & ~F.col("blank"), "natural": F.col("blank") | F.coalesce("last", F.lit(False))}).where("row_key is not null and (mark or natural)")
    return one.groupBy("row_key").agg(F.array_sort(F.collect_list(F.when(F.col("mark"), F.col("n")))).alias("marks"), F.array_sort(F.collect_list(F.when(F.col("natural"), F.col("n")))).alias("natural"))


SPANS = "row_key string, span_no int, piece_no int, start long, own_start long, end long"


def split_spans(df: DataFrame, key: str, spans: str, most: int = 120, overlap: int = 10, lines: DataFrame | None = None) -> DataFrame:
    """Pieces of every span of more than ``most`` lines; ``span_no`` is its place in the array, from 1.

    ``lines`` (the key, line_no, line) are the texts of the lines of each key's document, where they are known. Spans without
    start or end, and those that end before they start, give no row, nor do null keys, arrays
    and spans. Repeated rows count once.
    """
    begins = F.array_sort(F.array_compact(F.transform(spans, lambda x: x["start_line"].cast("long") - 1)))  # a section may end before another begins
    src = df.select(F.col(key).cast("string").alias("row_key"), begins.alias("natural"), F.posexplode(spans).alias("i", "s")).where("row_key is not null")
    src = src.select("row_key", (F.col("i") + 1).alias("span_no"), F.col("s.start_line").cast("long").alias("a"), F.col("s.end_line").cast("long").alias("b"), "natural")
    src = src.where(F.col("b") - F.col("a") + 1 > most).distinct()
    if lines is not None:
        by = line_marks(lines, key).withColumnRenamed("natural", "more")
        none = F.array().cast("array<bigint>")
        both = F.array_sort(F.array_union("natural", F.coalesce("more", none)))
        src = src.join(by, "row_key", "left").select("row_key", "span_no", "a", "b", both.alias("natural"), F.coalesce("marks", none).alias("marks"))
    else:
        src = src.withColumn("marks", F.array().cast("array<bigint>"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SPANS.split(", ")])

        rows = []
        for b in batches:
            for k, no, x, y, natural, marks in zip(*(c.to_pylist() for c in b.columns)):
                for i, p in enumerate(span_pieces(x, y, most, overlap, most // 2, marks, natural), 1):
                    rows.append((k, no, i, *p))
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return src.mapInArrow(run, SPANS)


def split_all(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """Pieces of the oversized chunk texts and of the oversized section spans (whose text is null)."""
    a = split_texts(chunks, "chunk_id", "text", "created_at").withColumn("tbl", F.lit("chunks"))
    b = split_spans(findings, "finding_id", "section_spans").withColumn("tbl", F.lit("findings"))
    b = b.withColumns({"n_words": F.lit(None).cast("int"), "n_chars": F.lit(None).cast("int"), "text": F.lit(None).cast("string")})
    cols = ["tbl", *(x.split()[0] for x in PIECES.split(", "))]
    return a.select(cols).unionByName(b.select(cols))
