"""Text functions: Column in, Column out, all of them Catalyst built-ins.

Null text gives null, or an empty array where an array is returned. ``(?U)`` makes Java's classes Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[가-힣A-Za-z0-9]+"

# Words that are no keywords of a reason.
KEYWORD_STOPWORDS = ("및", "등", "관련", "경우", "대상", "처분", "금액", "손금", "누락", "과다", "산출", "계상", "인정", "부인", "미포함", "제외", "오류")

# What a masked number is replaced with, in this order.
MASKS = (
    (r"\d{6}-\d{7}", "[주민번호]"),
    (r"\d{3}-\d{2}-\d{5}", "[사업자번호]"),
    (r"\d{4}-\d{4}-\d{4}-\d{4}", "[카드번호]"),
    (r"\d{2,3}-\d{3,4}-\d{4}", "[전화번호]"),
)
# Abbreviations of query words.
ABBREVIATIONS = {"부가세": "부가가치세", "종소세": "종합소득세", "양도세": "양도소득세", "VAT": "부가가치세"}
# Words that a query loses anywhere, as whole words, and particles that it loses after Hangul.
COMPOUND_NOISE = ("적출사례", "조사사례", "적발사례", "세무조사", "세무사례")
WORD_NOISE = ("사례", "사건", "적발", "적출", "조사", "예시", "예제", "알려줘", "알려주세요", "찾아줘", "검색", "보여줘", "관련", "있어", "있나요", "있습니까", "케이스")
PARTICLES = ("시", "에", "의", "를", "을", "가", "이", "와", "과", "도")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end (Spark's trim takes blanks only)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def tokens(c: Column | str) -> Column:
    """Runs of Hangul, Latin letters and digits, in order."""
    return F.coalesce(F.regexp_extract_all(_col(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(tokens(c))


def words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two token arrays without repeats; 0 if either is empty or null."""
    a, b = _col(a), _col(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def set_cosine(a: Column | str, b: Column | str) -> Column:
    """Shared tokens over the geometric mean of both sizes; 0 if either is empty or null."""
    a, b = _col(a), _col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(F.lit(0.0))


def keywords(c: Column | str, stopwords: Sequence[str] = KEYWORD_STOPWORDS, least: int = 2, top: int = 6) -> Column:
    """The first ``top`` different tokens of at least ``least`` characters that are no stopwords, in order."""
    keep = F.filter(tokens(c), lambda t: (F.char_length(t) >= least) & ~t.isin(*stopwords) if stopwords else F.char_length(t) >= least)
    return F.slice(F.array_distinct(keep), 1, top)


def labels(c: Column | str, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Sorted labels of which the label itself or a synonym occurs in the text."""
    c = _col(c)

    def occurs(label: str) -> Column:
        return reduce(lambda x, y: x | y, [c.contains(p) for p in (label, *vocabulary[label])])

    return F.array_compact(F.array(*[F.when(occurs(k), F.lit(k)) for k in sorted(vocabulary)])) if vocabulary else F.array().cast("array<string>")


def first_case(c: Column | str, rules: Sequence[tuple], codes: Column | str | None = None) -> Column:
    """Struct (label, confidence) of the first rule all of whose groups have a member in the lower-cased text; else (null, 0).

    A rule is (groups, label, confidence), or has a prefix as well: then a code of the array ``codes`` that begins with it is a hit, too.
    """
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    kind = "struct<label:string,confidence:double>"
    out = F.struct(F.lit(None).alias("label"), F.lit(0.0).alias("confidence")).cast(kind)
    for groups, label, confidence, *prefix in reversed(rules):
        hit = reduce(lambda x, y: x & y, [reduce(lambda p, q: p | q, [low.contains(w) for w in g]) for g in groups])
        if prefix and codes is not None:
            hit = hit | F.coalesce(F.exists(_col(codes), lambda x: x.startswith(prefix[0])), F.lit(False))
        out = F.when(hit, F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence")).cast(kind)).otherwise(out)
    return out


def entities(c: Column | str, patterns: Sequence[str], top: int = 10) -> Column:
    """Different matches of the patterns, sorted, at most ``top`` of them."""
    found = F.flatten(F.array(*[F.regexp_extract_all(_col(c), F.lit(p), F.lit(0)) for p in patterns]))
    return F.slice(F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))), 1, top)


def mask_numbers(c: Column | str, masks: Sequence[tuple[str, str]] = MASKS) -> Column:
    """Personal numbers replaced, longest formats first."""
    c = _col(c)
    for pattern, name in masks:
        c = F.regexp_replace(c, rf"(?U)\b{pattern}\b", name)
    return c


def script_of(c: Column | str, share: float = 0.3) -> Column:
    """``ko`` if more than ``share`` of the word characters are Hangul syllables, ``unknown`` without any, else ``en``."""
    c = F.coalesce(_col(c), F.lit(""))
    hangul, letters = F.regexp_count(c, F.lit("[가-힣]")), F.regexp_count(c, F.lit(r"(?U)\w"))
    return F.when(letters == 0, "unknown").when(hangul > letters * F.lit(share), "ko").otherwise("en")


def plain_query(c: Column | str) -> Column:
    """White space squeezed, marks made blanks, lower case."""
    return strip(F.lower(F.regexp_replace(squeeze(c), r"(?U)[^\w\s가-힣]", " ")))


def expand_abbreviations(c: Column | str, table: Mapping[str, str] = ABBREVIATIONS) -> Column:
    c = _col(c)
    for short, long in table.items():
        c = F.regexp_replace(c, rf"(?iU)\b{short}\b", long)
    return c


def drop_noise(c: Column | str, compounds: Sequence[str] = COMPOUND_NOISE, noise: Sequence[str] = WORD_NOISE, particles: Sequence[str] = PARTICLES) -> Column:
    """A query without noise words, and without particles that stand after Hangul and before white space."""
    c = _col(c)
    if compounds:
        c = F.regexp_replace(c, "(?iU)" + "|".join(compounds), "")
    for w in noise:
        c = F.regexp_replace(c, rf"(?iU)\b{w}\b", "")
    for p in particles:
        c = F.regexp_replace(c, rf"(?U)(?<=[가-힣]){p}\s+", " ")
    return squeeze(c)


def preprocess_query(c: Column | str) -> Column:
    return drop_noise(expand_abbreviations(plain_query(mask_numbers(c))))


def plain_text(c: Column | str) -> Column:
    """Chunk text without page marks (``- 3 -``) and Markdown heads, with single blanks and no zero-width characters."""
    c = F.regexp_replace(_col(c), r"-\s*\d+\s*-", " ")
    c = F.regexp_replace(c, r"(?m)^#{1,6}\s*", "")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return strip(F.regexp_replace(c, "[​-‍﻿]", ""))


def bare_item(c: Column | str) -> Column:
    """An item without its leading list number; the item itself if nothing else is left."""
    c = _col(c)
    rest = strip(F.regexp_replace(c, r"(?U)^\s*\d+\s*[.)]\s*", ""))
    return F.when(rest != "", rest).otherwise(c)


def occurrences(c: Column | str, needle: str) -> Column:
    """How often a string occurs, without overlaps."""
    c = _col(c)
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int") if needle else F.lit(0)


def strip_tags(c: Column | str) -> Column:
    """Line-break tags made line breaks, other tags removed."""
    return strip(F.regexp_replace(F.regexp_replace(_col(c), r"(?i)<br\s*/?>", "\n"), "<[^>]+>", ""))


def text_hash(c: Column | str) -> Column:
    """First 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(_col(c), 256), 1, 16)


def uuid_of(c: Column | str) -> Column:
    """The MD5 of a string written as a UUID."""
    return F.regexp_replace(F.md5(_col(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def paragraphs(c: Column | str, separator: str = "\n\n") -> Column:
    return F.filter(F.split(_col(c), separator), lambda p: strip(p) != "")


def fixed_segments(paras: Column | str, most: int = 800) -> Column:
    """Paragraphs trimmed; those of more than ``most`` words cut after every ``most`` words."""

    def cut(p: Column) -> Column:
        w = words(p)
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(most)), lambda i: F.array_join(F.slice(w, i + 1, most), " "))
        return F.when(F.size(w) <= most, F.array(strip(p))).otherwise(parts)

    return F.filter(F.flatten(F.transform(_col(paras), cut)), lambda s: s != "")


def lines_between(c: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines ``start`` to ``end`` of a text (from 1, both included); empty outside of it."""
    return joined_lines(F.split(_col(c), "\n"), start, end)


def joined_lines(lines: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines ``start`` to ``end`` of an array of lines, as :func:`lines_between` has them of a text."""
    start, end = F.greatest(_col(start), F.lit(1)), _col(end)
    return F.array_join(F.slice(_col(lines), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it and however Spark merges projections."""
    return F.transform(F.array(value), body)[0]
