"""Several values packed in one field: minimum-description-length choice of a dialect.

A dialect is a set of marks that part values, a set of quotes that protect them, and whether list marks are read. The
length of a field under a dialect is that of the dialect, of every mark, quote pair and list mark in it, and
of its values; a value costs the bits of its frequency in the whole table and its spelling shared among its
occurrences. Every field is parsed with the dialect of least length. The frequencies come from one parse a
field: first the parse of the shortest frame, then the one chosen with the frequencies so far.

What the rules below say without doubt is no matter of length. A parse that leaves a parting mark in a value, overlooks
a clear pair of quotes or a clear list mark would have to spell the field once more to say so, which no other parse
exceeds; it is left out before any frequency is known. So a dialect of one kind of mark wins where a field
holds that kind only, the dialect of all marks where it is mixed; frequencies decide where the rules leave several readings:
quotes that hold the same quote again, and a lone number with a bracket or stop inside a field.

The rules: marks of any script, tabs and line breaks (also as HTML tags) part values. Not so a mark between
two digits, anything inside quotes around a value, brackets within a value, ``%``, and a hyphen or full stop
without white space at its side. List marks part as well and belong to no value.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import materialize

_TAG = re.compile(r"<\s*/?\s*(?:br|p|div|li|tr|td)\b[^<>]*>", re.I)
_BREAK = frozenset("\t\n\r\x0b\x0c\x85  ")
_SPACE = re.compile(r"\s+")
# Quotes, the opening one before the closing one.
DOUBLE, SINGLE = '""＂＂', "''＇＇"
PRINTED = "“”„“‘’‚‘「」『』«»‹›《》〈〉｢｣"
_BRACKETS = dict(zip("([{（［｛〔【〖", ")]}）］｝〕】〗"))
_HYPHENS, _STOPS = frozenset("-‐‑‒–−－﹣"), frozenset(".．。｡")
_BULLETS = "•‣◦▪▫■□●○◆◇▶▷►※*∙·-–"
_SYMBOL_MARKS = frozenset("|｜¦<>=~^`+ㆍᆞ＋＝～＜＞∙⋅")
#: A list mark where a value begins; Hangul letters count singly, numbers not before another digit.
_LIST = re.compile(rf"(?:[{re.escape(_BULLETS)}](?=\s)|[{re.escape('•‣◦▪▫■□●○◆◇▶▷►※')}]|[①-⑳⑴-⒛㉠-㉻㈀-㈞❶-❿➀-➉]|[(（](?:\d{{1,3}}|[가-하ㄱ-ㅎ])[)）](?!\d)|(?:\d{{1,3}}|[가-하ㄱ-ㅎ])(?:[)）]|[.．](?=\s|[^\W\d_]))(?!\d))[.．)）]?\s*")
#: A list mark further on, after white space (circled ones anywhere).
_LATER = re.compile(r"(?:[①-⑳⑴-⒛㉠-㉻❶-❿➀-➉]|(?<=\s)(?:[(（](?:\d{1,3}|[가-하ㄱ-ㅎ])[)）](?=\s)|(?:\d{1,3}|[가-하ㄱ-ㅎ])[.)．）](?=\s)))\s*")


_MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "P") + "".join(sorted(_SYMBOL_MARKS))
_IS_MARK = frozenset(_MARKS)
_WHOLE = frozenset("%％﹪٪")
#: Where a value may end: at a mark or break, or at a later list mark.
_EVENT = re.compile("[" + re.escape(_MARKS + "".join(_BREAK)) + "]")
_LISTED = re.compile(rf"[{re.escape(_BULLETS)}①-⑳⑴-⒛㉠-㉻❶-❿➀-➉㈀-㈞]|[\d가-하ㄱ-ㅎ][.)．）]").search
_LATER_AT = re.compile(f"(?={_LATER.pattern})")

#: Kinds of marks; a dialect parts by one of them (and by breaks), or by all marks of any script.
KINDS = {"comma": ",，、﹐､", "semicolon": ";；﹔", "slash": "/／", "dot": "·ㆍ・･•‧∙⋅", "bar": "|｜¦", "break": "", "all": None}
QUOTES = {"all": DOUBLE + SINGLE + PRINTED, "double": DOUBLE + PRINTED, "single": SINGLE + PRINTED, "printed": PRINTED, "none": ""}


@dataclass(frozen=True)
class Dialect:
    kind: str  # of KINDS
    quotes: str  # of QUOTES
    lists: bool

    @property
    def marks(self) -> str | None:
        return KINDS[self.kind]


DIALECTS = tuple(Dialect(k, q, li) for q, li, k in product(QUOTES, (True, False), KINDS))
_NUMBER = {(d.kind, d.quotes, d.lists): i for i, d in enumerate(DIALECTS)}
_KIND_SETS = [(k, frozenset(m) | _BREAK) for k, m in KINDS.items() if m is not None]
FULL = DIALECTS[_NUMBER["all", "all", True]]  # all that the rules know
#: Bits of the choice of a dialect, of a mark in a dialect of one kind and of all kinds, of a pair of quotes, of a list mark.
_CHOICE = math.log2(len(DIALECTS))
ONE_KIND, ALL_KINDS, PAIR, LIST = 1.0, 6.0, 2.0, 3.0


@dataclass
class Parse:
    values: list[str] = field(default_factory=list)
    marks: set[str] = field(default_factory=set)  # that part
    n_marks: int = 0
    pairs: list[tuple[str, bool]] = field(default_factory=list)  # opening quote, and whether the pair is clear
    n_lists: int = 0
    left: bool = False  # a mark that parts by the rules is left in a value

    def bits(self, d: Dialect) -> float:
        """Length of the frame: the dialect, marks, pairs and list marks."""
        return _CHOICE + self.n_marks * (ALL_KINDS if d.marks is None else ONE_KIND) + len(self.pairs) * PAIR + self.n_lists * LIST


def _parts(s: str, i: int) -> bool:
    """Whether the rules let the character part values."""
    c = s[i]
    if c in _BREAK:
        return True
    if c not in _IS_MARK or c in _WHOLE:
        return False
    before, after = s[i - 1 : i], s[i + 1 : i + 2]
    if before.isdigit() and after.isdigit():
        return False
    return not ((c in _HYPHENS or c in _STOPS and c not in "。｡") and not before.isspace() and not after.isspace())


def _closing(s: str, i: int, quote: str, lists: bool) -> int:
    """Place of the quote that closes the one before i, or -1; it stands before a mark, a break or the end."""
    n = len(s)
    while 0 <= (q := s.find(quote, i)):
        back = 0
        while q - back - 1 >= i and s[q - back - 1] == "\\":
            back += 1
        if back % 2:
            i = q + 1
        elif quote in (DOUBLE + SINGLE) and s[q + 1 : q + 2] == quote:
            i = q + 2
        else:
            j = q + 1
            while j < n and s[j].isspace() and s[j] not in _BREAK:
                j += 1
            if j >= n or s[j] in _BREAK or s[j] in _IS_MARK or lists and _LATER.match(s, j):
                return q
            i = q + 1
    return -1


def _unquote(x: str, quote: str) -> str:
    x = x.replace("\\" + quote, quote)
    return x.replace(quote * 2, quote) if quote in (DOUBLE + SINGLE) else x


def read(text: str, d: Dialect) -> Parse:
    """The field by one dialect."""
    s = (_TAG.sub("\n", text) if "<" in text else text).strip()
    if len(s) > 1 and s[0] in "[［" and s[-1] in "]］":
        s = s[1:-1]
    quotes = QUOTES[d.quotes]
    opening = dict(zip(quotes[::2], quotes[1::2]))
    out, marks = Parse(), d.marks
    n, i = len(s), 0
    lists = {m.start() for m in _LATER_AT.finditer(s)} if d.lists and _LISTED(s) else set()
    events = [m.start() for m in _EVENT.finditer(s)]  # all places where something may happen, found once
    if lists:
        events = sorted({*events, *lists})
    at, last = 0, len(events)

    def add(x: str) -> None:
        x = _SPACE.sub(" ", x).strip()
        if x and x != "-":
            out.values.append(x)

    while i < n:
        # where a value begins
        while i < n and s[i].isspace():
            i += 1
        if d.lists and (m := _LIST.match(s, i)):
            out.n_lists += 1
            i = m.end()
            while i < n and s[i].isspace() and s[i] not in _BREAK:
                i += 1
        if i >= n:
            break
        if s[i] in opening:
            close = opening[s[i]]
            end = _closing(s, i + 1, close, d.lists)
            if end >= 0:
                bare = _unquote(s[i + 1 : end], close)
                held = s[i + 1 : end].replace("\\" + close, "").replace(close * 2, "")
                out.pairs.append((s[i], close not in held))
                add(bare)
                i = end + 1
                while i < n and s[i].isspace() and s[i] not in _BREAK:
                    i += 1
                if i < n and i not in lists:
                    out.n_marks += 1
                    out.marks.add(s[i])
                    out.left |= marks is not None and s[i] not in marks and s[i] not in _BREAK
                    i += 1  # the mark after the quote
                continue
        start = i
        while True:
            while at < last and events[at] < i:
                at += 1
            if at == last:
                i = n
                break
            i = events[at]
            c, later = s[i], i > start and i in lists
            if c in _BRACKETS and not later:
                end = s.find(_BRACKETS[c], i + 1)
                if end >= 0:
                    i = end + 1
                    continue
            if later:
                break
            if _parts(s, i):
                if marks is None or c in marks or c in _BREAK:
                    break
                out.left = True
            i += 1
        add(s[start:i])
        if i < n and not (i > start and i in lists):
            out.n_marks += 1
            out.marks.add(s[i])
            i += 1
    return out


def parse(text: str, d: Dialect = FULL) -> list[str]:
    """The values of a field by one dialect, trimmed; empty ones and ``-`` are left out, repeated ones stay."""
    return read(text, d).values


#: A list mark about which there is no doubt wherever it stands.
_CIRCLED = re.compile(r"[①-⑳⑴-⒛㉠-㉻❶-❿➀-➉]").search


def _lists_clear(text: str, p: Parse) -> bool:
    """Whether list marks are beyond doubt: circled ones, one at the front, or several; a lone number further on isn't."""
    s = _TAG.sub("\n", text).strip().lstrip("[［ ")
    return bool(p.n_lists > 1 or _CIRCLED(text) or _LIST.match(s))


#: Anything that could part a value or begin a list.
_SPECIAL = re.compile("[" + re.escape(_MARKS + "".join(_BREAK) + _BULLETS) + "①-⑳⑴-⒛㉠-㉻㈀-㈞❶-❿➀-➉]").search
_PLAIN = _NUMBER["comma", "all", False]


def readings(text: str) -> list[tuple[int, float, list[str]]]:
    """(dialect, bits of its frame, values) of the readings that the rules allow, each with its shortest dialect, shortest frame first.

    Dialects of one kind of mark are not run: where one covers all marks that part, it reads what the dialect of all marks reads,
    and where it doesn't it leaves a mark in a value, which the rules don't allow.
    """
    if not _SPECIAL(text):  # one value or none, whatever the dialect
        v = _SPACE.sub(" ", text).strip()
        return [(_PLAIN, _CHOICE, [v] if v else [])]
    listed = _LISTED(text)
    full = read(text, FULL)
    ignoring_lists = listed and full.n_lists and not _lists_clear(text, full)
    best: dict[tuple, tuple[float, int, list[str]]] = {}
    for lists in (True, False) if ignoring_lists else (True,) if listed else (False,):
        every = full if lists or not listed else read(text, Dialect("all", "all", False))
        clear = {q for q, sure in every.pairs if sure}
        doubt = any(not sure for _, sure in every.pairs)
        for name in QUOTES if doubt else ("all",):  # without doubtful pairs no other quotes read anything else
            if not clear <= set(QUOTES[name][::2]):
                continue  # overlooks a clear pair of quotes
            p = every if name == "all" else read(text, Dialect("all", name, lists))
            k = _NUMBER[next((k for k, m in _KIND_SETS if p.marks <= m), "all"), name, lists]
            got = (p.bits(DIALECTS[k]), k, p.values)
            key = tuple(p.values)
            if key not in best or got[:2] < best[key][:2]:
                best[key] = got
    return [(k, b, v) for b, k, v in sorted(best.values(), key=lambda x: x[:2])]


_READ = "tbl string, row_key string, elem int, s string, dialect int, vals array<string>, others array<struct<dialect:int,bits:double,vals:array<string>>>"
_OTHERS = pa.list_(pa.struct([("dialect", pa.int32()), ("bits", pa.float64()), ("vals", pa.list_(pa.string()))]))


def _read_all(fields: DataFrame) -> DataFrame:
    """Each field with its first reading; where there are several also the string and all of them."""
    names = [x.split()[0] for x in _READ.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list] = {}
        for b in batches:
            texts, got = b.column(3).to_pylist(), []
            for t in texts:
                p = memo.get(t)
                if p is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    p = memo[t] = readings(t)
                got.append(p)
            several = [len(p) > 1 for p in got]
            others = [[{"dialect": k, "bits": f, "vals": v} for k, f, v in p] if more else None for p, more in zip(got, several)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([t if more else None for t, more in zip(texts, several)], pa.string()), pa.array([p[0][0] for p in got], pa.int32()), pa.array([p[0][2] for p in got], pa.list_(pa.string())), pa.array(others, _OTHERS)],
                names=names,
            )

    return fields.select("tbl", "row_key", "elem", "s").mapInArrow(run, _READ)


def value_codes(counts: DataFrame, total: DataFrame) -> DataFrame:
    """``val``, ``bits``: code length of each value, from its share (``c``) of all values (``n``) and its spelling shared among its occurrences."""
    c = F.greatest(F.col("c"), F.lit(1))
    return counts.crossJoin(F.broadcast(total)).select("val", (F.log2(F.greatest(F.col("n"), F.lit(1)) / c) + 8.0 * (F.char_length("val") + 1) / c).alias("bits"))


def choose(read_: DataFrame, rounds: int = 2) -> DataFrame:
    """``s``, ``dialect``, ``vals``: for each string with several readings the one of least length (equal lengths: the first dialect).

    Frequencies are counted over one reading of every field of the table: of the first round the shortest frames, of the
    later ones those chosen in the round before.
    """
    several = read_.where("s is not null")
    each = several.groupBy("s").agg(F.count("*").alias("m"), F.first("others").alias("o"))  # equal strings have equal readings
    each = materialize(each.select("s", "m", F.posexplode("o").alias("i", "x")).select("s", "m", "i", "x.dialect", "x.bits", "x.vals"), "readings")
    words = each.select("s", "i", "m", F.explode("vals").alias("val"))
    wanted = words.select("val").distinct()
    # only the values of open fields need a code; they are counted inside the tasks before anything is shuffled
    sure = read_.where("s is null").select(F.explode("vals").alias("val")).groupBy("val").agg(F.count("*").alias("c"))
    total = read_.agg(F.coalesce(F.sum(F.size("vals")), F.lit(0)).alias("n"))
    sure = materialize(wanted.join(sure, "val", "left").select("val", F.coalesce("c", F.lit(0)).alias("c")), "value-counts")
    chosen = each.where("i = 0").select("s", "i")
    for _ in range(rounds):
        here = words.join(chosen, ["s", "i"], "left_semi").select("val", F.col("m").alias("c"))
        codes = value_codes(sure.unionByName(here).groupBy("val").agg(F.sum("c").alias("c")), total)
        spelt = words.select("s", "i", "val").join(codes, "val").groupBy("s", "i").agg(F.sum("bits").alias("v"))
        cost = each.select("s", "i", "dialect", "bits").join(spelt, ["s", "i"], "left").select("s", "i", "dialect", (F.col("bits") + F.coalesce("v", F.lit(0.0))).alias("cost"))
        chosen = cost.groupBy("s").agg(F.min(F.struct("cost", "dialect", "i")).alias("b")).select("s", F.col("b.i").alias("i"))
    return each.join(chosen, ["s", "i"], "left_semi").select("s", "dialect", "vals")


def unpack(fields: DataFrame) -> DataFrame:
    """Split packed fields. ``fields``: tbl, row_key, elem (place of the string in the field, from 0) and s.

    Returns ``tbl``, ``row_key``, ``pos`` (from 1, across the strings of the field), ``val`` and ``packed`` (whether a string of the field
    holds two values or more). Null strings and keys, and fields without a value, give no row; every (tbl,
    row_key, elem) is expected once. An empty table gives no rows.
    """
    read_ = materialize(_read_all(fields.where("row_key is not null and s is not null")), "fields")
    done = read_.where("s is null").select("tbl", "row_key", "elem", "vals")
    several = read_.where("s is not null").select("tbl", "row_key", "elem", "s")
    if not several.isEmpty():  # else there is nothing to choose
        done = done.unionByName(several.join(choose(read_).select("s", "vals"), "s").select("tbl", "row_key", "elem", "vals"))
    # one field's strings come together; what a field holds is bounded by its row
    rows = done.where("size(vals) > 0").groupBy("tbl", "row_key").agg(F.array_sort(F.collect_list(F.struct("elem", "vals"))).alias("e"))
    rows = rows.select("tbl", "row_key", F.flatten(F.transform("e", lambda x: x["vals"])).alias("vals"), F.exists("e", lambda x: F.size(x["vals"]) > 1).alias("packed"))
    return rows.select("tbl", "row_key", "packed", F.posexplode("vals").alias("p", "val")).select("tbl", "row_key", (F.col("p") + 1).alias("pos"), "val", "packed")


def dialects(fields: DataFrame) -> DataFrame:
    """``tbl``, ``row_key``, ``elem``, ``kind``, ``quotes``, ``lists``: the dialect each field is read with."""
    read_ = materialize(_read_all(fields.where("row_key is not null and s is not null")), "fields")
    got = read_.where("s is null").select("tbl", "row_key", "elem", "dialect")
    several = read_.where("s is not null").select("tbl", "row_key", "elem", "s")
    if not several.isEmpty():
        got = got.unionByName(several.join(choose(read_).select("s", "dialect"), "s").select("tbl", "row_key", "elem", "dialect"))
    names = F.array(*[F.struct(F.lit(d.kind).alias("kind"), F.lit(d.quotes).alias("quotes"), F.lit(d.lists).alias("lists")) for d in DIALECTS])
    return got.withColumn("d", F.get(names, F.col("dialect"))).select("tbl", "row_key", "elem", "d.kind", "d.quotes", "d.lists")


def latest(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """``key`` and ``value``, of several rows with a key the one with the latest ``at`` (then the greatest value)."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("row_key")).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))).alias("m")).select("row_key", F.col("m.v").alias("v"))


def reason_fields(table_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """The strings of the case reasons of table rows and findings."""
    a = latest(table_rows, "row_id", "reason_kw_raw", "ingested_at").select(F.lit("table_rows").alias("tbl"), "row_key", F.lit(0).alias("elem"), F.col("v").alias("s"))
    b = latest(findings, "finding_id", "reason_kw_norm", "ingested_at").select(F.lit("findings").alias("tbl"), "row_key", F.posexplode("v").alias("elem", "s"))
    return a.unionByName(b)


def reasons(table_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """The case reasons of table rows and findings, a row each; see :func:`unpack`."""
    return unpack(reason_fields(table_rows, findings))


__all__ = ["DIALECTS", "FULL", "Dialect", "choose", "dialects", "latest", "parse", "read", "readings", "reason_fields", "reasons", "unpack", "value_codes"]
