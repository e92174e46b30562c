"""One form for texts that look the same but are written in other characters.

``relations`` says which two strings or code points look alike, each pair for itself: a code point and what Unicode says it is
made of (one step of its decomposition, canonical or of compatibility), two neighbours in a row of letters that look like a Latin one,
two kinds of blank, hyphen or middle dot, and a character that can't be seen and nothing. Union-find makes
the relation transitive, also inside strings: two strings are alike if their letters are. Of each class the member that is most
frequent in the corpus stands for all, and an Aho-Corasick automaton over the other members rewrites texts greedily, the leftmost
longest match first, until nothing changes. Two kinds of member can't stand for a class, as what they are part of would not come out
in one form: a sign for several letters (the letters stand for it), and a letter taken apart (marks compose as Unicode says).

Letter case, digits, ordinary spaces and line breaks keep making a difference.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import materialize

# Letters that look like the Latin letter before them.
LATIN_ALIKE = """
A АΑᎪꓮ  B ВΒᏴꓐ  C СϹᏟꓚ  D Ꭰꓓᗪ  E ЕΕᎬꓰ  F ꓝϜ  G ԌᏀꓖ  H НΗᎻꓧ  I ІΙӀꓲ  J ЈͿᎫꓙ  K КΚᏦꓗ  L ᏞꓡԼ
M МΜᎷꓟ  N Νꓠ  O ОΟՕꓳ  P РΡᏢꓑ  Q Ԛ  R Ꭱꓣ  S ЅՏᏚꓢ  T ТΤᎢꓔ  U Սꓴ  V ѴᏙꓦ  W ԜᎳꓪ  X ХΧꓫ  Y УΥҮꓬ  Z ΖᏃꓜ
a аαɑ  c сϲ  d ԁ  e еҽ  g ɡց  h һհ  i іιıᎥ  j јϳ  l ӏ  n ո  o оοօσ  p рρ  q ԛզ  s ѕꜱ  u υսʋ  v ѵν  w ԝ  x хχ  y уүγ
"""
# Characters that look like a hyphen, a middle dot, a blank.
HYPHENS = "-‐‑‒–⁃˗−﹘﹣－"
DOTS = "··ᐧ᛫•‧∙⋅⸱⸳・ㆍᆞꞏ･\U00010101"
BLANKS = "                　"
# Code points without a picture beside those of category Cf, as ranges.
INVISIBLE = [(0x00, 0x08), (0x0E, 0x1B), (0x7F, 0x84), (0x86, 0x9F), (0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
# Code points of category Cf that do have a picture, as ranges.
VISIBLE_CF = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]


def _in(c: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= c <= b for a, b in ranges)


@lru_cache(1)
def _rows() -> dict[str, str]:
    """Each look-alike with its neighbour in its row."""
    out = {}
    for row in (*(a + b for a, b in re.findall(r"(\S) (\S+)", LATIN_ALIKE)), HYPHENS, DOTS, BLANKS):
        for one, other in zip(row[1:], row):
            if one != other:
                out.setdefault(one, other)
    return out


def _unseen(x: str) -> bool:
    return _in(ord(x), INVISIBLE) or (unicodedata.category(x) == "Cf" and not _in(ord(x), VISIBLE_CF))


def _made_of(x: str) -> str:
    """One step of the decomposition of a code point; empty if it has none."""
    if "가" <= x <= "힣":
        d = unicodedata.normalize("NFD", x)
        return d if len(d) == 2 else unicodedata.normalize("NFC", d[:2]) + d[2]
    d = unicodedata.decomposition(x)
    return "".join(chr(int(h, 16)) for h in d.split() if h[0] != "<")


def _is_sign(x: str) -> bool:
    """Whether it is one code point that stands for several by compatibility."""
    return len(x) == 1 and len(unicodedata.normalize("NFKD", x)) > 1 and unicodedata.normalize("NFKC", x) != unicodedata.normalize("NFC", x)


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        out = defaultdict(list)
        for x in list(self.up):
            out[self.root(x)].append(x)
        return [sorted(g) for g in out.values() if len(g) > 1]


@lru_cache(1)
def _letters() -> list[tuple[str, str]]:
    """The code points that several compose to, each with these."""
    out = []
    for o in range(0xA0, 0x1D200):
        if 0x3400 <= o <= 0xABFF or 0xD7A4 <= o <= 0xF8FF:
            continue
        x = chr(o)
        if 0xAC00 <= o <= 0xD7A3 or unicodedata.decomposition(x)[:1] not in ("", "<"):
            nfd = unicodedata.normalize("NFD", x)
            if len(nfd) > 1 and unicodedata.normalize("NFC", nfd) == x:
                out.append((x, nfd))
    return out


def relations(seen: set[str]) -> Classes:
    """Look-alike classes of the code points in ``seen`` and of all that they are made of or compose to."""
    c, done, todo = Classes(), set(), sorted(seen)
    while todo:
        x = todo.pop()
        if x in done:
            continue
        done.add(x)
        c.root(x)
        near = [""] if _unseen(x) else [y for y in (_rows().get(x, ""), _made_of(x)) if y]
        for y in near:
            c.union(x, y)
            todo += [z for z in y if z not in done]
    # letters that compose of what is seen: a mark, or a Hangul vowel or final, after what it composes with
    marks = {m for m in done if unicodedata.combining(m) or "ᅡ" <= m <= "ᇂ"}
    if marks:
        for x, nfd in _letters():
            if not marks.isdisjoint(nfd[1:]) and all(m in marks or m < "ᅡ" for m in nfd[1:]):
                c.union(x, _made_of(x))
                c.union(x, nfd)
                if len(nfd) == 3:  # its marks in the other order
                    c.union(x, unicodedata.normalize("NFC", nfd[0] + nfd[2]) + nfd[1])
    return c


class Rewriter:
    """Rewrites texts to one form, given how often each code point occurs in the corpus."""

    def __init__(self, counts: dict[int, int]):
        total = max(1, sum(counts.values()))

        def frequency(s: str) -> tuple:
            """Occurrences, of a string those to expect of its code points; among equals the shorter, then the lower."""
            n = float(total)
            for x in s:
                n *= counts.get(ord(x), 0) / total
            return n, -len(s), [-ord(x) for x in s]

        self.to: dict[str, str] = {}
        classes = relations({chr(o) for o in counts})
        for g in classes.groups():  # classes of single code points
            if "" in g:
                self.to |= {x: "" for x in g if x}
            elif all(len(x) == 1 for x in g):
                best = max(g, key=frequency)
                self.to |= {x: best for x in g if x != best}

        def written(s: str) -> str:
            return unicodedata.normalize("NFC", "".join(self.to.get(x, x) for x in s))

        for x in [x for x in classes.up if len(x) > 1]:  # strings whose letters are alike are alike
            classes.union(x, "".join(self.to.get(y, y) for y in x))
            classes.union(x, written(x))
        for g in sorted(classes.groups(), key=lambda g: (max(len(unicodedata.normalize("NFD", x)) for x in g), g)):
            if "" in g or all(len(x) == 1 for x in g):
                continue
            forms = {w for x in g if not _is_sign(x) for w in (written(x), x if len(x) == 1 else written(x))}
            best = max((w for w in forms if written(w) == w), key=frequency, default=None) or max(forms, key=frequency)
            self.to |= {x: best for x in {*g, *forms} if x != best}
        self.auto = ahocorasick.Automaton()
        for x, y in self.to.items():
            self.auto.add_word(x, (len(x), y))
        if self.to:
            self.auto.make_automaton()
        # a text without any of these has no match
        last = sorted({x[-1] for x in self.to})
        self.some = re.compile("[" + "".join(map(re.escape, last)) + "]").search if last else lambda t: None
        # more than one mark on a letter may stand in any order
        mark = "[̀-ͯ҃-֑҇-ֽً-ٟ᪰-᫿᷀-᷿⃐-゙゚⃰︠-︯]"
        self.marks = re.compile(f"{mark}{{2}}|[À-ɏͰ-ӿḀ-῿]{mark}").search

    def __call__(self, text: str) -> str:
        if not self.some(text):
            return text
        for _ in range(len(text) + 1):
            if self.marks(text):
                text = unicodedata.normalize("NFC", text)
            out, at = [], 0
            for end, (n, y) in self.auto.iter_long(text):
                out.append(text[at : end + 1 - n])
                out.append(y)
                at = end + 1
            if not out:
                return text
            out.append(text[at:])
            new = "".join(out)
            if new == text or not self.some(new):
                return new
            text = new
        return text


def code_points(dfs: list[tuple[DataFrame, str]]) -> dict[int, int]:
    """How often each code point occurs in the given columns: at most as many entries as Unicode has code points."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = defaultdict(int)
        for b in batches:
            texts = b.column(0).drop_null().to_pylist()
            for i in range(0, len(texts), 256):
                u = np.frombuffer("".join(texts[i : i + 256]).encode("utf-32-le", "surrogatepass"), np.uint32)
                if len(u):
                    n = np.bincount(u)
                    for c in np.flatnonzero(n).tolist():
                        total[c] += int(n[c])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["c", "n"])

    out = None
    for df, col in dfs:
        x = df.select(F.col(col).cast("string").alias("t")).where("t is not null").mapInArrow(run, "c int, n long")
        out = x if out is None else out.unionByName(x)
    return {r.c: r.n for r in out.groupBy("c").agg(F.sum("n").alias("n")).collect()}


_REWRITERS: dict[str, Rewriter] = {}


def _share(df: DataFrame, counts: dict[int, int]):
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, counts))


def _rewriter(data) -> Rewriter:
    """The worker's rewriter for these counts; made once a Python worker."""
    name, counts = data.value
    if name not in _REWRITERS:
        _REWRITERS.clear()
        _REWRITERS[name] = Rewriter(counts)
    return _REWRITERS[name]


def one_form(df: DataFrame, text: str, counts: dict[int, int], keys: list[str], form: str = "form") -> DataFrame:
    """``keys``, ``text`` and ``form``: the one form of every text. Null gives null, an empty text an empty one."""
    data = _share(df, counts)
    src = df.select(*keys, F.col(text).cast("string").alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields) + f", `{form}` string"
    at, names = len(keys), [*src.columns, form]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rw = _rewriter(data)
        for b in batches:
            forms = pa.array([None if t is None else rw(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, forms], names=names)

    return src.mapInArrow(run, schema)


def _digests(df: DataFrame, key: str, text: str, order: str, counts: dict[int, int]) -> DataFrame:
    """``key``, ``form`` and ``raw``: 128-bit hashes of the one form and of the text itself; one row a key."""
    data = _share(df, counts)
    src = df.select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), F.col(text).cast("string").alias("t")).where("key is not null and t is not null")
    kind = src.schema["at"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rw = _rewriter(data)

        def h(t: str) -> bytes:
            return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

        for b in batches:
            raw, form = [], []
            for t in b.column(2).to_pylist():
                f = rw(t)
                raw.append(h(t))
                form.append(raw[-1] if f is t or f == t else h(f))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["key", "at", "form", "raw"])

    rows = src.mapInArrow(run, f"key string, at {kind}, form binary, raw binary")
    return rows.groupBy("key").agg(F.max(F.struct("at", "form", "raw")).alias("s")).select("key", "s.form", "s.raw")


def pairs(df: DataFrame, key: str, text: str, order: str, counts: dict[int, int]) -> DataFrame:
    """``key_a``, ``key_b`` (key_a < key_b): rows whose texts read the same but aren't equal.

    Rows with one key are one record, the one with the greatest ``order``. Null keys and texts are in no pair. Equal
    texts are never paired with each other on the way: first the different spellings of a form are
    paired, then each spelling is replaced by its rows.
    """
    rows = materialize(_digests(df, key, text, order, counts), "forms")
    spellings = rows.groupBy("form", "raw").agg(F.lit(1).alias("one"))
    several = spellings.groupBy("form").agg(F.count("*").alias("c")).where("c > 1").select("form")
    spellings = spellings.join(several, "form", "left_semi").select("form", "raw")
    two = spellings.join(spellings.withColumnRenamed("raw", "raw_b"), "form").where("raw <> raw_b")
    a = rows.select(F.col("key").alias("key_a"), "form", "raw")
    b = rows.select(F.col("key").alias("key_b"), F.col("form").alias("form_b"), F.col("raw").alias("rb"))
    left = a.join(two, ["form", "raw"])
    out = left.join(b, (left["form"] == b["form_b"]) & (left["raw_b"] == b["rb"]) & (left["key_a"] < b["key_b"]))
    return out.select("key_a", "key_b")


def classes(df: DataFrame, key: str, text: str, order: str, counts: dict[int, int]) -> DataFrame:
    """``key``, ``cls`` (hash of the one form), ``spelling`` (hash of the text), ``n_rows`` and ``n_spellings`` of the class: one row a record.

    The membership from which :func:`pairs` would list the pairs; copies aren't multiplied. Null keys and texts are in no class.
    """
    rows = materialize(_digests(df, key, text, order, counts), "forms")
    sizes = rows.groupBy("form", "raw").agg(F.count("*").alias("n")).groupBy("form").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"))
    return rows.join(sizes, "form").select("key", F.hex("form").alias("cls"), F.hex("raw").alias("spelling"), "n_rows", "n_spellings")


NUMBER = r"^\s*[0-9]+[.)] +"


def references(df: DataFrame, key: str, item: str, ref: DataFrame, code: str, name: str, counts: dict[int, int]) -> DataFrame:
    """``key_a`` (key of ``df``), ``key_b`` (code of ``ref``): items that read like a reference item but equal none.

    A leading list number (``N. `` or ``N) ``) is no part of an item. Null items and keys give no row.
    """
    got = one_form(df.select(F.col(key).cast("string").alias("key_a"), F.col(item).alias("item")).where("key_a is not null and item is not null").distinct(), "item", counts, ["key_a"])
    got = got.withColumn("form", F.regexp_replace("form", NUMBER, "")).withColumn("bare", F.regexp_replace("item", NUMBER, ""))
    names = one_form(ref.select(F.col(code).cast("string").alias("key_b"), F.col(name).alias("name")).where("name is not null"), "name", counts, ["key_b"])
    exact = names.select(F.col("name").alias("bare")).distinct()
    return got.join(exact, "bare", "left_anti").join(names, "form").select("key_a", "key_b").distinct()


def found(chunks: DataFrame, findings: DataFrame, item_ref: DataFrame) -> DataFrame:
    """``tbl``, ``key_a``, ``key_b`` over the chunks and the findings; see :func:`pairs` and :func:`references`."""
    counts = code_points([(chunks, "text"), (findings, "item"), (item_ref, "item")])
    a = pairs(chunks, "chunk_id", "text", "created_at", counts).select(F.lit("chunks").alias("tbl"), "key_a", "key_b")
    b = references(findings, "finding_id", "item", item_ref, "code", "item", counts).select(F.lit("findings").alias("tbl"), "key_a", "key_b")
    return a.unionByName(b).distinct()
