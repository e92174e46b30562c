"""Languages of documents and of their parts, by error-correcting output codes.

Each language has a codeword; a linear classifier over hashed character n-grams predicts each bit of it. A
segment gets the language whose codeword loses least against the predicted bits, each bit weighted by how
often it is right on labelled text; where the two best are close the segment counts as ambiguous.

The classifiers are fitted on a bounded sample of labelled documents (see :class:`Sample`), on two rounds: the
labels are noisy, so the second round keeps only sentences that the first gives the language of their label.
A language that most sentences under its label disagree with stays if the others are a class of their own on
held-out text (see :func:`own_class`), and is dropped if not.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.bpe import slices
from docloom.llm.lookalike import INVISIBLE, LATIN_ALIKE
from docloom.runtime import spread

BITS = 16  # of the n-gram hash
SIZE = 1 << BITS


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled sample: documents a language, sentences a document, code points a sentence."""

    documents: int = 150
    sentences: int = 6
    chars: int = 200


# ---- text to segments

_FOLD = {o: None for a, b in INVISIBLE for o in range(a, b + 1)}
_FOLD |= {o: None for o in (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF, *range(0x202A, 0x202F), *range(0x2066, 0x206A))}
_ALIKE = {ord(c): w[0] for w in re.findall(r"(\S) (\S+)", LATIN_ALIKE) for c in w[1]}
_ODD = re.compile("[^\x00-\x7f가-힣぀-ヿ一-鿿À-ž、。，]").search
_HAS_ALIKE = re.compile("[A-Za-z][" + "".join(map(chr, _ALIKE)) + "]|[" + "".join(map(chr, _ALIKE)) + "][A-Za-z]")


def clean(text: str) -> str:
    """The text with width and compatibility forms and look-alike letters inside Latin words made plain."""
    if _ODD(text):
        text = unicodedata.normalize("NFKC", text.translate(_FOLD))
        if _HAS_ALIKE.search(text):
            text = regex.sub(r"\p{L}*[A-Za-z]\p{L}*", lambda m: m[0].translate(_ALIKE), text)
    return text


#: Ends of a line or sentence; a full stop inside a number or word or before a comma ends nothing.
_END = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029\t|]+|<[bB][rR]\s*/?>|[。！？｡]+[」』”’\"')\]]*|[.!?…]+[\"'”’)\]]*(?=\s|$|[가-힣぀-ヿ一-鿿])(?!\s*,)")
#: Runs of one kind of letters.
_RUN = re.compile(r"(?P<k>[가-힣ᄀ-ᇿㄱ-ㆎ]+)|(?P<c>[぀-ヿ㐀-鿿豈-﫿]+)|(?P<l>[A-Za-zÀ-ɏḀ-ỿ]+(?:['’-][A-Za-zÀ-ɏḀ-ỿ]+)*)|(?P<o>[Ͱ-῿Ⲁ-⿟]+)")
#: Least letters (of Korean; of Chinese and Japanese) and least words (of Latin script) of a full sentence.
LEAST = {"k": 9, "c": 7, "l": 4}


#: A stretch without any stop is judged in windows of about this many characters, in case it holds several languages.
WINDOW = 200


def _windows(part: str, lo: int, hi: int) -> list[tuple[int, int]]:
    out = []
    while hi - lo > 2 * WINDOW:
        at = part.rfind(" ", lo + WINDOW // 2, lo + WINDOW) + 1 or lo + WINDOW
        out.append((lo, at))
        lo = at
    return [*out, (lo, hi)]


_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def mask(text: str) -> str:
    """The text with every ASCII digit made 0, of the same length: sentences that differ in figures alone are equal then."""
    return text.encode("utf-8", "surrogatepass").translate(_DIGITS).decode("utf-8", "surrogatepass")


def segments(text: str, memo: dict[str, tuple] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, part) of the parts of a cleaned text that may be full sentences of one language.

    Lines and sentences are parted, then stretches of another kind of letters that are long enough for a
    sentence of their own; very long ones are cut into windows. Names and abbreviations inside a sentence stay
    with it; what is too short for a sentence is left out. ``memo`` keeps what a sentence was cut into.
    """
    out = []
    at = 0
    memo = {} if memo is None else memo
    for end, nxt in [m.span() for m in _END.finditer(text)] + [(len(text), 0)]:
        if end - at >= 7:
            part = text[at:end]
            cut = memo.get(part)
            if cut is None:
                cut = memo[part] = tuple((a, z, part[a:z]) for x, y in _by_script(part) for a, z in _windows(part, x, y))
            for a, z, p in cut:
                out.append((at + a, at + z, p))
        at = nxt
    return out


_ONE = {"k": re.compile(r"[가-힣ᄀ-ᇿ]"), "c": re.compile(r"[぀-ヿ㐀-鿿]"), "l": re.compile(r"[A-Za-zÀ-ɏ]")}


_WORD = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]{2,}").findall
_LOW = re.compile(r"\b[A-Za-zÀ-ɏḀ-ỿ]?[a-zß-ɏ][a-zß-ɏḀ-ỿ]*").findall


def _by_script(part: str) -> list[tuple[int, int]]:
    kinds = [k for k, f in _ONE.items() if f.search(part)]
    whole = [(0, len(part))]
    if kinds == ["l"]:  # words, without abbreviations unless all is in capitals
        return whole if len(_WORD(part) if part.isupper() else _LOW(part)) >= LEAST["l"] else []
    if len(kinds) == 1:
        n = len(part)
        if n < 2 * LEAST[kinds[0]]:
            n = sum(m.end() - m.start() for m in _RUN.finditer(part))
        return whole if n >= LEAST[kinds[0]] else []
    # stretches of one kind of letters and their weight: letters, or words that are no abbreviation
    stretches: list[list] = []
    upper = part.isupper()
    for m in _RUN.finditer(part):
        k, n = m.lastgroup, m.end() - m.start()
        w = n if k != "l" else int((n > 1 or m[0].islower()) and (upper or not m[0].isupper()))
        if stretches and stretches[-1][0] == k:
            stretches[-1][2], stretches[-1][3] = m.end(), stretches[-1][3] + w
        else:
            stretches.append([k, m.start(), m.end(), w])
    strong = [s for s in stretches if s[3] >= LEAST.get(s[0], 8)]
    if not strong:  # pieces of a sentence around names: the kind with most weight, if it has enough of it together
        by: dict[str, int] = {}
        for s in stretches:
            by[s[0]] = by.get(s[0], 0) + s[3]
        k = max(by, key=by.get, default="")
        return whole if by and by[k] >= LEAST.get(k, 8) else []
    merged: list[list] = []
    for s in strong:
        if merged and merged[-1][0] == s[0]:
            merged[-1][2] = s[2]
        else:
            merged.append(list(s))
    starts = [0, *(s[1] for s in merged[1:])]
    return list(zip(starts, [*starts[1:], len(part)]))


# ---- n-grams and classifiers

def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all parts, one after the other, and the start of each part; every part has some."""
    text = " ".join(p.lower() for p in parts)
    lens = np.fromiter((len(p.lower()) for p in parts), np.int64, len(parts))
    c = np.frombuffer((" " + text + "  ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c[(c < 65) | ((c > 90) & (c < 97))] = 32  # digits and marks say nothing
    with np.errstate(over="ignore"):
        a, b, d, e = c[:-3], c[1:-2], c[2:-1], c[3:]
        mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
        one = mix((b >> np.uint64(6)) + np.uint64(1 << 40))
        two = mix(b * np.uint64(0x10001) + d + np.uint64(1 << 50))
        three = mix((a * np.uint64(0x1000003) + b) * np.uint64(0x1000003) + d + np.uint64(1 << 60))
        four = mix(((a * np.uint64(0x1000003) + b) * np.uint64(0x1000003) + d) * np.uint64(0x1000003) + e)
    grams = np.stack([one, two, three, four], 1)
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    return grams, starts


class Codes:
    """Codewords of the languages: rows of -1 and 1, all different, and every bit of both signs (but with one language)."""

    def __init__(self, n: int, bits: int = 15, seed: int = 3):
        if n > 1 << bits:
            raise ValueError(f"{n} languages have no different codewords of {bits} bits")
        g = np.random.default_rng([seed, n, bits])
        best, far = None, 0
        for _ in range(400):
            m = g.choice([-1, 1], size=(n, bits))
            if n > 2 and not (abs(m.sum(0)) > n - 2).any():
                d = self.distance(m)
                if d > far:
                    best, far = m, d
        if best is None:  # few languages or very many: words and their complements
            for _ in range(20):
                words = g.choice(1 << (bits - 1), size=(n + 1) // 2, replace=False)
                m = 2 * (words[:, None] >> np.arange(bits) & 1) - 1
                m = np.stack([m, -m], 1).reshape(-1, bits)[:n]
                if best is None or self.distance(m) > far:
                    best, far = m, self.distance(m)
        self.matrix = best

    @staticmethod
    def distance(m: np.ndarray) -> int:
        """Least number of places in which two rows differ; all places with a single row."""
        alike = (m @ m.T.astype(np.float32)).astype(int)
        np.fill_diagonal(alike, -m.shape[1])
        return (m.shape[1] - alike.max()) // 2


#: Characters whose n-grams are looked up at a time.
BLOCK = 200_000


class Model:
    """Fitted classifiers; picklable, of fixed size (n-gram hash times bits)."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.codes, self.weights, self.trust = languages, codes, weights, trust

    def margins(self, parts: list[str]) -> np.ndarray:
        """(parts, bits): mean vote of the n-grams of each part for each bit."""
        if any(len(p) > BLOCK for p in parts):
            return np.concatenate([self._long(p) if len(p) > BLOCK else self.margins([p]) for p in parts])
        grams, starts = features(parts)
        votes = self.weights[grams[:, 0]]
        for i in range(1, grams.shape[1]):
            votes += self.weights[grams[:, i]]
        sums = np.add.reduceat(votes, starts, axis=0)
        size = np.diff(np.append(starts, len(grams)))
        return sums / np.sqrt(np.maximum(size, 1))[:, None]

    def _long(self, part: str) -> np.ndarray:
        """The margins of a single part, its n-grams taken block by block."""
        low = part.lower()
        total = np.zeros((1, self.weights.shape[1]))
        for lo in range(0, len(low), BLOCK):
            at = max(lo - 1, 0)  # an n-gram begins one character before its place and ends two after
            grams, _ = features([low[at : lo + BLOCK + 2]])
            mine = grams[lo - at : lo - at + BLOCK]
            total += sum(self.weights[mine[:, i]].sum(0, dtype=np.float64) for i in range(mine.shape[1]))
        return total / np.sqrt(len(low))

    def decide(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language of each part, and the confidence: the share it has against the second best."""
        if not parts:
            return np.empty(0, np.int64), np.empty(0)
        f = np.clip(self.margins(parts), -30, 30)
        loss = np.log1p(np.exp(-f[:, None, :] * self.codes[None, :, :])) @ self.trust
        best = loss.argmin(1)
        low = np.sort(loss, axis=1)
        gap = (low[:, 1] - low[:, 0]) if loss.shape[1] > 1 else np.full(len(low), 99.0)
        return best, 1 / (1 + np.exp(-np.minimum(gap, 50)))


def fit(parts: list[str], labels: list[str], seed: int = 5, epochs: int = 6, bits: int = 15) -> Model | None:
    """Fit the bits on labelled sentences; None without any. Fixed order and seed make it repeatable."""
    if not parts:
        return None
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    keep = np.ones(len(parts), bool)
    model = None
    for turn in range(2):
        code = Codes(len(languages), bits).matrix
        use = np.flatnonzero(keep)
        held = use[np.arange(len(use)) % 8 == 7] if len(use) > 80 else use
        train = use[np.arange(len(use)) % 8 != 7] if len(use) > 80 else use
        weights = _logistic([parts[i] for i in train], y[train], code, epochs)
        model = Model(languages, code.astype(np.float32), weights, np.ones(bits, np.float32) / bits)
        right = (np.sign(np.concatenate([model.margins([parts[i] for i in held[j : j + 500]]) for j in range(0, len(held), 500)])) == code[y[held]]).mean(0)
        model.trust = np.clip(right - 0.5, 0.02, 0.5).astype(np.float32)
        model.trust *= 2 / model.trust.sum() * bits / 4
        if turn == 0:
            got = np.concatenate([model.decide(parts[j : j + 500])[0] for j in range(0, len(parts), 500)])
            agree = got == y
            share = np.array([agree[y == i].mean() if (y == i).any() else 0 for i in range(len(languages))])
            doubtful = [i for i in range(len(languages)) if share[i] < 0.4]
            kept = own_class(parts, y, doubtful) if len(doubtful) < len(languages) else {}
            good = [i for i in range(len(languages)) if share[i] >= 0.4 or i in kept]
            if not good:
                return model
            keep = agree & ~np.isin(y, doubtful)
            for mine in kept.values():
                keep[mine] = True
            languages2 = [languages[i] for i in good]
            y = np.array([languages2.index(languages[i]) if i in good else -1 for i in y])
            languages = languages2
    return model


#: Least sentences that bear out a doubtful language, and by how much (nats an n-gram) each is likelier in it than in any other.
OWN, GAIN = 6, 0.1


def own_class(parts: list[str], y: np.ndarray, doubtful: list[int]) -> dict[int, np.ndarray]:
    """The doubtful languages that are a class of their own, each with the places of the sentences that show it.

    A sentence shows it if its n-grams are likelier under the other half of its label's sentences (which come in order of
    their documents) than under all sentences of any other label. Sentences of other languages aren't, however many bear the
    label: their own label has them in greater number and purity.
    """

    def logs(at: np.ndarray) -> np.ndarray:
        c = np.full(SIZE, 0.05)
        for j in range(0, len(at), 500):
            c += np.bincount(features([parts[i] for i in at[j : j + 500]])[0].ravel(), minlength=SIZE)
        return np.log(c / c.sum())

    def shown(at: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        got, halves = [at[:0]], np.array_split(at, 2)
        for test, rest in (halves, halves[::-1]):
            own = logs(rest)
            for j in range(0, len(test), 500):
                grams, starts = features([parts[k] for k in test[j : j + 500]])
                size = np.diff(np.append(starts, len(grams))) * grams.shape[1]
                gain = np.min([np.add.reduceat((own - x)[grams].sum(1), starts) for x in others], axis=0) / size
                got.append(test[j : j + 500][gain > GAIN])
        return np.concatenate(got)

    every = {i: logs(np.flatnonzero(y == i)) for i in np.unique(y)} if doubtful else {}
    found = {i: shown(np.flatnonzero(y == i), [x for k, x in every.items() if k != i]) for i in doubtful}
    return {i: at for i, at in found.items() if len(at) >= OWN}


def _logistic(parts: list[str], y: np.ndarray, code: np.ndarray, epochs: int, block: int = 500) -> np.ndarray:
    """Weights (n-gram, bit): naive Bayes to start from, then gradient steps of the logistic loss, block by block of sentences."""
    n_lang, bits = code.shape
    blocks = [(features(parts[i : i + block]), y[i : i + block]) for i in range(0, len(parts), block)]
    counts = np.zeros((n_lang, SIZE))
    for (grams, starts), yy in blocks:
        row = np.repeat(yy, np.diff(np.append(starts, len(grams))))
        for i in range(grams.shape[1]):
            np.add(counts, np.bincount(row * SIZE + grams[:, i], minlength=n_lang * SIZE).reshape(n_lang, SIZE), out=counts)
    p = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
    w = np.zeros((SIZE, bits), np.float32)
    for b in range(bits):
        if not (code[:, b] > 0).any() or not (code[:, b] < 0).any():
            continue  # a single language: nothing to tell apart
        w[:, b] = 0.1 * (np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)))
    w[counts.sum(0) == 0] = 0
    del p, counts
    each = len(y) / n_lang / np.maximum(np.bincount(y, minlength=n_lang), 1)  # every language counts alike
    power = np.full((SIZE, bits), 1e-6, np.float32)
    for _ in range(epochs):
        grad = np.zeros((SIZE, bits), np.float32)
        for (grams, starts), yy in blocks:
            size = np.diff(np.append(starts, len(grams)))
            scale, target = 1 / np.sqrt(np.maximum(size, 1)), code[yy]
            votes = w[grams[:, 0]]
            for i in range(1, grams.shape[1]):
                votes += w[grams[:, i]]
            f = np.add.reduceat(votes, starts, axis=0) * scale[:, None]
            g = target / (1 + np.exp(np.clip(target * f, -30, 30))) * (each[yy] * scale)[:, None]
            row = np.repeat(np.arange(len(yy)), size)
            for b in range(bits):
                mine = g[row, b]
                for i in range(grams.shape[1]):
                    grad[:, b] += np.bincount(grams[:, i], weights=mine, minlength=SIZE)
        power += grad**2
        w += 0.05 * grad / np.sqrt(power)
    return w


# ---- over tables


def label_language(label: Column, codes: DataFrame) -> Column:
    """The language a label names, null if it names none; ``codes`` has lang, iso3 and name_en.

    ``codes`` is a reference table of languages, which is bounded (some thousands of languages at most).
    """
    rows = [r for r in codes.select("lang", "iso3", "name_en").collect() if r.lang]
    names: dict[str, str] = {}
    for r in rows:
        for x in (r.lang, r.iso3, r.name_en):
            if x:
                names[x.strip().lower()] = r.lang
    if not names:
        return F.lit(None).cast("string")
    # letters, digits and no more: a label's own white space of any kind goes first
    bare = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    short = F.create_map(*[F.lit(x) for r in rows for x in (r.lang.lower(), r.lang)])
    region = F.regexp_extract(bare, r"^([a-z]{2,3})[-_][a-z0-9]+(?:[-_][a-z0-9]+)*$", 1)
    return F.coalesce(F.try_element_at(table, bare), F.try_element_at(short, region))


def fit_on(documents: DataFrame, codes: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: Sample = Sample()) -> Model | None:
    """Fit on at most about ``sample.documents`` documents a language, drawn by a hash of the key."""
    named = documents.select(F.xxhash64(key).alias("h"), F.col(text).alias("t"), label_language(F.col(label), codes).alias("y")).where("y is not null and t is not null")
    counts = {r.y: r.n for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, float(min(1.0, sample.documents / n)))])
    drawn = named.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("y")] * 1_000_003).select("h", "t", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for b in batches:
            hs, ys, ps = [], [], []
            memo.clear()
            for h, t, y in zip(*(c.to_pylist() for c in b.columns)):
                got = segments(mask(clean(t)), memo)
                pick = np.random.default_rng(h & (2**63 - 1)).permutation(len(got))[: sample.sentences]
                for i in sorted(pick.tolist()):
                    hs.append(h)
                    ys.append(y)
                    ps.append(got[i][2][: sample.chars])
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ys, pa.string()), pa.array(ps, pa.string())], names=["h", "y", "p"])

    rows = drawn.mapInArrow(run, "h long, y string, p string").toPandas()
    rows = rows.sort_values(["h", "y", "p"], kind="stable")
    return fit(rows["p"].tolist(), rows["y"].tolist())


SEGMENTS = "seg_no int, start int, end int, lang string, confidence double, ambiguous boolean, sentence boolean"
SURE = 0.65
#: The language of a text without any letter, as in ISO 639-2.
UNKNOWN = "und"


def places(text: str, cleaned: str) -> np.ndarray | None:
    """For each place in the cleaned text (and its end) the place in the text itself; None if they are the same."""
    if cleaned == text:
        return None
    at: list[int] = []
    for m in regex.finditer(r"\X", text):  # characters with their marks, which normalisation keeps apart
        at += [m.start()] * len(unicodedata.normalize("NFKC", m[0].translate(_FOLD)))
    at.append(len(text))
    if len(at) != len(cleaned) + 1:  # marks that joined across: in proportion
        return np.linspace(0, len(text), len(cleaned) + 1).astype(np.int64)
    return np.array(at)


def _label_batch(model: Model, texts: list[str | None], memo: dict[str, tuple[int, float]], cuts: dict[str, tuple], located: bool = True):
    """For each text its segments as (start, end, language number, confidence), and whether they are full sentences.

    A text without any is one segment of which all letters are judged; without a letter its language is -1.
    """
    for kept in (memo, cuts):
        if len(kept) > 100_000:
            kept.clear()
    cleaned = [clean(t) if t else "" for t in texts]
    cut = [segments(mask(t), cuts) if t else [] for t in cleaned]
    whole = [not s for s in cut]
    cut = [[(0, len(t), _GAP.sub(" ", t).strip())] if not s and _LETTER(t) else s for s, t in zip(cut, cleaned)]
    new = [p for p in dict.fromkeys(p for s in cut for _, _, p in s) if p not in memo]
    lo = 0
    while lo < len(new):
        hi, total = lo, 0
        while hi < len(new) and (hi == lo or total + len(new[hi]) < BLOCK):
            total += len(new[hi])
            hi += 1
        best, conf = model.decide(new[lo:hi])
        memo.update(zip(new[lo:hi], zip(best.tolist(), conf.tolist())))
        lo = hi
    out = []
    for t, c, s, w in zip(texts, cleaned, cut, whole):
        got = [(a, z, *memo[p]) for a, z, p in s]
        if not got and t and t.strip():
            got = [(0, len(c), -1, 0.0)]
        if located and got and (at := places(t, c)) is not None:
            got = [(int(at[a]), int(at[z]), lang, conf) for a, z, lang, conf in got]
        out.append((got, not w))
    for p in new:
        if len(p) > 2 * WINDOW:  # a whole text, which can be of any length: not kept
            del memo[p]
    return out


_LETTER = regex.compile(r"\p{L}").search
#: What isn't a letter nor a mark on one; in a text of figures it would outvote the letters.
_GAP = regex.compile(r"[^\p{L}\p{M}]+")


def label_segments(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", located: bool = True) -> DataFrame:
    """One row for each run of sentences of one language: its place in the text (code points), language and confidence.

    The confidence is that of its sentences, weighted by length. Ambiguous are sentences whose confidence is
    below ``SURE``; they take the language of the sentence before or after them if that is one of their document's.
    A text without a full sentence is one ambiguous segment, with ``sentence`` false; its language is ``und`` and its confidence 0 if
    it has no letter. Null, empty and blank texts have no segments. Without ``located`` places are those of the cleaned text, which
    spares finding them in the text itself.
    """
    src = spread(documents.select(F.col(key), F.col(text).cast("string").alias("t")))
    schema = f"`{key}` {src.schema[key].dataType.simpleString()}, {SEGMENTS}"
    if model is None:
        return src.sparkSession.createDataFrame([], schema)
    shared = src.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.bool_()]
    names = [key, *(x.split()[0] for x in SEGMENTS.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo, cuts = shared.value, {}, {}
        for b in batches:
            for lo, hi in slices(b.column(1), 2 << 20):
                part = b.slice(lo, hi - lo)
                rows, at = [], []
                for i, (segs, sentence) in enumerate(_label_batch(m, part.column(1).to_pylist(), memo, cuts, located)):
                    for j, s in enumerate(_join(segs), 1):
                        rows.append((j, s[0], s[1], m.languages[s[2]] if s[2] >= 0 else UNKNOWN, s[3], s[4] or not sentence, sentence))
                        at.append(i)
                cols = list(zip(*rows)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return src.mapInArrow(run, schema)


def _join(segs: list[tuple[int, int, int, float]]) -> list[list]:
    """Runs of one language: start, end, language, confidence, ambiguous."""
    sure = {s[2] for s in segs if s[3] >= SURE}
    out: list[list] = []
    for i, (a, z, lang, conf) in enumerate(segs):
        if conf < SURE and lang not in sure:
            near = [s[2] for s in (segs[i - 1 : i] + segs[i + 1 : i + 2]) if s[3] >= SURE]
            if near:
                lang = near[0]
        n = z - a
        if out and out[-1][2] == lang:
            o = out[-1]
            o[1], o[3], o[5] = z, (o[3] * o[5] + conf * n) / (o[5] + n), o[5] + n
        else:
            out.append([a, z, lang, conf, False, n])
    for o in out:
        o[4] = o[3] < SURE
    return out


def document_languages(segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``lang``, ``confidence``, ``share``: the languages that are in each document."""
    n = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    by = segs.groupBy(key, "lang").agg(F.sum(n).alias("n"), (F.sum(F.col("confidence") * n) / F.sum(n)).alias("confidence"))
    return by.select(key, "lang", "confidence", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def wrong_labels(documents: DataFrame, codes: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: Sample = Sample()) -> DataFrame:
    """``key``, ``lang``: the languages of each document that has several, or one that its label doesn't name."""
    model = fit_on(documents, codes, text, label, key, sample)
    langs = label_segments(documents, model, key, text, located=False).where("sentence").select(key, "lang").distinct()
    per = langs.groupBy(key).agg(F.collect_set("lang").alias("langs"))  # at most as many as there are languages
    labels = documents.select(key, label_language(F.col(label), codes).alias("named"))
    got = per.join(labels, key)
    case = (F.size("langs") > 1) | F.col("named").isNull() | (F.col("named") != F.col("langs")[0])
    return got.where(case).select(key, F.explode("langs").alias("lang")).distinct()
