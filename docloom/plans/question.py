"""From a question to a retrieval plan. This part runs on the driver over one question; model calls are hooks."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.retrieve import Expansion

# Words that hint at a section, and words that ask for an explanation.
SECTION_HINTS = {
    "조사착안": ("착안", "발견", "적발", "확인", "검토", "문제점", "의혹", "혐의"),
    "조사기법": ("조사기법", "기법", "방법", "절차", "확인방법", "검증", "조사방법", "접근"),
}
EXPLAIN = ("설명해", "뭐야", "무엇인지", "정의", "의미")

Filler = Callable[[str], Mapping[str, object]]


@dataclass(frozen=True)
class Slots:
    code: str | None = None
    labels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    hints: Mapping[str, Sequence[str]] = field(default_factory=dict)
    required: Sequence[str] = ()
    optional: Sequence[str] = ()
    confidence: float = 0.0


@dataclass(frozen=True)
class Question:
    text: str
    plain: str
    script: str
    intent: str
    slots: Slots
    expansion: Expansion
    route: str


def normalize(spark: SparkSession, questions: Sequence[str]) -> DataFrame:
    """``q``, ``text``, ``plain``, ``script``: questions cleaned by the same Column functions that batch jobs use."""
    df = spark.createDataFrame(list(enumerate(questions)), "q int, text string")
    return df.withColumns({"plain": tx.preprocess_query("text"), "script": tx.script_of("text")})


def slots_of(plain: str, vocabularies: Mapping[str, Mapping[str, Sequence[str]]]) -> Slots:
    """Slots by rule: a five-digit code, vocabulary labels named in the question (by label or synonym), section hints."""
    code = re.search(r"(?<!\d)\d{5}(?!\d)", plain)
    found = {k: sorted(x for x, syn in v.items() if any(p.lower() in plain for p in (x, *syn) if p)) for k, v in vocabularies.items()}
    hints = {s: [w for w in ws if w in plain] for s, ws in SECTION_HINTS.items()}
    terms = [x for v in found.values() for x in v]
    s = Slots(code[0] if code else None, found, hints, terms[:2], terms[2:])
    return replace(s, confidence=confidence(s))


def confidence(s: Slots, code: float = 0.3, first: float = 0.2, others: float = 0.25, hints: float = 0.1) -> float:
    groups = list(s.labels.values())
    total = code * bool(s.code) + first * bool(groups and groups[0]) + others * any(groups[1:]) + hints * any(s.hints.values())
    return min(1.0, round(total, 6))


def expand_by_rule(plain: str, s: Slots) -> Expansion:
    """Remaining words of the question are musts; the labels' names may match as well."""
    words = [w for w in plain.split() if len(w) > 1 and not any(w in ws for ws in SECTION_HINTS.values())]
    related = [x for v in s.labels.values() for x in v if x not in words]
    return Expansion(must=tuple(dict.fromkeys(words)), related=tuple(dict.fromkeys(related)))


def validated(raw: Mapping[str, object]) -> Expansion:
    """A hook's answer made an expansion: lists of strings, numbers as boosts, anything else dropped."""

    def strings(v: object) -> tuple[str, ...]:
        v = [v] if isinstance(v, str) else v
        return tuple(dict.fromkeys(x.strip() for x in v if isinstance(x, str) and x.strip())) if isinstance(v, (list, tuple)) else ()

    w = raw.get("boost_weights")
    weights = {str(k): float(x) for k, x in w.items() if isinstance(x, (int, float))} if isinstance(w, Mapping) else {}
    return Expansion(strings(raw.get("must_have")), strings(raw.get("should_have")), strings(raw.get("related_terms")), weights)


def expansion_confidence(e: Expansion) -> float:
    base = 0.7 if len(e.must) >= 2 else 0.5 if e.must else 0.0
    return min(1.0, round(base + 0.1 * bool(e.should) + 0.1 * (len(e.related) >= 3), 6))


def needs_clarifying(s: Slots, e: Expansion, least: float = 0.4) -> bool:
    if e.must:
        return False
    return s.confidence < least or not (s.code or any(s.labels.values()))


def clarification(s: Slots, asks: Mapping[str, str]) -> str:
    """What to ask back: the text of each vocabulary that the question named nothing of."""
    return " ".join(t for k, t in asks.items() if not s.labels.get(k))


def merged(ruled: Slots, filled: Mapping[str, object]) -> Slots:
    """A hook's slots, made lists of strings; where it names no label of any vocabulary the ruled slots count, and a ruled code always does."""

    def strings(v: object) -> list[str]:
        v = [v] if isinstance(v, str) else v
        return [x.strip() for x in v if isinstance(x, str) and x.strip()] if isinstance(v, (list, tuple)) else []

    labels = {k: strings(filled.get(k)) for k in ruled.labels}
    if not any(labels.values()):
        labels = dict(ruled.labels)
    code = filled.get("code")
    terms = list(dict.fromkeys(x for v in labels.values() for x in v))
    s = replace(ruled, code=ruled.code or (code if isinstance(code, str) and re.fullmatch(r"\d{5}", code) else None), labels=labels, required=terms[:2], optional=terms[2:])
    return replace(s, confidence=confidence(s))


def plans(questions: DataFrame, vocabularies: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """The rules of :func:`plan` over a table of questions (``q``, ``text``): any number at once, without a hook.

    Adds ``plain``, ``script``, ``intent``, ``code``, a sorted array of labels for each vocabulary, ``sections`` (those hinted at), ``must``,
    ``confidence`` and ``route``. A null question is an empty one.
    """
    low, has = F.lower("text"), lambda c, ws: reduce(lambda a, b: a | b, [c.contains(w) for w in ws])
    out = questions.withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumns({"plain": tx.preprocess_query("text"), "script": tx.script_of("text"), "intent": F.when(has(low, EXPLAIN), "explain").otherwise("search")})
    plain = F.col("plain")
    folded = {k: {x: [p.lower() for p in (x, *syn) if p] for x, syn in v.items()} for k, v in vocabularies.items()}
    named = {k: F.array_compact(F.array(*[F.when(has(plain, ps), F.lit(x)) for x, ps in sorted(v.items())])) for k, v in folded.items()}
    hints = F.array_compact(F.array(*[F.when(has(plain, ws), F.lit(s)) for s, ws in SECTION_HINTS.items()]))
    hinting = sorted({w for ws in SECTION_HINTS.values() for w in ws})
    must = F.array_distinct(F.filter(tx.words("plain"), lambda w: (F.char_length(w) > 1) & ~w.isin(hinting)))
    out = out.withColumns({"code": F.nullif(F.regexp_extract("plain", r"(?<!\d)\d{5}(?!\d)", 0), F.lit("")), **named, "sections": hints, "must": must})
    some = [F.size(k) > 0 for k in named] or [F.lit(False)]
    score = 0.3 * F.col("code").isNotNull().cast("int") + 0.2 * some[0].cast("int") + 0.25 * reduce(lambda a, b: a | b, some[1:], F.lit(False)).cast("int") + 0.1 * (F.size("sections") > 0).cast("int")
    n = F.size("must")
    related = reduce(lambda a, b: a + b, [F.size(F.array_except(F.col(k), F.col("must"))) for k in named], F.lit(0))
    words = F.when(n >= 2, 0.7).when(n == 1, 0.5).otherwise(0.0) + F.when(related >= 3, 0.1).otherwise(0.0)
    out = out.withColumn("confidence", F.round(F.least(F.lit(1.0), F.greatest(score, words)), 6))
    known = F.col("code").isNotNull() | reduce(lambda a, b: a | b, some)
    clarify = (n == 0) & ((F.col("confidence") < 0.4) | ~known)
    return out.withColumn("route", F.when(clarify, "clarify").otherwise(F.col("intent")))


def plan(text: str, plain: str, script: str, vocabularies: Mapping[str, Mapping[str, Sequence[str]]], expander: Filler | None = None, slotter: Filler | None = None) -> Question:
    """The plan of a normalised question. ``slotter`` and ``expander`` are model hooks; failing ones fall back to the rules."""
    low = text.lower()
    intent = "explain" if any(w in low for w in EXPLAIN) else "search"
    s = slots_of(plain, vocabularies)
    if slotter and intent == "search":
        try:
            s = merged(s, slotter(plain))
        except Exception:  # noqa: BLE001 - whatever a hook raises, the rules remain
            pass
    e = expand_by_rule(plain, s)
    if expander and intent == "search":
        try:
            got = validated(expander(plain))
            e = got if got.words() else e
        except Exception:  # noqa: BLE001 - whatever a hook raises, the rules remain
            pass
    s = replace(s, confidence=max(s.confidence, expansion_confidence(e)))
    route = "clarify" if needs_clarifying(s, e) else intent
    return Question(text, plain, script, intent, s, e, route)


def vocabulary_prompt(vocabularies: Mapping[str, Mapping[str, Sequence[str]]], most: Mapping[str, tuple[int, int]]) -> str:
    """A vocabulary as prompt lines: the first labels of each kind with their first synonyms."""
    lines = []
    for kind, v in vocabularies.items():
        n, m = most.get(kind, (20, 5))
        lines += [f"{kind}: {x} ({', '.join(list(v[x])[:m])})" for x in list(v)[:n]]
    return "\n".join(lines)
