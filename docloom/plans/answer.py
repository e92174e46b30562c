"""The end of a question: a packed context and its references as text. The model is a hook; without it the context itself is the answer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

# Messages for questions that end without an answer.
NO_CONTEXT = "관련 사례를 찾지 못했습니다."
FAILED = "답변을 생성하지 못했습니다."

Composer = Callable[[str, str], str]


def counts_line(words: Sequence[str], counts: Sequence[int]) -> str:
    """How many blocks each keyword was in; nothing for a single keyword."""
    return ", ".join(f"{w}: {n}" for w, n in zip(words, counts)) if len(words) > 1 else ""


def reference_lines(references: DataFrame) -> list[str]:
    """One line for each referenced block, by report and line; there are at most as many as blocks were accepted."""
    rows = references.select("doc_id", "finding_id", "page", "start_line", "end_line", "section").orderBy("doc_id", "start_line", "finding_id").collect()
    return [f"- {r.doc_id} {r.finding_id} ({r.section}, p.{r.page}, {r.start_line}-{r.end_line})" for r in rows]


def excluded_lines(summary: DataFrame) -> list[str]:
    return [f"- {r[0]}: {', '.join(r['items'])}" + (f" (+{r['more']})" if r["more"] else "") for r in summary.collect()]


def compose(question: str, context: DataFrame, references: Sequence[str] = (), banner: str = "", excluded: Sequence[str] = (), model: Composer | None = None) -> str:
    """The answer text. The context is bounded by its token budget, so it is collected here and nowhere else."""
    rows = context.orderBy("seq").collect()
    if not rows:
        return NO_CONTEXT
    body = "\n\n".join(r["text"] for r in rows if r["text"])
    if model is not None:
        try:
            body = model(question, body) or FAILED
        except Exception:  # noqa: BLE001 - whatever the hook raises, the reader gets a message
            body = FAILED
    parts = [banner, body, "\n".join(references), "\n".join(excluded)]
    return "\n\n".join(p for p in parts if p)
