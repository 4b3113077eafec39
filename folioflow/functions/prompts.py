"""Texts for a model: the task of a filing, the tools it may call, one item to settle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def task_prompt(accession: Column, html_len: Column, links: Column, candidates: Column, difficulty: Column, parts: Column, incorporated: Column) -> Column:
    """``parts``: array of struct(part, rel), may be empty."""
    found = F.array_join(F.transform(parts, lambda p: F.format_string("Part %d at %.1f%%", p.part, 100 * p.rel)), ", ")
    return F.concat(
        F.format_string("Extract all item sections of filing %s.\nDocument: %.1f MB, %d contents links, %d candidates, difficulty %s.", accession, html_len / 1e6, F.coalesce(links, F.lit(0)), F.coalesce(candidates, F.lit(0)), F.coalesce(difficulty, F.lit("unknown"))),
        F.when(F.size(parts) > 0, F.concat(F.lit("\nPart headings: "), found)).otherwise(""),
        F.when(F.coalesce(incorporated, F.lit(False)), "\nItems 10 to 14 are incorporated by reference: assign them with position -1.").otherwise(""),
        F.lit("\n\nBegin with get_all_top_candidates, then assign all sure items with one batch_assign."),
    )


def resolve_prompt(item: Column, reasons: Column, place: Column, html_len: Column, candidates: Column, context: Column) -> Column:
    """``candidates``: array of struct(anchor_id, o, confidence, source, nearby_text), the surest first."""
    share = lambda o: F.format_string("%.1f%%", 100 * o / html_len)
    one = lambda c, k: F.format_string('  [%d] anchor=%s pos=%d (%s) conf=%d src=%s text="%s"', k + 1, c.anchor_id, c.o, share(c.o), c.confidence, c.source, F.left(c.nearby_text, F.lit(100)))
    listed = F.when(F.size(candidates) > 0, F.array_join(F.transform(candidates, one), "\n")).otherwise("  (none)")
    return F.concat(
        F.lit("Settle one item boundary of an annual report.\n\nItem: "), item, F.lit("\nProblem: "), reasons,
        F.lit("\nPlace now: "), F.when(place.isNull(), "unassigned").otherwise(F.format_string("%d (%s of the document)", place, share(place))),
        F.lit("\n\nCandidates, the surest first:\n"), listed, F.lit('\n\nText around the place:\n"'), F.left(F.coalesce(context, F.lit("")), F.lit(400)),
        F.lit('"\n\nAnswer with one JSON object only: {"action": "keep" | "move" | "remove", "anchor_id": "...", "char_position": N, "reasoning": "..."}'),
    )


def tool_prompt(tools: dict[str, tuple[dict[str, str], str]]) -> str:
    """The tools as text, for models without calls of their own.  ``tools``: name -> (argument -> kind, description)."""
    lines = ['Call tools by answering with JSON: {"tool": "name", "args": {...}}, or a list of such objects. Tools:']
    return "\n".join([*lines, *(f"- {name}({', '.join(f'{k}: {v}' for k, v in args.items())}): {text}" for name, (args, text) in tools.items())])
