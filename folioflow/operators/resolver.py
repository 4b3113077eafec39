"""A model in the loop: doubtful items settled one by one, and the tool-calling conversation.

The model is any function that is handed in; nothing here opens a connection.  Without one the deterministic policy of
``plans.rule_pipeline.assign_by_policy`` stands in.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import prompts
from folioflow.functions import text as T

DECISION = "action string, anchor_id string, char_position long, reasoning string, tokens long"


def questions(filings: DataFrame, chosen: DataFrame, doubtful: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """accession, item, prompt: one question for each doubtful (accession, item, reasons), with its ``most`` surest candidates."""
    by = Window.partitionBy("accession", "item").orderBy(F.desc("confidence"), "o", "anchor_id", "source")
    best = candidates.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)
    best = best.groupBy("accession", "item").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("anchor_id", "o", "confidence", "source", "nearby_text").alias("c")))).alias("cs"))
    q = doubtful.join(chosen.select("accession", "item", "o"), ["accession", "item"], "left").join(best, ["accession", "item"], "left")
    q = q.join(filings.select("accession", "html"), "accession")
    start = F.greatest(F.lit(0), F.col("o") - 200).cast("int")
    context = F.left(T.strip_plain(F.expr("substring(html, cast(greatest(0, o - 200) as int) + 1, cast(o + 500 - greatest(0, o - 200) as int))")), F.lit(400))
    none = F.array().cast("array<struct<anchor_id:string,o:int,confidence:int,source:string,nearby_text:string>>")
    text = prompts.resolve_prompt(F.col("item"), F.col("reasons"), F.col("o"), F.length("html"), F.coalesce(F.col("cs.c"), none), F.when(start.isNotNull(), context))
    return q.select("accession", "item", text.alias("prompt"))


def decisions(asked: DataFrame, model: Callable[[str], tuple[str, int]]) -> DataFrame:
    """``asked`` with action (keep, move, remove), anchor_id, char_position, reasoning, tokens.

    ``model``: a prompt to (answer, tokens), called in the executors, so it must be picklable.  An error or an answer that is no such object keeps the place.
    """
    schema = asked.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ", 3)

    def ask(prompt):
        import json
        import re

        try:
            answer, tokens = model(prompt)
            body = re.sub(r"\A```(?:json)?\s*|\s*```\Z", "", (answer or "").strip())
            got = json.loads(body)
            action = got.get("action", "keep")
            place = got.get("char_position")
            return action if action in ("keep", "move", "remove") else "keep", got.get("anchor_id"), None if place is None else int(place), str(got.get("reasoning", "")), int(tokens or 0)
        except Exception as e:  # whatever the model does, the place stays
            return "keep", None, None, f"model error: {e}", 0

    def run(frames):
        import pandas as pd

        for pdf in frames:
            found = pd.DataFrame([ask(p) for p in pdf.prompt], columns=[c.split()[0] for c in DECISION.split(", ")])
            found["char_position"] = found["char_position"].astype("Int64")
            yield pd.concat([pdf.reset_index(drop=True), found], axis=1)

    return asked.mapInPandas(run, f"{schema}, {DECISION}")


def resolved(chosen: DataFrame, answers: DataFrame) -> DataFrame:
    """accession, item, anchor_id, o after the answers: moved items at their new place (null for a negative one), removed ones gone."""
    moved = answers.filter("action = 'move' and char_position is not null").select("accession", "item", F.coalesce("anchor_id", F.lit("")).alias("anchor_id"), F.when(F.col("char_position") >= 0, F.col("char_position")).alias("o"))
    out = answers.filter("action = 'remove' or action = 'move' and char_position is not null").select("accession", "item")
    return chosen.select("accession", "item", "anchor_id", F.col("o").cast("long").alias("o")).join(out, ["accession", "item"], "left_anti").unionByName(moved)


class ModelError(Exception):
    """A failed call; ``limited``: too many requests; ``server``: an error on the other side.  Both are tried again."""

    def __init__(self, text: str, limited: bool = False, server: bool = False):
        super().__init__(text)
        self.limited, self.server = limited, server


#: What is said to a model that makes no headway.
NUDGE = "The last three changes did not reduce the issues. Try something else: scan_for_heading finds headings, or go on to another issue."
STOP = "Stop here. More than twenty turns have gone by and the issues do not get fewer. Call finalize now with what you have."


def converse(model: Callable, call: Callable[[str, dict], str], issues: Callable[[], int], finalized: Callable[[], bool], messages: list[dict], max_turns: int = 30, stall: int = 3, force_after: int = 20, compact_every: int = 10, most_chars: int = 100_000, keep_last: int = 10, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> dict:
    """The conversation with one filing's tools: turns, tokens, finalized, error, messages.

    ``model``: messages to (text, list of (tool, args), tokens), or a ``ModelError``; ``call``: runs a tool; ``issues``: how many the
    assignments have.  It ends when the model calls no tool, calls finalize, or has had ``max_turns``.  After ``stall`` turns without fewer
    issues the model is nudged, and after turn ``force_after`` told to finalize.  Long conversations keep their first two and last messages.
    """
    tokens, stalled, before, turn = 0, 0, float("inf"), -1

    def answer():
        for attempt in range(retries + 1):
            try:
                return model(messages)
            except ModelError as e:
                if not (e.limited or e.server):
                    raise
                if attempt == retries:
                    raise ModelError(f"{e} after {retries} retries") from e
                wait((attempt + 1) * (10 if e.limited else 3))
        return None

    def state(error=None, turns=0):
        return {"turns": turns, "tokens": tokens, "finalized": finalized(), "error": error, "messages": messages}

    for turn in range(max_turns):
        try:
            text, calls, used = answer()
        except ModelError as e:
            return state(str(e), turn)
        tokens += used
        messages.append({"role": "assistant", "content": text or "", "calls": calls})
        if not calls:
            break
        shown = [f"[{name}] {call(name, args)}" for name, args in calls]
        messages.append({"role": "user", "content": "Tool results:\n" + "\n".join(shown)})
        if finalized():
            break
        now = issues()
        stalled = stalled + 1 if now > 0 and now >= before else 0
        before = now
        if stalled >= stall:
            messages.append({"role": "user", "content": STOP if turn >= force_after else NUDGE})
            stalled = 0
        if (turn + 1) % compact_every == 0 and message_chars(messages) > most_chars and len(messages) > keep_last + 2:
            gone = len(messages) - keep_last - 2
            messages[2 : 2 + gone] = [{"role": "user", "content": f"[{gone} earlier messages left out: the filing was explored, items assigned and checked.]"}]
    return state(None, turn + 1)


def message_chars(messages: list[dict]) -> int:
    """Characters of all contents and tool arguments."""
    return sum(len(m.get("content") or "") + sum(len(str(args)) for _, args in m.get("calls") or ()) for m in messages)
