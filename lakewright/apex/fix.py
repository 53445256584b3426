"""Applying edits to a corpus, and repeating fixes until nothing is left to fix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .bind import Program
from .corpus import is_trigger
from .diagnostics import dead_code_fixes
from .parser import parse
from .pattern import PatternError, outermost, splice

APPLIED = "path string, text string, edits int, status string, reason string"


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (path, text, edits, status, reason) after edits (path, start, end,
    new_text) in bytes. Edits inside another are part of it; a file whose edits
    cross, or that would gain parse errors, is refused and keeps its text."""
    per = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new_text"))).alias("e"))
    joined = files.select("path", "text").join(per, "path", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text, es in zip(f["path"], f["text"], f["e"], strict=True):
                if es is None or not len(es):
                    rows.append((path, text, 0, "same", None))
                    continue
                raw = text.encode("utf-8")
                chars = [(len(raw[: e["start"]].decode("utf-8", "ignore")), len(raw[: e["end"]].decode("utf-8", "ignore")), e["new_text"]) for e in es]
                try:
                    todo = outermost(chars)
                except PatternError as err:
                    rows.append((path, text, 0, "refused", str(err)))
                    continue
                new = splice(text, todo, 0, len(text))
                gained = len(parse(new, is_trigger(path)).errors) - len(parse(text, is_trigger(path)).errors)
                rows.append((path, text, 0, "refused", f"{gained} more parse errors") if gained > 0 else (path, new, len(todo), "changed", None))
            yield pd.DataFrame(rows, columns=["path", "text", "edits", "status", "reason"])

    return joined.mapInPandas(run, APPLIED)


def fix(files: DataFrame, edits_of: Callable[[Program], DataFrame] | None = None, max_passes: int = 20) -> tuple[DataFrame, int]:
    """(files, passes): edits applied until a pass changes nothing. Each pass
    sees the texts of the one before, since a deletion can leave more unused."""
    edits_of = edits_of or (lambda p: dead_code_fixes(p).where("status = 'apply'"))
    done = 0
    cur = cut(files.select("path", "text"), "fix")
    while done < max_passes:
        out = cut(apply_edits(cur, edits_of(Program(cur)).select("path", "start", "end", "new_text")), "fix")
        if not out.where("status = 'changed'").take(1):
            break
        done += 1
        cur = out.select("path", "text")
    return cur, done
