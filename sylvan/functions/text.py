"""Text: tokens and sizes as Columns; edits, diffs and version chains as Arrow-batched functions."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sylvan.functions.shipping import ship

QUERY_TERMS, SNAPSHOT_EVERY = 50, 10


def tokens_col(col: Column) -> Column:
    """Lower-case word tokens, by Unicode's idea of a word."""
    return F.filter(F.split(F.lower(col), r"(?U)\W+"), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    return [t for t in re.split(r"\W+", query.lower()) if t][:QUERY_TERMS]


def line_count_col(col: Column) -> Column:
    return F.when(col == "", 0).otherwise(F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit(""))) + 1)


@dataclass(frozen=True)
class Edited:
    content: str | None = None
    error: str | None = None
    method: str | None = None

    @property
    def success(self) -> bool:
        return self.error is None


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _blocks(lines: list[str], at: list[int], wanted: list[str]) -> list[tuple[int, int]]:
    """Character ranges of runs of lines that equal the wanted ones but for outer white space."""
    n, bare, want = len(wanted), [x.strip() for x in lines], [x.strip() for x in wanted]
    return [(at[k], at[k + n - 1] + len(lines[k + n - 1])) for k in range(len(lines) - n + 1) if bare[k : k + n] == want]


def _anchored(lines: list[str], at: list[int], wanted: list[str]) -> list[tuple[int, int]]:
    """The range between equal first and last lines whose middle is alike enough."""
    if len(wanted) < 3:
        return []
    bare, want = [x.strip() for x in lines], [x.strip() for x in wanted]
    spans = []
    for i in (k for k, x in enumerate(bare) if x == want[0]):
        j = next((k for k in range(i + 2, len(bare)) if bare[k] == want[-1]), None)
        if j is not None:
            spans.append((i, j))

    def alike(i: int, j: int) -> float:
        pairs = list(zip(bare[i + 1 : j], want[1:-1]))
        if not pairs:
            return 0.0
        return sum(1 - _distance(a, b) / max(len(a), len(b)) for a, b in pairs if a or b) / len(pairs)

    rated = [(alike(i, j), -k, (i, j)) for k, (i, j) in enumerate(spans)]
    if not rated:
        return []
    best = max(rated)
    i, j = best[2]
    return [(at[i], at[j] + len(lines[j]))] if best[0] >= (0.6 if len(rated) == 1 else 0.3) else []


def line_number(text: str, at: int) -> int:
    """The number, from 1, of the line that a place lies in."""
    return text.count("\n", 0, at) + 1


def in_context(text: str, start: int, end: int, around: int = 3) -> str:
    """The numbered lines of a stretch, marked, with some before and after."""
    lines, a, b = text.split("\n"), line_number(text, start), line_number(text, end)
    return "\n".join(f"{k:4d} {'>' if a <= k <= b else ' '} {lines[k - 1]}" for k in range(max(1, a - around), min(len(lines), b + around) + 1))


def _several(text: str, found: list[tuple[int, int]]) -> str:
    """What to say of a stretch that is found more than once: the line of each place and what stands around it."""
    shown = "\n\n---\n\n".join(f"Match at line {line_number(text, a)}:\n{in_context(text, a, b)}" for a, b in found)
    return f"Found {len(found)} matches; give more context to pick one.\n\n{shown}"


def edit(content: str, old: str, new: str, every: bool = False) -> Edited:
    """Replace a stretch: exact, else by trimmed lines, else by anchors with an alike middle."""
    if not old:
        return Edited(error="the text to replace is empty")
    if old == new:
        return Edited(error="old and new text are equal")
    content, old, new = (x.replace("\r\n", "\n") for x in (content, old, new))
    if (n := content.count(old)) and (every or n == 1):
        return Edited(content.replace(old, new), method="exact")
    if n:
        return Edited(error=_several(content, [m.span() for m in re.finditer(re.escape(old), content)]), method="exact")
    lines, wanted = content.split("\n"), old.removesuffix("\n").split("\n")
    at, k = [], 0
    for x in lines:
        at.append(k)
        k += len(x) + 1
    for method, found in (("line_trimmed", _blocks(lines, at, wanted)), ("block_anchor", _anchored(lines, at, wanted))):
        if not found:
            continue
        if every:
            return Edited(error=f"all can be replaced only by exact matches, not by {method}", method=method)
        if len(found) > 1:
            return Edited(error=_several(content, found), method=method)
        a, b = found[0]
        return Edited(content[:a] + new + content[b:], method=method)
    return Edited(error="text not found")


def edit_col(col: Column, old: str, new: str, every: bool = False) -> Column:
    """struct(success, content, error, method), in Arrow batches."""
    ship()

    @F.pandas_udf("success boolean, content string, error string, method string")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [edit(t or "", old, new, every) for t in texts]
        return pd.DataFrame({"success": [d.success for d in done], "content": [d.content for d in done], "error": [d.error for d in done], "method": [d.method for d in done]})

    return run(col)


END_MARK = "\\ No newline at end of file\n"


def diff(old: str, new: str) -> str:
    """A unified diff; lines end at line feeds alone."""
    cut = lambda t: [x for x in re.split(r"(?<=\n)", t) if x]
    out = []
    for line in difflib.unified_diff(cut(old), cut(new), "a", "b"):
        out.append(line if line.endswith("\n") else line + "\n" + END_MARK)
    return "".join(out)


def patch(base: str, changes: str) -> str:
    """The text after a unified diff; raises ValueError where the diff doesn't fit."""
    if not changes:
        return base
    source, out, at = [x for x in re.split(r"(?<=\n)", base) if x], [], 0
    rows = [x for x in re.split(r"(?<=\n)", changes) if x]
    k = 0
    while k < len(rows):
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", rows[k])
        k += 1
        if not m:
            continue
        first, n_old, n_new = int(m[1]), int(m[2] or 1), int(m[4] or 1)
        start = first - 1 if n_old else first
        if start < at or start + n_old > len(source):
            raise ValueError(f"the hunk at line {first} doesn't fit")
        out += source[at:start]
        got_old = got_new = 0
        while got_old < n_old or got_new < n_new:
            sign, body = rows[k][0], rows[k][1:]
            bare = k + 1 < len(rows) and rows[k + 1] == END_MARK
            if sign in " -":
                if source[start + got_old].rstrip("\n") != body.rstrip("\n"):
                    raise ValueError(f"line {start + got_old + 1} differs from the diff")
                got_old += 1
            if sign in " +":
                out.append(body[:-1] if bare else body)
                got_new += 1
            k += 1 + bare
        at = start + n_old
    return "".join(out + source[at:])


def replay(chain: list[tuple[bool, str]]) -> str:
    """A version from its chain of (is snapshot, stored text), the oldest first."""
    if chain and not chain[0][0]:
        raise ValueError("a chain begins with a snapshot")
    text = ""
    for whole, stored in chain:
        text = stored if whole else patch(text, stored)
    return text


def is_snapshot_col(number: Column) -> Column:
    return (number == 1) | (number % SNAPSHOT_EVERY == 0)
