"""Text forms of a relation, after its rows were chosen and ordered by Spark."""

from __future__ import annotations

from sylvan.operators.relation import Relation


def cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value).replace("|", "\\|").replace("\n", " ")


def table(names: tuple[str, ...], rows: list) -> str:
    head = ["| " + " | ".join(names) + " |", "|" + "|".join(" --- " for _ in names) + "|"]
    return "\n".join([*head, *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)])


def tree(paths: list[str]) -> str:
    out, shown = [], set()
    for p in paths:
        parts = p.strip("/").split("/")
        for k in range(1, len(parts) + 1):
            at = "/".join(parts[:k])
            if at not in shown:
                shown.add(at)
                out.append("  " * (k - 1) + parts[k - 1])
    return "\n".join(out)


def grep(rows: list) -> str:
    out = []
    for r in rows:
        if r["lines"] is None:
            out.append(f"{r['path']}:{int(r['score'] or 0)}")
            continue
        text = (r["content"] or "").split("\n") if r["content"] is not None else None
        hits = {x["match"] for x in r["lines"]}
        for a, b in sorted({(x["start"], x["end"]) for x in r["lines"]}):
            for k in range(a, b + 1):
                mark = ":" if k in hits else "-"
                out.append(f"{r['path']}{mark}{k}" + (f"{mark}{text[k - 1]}" if text else ""))
    return "\n".join(out)


VERBS = {"write": "Wrote", "delete": "Deleted", "move": "Moved", "copy": "Copied", "edit": "Edited", "mkedge": "Linked"}


def render(out: Relation, output: tuple[str, ...] | None = None, limit: int | None = None) -> str:
    """All rows as text; with ``limit`` the first ones, and how many more there are."""
    errors = "\n".join(f"ERROR: {e}" for e in out.errors)
    rows = list(out.ordered().toLocalIterator()) if limit is None else out.ordered().limit(limit).collect()
    more = out.df.count() - limit if limit is not None and len(rows) == limit else 0
    errors = "\n".join(x for x in (f"({more} more)" if more else "", errors) if x)
    if output:
        names = out.project(output)
        body = "\n".join(r["path"] for r in rows) if names == ("path",) else table(names, rows)
        blank = [n for n in names if rows and all(r[n] is None for r in rows)]
        if blank:
            body += f"\n(no values: {', '.join(blank)})"
    elif out.function == "read":
        body = "\n".join((f"==> {r['path']} <==\n" if len(rows) > 1 else "") + (r["content"] or "") for r in rows)
    elif out.function == "grep":
        body = grep(rows)
    elif out.function == "tree":
        body = tree([r["path"] for r in rows])
    elif out.function == "stat":
        body = "\n\n".join("\n".join(f"{n}: {cell(r[n])}" for n in ("path", "kind", "size_bytes", "updated_at")) for r in rows)
    elif out.function in VERBS:
        body = "\n".join(f"{VERBS[out.function]} {r['path']}" for r in rows)
    elif any(r["score"] is not None for r in rows):
        body = table(("path", "score"), rows)
    else:
        body = "\n".join(r["path"] for r in rows)
    return "\n".join(x for x in (body, errors) if x)
