"""Globs and line patterns as Java regular expressions, with the parts of them that prune."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions, and the type names that stand for them beside their own.
_TYPES = """
clj cljs cljc edn: clojure | cls sty ltx tex: tex | cfg ini: ini | cc cpp cxx h hh hpp hxx: cpp cxx | c h: c | cmake: cmake | cs: cs csharp
css: css | csv: csv | diff patch: diff patch | dockerfile: docker dockerfile | erl hrl: erlang | ex exs: elixir | fish: fish | fish zsh bash sh: bash sh
go: go | gql graphql: gql graphql | groovy gsh gvy gy: groovy | hs lhs: haskell | htm html: html | java: java | cjs js mjs: javascript js
json: json | jsonc: jsonc | jsonl ndjson: jsonl | jsx: jsx | kt kts: kotlin kt | less: less | log: log | lua: lua | mak makefile mk: make makefile
markdown md mdown mkdn: markdown md | ml mli: ocaml | nix: nix | org: org | php phps phtml: php | pl pm t: perl pl | proto: proto protobuf
py pyi: py python | r: r | rb rbw: rb ruby | rs: rs rust | rst: rst | sass scss: sass scss | sc scala: scala | sql: sql | svelte: svelte | swift: swift
tf tfvars: terraform tf | hcl tf tfvars: hcl | toml: toml | ts tsx: ts typescript | tsv: tsv | tsx: tsx | text txt: txt | vue: vue | xml: xml | yaml yml: yaml yml | zig: zig | zsh: zsh
"""
TYPES: dict[str, tuple[str, ...]] = {n: tuple(e.split()) for e, names in (x.split(":") for x in _TYPES.replace("\n", "|").split("|") if x.strip()) for n in names.split()}


def extensions_of(names: tuple[str, ...] | list[str]) -> list[str]:
    """Type names (or bare extensions) as distinct lower-case extensions."""
    return list(dict.fromkeys(e for n in names for e in TYPES.get(n.lower().lstrip("."), (n.lower().lstrip("."),))))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: * and ? stay in a segment, ** crosses, [..] and [!..] are sets, braces are literal."""
    p = pattern if pattern.startswith("/") else "/" + pattern
    out, k = [], 0
    while k < len(p):
        c = p[k]
        if p.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif p.startswith("**", k):
            out.append(".*")
            k += 2
        elif c in "*?":
            out.append("[^/]*" if c == "*" else "[^/]")
            k += 1
        elif c == "[" and (end := p.find("]", k + (3 if p[k + 1 : k + 2] == "!" else 2))) > 0:
            body = p[k + 1 : end]
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
            k = end + 1
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_" else c)
            k += 1
    return "^(?s:" + "".join(out) + ")$"


def glob_parts(pattern: str) -> tuple[str, str | None, bool]:
    """(literal prefix, extension that the tail implies or None, whether both say it all)."""
    p = pattern if pattern.startswith("/") else "/" + pattern
    cut = min((p.find(c) for c in "*?[" if c in p), default=len(p))
    prefix, tail = p[:cut], p[cut:]
    m = re.fullmatch(r"(?:\*\*/)?\*\.([A-Za-z0-9]{1,32})", tail)
    ext = m[1] if m and m[1] == m[1].lower() else None
    return prefix, ext, bool(ext) and tail.startswith("**/") and prefix.endswith("/")


def glob_col(col: Column, pattern: str) -> Column:
    """A prefix test that is pushed to the scan, and the whole pattern behind it."""
    prefix, _, _ = glob_parts(pattern)
    test = F.regexp_like(col, F.lit(glob_regex(pattern)))
    return col.startswith(prefix) & test if len(prefix) > 1 else test


def line_regex(pattern: str, case: str = "sensitive", fixed: bool = False, word: bool = False) -> str:
    """A Python pattern for lines as Java writes it: Unicode classes, only line feeds end lines.

    case: sensitive, insensitive, or smart (insensitive if the pattern has no capital).
    """
    p = re.escape(pattern) if fixed else re.sub(r"\(\?P<(\w+)>", r"(?<\1>", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)).replace(r"\Z", r"\z")
    if word:
        p = rf"\b(?:{p})\b"
    loose = case == "insensitive" or case == "smart" and pattern == pattern.lower()
    return f"(?{'iu' if loose else ''}Ud){p}"


def literals(pattern: str, fixed: bool = False) -> list[str]:
    """Runs of letters and digits that every match has; none where that isn't plain to see."""
    if fixed:
        return re.findall(r"\w{3,}", pattern)[:8]
    if re.search(r"[|(?]|\{", pattern):
        return []
    plain = re.sub(r"\\.", "\0", re.sub(r"\[[^\]]*\]", "\0", pattern))
    plain = re.sub(r".[*]", "\0", plain)
    return [w for w in re.findall(r"[A-Za-z0-9]{3,}", plain.replace("+", "\0"))][:8]
