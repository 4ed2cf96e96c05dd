"""The key space: absolute paths, and the metadata tree that mirrors it under /.meta.

Every rule exists twice: as a Python function for arguments on the driver, and as a
Column expression for data, which stays inside whole-stage codegen.
"""

from __future__ import annotations

import posixpath
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions.shipping import ship

ROOT, META, FRAME = "/", "/.meta", "__meta__"
KINDS = ("file", "directory", "chunk", "version", "edge", "api")
PLAIN_NAMES = frozenset(
    "makefile gnumakefile bsdmakefile kbuild dockerfile containerfile jenkinsfile vagrantfile procfile brewfile gemfile rakefile podfile fastfile justfile taskfile cmakelists license licence copying notice authors contributors maintainers owners codeowners readme changelog changes news history todo install version build workspace pipfile snakefile caddyfile".split()
)
_EDGE = re.compile(r"^/\.meta(?P<own>/.+?)/__meta__/edges/(?P<dir>out|in)/(?P<type>[^/]+)(?P<other>/.+)$")


def normalize(path: str) -> str:
    """NFC, absolute, without empty, '.' and '..' segments."""
    clean = unicodedata.normalize("NFC", path or "").strip()
    out = posixpath.normpath("/" + clean)
    return "/" + out.lstrip("/")


def validate(path: str) -> str | None:
    """What is wrong with a path, or None."""
    if any(unicodedata.category(c) == "Cc" for c in path):
        return "path has a control character"
    if len(path) > 1024:
        return "path is longer than 1024 characters"
    if any(len(s) > 255 for s in path.split("/")):
        return "a segment is longer than 255 characters"
    return None


def parent(path: str) -> str:
    return posixpath.dirname(path) or ROOT


def name(path: str) -> str:
    return posixpath.basename(path)


def ancestors(path: str) -> list[str]:
    """Proper ancestors below the root, the highest first."""
    parts = path.strip("/").split("/")
    return ["/" + "/".join(parts[:k]) for k in range(1, len(parts))]


def extension(path: str) -> str | None:
    base = name(path)
    dot = base.rfind(".")
    ext = base[dot + 1 :].lower() if dot > 0 else ""
    return ext if ext and len(ext) <= 32 else None


def kind_of(path: str) -> str:
    """The kind that a path's form implies."""
    p = normalize(path)
    if _EDGE.match(p):
        return "edge"
    for word, kind in (("chunks", "chunk"), ("versions", "version"), ("apis", "api")):
        if f"/{FRAME}/{word}/" in p:
            return kind
    if p == ROOT or p == META or p.startswith(META + "/"):
        return "directory"
    base = name(p)
    return "file" if "." in base or base.lower() in PLAIN_NAMES else "directory"


def mutable(path: str) -> str | None:
    """Why a path can't be written, or None."""
    p = normalize(path)
    if p in (ROOT, META):
        return f"{p} can't be changed"
    if not p.startswith(META + "/"):
        return None
    edge = split_edge(p)
    if edge:
        return None if edge.outgoing else "incoming edges are a view; write the outgoing edge"
    inside = f"/{FRAME}/" in p or p.endswith(f"/{FRAME}")
    return None if inside and kind_of(p) in ("chunk", "version", "api", "directory") else f"no free content under {META}: {p}"


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    type: str
    outgoing: bool = True


def edge_out(source: str, target: str, type: str) -> str:
    return f"{META}{source}/{FRAME}/edges/out/{type}{target}"


def edge_in(source: str, target: str, type: str) -> str:
    return f"{META}{target}/{FRAME}/edges/in/{type}{source}"


def split_edge(path: str) -> Edge | None:
    m = _EDGE.match(path)
    if not m:
        return None
    a, b = m["own"], m["other"]
    return Edge(a, b, m["type"]) if m["dir"] == "out" else Edge(b, a, m["type"], False)


def chunk_path(owner: str, chunk: str) -> str:
    return f"{META}{owner}/{FRAME}/chunks/{chunk}"


def version_path(owner: str, number: int) -> str:
    return f"{META}{owner}/{FRAME}/versions/{number}"


def api_path(owner: str, action: str) -> str:
    return f"{META}{owner}/{FRAME}/apis/{action}"


def owner_of(path: str) -> str:
    """The file that a metadata path belongs to; other paths are their own."""
    if not path.startswith(META + "/"):
        return path
    return path[len(META) :].split(f"/{FRAME}", 1)[0] or ROOT


def valid_user(user: str) -> bool:
    return bool(user) and not re.search(r"[/\x00-\x1f\x7f]|\.\.", user) and user not in (".", "..")


def scoped(path: str, user: str) -> str:
    """A user's path as stored; both ends of an edge move."""
    edge = split_edge(path)
    if edge:
        pick = edge_out if edge.outgoing else edge_in
        return pick(f"/{user}{edge.source}", f"/{user}{edge.target}", edge.type)
    if path.startswith(META + "/"):
        return f"{META}/{user}{path[len(META):]}"
    return f"/{user}" if path == ROOT else f"/{user}{path}"


def unscoped(path: str, user: str) -> str:
    edge = split_edge(path)
    cut = lambda p: (p[len(user) + 1 :] or ROOT) if p == f"/{user}" or p.startswith(f"/{user}/") else p
    if edge:
        return (edge_out if edge.outgoing else edge_in)(cut(edge.source), cut(edge.target), edge.type)
    return META + cut(path[len(META) :]) if path.startswith(META + "/") else cut(path)


# Column forms


@F.pandas_udf(T.StringType())
def _normalize_udf(paths: pd.Series) -> pd.Series:
    return paths.map(normalize, na_action="ignore")


def normalize_col(col: Column) -> Column:
    """Clean ASCII paths pass in the JVM; only others go to Python, in Arrow batches."""
    ship()
    clean = col.rlike(r"^(/[!-.0-~]+)+$") & ~col.rlike(r"/\.\.?(/|$)")
    return F.when(clean, col).otherwise(_normalize_udf(F.when(~clean, col)))


def parent_col(col: Column) -> Column:
    up = F.regexp_replace(col, "/[^/]*$", "")
    return F.when(up == "", ROOT).otherwise(up)


def name_col(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def extension_col(col: Column) -> Column:
    found = F.lower(F.regexp_extract(name_col(col), r"(?s)^.+\.([^.]{1,32})$", 1))
    return F.when(found != "", found)


def depth_col(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("/"), F.lit("")))


def kind_col(col: Column) -> Column:
    base = name_col(col)
    out = F.when(col.rlike(r"^/\.meta/.+?/__meta__/edges/(out|in)/[^/]+/.+"), "edge")
    for word, kind in (("chunks", "chunk"), ("versions", "version"), ("apis", "api")):
        out = out.when(col.contains(f"/{FRAME}/{word}/"), kind)
    out = out.when((col == ROOT) | (col == META) | col.startswith(META + "/"), "directory")
    return out.when(base.contains(".") | F.lower(base).isin(*sorted(PLAIN_NAMES)), "file").otherwise("directory")


def ancestors_col(col: Column) -> Column:
    """Array of the proper ancestors below the root."""
    parts = F.split(F.substring(col, 2, 1 << 20), "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return F.when(F.size(parts) > 1, ups).otherwise(F.array().cast("array<string>"))


def edge_out_col(source: Column, target: Column, type: Column) -> Column:
    return F.concat(F.lit(META), source, F.lit(f"/{FRAME}/edges/out/"), type, target)


def edge_in_col(source: Column, target: Column, type: Column) -> Column:
    return F.concat(F.lit(META), target, F.lit(f"/{FRAME}/edges/in/"), type, source)


def split_edge_col(col: Column) -> Column:
    """struct(source, target, type, outgoing) of an edge path."""
    part = lambda k: F.regexp_extract(col, r"^/\.meta(/.+?)/__meta__/edges/(out|in)/([^/]+)(/.+)$", k)
    out = part(2) == "out"
    own, other = part(1), part(4)
    return F.when(part(2) != "", F.struct(F.when(out, own).otherwise(other).alias("source"), F.when(out, other).otherwise(own).alias("target"), part(3).alias("type"), out.alias("outgoing")))


def within_col(col: Column, root: str) -> Column:
    """The path itself or below it; a prefix test reaches the scan."""
    return F.lit(True) if root == ROOT else (col == root) | col.startswith(root + "/")
