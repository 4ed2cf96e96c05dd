"""A namespace: mounts of entry tables, permissions, users, and the lowering of queries.

Reads are lazy: a query becomes one DataFrame plan over the union of the mounts it can
touch (others are pruned by prefix). Writes replace a mount's entries by the next ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import paths as P
from sylvan.operators import graph as Gr
from sylvan.operators import grep as Gp
from sylvan.operators import lexical as L
from sylvan.operators import scan as S
from sylvan.operators import store as W
from sylvan.operators import vector as V
from sylvan.operators.relation import Relation
from sylvan.plans import language as Q
from sylvan.schema import ENTRY
from sylvan.sources.staging import cut

ERRORS_SHOWN = 1000
WRITES = {"write", "mkdir", "mkedge", "edit", "delete", "move", "copy"}


class PermissionMap:
    """A default and prefix rules; the longest prefix decides."""

    def __init__(self, default: str = "read_write", rules: dict[str, str] | None = None):
        for p in (default, *(rules or {}).values()):
            if p not in ("read", "read_write"):
                raise ValueError(f"unknown permission {p!r}")
        self.default = default
        self.rules = {P.normalize(k): v for k, v in (rules or {}).items()}

    def resolve(self, path: str) -> str:
        own = P.owner_of(P.normalize(path))
        hit = [p for p in self.rules if own == p or p == "/" or own.startswith(p + "/")]
        return self.rules[max(hit, key=len)] if hit else self.default

    def check(self, path: str) -> str | None:
        return None if self.resolve(path) == "read_write" else f"Cannot write to read-only path: {path}"


class Namespace:
    def __init__(self, entries: DataFrame, permissions: PermissionMap | None = None, embedder: Callable[[str], Sequence[float]] | None = None, user_scoped: bool = False):
        self.entries = entries
        self.permissions = permissions or PermissionMap()
        self.embedder = embedder
        self.user_scoped = user_scoped
        self.mounts: dict[str, Namespace] = {}

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def mount(self, name: str, other: Namespace) -> None:
        """Attaches a namespace under one segment."""
        if not re.fullmatch(r"/?[^/]+", name) or name.strip("/") in (".", "..", ".meta"):
            raise ValueError(f"a mount is one segment, not {name!r}")
        self.mounts["/" + name.strip("/")] = other

    def unmount(self, name: str) -> None:
        del self.mounts["/" + name.strip("/")]

    def resolve(self, path: str) -> tuple[Namespace, str, str]:
        """(namespace, its prefix here, the path inside it), through nested mounts."""
        path = P.normalize(path)
        for prefix, other in self.mounts.items():
            if path == prefix or path.startswith(prefix + "/"):
                inner, deeper, rest = other.resolve(path[len(prefix) :] or "/")
                return inner, prefix + deeper, rest
        return self, "", path

    def all_entries(self, touching: Iterable[str] | None = None) -> DataFrame:
        """Rows of this namespace and of its mounts, at their paths here; own rows under a mount are hidden."""
        rows = self.entries
        for prefix in self.mounts:
            rows = rows.where(~P.within_col(F.col("path"), prefix))
        for prefix, other in self.mounts.items():
            if touching is not None and not any(t == "/" or t == prefix or t.startswith(prefix + "/") or prefix.startswith(t.rstrip("/") + "/") or t.startswith(P.META) for t in touching):
                continue
            sub = other.all_entries()
            lead = lambda c, p=prefix: F.when(F.col(c) == "/", p).when(F.col(c).startswith(P.META + "/"), F.concat(F.lit(P.META + p), F.substr(c, F.lit(len(P.META) + 1)))).when(F.col(c).isNotNull(), F.concat(F.lit(p), F.col(c)))
            source, target = lead("source_path"), lead("target_path")
            path = F.when(F.col("kind") == "edge", P.edge_out_col(source, target, F.col("edge_type"))).otherwise(lead("path"))
            rows = rows.unionByName(sub.withColumns({"path": path, "source_path": source, "target_path": target}).withColumn("parent_path", P.parent_col(F.col("path"))).select(*ENTRY.fieldNames()))
        return rows

    def view(self, user: str | None = None, touching: Iterable[str] | None = None) -> DataFrame:
        """What a user sees: their own tree at the root; everything without users."""
        rows = self.all_entries(touching)
        if not self.user_scoped:
            return rows
        if not user or not P.valid_user(user):
            raise ValueError("a valid user is required")
        lead = f"/{user}"
        cut_lead = lambda c: F.when(F.col(c) == lead, "/").when(F.col(c).startswith(lead + "/"), F.substr(c, F.lit(len(lead) + 1))).when(F.col(c).startswith(f"{P.META}{lead}/"), F.concat(F.lit(P.META), F.substr(c, F.lit(len(P.META + lead) + 1))))
        rows = rows.where(F.col("path").startswith(lead + "/") | F.col("path").startswith(f"{P.META}{lead}/"))
        source, target = cut_lead("source_path"), cut_lead("target_path")
        rows = rows.where((F.col("kind") != "edge") | (source.isNotNull() & target.isNotNull()))
        path = F.when(F.col("kind") == "edge", P.edge_out_col(source, target, F.col("edge_type"))).otherwise(cut_lead("path"))
        return rows.withColumns({"path": path, "source_path": source, "target_path": target}).withColumn("parent_path", P.parent_col(F.col("path"))).select(*ENTRY.fieldNames())

    # writes

    def _apply(self, change: W.Change) -> Relation:
        """Takes over the rows after a change. Of what it refused the first are listed, and the rest is counted."""
        refused = cut(change.errors, "refused")
        errors = [f"{r['path']}: {r['error']}" for r in refused.orderBy("path", "error").limit(ERRORS_SHOWN).collect()]
        if len(errors) == ERRORS_SHOWN and (more := refused.count() - ERRORS_SHOWN):
            errors.append(f"and {more} more")
        touched = replace(change.touched, df=cut(change.touched.df, "touched"))
        self.entries = cut(change.entries, "entries")
        return replace(touched, errors=tuple(errors))

    def _nothing(self, function: str, errors: Iterable[str] = ()) -> Relation:
        return Relation.by_path(self.entries.where("false").select("path", "kind"), function, errors)

    def _denied(self, paths: Iterable[str], function: str) -> Relation | None:
        bad = []
        for p in paths:
            inner, prefix, rest = self.resolve(p)
            why = self.permissions.check(p) or (inner.permissions.check(rest) if inner is not self else None) or P.mutable(rest)
            if why:
                bad.append(why)
        return self._nothing(function, bad) if bad else None

    def _own(self, path: str, user: str | None) -> str:
        """The stored form of a user's path. In a namespace of users nothing is changed without one."""
        if not self.user_scoped:
            return P.normalize(path)
        if not user or not P.valid_user(user):
            raise ValueError("a valid user is required")
        return P.scoped(P.normalize(path), user)

    def _shown(self, out: Relation | None, user: str | None, function: str) -> Relation:
        """A change as its user sees it."""
        if out is None:
            return self._nothing(function)
        if not self.user_scoped:
            return out
        cut_lead = lambda e: e.replace(f"{P.META}/{user}/", P.META + "/").replace(f"/{user}/", "/")
        return replace(out.strip_scope(user), errors=tuple(map(cut_lead, out.errors)))

    def _routed(self, paths: Iterable[str]) -> list[tuple[Namespace, str, list[str]]]:
        """(namespace, its prefix, the paths inside it) for each mount that the paths lie in."""
        by: dict[int, tuple[Namespace, str, list[str]]] = {}
        for p in paths:
            inner, prefix, rest = self.resolve(p)
            by.setdefault(id(inner), (inner, prefix, []))[2].append(rest)
        return list(by.values())

    def _each(self, paths: list[str], user: str | None, function: str, change: Callable[[DataFrame, list[str]], W.Change]) -> Relation:
        """One change to each mount that the paths lie in, where none of them is denied."""
        paths = [self._own(p, user) for p in paths]
        if (no := self._denied(paths, function)) is not None:
            return self._shown(no, user, function)
        out = None
        for inner, prefix, own in self._routed(paths):
            done = inner._apply(change(inner.entries, own))
            done = done.add_prefix(prefix) if prefix else done
            out = done if out is None else out | done
        return self._shown(out, user, function)

    def write(self, rows: Iterable[tuple[str, str]], overwrite: bool = True, user: str | None = None) -> Relation:
        rows = [(self._own(p, user), c) for p, c in rows]
        if (no := self._denied((p for p, _ in rows), "write")) is not None:
            return self._shown(no, user, "write")
        owner = user if self.user_scoped else None
        by: dict[int, tuple[Namespace, str, list]] = {}
        for p, c in rows:
            inner, prefix, rest = self.resolve(p)
            by.setdefault(id(inner), (inner, prefix, []))[2].append((rest, c, owner))
        out = None
        for inner, prefix, own in by.values():
            done = inner._apply(W.write(inner.entries, self.spark.createDataFrame(own, "path string, content string, owner_id string"), overwrite))
            done = done.add_prefix(prefix) if prefix else done
            out = done if out is None else out | done
        return self._shown(out, user, "write")

    def delete(self, paths: Iterable[str], permanent: bool = False, cascade: bool = True, user: str | None = None) -> Relation:
        return self._each(list(paths), user, "delete", lambda e, own: W.delete(e, own, permanent, cascade))

    def mkdir(self, paths: Iterable[str], user: str | None = None) -> Relation:
        return self._each(list(paths), user, "mkdir", W.mkdir)

    def edit(self, paths: Iterable[str], edits: Iterable[tuple[str, str, bool]], user: str | None = None) -> Relation:
        edits = list(edits)
        return self._each(list(paths), user, "edit", lambda e, own: W.edit(e, own, edits))

    def mkedge(self, source: str, target: str, type: str, user: str | None = None) -> Relation:
        return self.mkedges([(source, target, type)], user)

    def mkedges(self, links: Iterable[tuple[str, str, str]], user: str | None = None) -> Relation:
        """Edges (source, target, type), one change for each mount; both ends of an edge lie in one."""
        links = [(self._own(a, user), self._own(b, user), t) for a, b, t in links]
        ends = [(self.resolve(a), self.resolve(b), t) for a, b, t in links]
        if any(a[0] is not b[0] for a, b, _ in ends):
            return self._nothing("mkedge", ["both ends of an edge lie in one mount"])
        if (no := self._denied((P.edge_out(a, b, t) for a, b, t in links), "mkedge")) is not None:
            return self._shown(no, user, "mkedge")
        by: dict[int, tuple[Namespace, str, list]] = {}
        for a, b, t in ends:
            by.setdefault(id(a[0]), (a[0], a[1], []))[2].append((a[2], b[2], t))
        out = None
        for inner, prefix, own in by.values():
            done = inner._apply(W.mkedge(inner.entries, self.spark.createDataFrame(own, "source string, target string, type string")))
            done = done.add_prefix(prefix) if prefix else done
            out = done if out is None else out | done
        return self._shown(out, user, "mkedge")

    def transfer(self, src: str, dest: str, remove: bool, overwrite: bool = True, user: str | None = None) -> Relation:
        return self.transfers([(src, dest)], remove, overwrite, user)

    def transfers(self, pairs: Iterable[tuple[str, str]], remove: bool, overwrite: bool = True, user: str | None = None) -> Relation:
        """Copies or moves (source, destination): one change for each pair of mounts, nothing where one of them is denied."""
        name, owner = "move" if remove else "copy", user if self.user_scoped else None
        pairs = [(self._own(a, user), self._own(b, user)) for a, b in pairs]
        if (no := self._denied([p for pair in pairs for p in (pair if remove else pair[1:])], name)) is not None:
            return self._shown(no, user, name)
        by: dict[tuple[int, int], tuple] = {}
        for a, b in ((self.resolve(x), self.resolve(y)) for x, y in pairs):
            by.setdefault((id(a[0]), id(b[0])), (a[0], b[0], b[1], []))[3].append((a[2], b[2]))
        out = None
        for source, target, prefix, own in by.values():
            table = self.spark.createDataFrame(own, "src string, dest string")
            if source is target:
                done = source._apply((W.move(source.entries, *own[0]) if len(own) == 1 else W.moves(source.entries, table)) if remove else W.copy(source.entries, table, overwrite, owner=owner))
            else:
                into, gone = W.transfer(source.entries, target.entries, table, remove, overwrite, owner=owner)
                gone = cut(gone.entries, "entries") if gone is not None else None
                done = replace(target._apply(into), function=name)
                source.entries = source.entries if gone is None else gone
            done = done.add_prefix(prefix) if prefix else done
            out = done if out is None else out | done
        return self._shown(out, user, name)

    # queries

    def query(self, text: str | Q.QueryPlan, user: str | None = None) -> Relation:
        plan = Q.parse(text) if isinstance(text, str) else text
        run = _Run(self, user)
        out = run.node(plan.tree, None)
        if plan.output:
            names = [f for n in plan.output for f in (out.project([n]) if n != "all" else ())]
            out = out.hydrate(run.entries, names)
        return out

    def cli(self, text: str, user: str | None = None, limit: int | None = None) -> str:
        from sylvan.plans.render import render

        plan = Q.parse(text)
        return render(self.query(plan, user), plan.output, limit)


class _Run:
    """One query; the entries are read once and shared by its stages."""

    def __init__(self, space: Namespace, user: str | None):
        self.space, self.user = space, user

    @property
    def entries(self) -> DataFrame:
        return self.space.view(self.user)

    def edges(self) -> DataFrame:
        return Gr.edges_of(self.entries)

    def node(self, node: object, given: Relation | None) -> Relation:
        if isinstance(node, Q.Union):
            out = self.node(node.parts[0], given)
            for p in node.parts[1:]:
                out = out | self.node(p, given)
            return out
        if isinstance(node, Q.Pipeline):
            out = self.node(node.source, given)
            for s in node.stages:
                out = self.node(s, out)
            return out
        if isinstance(node, Q.SetStage):
            other = self.node(node.query, None)
            return given & other if node.verb == "intersect" else given - other
        return self.stage(node, given)

    def see(self, out: Relation, flags: dict, *kinds: str) -> Relation:
        if "--all" in flags:
            return out
        return out.visible(*kinds, *flags.get("--include", ()))

    def told(self, out: Relation, wanted: list[str], tree: bool = False) -> Relation:
        """With an error for each path asked for that isn't there; of a tree's roots also for those that are no directories."""
        known = {r["path"]: r["kind"] for r in S.stat(self.entries, wanted).df.select("path", "kind").toLocalIterator()}
        errors = [f"Not found: {p}" for p in dict.fromkeys(map(P.normalize, wanted)) if p not in known and p not in (P.ROOT, P.META)]
        errors += [f"Not a directory: {p}" for p, kind in known.items() if tree and kind != "directory"]
        return replace(out, errors=out.errors + tuple(errors))

    def stage(self, s: Q.Stage, given: Relation | None) -> Relation:
        f, a, e, space = s.flags, list(s.args), self.entries, self.space
        want = given if given is not None and not a else a
        if s.verb in WRITES and space.user_scoped and self.user is None:
            raise ValueError("a valid user is required")
        match s.verb:
            case "read":
                return self.told(S.read(e, want), a) if a else S.read(e, want)
            case "stat":
                return self.told(S.stat(e, want), a) if a else S.stat(e, want)
            case "ls":
                return S.ls(e, want or ["/"], self.edges())
            case "tree":
                every = "--all" in f or "--include" in f
                if given is not None and not a:
                    out = S.trees(e, given.df.where(F.coalesce("kind", P.kind_col(F.col("path"))) == "directory").select("path"), f.get("--depth"), every)
                else:
                    roots = [P.normalize(r) for r in a or ["/"]]
                    out = S.tree(e, roots[0], f.get("--depth"), every)
                    for r in roots[1:]:
                        out = out | S.tree(e, r, f.get("--depth"), every)
                    out = self.told(out, [r for r in roots if r != "/"], True) if a else out
                return self.see(out, f, "file", "directory") if every else out
            case "glob":
                files = tuple(f.get("--type", ()))
                out = S.glob(e, a[0], a[1:], files, f.get("--max-count"), given)
                return self.see(out, f, "file", "directory")
            case "grep":
                case = "insensitive" if "--ignore-case" in f else "smart" if "--smart-case" in f else "sensitive"
                globs = f.get("--glob", ())
                around = f.get("--context", 0)
                out = Gp.grep(e, a[0], a[1:], f.get("--type", ()), f.get("--type-not", ()), [g for g in globs if not g.startswith("!")], [g[1:] for g in globs if g.startswith("!")], case, "--fixed-strings" in f, "--word-regexp" in f, "--invert-match" in f, f.get("--before-context", around), f.get("--after-context", around), "files" if "--files-with-matches" in f else "count" if "--count" in f else "lines", f.get("--max-count"), given)
                return self.see(out, f, "file", "directory")
            case "lsearch":
                return self.see(L.lexical_search(e, a[0], f.get("--k", 15), given), f, "file", "directory")
            case "vsearch":
                return self.see(V.vector_search(S.live(e).select("path", "embedding"), Q.vector_of(s.args), f.get("--k", 15), candidates=given), f, "file", "directory")
            case "search":
                if space.embedder is None:
                    raise ValueError("search needs an embedder")
                return self.see(V.semantic_search(S.live(e).select("path", "embedding"), a[0], space.embedder, f.get("--k", 15), candidates=given), f, "file", "directory")
            case "predecessors" | "successors" | "ancestors" | "descendants":
                return getattr(Gr, s.verb)(self.edges(), want)
            case "neighborhood":
                return self.see(Gr.neighborhood(self.edges(), want, f.get("--depth", 2)), f, "file", "directory", "edge")
            case "meetinggraph":
                return self.see(Gr.meeting_subgraph(self.edges(), want, "--min" in f), f, "file", "directory", "edge")
            case "pagerank" | "hits":
                return getattr(Gr, s.verb)(self.edges(), candidates=want if a or given is not None else None)
            case "betweenness" | "closeness":
                return getattr(Gr, s.verb + "_centrality")(self.edges(), want if a or given is not None else None)
            case "degree" | "indegree" | "outdegree":
                out = Gr.degree_centrality(self.edges(), {"degree": "both", "indegree": "in", "outdegree": "out"}[s.verb])
                return out if given is None and not a else out._with(out.df.join(S.seeds(e, want), "path", "left_semi").select(*out.df.columns))
            case "sort":
                return self.need(given, s).sort("--asc" not in f)
            case "top":
                return self.need(given, s).top(int(a[0]))
            case "kinds":
                return self.need(given, s).kinds(*a)
            case "write" | "mkdir" if given is not None:
                raise ValueError(f"{s.verb} takes no piped input")
            case "write":
                return space.write([(a[0], a[1])], "--no-overwrite" not in f, self.user)
            case "mkdir":
                return space.mkdir(a, self.user)
            case "delete":
                return space.delete(a or self.piped(given, s), user=self.user)
            case "edit":
                old, new = a[-2:]
                return space.edit(a[:-2] or self.piped(given, s), [(old, new, "--all" in f)], self.user)
            case "mkedge":
                x, y = a[-2:]
                target, kind = (x, y) if "/" in x and "/" not in y else (y, x)
                return space.mkedges([(p, target, kind) for p in (a[:1] if len(a) == 3 else self.piped(given, s))], self.user)
            case "move" | "copy":
                pairs = [(a[0], a[1])] if len(a) == 2 else [(p, a[0].rstrip("/") + p) for p in self.piped(given, s)]
                return space.transfers(pairs, s.verb == "move", "--no-overwrite" not in f, self.user)
        raise ValueError(s.verb)

    def piped(self, given: Relation | None, s: Q.Stage) -> list[str]:
        """The paths that a change is applied to, which is one batch however many they are."""
        return [r[0] for r in self.need(given, s).df.select("path").distinct().orderBy("path").toLocalIterator()]

    def need(self, given: Relation | None, s: Q.Stage) -> Relation:
        if given is None:
            raise ValueError(f"{s.verb} needs something before it")
        return given
