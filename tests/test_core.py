"""Driver-side functions: paths, patterns, edits, diffs, the language."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sylvan.functions import paths as P
from sylvan.functions import patterns as G
from sylvan.functions import text as X
from sylvan.plans import language as Q
from sylvan.plans.namespace import PermissionMap


def test_paths():
    assert P.normalize("a//b/../c/.") == "/a/c" and P.normalize("") == "/"
    assert P.normalize("/e\u0301") == "/\u00e9"
    assert P.kind_of("/x/Makefile") == "file" and P.kind_of("/x/.env") == "file" and P.kind_of("/x/y") == "directory"
    assert P.kind_of(P.chunk_path("/a.py", "c1")) == "chunk" and P.kind_of(P.version_path("/a.py", 3)) == "version"
    assert P.extension("/a/b.TAR.GZ") == "gz" and P.extension("/a/.env") is None
    assert P.validate("/a\x00") and P.validate("/" + "x" * 256) and not P.validate("/ok")
    assert P.ancestors("/a/b/c.txt") == ["/a", "/a/b"]
    assert P.mutable("/") and P.mutable("/.meta/x") and not P.mutable(P.edge_out("/a", "/b", "t"))


def test_edges_and_scopes():
    e = P.edge_out("/a.py", "/b/c.py", "imports")
    assert P.split_edge(e) == P.Edge("/a.py", "/b/c.py", "imports")
    assert P.split_edge(P.edge_in("/a.py", "/b/c.py", "imports")) == P.Edge("/a.py", "/b/c.py", "imports", False)
    assert P.unscoped(P.scoped(e, "u1"), "u1") == e and P.scoped("/x", "u1") == "/u1/x"
    assert P.owner_of(P.version_path("/d/a.py", 2)) == "/d/a.py"


@pytest.mark.parametrize("pattern, yes, no", [
    ("/a/*.py", "/a/x.py", "/a/b/x.py"), ("/a/**/*.py", "/a/b/c/x.py", "/b/x.py"), ("/a/**/*.py", "/a/x.py", "/a/x.pyc"), ("**/x?.md", "/q/x1.md", "/q/x12.md"),
    ("/[!a]/z", "/b/z", "/a/z"), ("/a[", "/a[", "/ab"), ("/{a,b}", "/{a,b}", "/a"), ("x.md", "/x.md", "/y/x.md"),
])
def test_globs(pattern, yes, no):
    r = re.compile(G.glob_regex(pattern))
    assert r.match(yes) and not r.match(no)
    prefix, _, _ = G.glob_parts(pattern)
    assert yes.startswith(prefix)


def test_lines():
    assert G.line_regex("Ab", "smart").startswith("(?Ud)") and "i" in G.line_regex("ab", "smart")[:5]
    assert "(?<x>a)" in G.line_regex("(?P<x>a)")
    assert G.literals("foo.*barr") == ["foo", "barr"] and G.literals("a|bcd") == [] and G.literals("def (x)?") == []
    assert G.extensions_of(["python", "js", "xyz"]) == ["py", "pyi", "cjs", "js", "mjs", "xyz"]


def test_type_names():
    expand = lambda *names: sorted(G.extensions_of(names))
    assert expand("cpp") == sorted(["cpp", "cc", "cxx", "hpp", "hh", "hxx", "h"]) and expand("cs") == expand("csharp") == ["cs"]
    assert expand("js", "jsx") == ["cjs", "js", "jsx", "mjs"] and expand("tf") == expand("terraform") == ["tf", "tfvars"] and expand("make") == ["mak", "makefile", "mk"]
    assert expand("bash") == ["bash", "fish", "sh", "zsh"] and expand("zsh") == ["zsh"] and expand("md") == ["markdown", "md", "mdown", "mkdn"] and expand("Mjs") == ["mjs"]
    assert expand("perl") == ["pl", "pm", "t"] and expand("docker") == ["dockerfile"] and expand("patch") == ["diff", "patch"] and len(G.TYPES) >= 79


def test_edit_tells_where():
    done = X.edit("one\ntwo\nthree\ntwo\nfive\nsix\nseven\neight", "two", "2")
    assert "Found 2 matches" in done.error and "Match at line 2:" in done.error and "   2 > two" in done.error and "   7   seven" in done.error and "   8   eight" not in done.error.split("Match at line 2:")[1].split("---")[0]


def test_edit_levels():
    assert X.edit("a b a", "b", "c").content == "a c a"
    assert not X.edit("a b a", "a", "c").success and X.edit("a b a", "a", "c", True).content == "c b c"
    assert X.edit("x\n  foo  \ny", "foo\n", "bar").method in ("exact", "line_trimmed")
    assert X.edit("x\n  foo\n  baz\ny", "foo\nbaz", "bar").content == "x\nbar\ny"
    got = X.edit("start\n one two three\nend\n", "start\none two threE\nend", "Z")
    assert got.method == "block_anchor" and got.content == "Z\n"
    assert not X.edit("abc", "", "x").success and not X.edit("abc", "q", "x").success and not X.edit("a", "a", "a").success


@given(st.text("ab\n", max_size=30), st.text("abc\n", max_size=30))
def test_diff_round_trip(a, b):
    assert X.patch(a, X.diff(a, b)) == b


def test_replay():
    texts = ["a\nb\n", "a\nc", "", "x\ny\n"]
    chain = [(True, texts[0])] + [(False, X.diff(p, q)) for p, q in zip(texts, texts[1:])]
    assert [X.replay(chain[: k + 1]) for k in range(4)] == texts
    with pytest.raises(ValueError):
        X.replay([(False, "x")])


def test_language():
    plan = Q.parse("glob '/a b/**' | grep -i -C 2 \"x|y\" | top 3 --output path,score & (ls / | sort --asc)")
    assert plan.verbs == ("glob", "grep", "top", "ls", "sort") and plan.output == ("path", "score")
    assert isinstance(plan.tree, Q.Union) and plan.tree.parts[0].stages[0].flags["--context"] == 2
    assert Q.parse("cat /x | except (rm /y)").verbs == ("read", "delete", "except")
    for bad in ("", "nope", "glob", "top x", "ls --all --include file", "grep a -l -c", "kinds foo", "(ls", "ls )", "intersect (ls)", "ls --output nope", "grep 'a"):
        with pytest.raises(Q.QuerySyntaxError):
            Q.parse(bad)


def test_permissions():
    p = PermissionMap("read", {"/a": "read_write", "/a/b": "read"})
    assert p.resolve("/a/x") == "read_write" and p.resolve("/a/b/c") == "read" and p.resolve("/ab") == "read"
    assert p.resolve(P.version_path("/a/x", 1)) == "read_write" and "Cannot write" in p.check("/z")
