"""Rows of source code and of version control, and column functions of names and paths."""

from pyspark.sql import functions as F

from plexus.functions import scalars as S
from plexus.operators import evidence, resolve
from plexus.plans import snapshot
from plexus.sources import changes, python_code
from plexus.streaming import delta

PACKAGE = {
    "src/app/__init__.py": "from .core import run as start\nfrom ...too import far\n",
    "src/app/core.py": """import os
from .base import Base, helper
import a.b.c

# TODO: mend
class Job(Base):
    def run(self, n):
        self.step(n)
        helper()
        os.path.join("x")
        return late()

    def step(self, helper):
        helper()

def late():
    def inner():
        return Job()
    return inner()

def run():
    late()

def test_run():
    run()
""",
    "src/app/base.py": "def helper():\n    pass\n\nclass Base:\n    def step(self):\n        pass\n",
    "src/app/use.py": "from app import start\nstart()\nunknown()\n",
    "bad.py": "x = (\n",
    "none.py": None,
    "skip.txt": "import x",
}


def test_module_paths():
    assert python_code.module_path("src/a/b.py") == ("a::b", "a", False)
    assert python_code.module_path("a/__init__.py") == ("a", "a", True) and python_code.module_path("__init__.py") == ("", "", True)
    assert python_code.absolute("c.d", 0, "a") == "c::d" and python_code.absolute("", 0, "a") is None
    assert python_code.absolute("c", 1, "a::b") == "a::b::c" and python_code.absolute("c", 2, "a::b") == "a::c" and python_code.absolute("", 1, "a") == "a"
    assert python_code.absolute("c", 3, "a::b") == "c" and python_code.absolute("c", 4, "a::b") is None


def test_python(spark):
    rows = python_code.python_rows(spark.createDataFrame(list(PACKAGE.items()), "path string, content string")).collect()
    of = lambda row, path: {(r.kind, r.name, r.owner, tuple(r.keys)) for r in rows if r.row == row and r.path == path}
    core = "src/app/core.py"
    assert {(k, n, o) for k, n, o, _ in of("node", core)} == {
        ("file", core, ""), ("type", "Job", "app::core"), ("function", "run", "app::core::Job"), ("function", "step", "app::core::Job"), ("function", "late", "app::core"),
        ("function", "inner", "app::core::late"), ("function", "run", "app::core"), ("test", "test_run", "app::core"),
    }
    assert of("call", core) == {
        ("CALLS", "self.step", "app::core::Job::run", ("py:app::core::Job::step", "py:app::base::Base::step")), ("CALLS", "helper", "app::core::Job::run", ("py:app::base::helper",)),
        ("CALLS", "late", "app::core::Job::run", ("py:app::core::late",)), ("CALLS", "Job", "app::core::late::inner", ("py:app::core::Job",)), ("CALLS", "inner", "app::core::late", ("py:app::core::late::inner",)),
        ("CALLS", "late", "app::core::run", ("py:app::core::late",)), ("CALLS", "run", "app::core::test_run", ("py:app::core::run",)),
    }
    assert {n for _, n, *_ in of("gap", core)} == {"os.path.join", "helper"} and {n for _, n, *_ in of("gap", "src/app/__init__.py")} == {"...too"}
    assert of("base", core) == {("IMPLEMENTS", None, "app::core::Job", ("py:app::core::Job", "py:app::base::Base"))}
    assert [(r.kind, r.line_start) for r in rows if r.row == "note"] == [("TODO", 5)] and [r.kind for r in rows if r.row == "gap" and r.path == "bad.py"] == ["parser-error"]
    assert {r.path for r in rows if r.path in ("none.py", "skip.txt")} == {"none.py"}


def test_python_resolves(spark):
    tables = python_code.graph_tables(python_code.python_rows(spark.createDataFrame(list(PACKAGE.items()), "path string, content string")))
    found = resolve.references(tables["refs"], tables["node_keys"]).collect()
    named = {(r.source_id.split("|")[2], r.keys[0]): (r.state, r.target_id and r.target_id.split("|")[2]) for r in found}
    assert named["py:app::use", "py:app::start"] == ("resolved", "py:app::core::run")  # by what the package exports
    assert named["py:app::core::Job::run", "py:app::core::Job::step"] == ("resolved", "py:app::core::Job::step")
    assert named["py:app::use", "py:app::use::unknown"][0] == "missing" and named["py:app::core", "py:os"][0] == "missing"
    edges = {(r.source_id.split("|")[2], r.target_id.split("|")[2], r.kind) for r in resolve.edge_support(resolve.references(tables["refs"], tables["node_keys"]), tables["nodes"]).collect()}
    assert ("py:app::core::test_run", "py:app::core::run", "TEST_CALLS") in edges and ("py:app::core::late", "py:app::core::late::inner", "CALLS") in edges
    kinds = {(r.implementor_id.split("|")[2], r.trait_id.split("|")[2]) for r in resolve.heritage(tables["heritage"], tables["node_keys"], tables["nodes"]).collect()}
    assert kinds == {("py:app::core::Job", "py:app::base::Base")}


A, B, Z = "a" * 40, "b" * 40, "0" * 40


def test_raw_changes(spark):
    good = f":100644 100755 {A} {B} M\0x y\0:000000 100644 {Z} {B} A\0new\0:100644 000000 {A} {Z} D\0old\0:100644 100644 {A} {B} R086\0from\0to\0"
    good = good.replace("R086", "R86")
    rows = [("ok", good), ("none", ""), ("null", None), ("cut", good[:-1]), ("kind", good.replace(" M", " X")), ("oid", good.replace(A, "a")), ("score", good.replace("R86", "R101"))]
    got = changes.raw_changes(spark.createDataFrame(rows, "capture string, raw string")).collect()
    assert [(r.kind, r.old_path, r.path, r.old_oid is None, r.new_oid is None, r.old_regular, r.new_regular) for r in sorted((r for r in got if r.capture == "ok"), key=lambda r: r.n)] == [
        ("modified", None, "x y", False, False, True, True), ("added", None, "new", True, False, False, True), ("deleted", "old", None, False, True, True, False), ("renamed", "from", "to", False, False, True, True),
    ]
    assert {r.capture: r.problem for r in got if r.problem} == dict.fromkeys(("cut", "kind", "oid", "score"), "malformed-diff-metadata")


def test_stats_and_merge(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    stats = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("b", 5, 6)], "path string, additions long, deletions long")
    got = changes.apply_stats(rows, stats, spark.createDataFrame([("b",)], "path string"), ["path"])
    assert {tuple(r) for r in got.collect()} == {("a", 4, 6), ("b", None, None), ("c", 0, 0)}
    assert [tuple(r) for r in changes.patch_totals(got.withColumn("g", F.lit(1)), "g").collect()] == [(1, 4, 6, 1)]
    side = lambda *v: spark.createDataFrame(list(v), "path string, status string, layer string, whole_file boolean, spans array<struct<start:long,end:long>>")
    merged = changes.merge_paths(side(("a", "modified", "staged", False, [(4, 6), (2, 2)]), ("d", "deleted", "staged", False, [])), side(("a", "deleted", "unstaged", True, [(2, 2)])))
    assert {(r.path, r.whole_file, tuple(map(tuple, r.spans)), tuple(r.statuses), tuple(r.layers)) for r in merged.collect()} == {("a", True, ((2, 2), (4, 6)), ("modified",), ("staged", "unstaged")), ("d", False, (), ("deleted",), ("staged",))}
    assert sorted(r.layer for r in changes.selected_layers(merged).collect()) == ["staged", "unstaged"]
    done = spark.createDataFrame([("x", True, True), ("x", True, None), ("y", True, True)], "g string, diff_complete boolean, analysis_complete boolean")
    assert {tuple(r) for r in changes.completeness(done, "g").collect()} == {("x", 2, False), ("y", 1, True)}
    folded = changes.fold_omissions(spark.createDataFrame([("a", "big", 2), ("a", "big", None), ("b", "big", 1)], "path string, reason string, occurrences int"))
    assert {tuple(r) for r in folded.collect()} == {("a", "big", 3), ("b", "big", 1)}
    why = lambda *v: changes.no_change_reason(*map(F.lit, v))
    assert tuple(spark.range(1).select(why(0, True, True, "index"), why(0, False, True, "index"), why(0, False, False, "worktree"), why(3, True, True, "index")).first()) == ("identical_commit_oids", "identical_trees", "empty_worktree_delta", None)


def test_names_and_paths(spark):
    one = lambda f, *v: [spark.range(1).select(f(*map(F.lit, x if isinstance(x, tuple) else (x,)))).first()[0] for x in v]
    assert one(S.normal_path, "a/./b//c", "a/../b", "../a", "/a/..", "/..", "") == ["a/b/c", "b", None, "/", None, ""]
    assert one(S.repository_relative, ("a/b.py", "/r"), ("/r/x/../y.py", "/r"), ("/other/y.py", "/r"), ("../z", "/r"), ("/r", "/r"), ("/rr/y", "/r")) == ["a/b.py", "y.py", None, None, None, None]
    assert one(S.joined_names, ("a", "b"), ("", "b"), ("a", "b" * 1022)) == ["a::b", "b", None]
    assert one(S.without_generics, "Vec<Map<A, B>>::new", "a", "x<y", "f<fn() -> u8>", "a>b<") == ["Vec::new", "a", None, "f", None]
    keys = one(S.terraform_key, ("a:b", "aws.x"), ("", "y"))
    assert keys == ["terraform:3:a:b:aws.x", "terraform:0::y"] and one(S.terraform_address, *keys, "terraform:9:a:b", "other") == ["aws.x", "y", None, None]
    assert one(S.override_file, "override.tf", "m/x_override.tf.json", "myoverride.tf", "override.tf/x") == [True, True, False, False]
    assert one(S.escaped, "a\tb\n\x01é", "plain") == ["a\\tb\\n\\u{1}é", "plain"]
    assert one(S.dot_escaped, 'a"\\\n\x07') == ['a\\"\\\\\\n\ufffd']
    assert one(S.inline_code, "`a` ``b`c`` `open", "none") == [["a", "b`c"], []]
    assert [r and tuple(r) for r in one(S.reference_definition, "[l]: <t> u", "  [a]b]: c", "x [l]: t", "[]: t")] == [("l", "t"), ("a]b", "c"), None, None]


def test_files_as_a_stream(spark, tmp_path):
    """Images after each batch equal a fresh index of the files as they are then."""
    one = [("a.py", "def f():\n    pass\n", 1), ("b.py", "from a import f\nfrom c import g\nf()\ng()\n", 1), ("a.py", "def old():\n    pass\n", 0)]
    two = [("c.py", "def g():\n    pass\n", 2), ("a.py", "def h():\n    pass\n", 2)]
    three = [("c.py", None, 3), ("b.py", "from a import h\nh()\n", 3)]
    kind = "path string, content string, seq long"
    folder, now = f"file://{tmp_path}/images", {}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for n, part in enumerate((one, two, three)):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        delta.follow_files(stream, folder, f"{tmp_path}/at").awaitTermination(120)
        for path, content, _ in sorted(part, key=lambda r: r[2]):
            now[path] = content
        now = {p: t for p, t in now.items() if t is not None}
        fresh = python_code.graph_tables(python_code.python_rows(spark.createDataFrame(list(now.items()), "path string, content string")))
        want = resolve.references(fresh["refs"], fresh["node_keys"])
        got = snapshot.load(spark, folder, delta.version(n))
        of = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
        assert of(got["refs"], "ref_id", "state", F.coalesce("target_id", F.lit(""))) == of(want, "ref_id", "state", F.coalesce("target_id", F.lit("")))
        assert of(got["nodes"], "id", "kind") == of(fresh["nodes"], "id", "kind") and of(got["files"], "path") == sorted((p,) for p in now)
        assert of(got["edges"], "source_id", "target_id", "kind", "support") == of(resolve.edge_support(want, fresh["nodes"]), "source_id", "target_id", "kind", "support")
    again = delta.apply_files(spark.createDataFrame(three, kind), 2, folder)
    assert again.endswith(delta.version(2))


def test_scope(spark):
    branches = spark.createDataFrame([(1, "f", 2, 9, True), (2, "f", 2, 9, False), (3, "f", 20, 4, True), (4, "g", 5, 5, False), (5, "f", 30, 40, False)], "k long, file_id string, line_start long, line_end long, arc boolean")
    spans = spark.createDataFrame([("f", 4, 6)], "file_id string, start long, end long")
    assert sorted(r.k for r in evidence.relevant_branches(branches, "k", spans).collect()) == [2, 3]
    rows = [("w", "staged", "a", "M", "1"), ("w", "untracked", "b", "A", None), ("x", "staged", "a", "M", "1")]
    kind = "w string, layer string, path string, status string, content_key string"
    of = lambda some: {r.w: r.digest for r in evidence.dirty_digest(spark.createDataFrame(some, kind), "w").collect()}
    assert of(rows) == of(rows[::-1]) and of(rows)["w"] != of(rows)["x"] and of([(*rows[0][:4], "2"), *rows[1:]])["w"] != of(rows)["w"]
