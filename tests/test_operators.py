"""Small literal cases."""

import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plexus.functions import scalars as S
from plexus.operators import diff, intervals, risk, search, traverse
from plexus.plans import snapshot
from plexus.plans.render import bounded_lines
from plexus.sources import ingest
from plexus.streaming.delta import follow


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_risk(spark):
    n = lambda *v: [F.lit(x) for x in v]
    assert one(spark, risk.criticality(*n(4, 3, 2, 1, 2, 5))) == (4175,)
    score = lambda *v: risk.node_risk(*n(*v))["score"]
    assert one(spark, score(1500, 3, True, 1, "function"), score(4000, 5, True, 10, "function"), score(0, 0, False, 0, "test"), score(0, 0, False, 0, "terraform")) == (5250, 5750, 500, 0)
    why = lambda kind, tests, direct, *v: risk.rationale(risk.node_risk(*n(*v), F.lit(kind)), F.lit(kind), *n(tests, direct))
    assert one(spark, why("function", 0, False, 5, 0, True, 16), why("test", 0, False, 0, 0, False, 0), why("function", 2, False, 0, 2, False, 1)) == (
        "no-static-test-path+affected-flow+security-sensitive+caller-impact+high-fan-in", "changed-test", "indirect-test-coverage+caller-impact",
    )
    assert one(spark, *[risk.fan_in(F.lit(x)) for x in (0, 1, 2, 3, 4, 15, 16, 5000)]) == (0, 250, 500, 500, 750, 750, 1000, 1000)


EDGES = [(1, 2, 1), (2, 3, 0), (2, 3, 0), (3, 4, 5), (5, 6, 4), (7, 8, 2)]


def test_impact_and_path(spark):
    graph = spark.createDataFrame(EDGES, "src long, dst long, relation int").distinct()
    got = traverse.impact(graph, spark.createDataFrame([(4,)], "id long"), 6).orderBy("level", "pos").select("node", "relation").collect()
    assert [tuple(r) for r in got] == [(4, None), (3, 5), (2, 0), (1, 1)]
    walk = lambda a, b: [r.node for r in traverse.paths(graph, spark.createDataFrame([(a, b)], "start long, goal long"), 8).orderBy("hop").collect()]
    assert walk(1, 4) == [1, 2, 3, 4] and walk(4, 1) == [] and walk(9, 9) == [9]


def test_cycles(spark):
    steps = spark.createDataFrame([tuple(x) for x in "ab ba cd de ec ce ff fa xy yx".split()], "node string, other string")
    assert {tuple(r) for r in traverse.strong_components(steps).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c"), ("x", "x"), ("y", "x")}


def reach(steps, root):
    seen, frontier, depth = {root: 0}, {root}, 0
    while frontier:
        depth += 1
        frontier = {b for a, b in steps if a in frontier} - seen.keys()
        seen |= dict.fromkeys(frontier, depth)
    return seen


def test_walks_equal_brute_force(spark):
    rng = random.Random(6)
    steps = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)]
    df = spark.createDataFrame(steps, "node long, other long")
    roots = spark.createDataFrame([(x,) for x in (0, 7, 7, 59, 999)], "id long")
    want = {(root, node, depth) for root in (0, 7, 59, 999) for node, depth in reach(steps, root).items()}
    for hops in (None, 3):
        near = {r for r in want if hops is None or r[2] <= hops}
        for few in (0, 1 << 20):  # by joins and over arrays
            assert sorted(tuple(r) for r in traverse.closure(df, roots, hops, few_steps=few).collect()) == sorted(near)
    both = {n: min(m for m in reach(steps, n) if n in reach(steps, m)) for n in range(60)}
    held = {n: low for n, low in both.items() if sum(v == low for v in both.values()) > 1}
    assert {r.node: r.component for r in traverse.strong_components(df).collect()} == held
    assert traverse.strong_components(df.limit(0)).count() == 0 == traverse.closure(df, roots.limit(0)).count()


def test_residual(spark):
    span = lambda *v: spark.createDataFrame([("f", a, b) for a, b in v], "p string, start long, end long")
    got = lambda a, b: sorted(tuple(r)[1:] for r in intervals.residual(a, b, "p").collect())
    assert got(span((2, 18)), span((4, 8), (12, 16))) == [(2, 2), (10, 10), (18, 18)]
    assert got(span((7, 7)), span((4, 12))) == [] and got(span((13, 13)), span((4, 12))) == [(13, 13)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60)), min_size=1, max_size=12))
def test_overlap_counts_each_pair_once(spark, a, b):
    left = spark.createDataFrame([(i, "f", x, x + n) for i, (x, n) in enumerate(a)], "i long, p string, start long, end long")
    right = spark.createDataFrame([(i, "f", x, x + n) for i, (x, n) in enumerate(b)], "j long, p string, line_start long, line_end long")
    want = sorted((i, j) for i, (x, n) in enumerate(a) for j, (y, m) in enumerate(b) if x <= y + m and y <= x + n)
    assert sorted(tuple(r) for r in intervals.overlap(left, right, "p").select("i", "j").collect()) == want


def test_api_diff(spark):
    side = lambda *v: spark.createDataFrame([(*x, k) for k, x in enumerate(v)], "identity string, signature string, line long, id long")
    base = side(("kept", "k", 1), ("changed", "u8", 2), ("removed", "r", 3), ("overload", "int", 4), ("overload", "char", 5))
    head = side(("kept", "k", 9), ("changed", "u16", 2), ("added", "a", 3), ("overload", "char", 4))
    assert {tuple(r) for r in diff.api_diff(base, head).collect()} == {("removed", "removed", 3, None), ("removed", "overload", 4, None), ("changed", "changed", 2, 2), ("added", "added", None, 3)}


def test_merge_changes(spark):
    rows = spark.createDataFrame([("a", "M", False, 2, 4), ("a", "M", True, 2, 4), ("a", "D", False, 0, 0), ("b", "D", False, 1, 1)], "path string, status string, whole_file boolean, start long, end long")
    assert {(r.path, r.whole_file, len(r.spans)) for r in diff.merge_changes(rows).collect()} == {("a", True, 1), ("b", False, 1)}


def test_search(spark):
    index = search.postings(spark.createDataFrame([(1, "foo_bar baz"), (2, "bar_foo"), (3, "foo barn")], "id long, name string"))
    assert {r.node_id for r in search.search(index, "foo_bar").collect()} == {1, 3}
    assert {r.node_id for r in search.search(index, "baz fo").collect()} == {1}


def test_scalars(spark):
    t = F.lit
    assert one(spark, S.language(t("a/b.d.ts")), S.language(t("x.tf.json")), S.language(t("x.hxx")), S.language(t("x.go"))) == ("typescript", "terraform", "cpp", None)
    assert one(spark, S.dependency_package(t(".cargo/vendor/p/x.rs")), S.dependency_package(t(".cargo/vendor/p/"))) == ("p", None)
    assert one(spark, S.score_text(t(12345)), S.line_range(t(3), t(3)), S.line_range(t(3), t(5)), S.shorten(t("äöü"), 4)) == ("1.2345", "3", "3-5", "äö…")
    assert one(spark, S.safe_path(t("a/b")), S.safe_path(t("../b")), S.safe_path(t("/a")), S.safe_path(t("a//b"))) == (True, False, False, False)
    assert one(spark, S.requirement_tokens(t("REQ-1, xREQ-2 A_B-3-4 (AB-5)"))) == (["REQ-1", "AB-5"],)
    assert one(spark, S.inline_links(t("[a](<b.md> x) [c](d)"))) == (["b.md", "d"],)
    assert one(spark, S.provider_source(t("HashiCorp/aws")), S.provider_source(t("h:443/a/b"))) == ("registry.terraform.io/hashicorp/aws", "h/a/b")
    assert one(spark, S.conventional_entry(t("on_x")), S.conventional_entry(t("main")), S.conventional_entry(t("x"))) == (True, True, False)


def test_ingest(spark):
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\n@@ -9,2 +10,0 @@\n-d\n-e\ndiff --git a/y b/y\n"
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(patch.split("\n"))], "patch string, n int, line string")
    got = {r.path: (r.additions, r.deletions, [tuple(s) for s in r.spans]) for r in ingest.patch_sections(lines).collect()}
    assert got == {"x": (2, 3, [(2, 4), (21, 21)]), "y": (0, 0, [])}
    llvm = '{"version":"2.0.1","data":[{"functions":[{"filenames":["f"],"regions":[[1,2,3,4,5,0,0,0],[1,2,3,4,6,0,0,0],[9,9,9,9,9,0,0,1]]}],"files":[]}]}'
    assert [tuple(r) for r in ingest.llvm_regions(spark.createDataFrame([(llvm,)], "content string")).collect()] == [("f", 1, 2, 3, 4, 11)]
    cov = '{"meta":{"format":3},"files":{"f":{"executed_lines":[1],"missing_lines":[2]}}}'
    assert {tuple(r) for r in ingest.coverage_py_lines(spark.createDataFrame([(cov,)], "content string")).collect()} == {("f", 1, 1), ("f", 2, 0)}
    tsv = spark.createDataFrame([("t", "k\tv\na\t1\na\t2\nbad\n")], "path string, content string")
    assert [(r.key, r.occurrence, r.width, r.cells.get("v")) for r in ingest.tsv_rows(tsv).orderBy("n").collect()] == [("a", 1, 2, "1"), ("a", 2, 2, "2"), ("bad", 1, 1, None)]
    twice = spark.createDataFrame([("t", "k\tv\tv\na\t1\t2\na\t3\t4\nb\t5\n")], "path string, content string")
    assert {(r.kind, r.name, r.line, r.n) for r in ingest.tsv_issues(twice).collect()} == {("duplicate-header", "v", None, 2), ("row-width", None, 4, 2), ("duplicate", "a", None, 2)}
    odd = spark.createDataFrame([("a", llvm), ("b", llvm.replace("2.0.1", "9.1")), ("c", cov), ("d", cov.replace("3", "2")), ("e", "{"), ("f", None)], "path string, content string")
    assert {tuple(r) for r in ingest.report_problems(odd).collect()} == {("b", "unsupported-version"), ("d", "unsupported-version"), ("e", "malformed"), ("f", "malformed")}
    md = spark.createDataFrame([("m", "[x](y.md)\n```\n[no](no)\n```\nREQ-7")], "path string, content string")
    got = {tuple(r)[1:] for r in ingest.markdown_records(md).collect()}
    assert {(1, "link", "y.md"), (3, "link", "no"), (5, "requirement", "REQ-7")} <= got and (2, "fence", hashlib.sha256(b"[no](no)").hexdigest()) in got and len(got) == 4
    text = "````py\n```\n~~~\n````\n~~~ x\n`a` ``b`c``\n[l]: <t> u\n"
    rows = spark.createDataFrame([("m", i + 1, x) for i, x in enumerate(text.split("\n"))], "path string, n int, line string")
    assert [(r.fence, r.role, r.unclosed) for r in ingest.fences(rows, "path").orderBy("n").collect()][:6] == [(1, "open", False), (1, "inside", False), (1, "inside", False), (1, "close", False), (5, "open", True), (5, "inside", True)]
    kinds = {tuple(r)[1:3] for r in ingest.markdown_records(spark.createDataFrame([("m", text)], "path string, content string")).collect()}
    assert {(1, "fence"), (5, "fence"), (5, "unclosed-fence"), (6, "inline-code"), (7, "reference-definition")} == kinds


def test_bounded(spark):
    lines = spark.createDataFrame([("g", 1, "abc"), ("g", 2, "de"), ("g", 3, "f")], "g string, n int, line string")
    assert [r.n for r in bounded_lines(lines, "g", "n", "line", 7).orderBy("n").collect()] == [1, 2]


def test_snapshot_and_stream(spark, tmp_path):
    files = spark.createDataFrame([("a", "rust", "1"), ("b", "python", "2")], "path string, language string, content_key string")
    image = snapshot.image_id(files)
    assert image == snapshot.image_id(files.orderBy(F.desc("path"))) != snapshot.image_id(files.where("path = 'a'"))
    snapshot.publish({"files": files}, f"file://{tmp_path}", image)
    assert snapshot.known(spark, f"file://{tmp_path}", image) and snapshot.load(spark, f"file://{tmp_path}", image)["files"].count() == 2
    files.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(files.schema).parquet(f"{tmp_path}/in")
    follow(stream, lambda df, n: seen.append(df.count()), f"{tmp_path}/at").awaitTermination(60)
    assert sum(seen) == 2
