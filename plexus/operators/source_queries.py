"""Queries of sources, changes, artifacts and text, over whole tables, each with SQL for an independent answer.

Files, captures and lines are put together from the tables' rows, odd ones among them, and read back by the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import pages, render, review
from ..sources import changes, ingest, python_code
from . import diff, evidence, resolve, search
from .queries import _CODE, _OVERRIDES, _RISK, _SIDES as _API, _code, _flows, _risks, api_diff, query

c = F.col


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# -- Python files: one of each supplier, and one of each nation that they import from

_FILES = """WITH s AS (SELECT s_suppkey AS k, 'src/n' || s_nationkey || '/s' || s_suppkey || '.py' AS path, 'n' || s_nationkey || '::s' || s_suppkey AS module, 'n' || s_nationkey AS package FROM supplier)"""


def _files(g):
    k = c("s_suppkey")
    path = text("src/n", c("s_nationkey"), "/s", k, ".py")
    content = text("from .base import helper, C\n\nclass D(C):\n    def m(self):\n        self.t()\n        self.m()\n\ndef f(helper2):\n    helper()\n    helper2()\n    g", k % 3, "()\n    x.y()\n\ndef g", k % 2, "():\n    pass\n")
    own = g.table("supplier").select(path.alias("path"), content.alias("content"))
    base = "def helper():\n    pass\n\nclass C:\n    def t(self):\n        pass\n\ndef test_c():\n    helper()\n"
    return own.unionByName(g.table("nation").select(text("src/n", c("n_nationkey"), "/base.py").alias("path"), F.lit(base).alias("content")))


@query(_FILES + """ SELECT path, 'node' AS row, unnest(['file', 'type', 'function', 'function', 'function']) AS kind, unnest([path, 'D', 'm', 'f', 'g' || k % 2]) AS name FROM s
    UNION ALL SELECT path, 'import', 'IMPORTS', unnest(['.base', '.base']) FROM s UNION ALL SELECT path, 'call', 'CALLS', unnest(['self.t', 'self.m', 'helper', 'g' || k % 3]) FROM s
    UNION ALL SELECT path, 'base', 'IMPLEMENTS', NULL FROM s UNION ALL SELECT path, 'gap', 'dynamic-or-unsupported-dispatch', unnest(['helper2', 'x.y']) FROM s
    UNION ALL SELECT path, unnest(['node', 'node', 'node', 'node', 'node', 'call']), unnest(['file', 'function', 'type', 'function', 'test', 'CALLS']), unnest([path, 'helper', 'C', 't', 'test_c', 'helper']) FROM (SELECT 'src/n' || n_nationkey || '/base.py' AS path FROM nation)""", graph=False)
def python_extraction(g):
    return python_code.python_rows(_files(g)).select("path", "row", "kind", "name")


@query(_FILES + """, r AS (SELECT path, module, package, unnest(['helper', 'C', 'self.t', 'self.m', 'helper()', 'g']) AS what, k FROM s)
    SELECT path, what, CASE WHEN what = 'g' AND k % 3 <> k % 2 THEN 'missing' ELSE 'resolved' END AS state,
           CASE what WHEN 'helper' THEN package || '::base::helper' WHEN 'C' THEN package || '::base::C' WHEN 'self.t' THEN package || '::base::C::t' WHEN 'self.m' THEN module || '::D::m'
                WHEN 'helper()' THEN package || '::base::helper' ELSE CASE WHEN k % 3 = k % 2 THEN module || '::g' || k % 3 END END AS target
    FROM r JOIN nation ON package = 'n' || n_nationkey""", graph=False)
def python_resolution(g):
    tables = python_code.graph_tables(python_code.python_rows(_files(g)))
    found = resolve.references(tables["refs"], tables["node_keys"]).where("not source_id like '%/base.py|%'")
    part = lambda col, i: F.get(F.split(col, r"\|"), F.lit(i))
    name = F.element_at(F.split(c("ref_id"), r"\|"), -1)
    tail = F.element_at(F.split(F.get("keys", F.lit(0)), "::"), -1)
    what = F.when(c("kind") == "IMPORTS", tail).when(name == "helper", "helper()").when(name.startswith("g"), "g").otherwise(name)
    return found.select(part("source_id", 0).alias("path"), what.alias("what"), "state", F.regexp_replace(part("target_id", 2), "^py:", "").alias("target"))


# -- version control

_RAW = """WITH o AS (SELECT o_custkey AS capture, o_orderkey AS k, sha1('a' || o_orderkey) AS old, sha1('b' || o_orderkey) AS new, o_orderkey % 5 AS how, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)"""


def _captures(g):
    k = c("o_orderkey")
    old, new, zero = F.sha1(text("a", k).cast("binary")), F.sha1(text("b", k).cast("binary")), "0" * 40
    head = lambda a, b, x, y, letter: text(f":{a} {b} ", x, " ", y, f" {letter}\0")
    record = (
        F.when(k % 5 == 0, F.concat(head("100644", "100755", old, new, "M"), text("p ", k, "\0"))).when(k % 5 == 1, F.concat(head("000000", "100644", F.lit(zero), new, "A"), text("p", k, "\0")))
        .when(k % 5 == 2, F.concat(head("120000", "000000", old, F.lit(zero), "D"), text("p", k, "\0"))).when(k % 5 == 3, F.concat(head("100644", "100644", old, new, "R87"), text("from/", k, "\0to/", k, "\0")))
        .otherwise(F.concat(head("100644", "120000", old, new, "T"), text("p", k, "\0")))
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, record.alias("r")))), lambda x: x["r"]), "")
    # Some captures are cut off or have a letter that doesn't exist.
    spoilt = F.when(c("capture") % 10 == 3, F.concat(c("whole"), F.lit(":"))).when(c("capture") % 10 == 7, F.replace(c("whole"), F.lit(" M"), F.lit(" Q"))).otherwise(c("whole"))
    return g.table("orders").groupBy(c("o_custkey").alias("capture")).agg(whole.alias("whole")).select("capture", spoilt.alias("raw"))


@query(_RAW + """, bad AS (SELECT capture FROM o GROUP BY capture HAVING capture % 10 = 3 OR (capture % 10 = 7 AND bool_or(how = 0)))
    SELECT capture, n::INT AS n, CASE how WHEN 0 THEN 'modified' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'type-changed' END AS kind, CASE how WHEN 2 THEN 'p' || k WHEN 3 THEN 'from/' || k END AS old_path,
           CASE how WHEN 0 THEN 'p ' || k WHEN 2 THEN NULL WHEN 3 THEN 'to/' || k ELSE 'p' || k END AS path, CASE WHEN how <> 1 THEN old END AS old_oid, CASE WHEN how <> 2 THEN new END AS new_oid, how NOT IN (1, 2) AS old_regular, how NOT IN (2, 4) AS new_regular, NULL AS problem
    FROM o WHERE capture NOT IN (SELECT capture FROM bad) UNION ALL SELECT capture, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'malformed-diff-metadata' FROM bad""", graph=False)
def raw_change_parse(g):
    return changes.raw_changes(_captures(g))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN coalesce(sum(l_linenumber), 0)::BIGINT END AS additions, CASE WHEN o_orderkey % 13 <> 0 THEN coalesce(sum(l_suppkey), 0)::BIGINT END AS deletions FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""", graph=False)
def patch_stats_applied(g):
    stats = g.table("lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_linenumber").cast("long").alias("additions"), c("l_suppkey").cast("long").alias("deletions"))
    rows = g.table("orders").select("o_orderkey")
    return changes.apply_stats(rows, stats, rows.where(c("o_orderkey") % 13 == 0), ["o_orderkey"])


_SIDES = """WITH a AS (SELECT 'f' || l_partkey AS path, CASE WHEN l_linenumber = 1 THEN 'deleted' WHEN l_linenumber % 2 = 0 THEN 'added' ELSE 'modified' END AS status, CASE WHEN l_suppkey % 2 = 0 THEN 'staged' ELSE 'unstaged' END AS layer, l_linenumber = 7 AS whole_file, 2 * (l_orderkey % 20) AS start FROM lineitem)"""


@query(_SIDES + """ SELECT path, max(whole_file) AS whole_file, count(DISTINCT start)::BIGINT AS spans, CASE WHEN bool_or(status <> 'deleted') THEN string_agg(DISTINCT status, ',' ORDER BY status) FILTER (WHERE status <> 'deleted') ELSE 'deleted' END AS statuses, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM a GROUP BY path""", graph=False)
def merged_changes(g):
    line = c("l_linenumber")
    start = (2 * (c("l_orderkey") % 20)).cast("long")
    rows = g.table("lineitem").select(
        text("f", c("l_partkey")).alias("path"), F.when(line == 1, "deleted").when(line % 2 == 0, "added").otherwise("modified").alias("status"), F.when(c("l_suppkey") % 2 == 0, "staged").otherwise("unstaged").alias("layer"),
        (line == 7).alias("whole_file"), F.array(F.struct(start.alias("start"), start.alias("end"))).alias("spans"),
    )
    merged = changes.merge_paths(rows.where(line <= 4), rows.where(line > 4))
    return merged.select("path", "whole_file", F.size("spans").cast("long").alias("spans"), F.array_join("statuses", ",").alias("statuses"), F.array_join("layers", ",").alias("layers"))


@query("SELECT o_custkey, count(*)::BIGINT AS paths, bool_and(o_orderkey % 50 <> 1 AND o_totalprice > 1000) AS complete FROM orders GROUP BY o_custkey", graph=False)
def change_completeness(g):
    rows = g.table("orders").select("o_custkey", F.when(c("o_orderkey") % 50 != 1, True).alias("diff_complete"), (c("o_totalprice") > 1000).alias("analysis_complete"))
    return changes.completeness(rows, "o_custkey")


@query("SELECT 'p' || l_partkey % 500 AS path, CASE WHEN l_linenumber > 4 THEN 'oversized' ELSE 'binary' END AS reason, sum(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_linenumber END)::BIGINT AS occurrences FROM lineitem GROUP BY ALL", graph=False)
def source_omissions(g):
    line = c("l_linenumber")
    return changes.fold_omissions(g.table("lineitem").select(text("p", c("l_partkey") % 500).alias("path"), F.when(line > 4, "oversized").otherwise("binary").alias("reason"), F.when(line % 3 != 0, line).alias("occurrences")))


# -- artifacts

_TSV = """WITH f AS (SELECT p_brand AS path, p_partkey, p_size % 4 AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS line, CASE WHEN p_partkey % 7 = 0 THEN 2 WHEN p_partkey % 11 = 0 THEN 4 ELSE 3 END AS width FROM part)"""


def _tsv(g):
    k = c("p_partkey")
    line = text(c("p_size") % 4, "\tv", k, F.when(k % 7 == 0, "").when(k % 11 == 0, "\tw\tw").otherwise("\tw"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, line.alias("l")))), lambda x: x["l"]), "\n")
    head = F.when(c("path").endswith("1"), "k\tv\tv").otherwise("k\tv\tw")
    return g.table("part").groupBy(c("p_brand").alias("path")).agg(body.alias("body")).select("path", F.concat(head, F.lit("\n"), c("body"), F.lit("\n")).alias("content"))


@query(_TSV + """ SELECT path, 'row-width' AS kind, NULL AS name, line::BIGINT AS line, width::BIGINT AS n FROM f WHERE width <> 3 UNION ALL SELECT path, 'duplicate', key::VARCHAR, NULL, count(*) FROM f GROUP BY path, key HAVING count(*) > 1
    UNION ALL SELECT DISTINCT path, 'duplicate-header', 'v', NULL::BIGINT, 2 FROM f WHERE path LIKE '%1'""", graph=False)
def tsv_issues(g):
    return ingest.tsv_issues(_tsv(g))


_LINES = """WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey % 6 AS how FROM lineitem)"""


def _fence_lines(g):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    how = c("l_partkey") % 6
    line = F.when(how == 0, "```").when(how == 1, "  ~~~~ info").when(how == 2, "````py").when(how == 3, "~~~~").when(how == 4, "    ```").otherwise("`a` text")
    return g.table("lineitem").select(c("l_orderkey").alias("doc"), place.alias("n"), line.alias("line"))


# The fold in SQL: state goes from line to line. 0 is outside; 3 and 4 are back-ticks of that length, 14 tildes.
@query(_LINES.replace("WITH", "WITH RECURSIVE") + """, walk AS (SELECT doc, n, how, CASE how WHEN 0 THEN 3 WHEN 1 THEN 14 WHEN 2 THEN 4 WHEN 3 THEN 14 ELSE 0 END AS state, CASE WHEN how < 4 THEN n END AS fence, CASE WHEN how < 4 THEN 'open' END AS role FROM l WHERE n = 1
    UNION ALL SELECT l.doc, l.n, l.how,
      CASE WHEN w.state = 0 OR w.role = 'close' THEN CASE l.how WHEN 0 THEN 3 WHEN 1 THEN 14 WHEN 2 THEN 4 WHEN 3 THEN 14 ELSE 0 END ELSE w.state END,
      CASE WHEN w.state = 0 OR w.role = 'close' THEN CASE WHEN l.how < 4 THEN l.n END ELSE w.fence END,
      CASE WHEN w.state = 0 OR w.role = 'close' THEN CASE WHEN l.how < 4 THEN 'open' END WHEN (w.state = 3 AND l.how = 0) OR (w.state = 14 AND l.how = 3) THEN 'close' ELSE 'inside' END
    FROM walk w JOIN l ON l.doc = w.doc AND l.n = w.n + 1)
    SELECT doc, n, fence, role FROM walk""", graph=False)
def markdown_fences(g):
    return ingest.fences(_fence_lines(g), "doc").select("doc", "n", "fence", "role")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ['x' || o_custkey] WHEN 1 THEN ['a`' || o_custkey, 'b'] WHEN 2 THEN [] WHEN 3 THEN [] WHEN 4 THEN [' é' || o_custkey] ELSE [] END AS spans FROM orders""", graph=False)
def inline_code_spans(g):
    k, v = c("o_orderkey") % 6, c("o_custkey")
    line = F.when(k == 0, text("see `x", v, "` and `open")).when(k == 1, text("``a`", v, "`` `b`")).when(k == 2, text("none ", v)).when(k == 3, text("``````", v)).when(k == 4, text("```` é", v, "````")).otherwise(text("`open ", v))
    return g.table("orders").select("o_orderkey", S.inline_code(line).alias("spans"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'l' || o_custkey WHEN 1 THEN 'a]b' END AS label, CASE o_orderkey % 5 WHEN 0 THEN 't' || o_custkey WHEN 1 THEN 'u' END AS target FROM orders""", graph=False)
def reference_definitions(g):
    k, v = c("o_orderkey") % 5, c("o_custkey")
    line = F.when(k == 0, text("  [l", v, "]: <t", v, "> title")).when(k == 1, text("[a]b]: u ", v)).when(k == 2, text("x [l]: t", v)).when(k == 3, text("[]: t", v)).otherwise(text("[l]:t", v))
    return g.table("orders").select("o_orderkey", S.reference_definition(line).alias("r")).select("o_orderkey", "r.label", "r.target")


# -- names, paths, lines


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 7 WHEN 0 THEN 'a/' || l_partkey WHEN 1 THEN 'b' || l_partkey || '/c.py' WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN l_partkey || '.rs' WHEN 5 THEN NULL ELSE 'ü/' || l_partkey END AS path FROM lineitem""", graph=False)
def coverage_paths(g):
    k, v = c("l_linenumber") % 7, c("l_partkey")
    name = (
        F.when(k == 0, text("./a//", v)).when(k == 1, text("/work/tree/x/../b", v, "/c.py")).when(k == 2, text("/usr/lib/", v)).when(k == 3, text("../", v))
        .when(k == 4, text("a/b/../../", v, ".rs")).when(k == 5, text("/work/treehouse/", v)).otherwise(text("ü/./", v))
    )
    return g.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.repository_relative(name, F.lit("/work/tree")).alias("path"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'm' || p_partkey || '::new' WHEN 1 THEN 'f' || p_partkey WHEN 2 THEN NULL ELSE 'g' END AS plain,
    'terraform:' || octet_length(encode('dé:' || p_size)) || ':dé:' || p_size || ':aws.' || p_partkey AS key, 'aws.' || p_partkey AS address FROM part""", graph=False)
def name_keys(g):
    k = c("p_partkey")
    name = F.when(k % 4 == 0, text("m", k, "<A<B>, C>::new")).when(k % 4 == 1, text("f", k)).when(k % 4 == 2, text("x", k, "<y")).otherwise(text("g<fn(", k, ") -> u8>"))
    key = S.terraform_key(text("dé:", c("p_size")), text("aws.", k))
    return g.table("part").select("p_partkey", S.without_generics(name).alias("plain"), key.alias("key"), S.terraform_address(key).alias("address"))


@query(_OVERRIDES + _CODE + """ SELECT src, dst, relation, CASE relation WHEN 0 THEN 'call -> n' WHEN 1 THEN 'call -> n' WHEN 2 THEN 'import -> n' WHEN 3 THEN 'depends-on -> n' WHEN 4 THEN 'implements -> n' ELSE 'dispatch -> n' END || dst || ' ' || kind || ' ' || name || ' file' || file_id || ':' || line_start AS line
    FROM code JOIN nodes ON id = dst WHERE src IN (SELECT id FROM nodes WHERE id % 50 = 0)""")
def node_lines(g):
    from .traverse import RELATIONS

    named = F.get(F.array(*[F.lit(k) for k, _ in sorted(RELATIONS.items(), key=lambda x: x[1])]), c("relation"))
    rows = _code(g).where("src % 50 = 0").join(g.nodes, c("dst") == c("id"))
    return rows.select("src", "dst", "relation", render.node_line(render.relation_label(named, F.lit(False)), c("dst"), c("kind"), c("name"), text("file", c("file_id")), c("line_start")).alias("line"))


@query(""" SELECT part, line FROM (SELECT 1 AS part, '  n' || id || ' [label="' || name || '"];' AS line FROM nodes WHERE kind IN ('file', 'type') UNION ALL SELECT 2, '  n' || implementor_id || ' -> n' || trait_id || ' [label="implements ->"];' FROM (SELECT DISTINCT implementor_id, trait_id FROM implements)
    UNION ALL SELECT 0, 'digraph changes {' UNION ALL SELECT 3, '}')""")
def dot_graph(g):
    edges = g.implements.select(c("implementor_id").alias("source_id"), c("trait_id").alias("target_id"), render.relation_label(F.lit("IMPLEMENTS"), F.lit(False)).alias("label"))
    return render.dot_lines(g.nodes.where("kind in ('file', 'type')"), edges).select("part", "line")


@query("""WITH t AS (SELECT DISTINCT p_partkey AS node_id, unnest(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM part),
    q AS (SELECT DISTINCT p_partkey AS query_id, unnest([substr(lower(string_split(p_name, ' ')[1]), 1, 3), lower(string_split(p_name, ' ')[2])]) AS asked FROM part WHERE p_partkey % 50 = 0),
    h AS (SELECT query_id, asked, node_id FROM q JOIN t ON starts_with(token, asked) GROUP BY ALL),
    n AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id) SELECT query_id, node_id FROM h JOIN n USING (query_id) GROUP BY query_id, node_id HAVING count(*) = max(n)""", graph=False)
def search_many(g):
    """Every part whose key divides by 50 asks, against all parts: a beginning of its first word, and its second."""
    part = g.table("part")
    words = F.split(F.lower("p_name"), " ")
    queries = part.where("p_partkey % 50 = 0").select(c("p_partkey").alias("query_id"), F.concat(F.substring(F.get(words, F.lit(0)), 1, 3), F.lit(" "), F.get(words, F.lit(1))).alias("query"))
    return search.search_all(search.postings(part.select(c("p_partkey").alias("id"), c("p_name").alias("name"))), queries)


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_linenumber || '|' || l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber || '|' || l_quantity) > 1", graph=False)
def duplicate_keys(g):
    return diff.duplicates(g.table("lineitem"), ["l_partkey", "l_suppkey"], ["l_linenumber", "l_quantity"])


@query(" SELECT r.ref_id FROM resolved r WHERE target_id IS NOT NULL AND target_id NOT IN (SELECT id FROM nodes WHERE kind <> 'test')")
def orphan_references(g):
    return diff.orphans(g.resolved, g.nodes.where("kind <> 'test'"), "target_id", "id").select("ref_id")


# -- a review

_SCORE = "printf('%d.%04d', ({0} // 10000)::BIGINT, ({0} % 10000)::BIGINT)"
_REVIEW = _RISK + ", " + _API.removeprefix("WITH ").replace("sides AS", "sides AS", 1).replace("\n    SELECT CASE WHEN h2.line", ",\n    api AS (SELECT CASE WHEN h2.line", 1) + f"""),
    told AS (SELECT 'risk' AS section, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS n, 'risk ' || {_SCORE.format('score')} || ' n' || id || ' flow=' || {_SCORE.format('flow')} || ' tests=' || {_SCORE.format('untested')} || ' security=' || {_SCORE.format('security')} || ' callers=' || {_SCORE.format('called')} || ' '
        || concat_ws('+', CASE WHEN kind = 'test' THEN 'changed-test' WHEN kind = 'terraform' THEN 'test-paths-unmodeled' WHEN tests = 0 THEN 'no-static-test-path' WHEN NOT direct THEN 'indirect-test-coverage' ELSE 'direct-test-coverage' END,
           CASE WHEN flow > 0 THEN 'affected-flow' END, CASE WHEN security > 0 THEN 'security-sensitive' END, CASE WHEN called > 0 THEN 'caller-impact' END, CASE WHEN called = 1000 THEN 'high-fan-in' END) AS line FROM risks
      UNION ALL SELECT 'flow', row_number() OVER (ORDER BY criticality DESC, entry::VARCHAR), 'flow ' || {_SCORE.format('criticality')} || ' n' || entry || ' nodes=' || nodes || ' files=' || files || ' external=' || external || ' security=' || security || ' tested=' || tested || ' depth=' || depth FROM scored
      UNION ALL SELECT 'api', row_number() OVER (ORDER BY coalesce(head_line, base_line), identity || '|' || status, coalesce(base_line, 0)), 'api ' || status || ' ' || identity || ' ' || coalesce(base_line::VARCHAR, '-') || ' ' || coalesce(head_line::VARCHAR, '-') FROM api
      UNION ALL SELECT 'summary', 1, 'summary overall=' || {_SCORE.format('coalesce((SELECT max(score) FROM risks), 0)')} || ' symbols=' || (SELECT count(*) FROM risks) || ' flows=' || (SELECT count(*) FROM scored) || ' gaps=' || (SELECT count(*) FROM risks WHERE tests = 0 AND kind NOT IN ('test', 'terraform')) || ' api=' || (SELECT count(*) FROM api))"""


def _review(g):
    return review.review(_risks(g), _flows(g)[0], api_diff(g))


@query(_REVIEW + " SELECT section, n::BIGINT AS n, line FROM told")
def changes_review(g):
    return _review(g)


@query(_REVIEW + """, placed AS (SELECT section, n, line, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY section ORDER BY n) AS stop FROM told)
    SELECT section, max(stop) FILTER (WHERE stop <= 4096)::BIGINT AS "end", string_agg(line || chr(10), '' ORDER BY n) FILTER (WHERE stop <= 4096) AS text, count(*) FILTER (WHERE stop <= 4096)::BIGINT AS records, max(stop)::BIGINT AS total FROM placed GROUP BY section""")
def review_first_pages(g):
    lines = _review(g)
    cursors = lines.select("section").distinct().withColumns({"start": F.lit(0).cast("long"), "budget": F.lit(4096).cast("long")})
    return pages.page(lines, cursors, "section", "n", "line").select("section", "end", "text", "records", "total")


# -- scope

_GAPS = """, changed AS (SELECT id FROM nodes WHERE id // 100000000000000000 = 5 AND id % 50 = 0), scope AS (SELECT DISTINCT file_id, line_start AS start, line_end AS stop FROM nodes JOIN changed USING (id)),
    gaps AS (SELECT ref_id, file_id, source_id, line FROM resolved JOIN nodes ON id = source_id WHERE state <> 'resolved')"""


@query(_GAPS + """, lit AS (SELECT DISTINCT file_id, unnest(range(start, stop + 1)) AS line FROM scope)
    SELECT ref_id FROM gaps WHERE file_id = 100000000000000001 OR source_id IN (SELECT id FROM changed) OR (file_id, line) IN (SELECT (file_id, line) FROM lit)""")
def relevant_gaps(g):
    gaps = g.resolved.where("state <> 'resolved'").join(g.nodes.select(c("id").alias("source_id"), "file_id"), "source_id").select("ref_id", "file_id", "source_id", c("line").alias("line_start"), c("line").alias("line_end"))
    asked = g.nodes.where("id div 100000000000000000 = 5 and id % 50 = 0")
    files = g.nodes.where("id = 100000000000000001").select(c("id").alias("file_id"))
    return evidence.relevant(gaps, "ref_id", files, asked.select("id"), asked.select("file_id", c("line_start").alias("start"), c("line_end").alias("end"))).select("ref_id")


@query("""SELECT o_custkey, count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey % 3 = 0)::BIGINT AS staged, count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey % 3 = 1)::BIGINT AS unstaged, count(DISTINCT o_orderkey) FILTER (WHERE o_orderkey % 3 = 2)::BIGINT AS untracked FROM orders GROUP BY o_custkey""", graph=False)
def status_counts(g):
    k = c("o_orderkey")
    return evidence.status_counts(g.table("orders").select("o_custkey", text("p", k).alias("path"), F.when(k % 3 == 0, "staged").when(k % 3 == 1, "unstaged").otherwise("untracked").alias("layer")), "o_custkey")


@query(""" SELECT path, line_start, line_end, reason, count(*)::BIGINT AS occurrences, CASE reason WHEN 'missing' THEN 3 WHEN 'ambiguous' THEN 4 ELSE 5 END::BIGINT AS "order" FROM (
    SELECT 'file' || file_id AS path, line AS line_start, line AS line_end, state AS reason FROM resolved JOIN nodes ON id = source_id WHERE state <> 'resolved'
    UNION ALL SELECT 'file' || file_id, line_start, line_end, 'dynamic-or-unsupported-dispatch' FROM nodes WHERE kind = 'test') GROUP BY ALL""")
def gap_records(g):
    path = text("file", c("file_id")).alias("path")
    named = g.resolved.where("state <> 'resolved'").join(g.nodes.select(c("id").alias("source_id"), "file_id"), "source_id").select(path, c("line").alias("line_start"), c("line").alias("line_end"), c("state").alias("reason"))
    own = g.nodes.where("kind = 'test'").select(path, "line_start", "line_end", F.lit("dynamic-or-unsupported-dispatch").alias("reason"))
    return evidence.static_gap_records(own, named)
