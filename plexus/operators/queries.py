"""Queries of the graph operators over whole tables, each with SQL for an independent answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.lineage import cut
from ..plans.render import bounded_lines
from ..plans.snapshot import apply_delta, changed_files
from ..sources.projection import GRAPH_SQL, Graph
from . import diff, intervals, resolve, risk, search, traverse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True, name: str | None = None):
    """Register a query that gets the graph, and its SQL, in front of which the graph's tables stand if ``graph``."""

    def register(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Graph.of(spark, sf_dir))
        if sql:
            SQL[key] = f"WITH {'RECURSIVE ' if 'RECURSE' in sql else ''}{GRAPH_SQL}{sql.replace('RECURSE', '')}" if graph else sql
        return f

    return register


c = F.col


def _changed(g: Graph) -> DataFrame:
    """The nodes that are asked about: parts whose key divides by 50, against all nodes."""
    return g.nodes.where("id div 100000000000000000 = 5 and id % 50 = 0").select("id")


_CHANGED = "changed AS (SELECT id FROM nodes WHERE id // 100000000000000000 = 5 AND id % 50 = 0)"


# -- resolution ---------------------------------------------------------------------------------------------------


@query(" SELECT ref_id, state, target_id FROM resolved")
def resolve_ranked_first_match(g):
    return g.resolved.select("ref_id", "state", "target_id")


@query(" SELECT key, n::BIGINT AS n, CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN target END AS target FROM cand")
def candidate_lookup(g):
    found = resolve.candidates(g.node_keys)
    return found.select("key", "n", F.when(c("n") == 1, "unique").otherwise("ambiguous").alias("state"), F.when(c("n") == 1, c("target")).alias("target"))


@query(" SELECT key, amb = 1 AS ambiguous, n::BIGINT AS n, target FROM alias_cand")
def alias_candidates(g):
    return resolve.alias_candidates(g.refs, resolve.candidates(g.node_keys))


@query(" SELECT source_id, target_id, kind, support FROM edges")
def edge_support(g):
    return g.edges.select("source_id", "target_id", "kind", "support")


@query(" SELECT DISTINCT implementor_id, trait_id FROM implements")
def heritage_resolution(g):
    return g.implements


@query(", o AS (SELECT id, coalesce(CASE WHEN n = 1 THEN target END, file_id) AS parent_id FROM nodes LEFT JOIN cand ON key = owner_key WHERE owner_key IS NOT NULL) SELECT * FROM o")
def method_reparent(g):
    return resolve.reparent(g.nodes, g.node_keys)


@query(
    """, open AS (SELECT source_id, line, count(*) AS n, min(ref_id) AS ref_id, min(kind) AS kind, min(alias_key) AS alias, min(regexp_extract(keys[-1], '([^:]*)$', 1)) AS symbol FROM resolved WHERE state <> 'resolved' GROUP BY ALL),
    defs AS (SELECT DISTINCT 600000000000000000 + l_orderkey AS source_id, l_linenumber::BIGINT AS line, l_partkey::VARCHAR AS symbol, 500000000000000000 + l_partkey AS target_id FROM lineitem)
    SELECT ref_id, target_id FROM open JOIN defs USING (source_id, line, symbol) WHERE n = 1 AND kind = 'CALLS' AND alias IS NULL"""
)
def index_upgrade(g):
    item = g.table("lineitem")
    defs = item.select((c("l_orderkey") + 600_000_000_000_000_000).alias("source_id"), c("l_linenumber").cast("long").alias("line"), c("l_partkey").cast("string").alias("symbol"), (c("l_partkey") + 500_000_000_000_000_000).alias("target_id"))
    return resolve.upgrade_by_index(g.resolved, defs)


@query(" SELECT source_id, target_id, bool_and(source = 'scip') AS scip_only FROM resolved WHERE state = 'resolved' GROUP BY ALL HAVING bool_and(source = 'scip')")
def scip_only_edges(g):
    return g.resolved.where("state = 'resolved'").groupBy("source_id", "target_id").agg(F.every(c("source") == "scip").alias("scip_only")).where("scip_only")


@query(" SELECT kind, count(*) FILTER (WHERE state = 'missing')::BIGINT AS missing, count(*) FILTER (WHERE state = 'ambiguous')::BIGINT AS ambiguous, count(*) FILTER (WHERE state = 'resolved')::BIGINT AS resolved FROM resolved GROUP BY kind")
def unresolved_totals(g):
    n = lambda s: F.count_if(c("state") == s).alias(s)
    return g.resolved.groupBy("kind").agg(n("missing"), n("ambiguous"), n("resolved"))


@query(
    """, gaps AS (SELECT n.file_id, r.kind AS category, r.state AS reason, count(*)::BIGINT AS occurrences FROM resolved r JOIN nodes n ON n.id = r.source_id WHERE state <> 'resolved' GROUP BY ALL)
    SELECT category, reason, sum(occurrences)::BIGINT AS occurrences, count(*)::BIGINT AS files FROM gaps GROUP BY ALL"""
)
def gap_accounting(g):
    owner = g.nodes.select(c("id").alias("source_id"), "file_id")
    gaps = g.resolved.where("state <> 'resolved'").join(owner, "source_id").groupBy("file_id", c("kind").alias("category"), c("state").alias("reason")).agg(F.count("*").alias("occurrences"))
    return gaps.groupBy("category", "reason").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("files"))


@query(
    """, seen AS (SELECT file_id, count(*)::BIGINT AS observed FROM refs JOIN nodes ON id = source_id GROUP BY file_id),
    got AS (SELECT file_id, count(*) FILTER (WHERE state = 'resolved')::BIGINT AS resolved, count(*) FILTER (WHERE state <> 'resolved')::BIGINT AS gaps FROM resolved JOIN nodes ON id = source_id GROUP BY file_id)
    SELECT file_id, observed, resolved, gaps, observed = resolved + gaps AS complete FROM seen JOIN got USING (file_id)"""
)
def relation_site_accounting(g):
    owner = g.nodes.select(c("id").alias("source_id"), "file_id")
    seen = g.refs.join(owner, "source_id").groupBy("file_id").agg(F.count("*").alias("observed"))
    got = g.resolved.join(owner, "source_id").groupBy("file_id").agg(F.count_if(c("state") == "resolved").alias("resolved"), F.count_if(c("state") != "resolved").alias("gaps"))
    return seen.join(got, "file_id").withColumn("complete", c("observed") == c("resolved") + c("gaps"))


@query(
    """, stored AS (SELECT source_id, target_id, kind, support + (source_id % 97 = 0)::INT AS support FROM edges WHERE target_id % 89 <> 0)
    SELECT 'expected' AS side, * FROM (SELECT source_id, target_id, kind, support FROM edges EXCEPT ALL SELECT * FROM stored) UNION ALL SELECT 'stored', * FROM (SELECT * FROM stored EXCEPT ALL SELECT source_id, target_id, kind, support FROM edges)"""
)
def invariant_two_way_diff(g):
    want = g.edges.select("source_id", "target_id", "kind", "support")
    have = want.where("target_id % 89 <> 0").withColumn("support", c("support") + F.when(c("source_id") % 97 == 0, 1).otherwise(0))
    return want.exceptAll(have).select(F.lit("expected").alias("side"), "*").unionByName(have.exceptAll(want).select(F.lit("stored").alias("side"), "*"))


# -- neighbours and walks --------------------------------------------------------------------------------------------

_NEIGHBORS = {
    "member": "SELECT parent_id AS node, id AS other FROM nodes WHERE parent_id IS NOT NULL",
    "test": "SELECT target_id AS node, source_id AS other FROM edges WHERE kind = 'TEST_CALLS'",
    "caller": "SELECT target_id AS node, source_id AS other FROM edges WHERE kind = 'CALLS'",
    "impl": "SELECT trait_id AS node, implementor_id AS other FROM implements",
    "call": "SELECT source_id AS node, target_id AS other FROM edges WHERE kind IN ('CALLS', 'TEST_CALLS')",
    "implements": "SELECT implementor_id AS node, trait_id AS other FROM implements",
    "in": "SELECT id AS node, coalesce(parent_id, file_id) AS other FROM nodes WHERE kind <> 'file'",
    "import": "SELECT source_id AS node, target_id AS other FROM edges WHERE kind = 'IMPORTS'",
    "dependent": "SELECT target_id AS node, source_id AS other FROM edges WHERE kind = 'DEPENDS_ON'",
    "depends_on": "SELECT source_id AS node, target_id AS other FROM edges WHERE kind = 'DEPENDS_ON'",
}
for _relation, _sql in _NEIGHBORS.items():
    query(f" SELECT DISTINCT * FROM ({_sql})", name=f"neighbors_{_relation}")(lambda g, r=_relation: traverse.neighbors(g.nodes, g.edges, g.implements, r))

def _view_sql(depth: int, most: int) -> str:
    steps = " UNION ALL ".join(f"SELECT DISTINCT node, other, {i} AS rank FROM ({_NEIGHBORS[r]})" for i, r in enumerate(traverse.VIEW))
    out = f", steps AS MATERIALIZED ({steps}), l0 AS (SELECT id AS root, id AS node, 0 AS level, 1::BIGINT AS pos, NULL::INT AS rank, 1::BIGINT AS size FROM nodes WHERE id % 50 = 0 AND kind <> 'file'), s0 AS (SELECT * FROM l0)"
    for k in range(1, depth + 2):
        where = "" if k == 1 else " AND e.rank <> 0"
        out += f""", a{k} AS MATERIALIZED (SELECT root, node, {k} AS level, row_number() OVER (PARTITION BY root ORDER BY hit.pos, hit.rank, node) AS pos, hit.rank AS rank, count(*) OVER (PARTITION BY root) AS size FROM (
            SELECT l.root, e.other AS node, min({{'pos': l.pos, 'rank': e.rank}}) AS hit FROM l{k - 1} l JOIN steps e ON e.node = l.node{where} WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.root = l.root AND s.node = e.other) GROUP BY ALL)),
            l{k} AS (SELECT * FROM a{k} WHERE pos <= {most}), s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})"""
    return out + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY level, pos) AS n FROM s{depth + 1}), told AS (SELECT *, NOT bool_or(size > {most} OR level > {depth} OR n > {most}) OVER (PARTITION BY root) AS complete FROM placed)
        SELECT root, node, level, pos::INT AS pos, rank, complete FROM told WHERE n <= {most} AND level <= {depth}"""


@query(_view_sql(2, 12))
def view_nodes(g):
    return traverse.view(traverse.view_steps(g.nodes, g.edges, g.implements), g.nodes.where("id % 50 = 0 and kind <> 'file'"), 2, 12)


_OVERRIDES = """RECURSE, up(type_id, super_id) AS (SELECT implementor_id, trait_id FROM implements UNION SELECT up.type_id, i.trait_id FROM up JOIN implements i ON i.implementor_id = up.super_id),
    overrides AS (SELECT DISTINCT m.id AS member_id, b.id AS base_id FROM up JOIN nodes m ON m.parent_id = up.type_id AND m.kind = 'function' JOIN nodes b ON b.parent_id = up.super_id AND b.kind = 'function' AND b.name = m.name)"""


@query(_OVERRIDES + " SELECT * FROM overrides")
def override_closure(g):
    return traverse.override_closure(g.overrides)


_CODE = """, code AS (SELECT DISTINCT source_id AS src, target_id AS dst, CASE kind WHEN 'CALLS' THEN 0 WHEN 'TEST_CALLS' THEN 1 WHEN 'IMPORTS' THEN 2 ELSE 3 END AS relation FROM edges
    UNION SELECT implementor_id, trait_id, 4 FROM implements UNION SELECT base_id, member_id, 5 FROM overrides)"""


def _code(g):
    return traverse.code_graph(g.edges, g.implements)


@query(_OVERRIDES + _CODE + " SELECT relation, count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS sources, count(DISTINCT dst)::BIGINT AS targets FROM code GROUP BY relation")
def code_graph_totals(g):
    return traverse.code_totals(_code(g), g.overrides)


def _impact_sql(depth: int) -> str:
    out = _OVERRIDES + _CODE + ", " + _CHANGED + ", l0 AS (SELECT id AS root, id AS node, 0 AS level, 1::BIGINT AS pos, NULL::INT AS relation FROM changed), s0 AS (SELECT * FROM l0)"
    for k in range(1, depth + 1):
        out += f""", l{k} AS (SELECT root, node, {k} AS level, row_number() OVER (PARTITION BY root ORDER BY hit.pos, node) AS pos, hit.rel AS relation FROM (
            SELECT l.root, e.src AS node, min({{'pos': l.pos, 'via': l.node, 'rel': e.relation}}) AS hit FROM l{k - 1} l JOIN code e ON e.dst = l.node
            WHERE NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.root = l.root AND s.node = e.src) GROUP BY ALL)), s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})"""
    return out + f" SELECT * FROM s{depth}"


@query(_impact_sql(3))
def impact_depth3(g):
    return traverse.impact(_code(g), _changed(g), 3, g.overrides)


@query(_impact_sql(3).rsplit(" SELECT * FROM s3", 1)[0] + ", placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY level, pos) AS n, count(*) OVER (PARTITION BY root) AS total FROM s3) SELECT root, node, level, pos, relation, total <= 20 AS complete FROM placed WHERE n <= 20")
def impact_bounded(g):
    return traverse.impact_first(_code(g), _changed(g), 3, 20, g.overrides)


def _pairs(g):
    return g.table("customer").where("c_custkey % 50 = 0").select((c("c_custkey") + 400_000_000_000_000_000).alias("start"), (c("c_nationkey") + 200_000_000_000_000_000).alias("goal"))


def _path_sql(hops: int, both: bool) -> str:
    steps = "SELECT src AS node, dst AS next, 0 AS reverse, relation FROM code" + (" UNION ALL SELECT dst, src, 1, relation FROM code" if both else "")
    out = _OVERRIDES + _CODE + f""", steps AS MATERIALIZED ({steps}), s0 AS (SELECT 400000000000000000 + c_custkey AS start, 200000000000000000 + c_nationkey AS goal, 0 AS hop, 400000000000000000 + c_custkey AS node, NULL::BIGINT AS parent, NULL::INT AS reverse, NULL::INT AS relation FROM customer WHERE c_custkey % 50 = 0)"""
    for k in range(1, hops + 1):
        out += f""", s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT start, goal, {k}, node, hit.parent, hit.reverse, hit.relation FROM (
            SELECT s.start, s.goal, t.next AS node, min({{'parent': s.node, 'reverse': t.reverse, 'relation': t.relation}}) AS hit FROM s{k - 1} s JOIN steps t ON t.node = s.node
            WHERE s.hop = {k - 1} AND NOT EXISTS (SELECT 1 FROM s{k - 1} d WHERE d.start = s.start AND d.goal = s.goal AND (d.node = t.next OR d.node = d.goal)) GROUP BY ALL))"""
    out += f", w0 AS (SELECT * FROM s{hops} WHERE node = goal)"
    for k in range(1, hops + 1):
        out += f", w{k} AS (SELECT s.* FROM s{hops} s JOIN w{k - 1} w ON s.start = w.start AND s.goal = w.goal AND s.node = w.parent)"
    return out + " " + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(hops + 1))


@query(_path_sql(6, False))
def path_forward(g):
    return traverse.paths(_code(g), _pairs(g), overrides=g.overrides)


@query(_path_sql(6, True))
def path_any(g):
    return traverse.paths(_code(g), _pairs(g), any_direction=True, overrides=g.overrides)


@query(_OVERRIDES + """ SELECT node, other, min(dispatch)::INT AS dispatch FROM (SELECT source_id AS node, target_id AS other, 0 AS dispatch FROM edges WHERE kind = 'CALLS'
    UNION ALL SELECT member_id, base_id, 1 FROM overrides WHERE member_id <> base_id UNION ALL SELECT base_id, member_id, 1 FROM overrides WHERE member_id <> base_id) GROUP BY node, other""")
def flow_neighbors(g):
    return traverse.flow_neighbors(g.edges, g.overrides)


_ENTRIES = f"""RECURSE, {_CHANGED}, reach(root, node) AS (SELECT id, id FROM changed UNION SELECT root, source_id FROM reach JOIN edges ON kind = 'CALLS' AND target_id = node),
    entries AS (SELECT root, node AS entry FROM reach JOIN nodes ON id = node AND kind = 'function' WHERE NOT EXISTS (SELECT 1 FROM edges WHERE kind = 'CALLS' AND target_id = node))"""


@query(_ENTRIES + " SELECT * FROM entries")
def affected_entries(g):
    return risk.affected_entries(g.edges, g.nodes, _changed(g))


_SECURE = "|".join(S.SECURITY_WORDS)
_FLOWS = _ENTRIES + f""", walk(entry, node, depth) AS (SELECT DISTINCT entry, entry, 0 FROM entries UNION SELECT entry, target_id, depth + 1 FROM walk JOIN edges ON kind = 'CALLS' AND source_id = node WHERE depth < 15),
    member AS (SELECT entry, node, min(depth)::BIGINT AS depth FROM walk GROUP BY ALL),
    ext AS (SELECT source_id AS node, count(*) AS n FROM resolved WHERE kind = 'CALLS' AND target_id IS NULL GROUP BY ALL), tst AS (SELECT DISTINCT target_id AS node FROM edges WHERE kind = 'TEST_CALLS'),
    flow AS (SELECT entry, count(*)::BIGINT AS nodes, count(DISTINCT file_id)::BIGINT AS files, coalesce(sum(ext.n), 0)::BIGINT AS external, count(*) FILTER (WHERE regexp_matches(lower(name), '{_SECURE}'))::BIGINT AS security,
             count(tst.node)::BIGINT AS tested, max(depth)::BIGINT AS depth FROM member JOIN nodes ON id = member.node LEFT JOIN ext USING (node) LEFT JOIN tst ON tst.node = member.node GROUP BY entry HAVING count(*) >= 2),
    scored AS (SELECT *, round(least(greatest(0.30::DOUBLE * least((files - 1)::DOUBLE / 4, 1) + 0.20::DOUBLE * least(external::DOUBLE / 5, 1) + 0.25::DOUBLE * (security::DOUBLE / nodes) + 0.15::DOUBLE * (1 - tested::DOUBLE / nodes) + 0.10::DOUBLE * least(depth::DOUBLE / 10, 1), 0), 1) * 10000)::BIGINT AS criticality FROM flow)"""


def _flows(g):
    """Flows and their members, worked out once for a graph: a review reads them in several places."""

    def made():
        members = risk.flow_members(g.edges, risk.affected_entries(g.edges, g.nodes, _changed(g)))
        return cut(risk.flows(members, g.edges, g.nodes, g.resolved), "flows"), members

    return g.once("flows", made)


@query(_FLOWS + " SELECT * FROM scored")
def flow_criticality(g):
    return _flows(g)[0]


_SCORES = _FLOWS + ", flow_score AS (SELECT m.node AS id, sum(criticality)::BIGINT AS flow FROM member m JOIN changed ON changed.id = m.node JOIN scored USING (entry) GROUP BY 1)"


@query(_SCORES + " SELECT * FROM flow_score")
def flow_score_per_root(g):
    return risk.flow_scores(*_flows(g), _changed(g))


@query(_ENTRIES + """, walk(entry, node) AS (SELECT DISTINCT entry, entry FROM entries UNION SELECT entry, target_id FROM walk JOIN edges ON kind = 'CALLS' AND source_id = node) SELECT DISTINCT entry, node FROM walk""")
def trace_flow_nodes(g):
    return risk.flow_members(g.edges, risk.affected_entries(g.edges, g.nodes, _changed(g))).select("entry", "node")


_COUNT_PARTS = """, base AS (SELECT id, id AS of FROM changed UNION SELECT id, base_id FROM changed JOIN overrides ON member_id = id),
    callers AS (SELECT id, count(DISTINCT source_id) AS callers FROM base JOIN edges ON target_id = of AND kind IN ('CALLS', 'DEPENDS_ON') GROUP BY id),
    back AS (SELECT target_id AS node, source_id AS other FROM edges WHERE kind = 'CALLS' UNION SELECT member_id, base_id FROM overrides WHERE member_id <> base_id),
    above(root, node) AS (SELECT id, id FROM changed UNION SELECT root, other FROM above JOIN back USING (node)),
    tests AS (SELECT root AS id, count(DISTINCT source_id) AS tests, bool_or(node = root) AS direct FROM above JOIN edges ON target_id = node AND kind = 'TEST_CALLS' GROUP BY root),
    wide AS (SELECT root AS id, count(*) > 5000 AS omitted FROM above GROUP BY root),
    counts AS (SELECT id, coalesce(callers, 0)::BIGINT AS callers, coalesce(tests, 0)::BIGINT AS tests, coalesce(direct, false) AS direct, coalesce(omitted, false) AS omitted FROM changed LEFT JOIN callers USING (id) LEFT JOIN tests USING (id) LEFT JOIN wide USING (id))"""
_COUNTS = _OVERRIDES + ", " + _CHANGED + _COUNT_PARTS
_RISK = _SCORES + _OVERRIDES.replace("RECURSE", "") + _COUNT_PARTS + f""", parts AS (SELECT c.id, n.kind, c.tests, c.direct, least(coalesce(flow, 0), 2500) AS flow, CASE n.kind WHEN 'terraform' THEN 0 WHEN 'test' THEN 500 ELSE 3000 - 500 * least(c.tests, 5) END AS untested,
      CASE WHEN regexp_matches(lower(name), '{_SECURE}') THEN 2000 ELSE 0 END AS security, CASE WHEN callers = 0 THEN 0 WHEN callers = 1 THEN 250 WHEN callers <= 3 THEN 500 WHEN callers <= 15 THEN 750 ELSE 1000 END AS called FROM counts c JOIN nodes n USING (id) LEFT JOIN flow_score USING (id)),
    risks AS (SELECT *, (flow + untested + security + called)::BIGINT AS score FROM parts)"""


def _counts(g):
    return g.once("counts", lambda: risk.risk_counts(g.edges, g.overrides, _changed(g)))


def _risks(g):
    return g.once("risks", lambda: cut(_named_risks(g), "risks"))


def _named_risks(g):
    named = _counts(g).join(g.nodes.select("id", "name", "kind"), "id").join(risk.flow_scores(*_flows(g), _changed(g)), "id", "left")
    flow = F.coalesce("flow", F.lit(0))
    return named.select("id", "kind", "tests", "direct", risk.node_risk(flow, c("tests"), S.security_sensitive(c("name")), c("callers"), c("kind")).alias("risk"))


@query(_COUNTS + " SELECT * FROM counts")
def node_risk_counts(g):
    return _counts(g)


@query(_RISK + " SELECT id, score, printf('%d.%04d', (score // 10000)::BIGINT, (score % 10000)::BIGINT) AS score_text, row_number() OVER (ORDER BY score DESC, id) AS rank FROM risks")
def node_risk_rank(g):
    # Changed roots are a review's, so their ranking goes through one task.
    score = c("risk.score")
    return _risks(g).select("id", score.alias("score"), S.score_text(score).alias("score_text"), F.row_number().over(Window.orderBy(F.desc(score), "id")).cast("long").alias("rank"))


@query(_RISK + """ SELECT id, concat_ws('+', CASE WHEN kind = 'test' THEN 'changed-test' WHEN kind = 'terraform' THEN 'test-paths-unmodeled' WHEN tests = 0 THEN 'no-static-test-path' WHEN NOT direct THEN 'indirect-test-coverage' ELSE 'direct-test-coverage' END,
    CASE WHEN flow > 0 THEN 'affected-flow' END, CASE WHEN security > 0 THEN 'security-sensitive' END, CASE WHEN called > 0 THEN 'caller-impact' END, CASE WHEN called = 1000 THEN 'high-fan-in' END) AS rationale FROM risks""")
def risk_rationale(g):
    return _risks(g).select("id", risk.rationale(c("risk"), c("kind"), c("tests"), c("direct")).alias("rationale"))


@query(_RISK + " SELECT score, id FROM risks ORDER BY score DESC, id LIMIT 1")
def top_risk(g):
    return risk.top_risk(_risks(g).select("id", "risk.score"))


@query(" SELECT p_partkey, count(DISTINCT source_id)::BIGINT AS callers, CASE WHEN count(DISTINCT source_id) = 0 THEN 0 WHEN count(DISTINCT source_id) = 1 THEN 250 WHEN count(DISTINCT source_id) <= 3 THEN 500 WHEN count(DISTINCT source_id) <= 15 THEN 750 ELSE 1000 END AS tier FROM part LEFT JOIN edges ON target_id = 500000000000000000 + p_partkey AND edges.kind IN ('CALLS', 'DEPENDS_ON') GROUP BY p_partkey")
def fan_in_tiers(g):
    calls = g.edges.where("kind in ('CALLS', 'DEPENDS_ON')").groupBy((c("target_id") - 500_000_000_000_000_000).alias("p_partkey")).agg(F.count_distinct("source_id").alias("callers"))
    return g.table("part").select("p_partkey").join(calls, "p_partkey", "left").withColumn("callers", F.coalesce("callers", F.lit(0)).cast("long")).withColumn("tier", risk.fan_in(c("callers")))


_IMPORTS = """WITH RECURSIVE imports AS (SELECT s_nationkey AS node, c_nationkey AS other FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
    WHERE s_nationkey <> c_nationkey GROUP BY ALL), reach(node, other) AS (SELECT * FROM imports UNION SELECT r.node, i.other FROM reach r JOIN imports i ON i.node = r.other)"""


def _imports(g):
    item = g.table("lineitem").join(g.table("orders"), c("l_orderkey") == c("o_orderkey"))
    both = item.join(g.table("supplier"), c("l_suppkey") == c("s_suppkey")).join(g.table("customer"), c("o_custkey") == c("c_custkey"))
    return both.where("s_nationkey <> c_nationkey").select(c("s_nationkey").alias("node"), c("c_nationkey").alias("other")).distinct()


@query(_IMPORTS + " SELECT a.node, least(a.node, min(a.other)) AS component FROM reach a JOIN reach b ON a.node = b.other AND a.other = b.node WHERE a.node <> a.other GROUP BY a.node", graph=False)
def import_cycle_scc(g):
    return traverse.strong_components(_imports(g))


@query(_IMPORTS.replace("reach(node, other)", "walk(root, node, hops)").split(", walk")[0] + """, walk(root, node, hops) AS (SELECT node, other, 1 FROM imports UNION SELECT root, other, hops + 1 FROM walk JOIN imports USING (node) WHERE hops < 25 AND walk.node <> root)
    SELECT root AS node, min(hops)::INT AS hops FROM walk WHERE root = walk.node GROUP BY root""", graph=False)
def shortest_cycle(g):
    steps = _imports(g)
    reach = traverse.closure(steps, steps.select(c("node").alias("id")).distinct(), 25)
    back = steps.select(c("node"), c("other").alias("root"))
    return reach.join(back, ["root", "node"]).groupBy("root").agg((F.min("depth") + 1).alias("hops")).withColumnRenamed("root", "node")


# -- spans ---------------------------------------------------------------------------------------------------------

_SPANS = """, spans AS (SELECT 100000000000000000 + l_orderkey % 5 AS file_id, CASE WHEN l_linenumber % 4 = 0 THEN 2 * (l_orderkey % 3000 + 1) + 1 ELSE 2 * (l_orderkey % 3000 + 1) END AS start,
    CASE WHEN l_linenumber % 4 = 0 THEN 2 * (l_orderkey % 3000 + 1) + 1 ELSE 2 * (l_orderkey % 3000 + 1 + l_linenumber) END AS stop FROM lineitem),
    cover AS (SELECT DISTINCT file_id, 2 * line_start AS start, 2 * line_end AS stop FROM nodes WHERE kind = 'test')"""


def _spans(g):
    first, anchor = c("l_orderkey") % 3000 + 1, c("l_linenumber") % 4 == 0
    return g.table("lineitem").select(
        (c("l_orderkey") % 5 + 100_000_000_000_000_000).alias("file_id"), F.when(anchor, 2 * first + 1).otherwise(2 * first).alias("start"), F.when(anchor, 2 * first + 1).otherwise(2 * (first + c("l_linenumber"))).alias("end")
    )


_MERGE = """, {name} AS (SELECT file_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= 1 + max(stop) OVER (PARTITION BY file_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY file_id, island)"""


@query(_SPANS + _MERGE.format(name="m", source="spans") + ' SELECT file_id, start, stop AS "end" FROM m')
def merged_spans(g):
    return intervals.merged(_spans(g), "file_id")


_MERGED = _SPANS + _MERGE.format(name="m", source="spans")


def _symbols(g, where="kind <> 'file'"):
    return g.nodes.where(where).select("id", "file_id", (2 * c("line_start")).alias("line_start"), (2 * c("line_end")).alias("line_end"))


@query(_MERGED + " SELECT DISTINCT n.file_id, n.id FROM nodes n JOIN m s ON s.file_id = n.file_id AND s.start <= 2 * n.line_end AND 2 * n.line_start <= s.stop WHERE n.kind <> 'file'")
def changed_symbols_interval(g):
    return intervals.touched(_spans(g), _symbols(g), "file_id").select("file_id", "id").distinct()


@query(_SPANS + _MERGE.format(name="a", source="spans") + """, pts AS (SELECT file_id, start, stop, unnest(range(start, stop + 1)) AS p FROM a),
    dark AS (SELECT DISTINCT file_id, unnest(range(start, stop + 1)) AS p FROM cover), free AS (SELECT * FROM pts ANTI JOIN dark USING (file_id, p)),
    runs AS (SELECT file_id, min(p) AS a, max(p) AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY file_id, start ORDER BY p) AS k FROM free) GROUP BY file_id, start, k),
    rounded AS (SELECT file_id, CASE WHEN a = b THEN a ELSE a + a % 2 END AS start, CASE WHEN a = b THEN b ELSE b - b % 2 END AS "end" FROM runs) SELECT * FROM rounded WHERE start <= "end" """)
def residual_ranges(g):
    return intervals.residual(_spans(g), _symbols(g, "kind = 'test'").select("file_id", c("line_start").alias("start"), c("line_end").alias("end")), "file_id")


@query(_MERGED + """, notes AS (SELECT event_id, 100000000000000000 + event_id % 5 AS file_id, 2 * (event_id % 3000 + 1) AS place FROM events), hit AS (SELECT DISTINCT n.file_id, 2 * n.line_start AS start, 2 * n.line_end AS stop FROM nodes n JOIN m s ON s.file_id = n.file_id AND s.start <= 2 * n.line_end AND 2 * n.line_start <= s.stop WHERE kind <> 'file'),
    light AS (SELECT DISTINCT file_id, unnest(range(start, stop + 1)) AS place FROM (SELECT * FROM hit UNION SELECT * FROM m)) SELECT event_id FROM notes SEMI JOIN light USING (file_id, place)""")
def notes_in_scope(g):
    notes = g.table("events").select("event_id", (c("event_id") % 5 + 100_000_000_000_000_000).alias("file_id"), (2 * (c("event_id") % 3000 + 1)).alias("line_start")).withColumn("line_end", c("line_start"))
    return intervals.in_scope(notes, _spans(g), _symbols(g), "file_id").select("event_id").distinct()


@query(_SPANS + """, dark AS (SELECT DISTINCT file_id, unnest(range(start, stop + 1)) AS p FROM cover), region AS (SELECT l_orderkey, l_linenumber, l_partkey, 100000000000000000 + l_partkey % 6 AS file_id, 2 * (l_partkey % 4000 + 1) AS a, 2 * (l_partkey % 4000 + 1 + l_linenumber) AS b FROM lineitem),
    hit AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, unnest(range(a, b + 1)) AS p FROM region) SEMI JOIN dark USING (file_id, p))
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN file_id = 100000000000000005 THEN 'unmapped-file' ELSE 'unmapped-region' END AS reason FROM region ANTI JOIN hit USING (l_orderkey, l_linenumber, l_partkey)""")
def coverage_unmapped(g):
    region = g.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (c("l_partkey") % 6 + 100_000_000_000_000_000).alias("file_id"), (2 * (c("l_partkey") % 4000 + 1)).alias("line_start"), (2 * (c("l_partkey") % 4000 + 1 + c("l_linenumber"))).alias("line_end"))
    cover = _symbols(g, "kind = 'test'").select("file_id", c("line_start").alias("start"), c("line_end").alias("end"))
    files = g.nodes.where("kind = 'file'").select(c("id").alias("file_id"))
    return intervals.unmapped(region, cover, files, "file_id", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""WITH RECURSIVE links AS (SELECT o_orderkey AS link, unnest(['o' || o_orderkey // 8, 'c' || o_custkey, 'd' || o_custkey % 400]) AS id FROM orders),
    seen(id) AS (SELECT 'c1' UNION SELECT b.id FROM seen s JOIN links a ON a.id = s.id JOIN links b ON b.link = a.link) SELECT id FROM seen""", graph=False)
def provenance_fixpoint(g):
    ends = F.array(F.concat(F.lit("o"), F.floor(c("o_orderkey") / 8)), F.concat(F.lit("c"), c("o_custkey")), F.concat(F.lit("d"), c("o_custkey") % 400))
    links = g.table("orders").select(c("o_orderkey").alias("link"), F.explode(ends).alias("id"))
    return intervals.provenance_fixpoint(links, g.spark.sql("select 'c1' as id"))


@query("""WITH named AS (SELECT p_name AS name, p_partkey FROM part UNION SELECT p_brand || '/' || p_type || '/' || p_size, p_partkey FROM part), runs AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || (p_size + p_partkey % 2) AS test FROM part)
    SELECT test, CASE WHEN count(p_partkey) = 0 THEN 'missing' WHEN count(p_partkey) = 1 THEN 'mapped' ELSE 'ambiguous' END AS state, CASE WHEN count(p_partkey) = 1 THEN min(p_partkey) END AS p_partkey FROM runs LEFT JOIN named ON name = test GROUP BY test""", graph=False)
def test_mapping(g):
    part = g.table("part")
    sku = lambda size: F.concat(c("p_brand"), F.lit("/"), c("p_type"), F.lit("/"), size)
    named = part.select(c("p_name").alias("test"), "p_partkey").unionByName(part.select(sku(c("p_size")).alias("test"), "p_partkey")).distinct().groupBy("test").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey"))
    runs = part.select(sku(c("p_size") + (c("p_partkey") % 2).cast("int")).alias("test")).distinct()
    return runs.join(named, "test", "left").select("test", F.when(c("n").isNull(), "missing").when(c("n") == 1, "mapped").otherwise("ambiguous").alias("state"), F.when(c("n") == 1, c("p_partkey")).alias("p_partkey"))


# -- two sides --------------------------------------------------------------------------------------------------------

_SIDES = """WITH sides AS (SELECT p_brand || '/' || p_type AS identity, 'size ' || (p_size // 10) AS base_sig, 'size ' || (p_size // 10 + (p_partkey % 5 = 0)::INT) AS head_sig, p_partkey AS line, p_partkey AS id FROM part),
    b AS (SELECT *, row_number() OVER (PARTITION BY identity, base_sig ORDER BY line, id) AS rn FROM sides WHERE id % 10 <> 3), h AS (SELECT *, row_number() OVER (PARTITION BY identity, head_sig ORDER BY line, id) AS rn FROM sides WHERE id % 10 <> 7),
    b2 AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY line, id) AS k FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.identity = b.identity AND h.head_sig = b.base_sig AND h.rn = b.rn)),
    h2 AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY line, id) AS k FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE h.identity = b.identity AND h.head_sig = b.base_sig AND h.rn = b.rn))
    SELECT CASE WHEN h2.line IS NULL THEN 'removed' WHEN b2.line IS NULL THEN 'added' ELSE 'changed' END AS status, coalesce(b2.identity, h2.identity) AS identity, b2.line AS base_line, h2.line AS head_line FROM b2 FULL JOIN h2 ON b2.identity = h2.identity AND b2.k = h2.k"""


@query(_SIDES, graph=False)
def api_diff(g):
    part = g.table("part")
    side = lambda keep, size: part.where(keep).select(F.concat(c("p_brand"), F.lit("/"), c("p_type")).alias("identity"), F.concat(F.lit("size "), size.cast("string")).alias("signature"), c("p_partkey").alias("line"), c("p_partkey").alias("id"))
    tens = F.floor(c("p_size") / 10)
    return diff.api_diff(side("p_partkey % 10 <> 3", tens), side("p_partkey % 10 <> 7", tens + F.when(c("p_partkey") % 5 == 0, 1).otherwise(0)))


@query(", gone AS (SELECT 'gone:' || p_partkey AS key FROM part WHERE p_partkey % 10 = 3) SELECT ref_id, arg_min(key, rank) AS key FROM ref_keys JOIN gone USING (key) JOIN (SELECT ref_id FROM resolved WHERE state <> 'resolved') USING (ref_id) GROUP BY ref_id")
def broken_references(g):
    gone = g.table("part").where("p_partkey % 10 = 3").select(F.concat(F.lit("gone:"), c("p_partkey")).alias("key"))
    return diff.broken_references(gone, g.resolved)


@query("""WITH a AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 2 = 0)), b AS (SELECT doc_id - 1 AS doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 2 = 1)),
    x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS rn FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS rn FROM b)
    SELECT 'removed' AS side, doc_id, md5(line) AS line, n::BIGINT AS n FROM x ANTI JOIN y USING (doc_id, line, rn) UNION ALL SELECT 'added', doc_id, md5(line), n FROM y ANTI JOIN x USING (doc_id, line, rn)""", graph=False)
def record_bag_diff(g):
    docs = g.table("documents")
    side = lambda odd: docs.where(c("doc_id") % 2 == odd).select((c("doc_id") - odd).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", (c("n") + 1).cast("long"))
    return diff.bag_diff(side(0), side(1), ["doc_id", "line"], "n").withColumn("line", F.md5(c("line").cast("binary")))


@query("""WITH o AS (SELECT p_brand AS key, p_partkey AS n, p_size AS size, p_type AS type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS occurrence FROM part WHERE p_partkey % 10 <> 3),
    w AS (SELECT p_brand AS key, p_partkey AS n, p_size + (p_partkey % 5 = 0)::INT AS size, p_type AS type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS occurrence FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 50 <> 7),
    j AS (SELECT key, occurrence, o.n AS a, w.n AS b, concat_ws(',', CASE WHEN o.size <> w.size THEN 'size' END, CASE WHEN o.type <> w.type THEN 'type' END) AS changed FROM o FULL JOIN w USING (key, occurrence))
    SELECT key, occurrence::INT AS occurrence, status, CASE WHEN status = 'modified' THEN changed ELSE '' END AS changed, ambiguous FROM (SELECT *, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN changed <> '' THEN 'modified' END AS status, max(occurrence) OVER (PARTITION BY key) > 1 AS ambiguous FROM j) WHERE status IS NOT NULL""", graph=False)
def tsv_diff(g):
    part = g.table("part").where("p_partkey % 10 <> 3")
    side = lambda df, size: df.select(c("p_brand").alias("key"), c("p_partkey").alias("n"), size.alias("size"), c("p_type").alias("type"))
    return diff.row_diff(side(part, c("p_size")), side(part.where("p_partkey % 50 <> 7"), c("p_size") + F.when(c("p_partkey") % 5 == 0, 1).otherwise(0)), "key", "n")


_PATHS = """paths AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'D' WHEN o_orderkey % 3 = 1 THEN 'A' ELSE 'M' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN '.cargo/vendor/pkg' || o_custkey % 20 || '/src/' ELSE 'src/' END || o_orderkey || '.rs' AS path, o_orderkey FROM orders),
    renames AS (SELECT d.path AS old_path, a.path FROM paths d JOIN paths a ON a.o_orderkey = d.o_orderkey + 1 WHERE d.status = 'D' AND a.status = 'A' AND d.o_orderkey % 2 = 0)"""


def _paths(g):
    status = F.when(c("o_orderkey") % 3 == 0, "D").when(c("o_orderkey") % 3 == 1, "A").otherwise("M")
    head = F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit(".cargo/vendor/pkg"), c("o_custkey") % 20, F.lit("/src/"))).otherwise(F.lit("src/"))
    return g.table("orders").select(status.alias("status"), F.concat(head, c("o_orderkey"), F.lit(".rs")).alias("path"), "o_orderkey", "o_custkey")


def _renames(g):
    p = _paths(g)
    d = p.where("status = 'D' and o_orderkey % 2 = 0").select((c("o_orderkey") + 1).alias("o_orderkey"), c("path").alias("old_path"))
    return d.join(p.where("status = 'A'"), "o_orderkey").select("old_path", "path")


@query(f"WITH {_PATHS} SELECT 'R' AS status, old_path, path FROM renames UNION ALL SELECT status, NULL, path FROM paths p WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE (p.status = 'D' AND r.old_path = p.path) OR (p.status = 'A' AND r.path = p.path))", graph=False)
def rename_coalesce(g):
    return diff.coalesce_renames(_paths(g).select("status", "path"), _renames(g))


@query(f"""WITH {_PATHS}, changes AS (SELECT p.path, r.old_path FROM paths p LEFT JOIN renames r USING (path)), found AS (SELECT path, unnest(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'committed' END, CASE WHEN o_orderkey % 5 = 0 THEN 'staged' END, CASE WHEN o_orderkey % 7 = 0 THEN 'unstaged' END], lambda x: x IS NOT NULL)) AS layer FROM paths)
    SELECT c.path, coalesce(string_agg(DISTINCT layer, ',' ORDER BY layer), '') AS layers FROM changes c LEFT JOIN found f ON f.path = c.path OR f.path = c.old_path GROUP BY c.path""", graph=False)
def layers_per_path(g):
    p = _paths(g)
    layer = F.array_compact(F.array(F.when(c("o_orderkey") % 2 == 0, "committed"), F.when(c("o_orderkey") % 5 == 0, "staged"), F.when(c("o_orderkey") % 7 == 0, "unstaged")))
    return diff.layers(p.select("path").join(_renames(g), "path", "left"), p.select("path", F.explode(layer).alias("layer")))


@query(f"WITH {_PATHS} SELECT regexp_extract(path, '^\\.cargo/vendor/([^/]+)/.+', 1) AS package, count(*)::BIGINT AS files, count(*) FILTER (WHERE status = 'A')::BIGINT AS added, count(*) FILTER (WHERE status = 'D')::BIGINT AS deleted, count(*) FILTER (WHERE status = 'M')::BIGINT AS modified FROM paths WHERE path LIKE '.cargo/vendor/%' GROUP BY 1", graph=False)
def vendored_package_summary(g):
    n = lambda s, name: F.count_if(c("status") == s).alias(name)
    return _paths(g).withColumn("package", S.dependency_package(c("path"))).where("package is not null").groupBy("package").agg(F.count("*").alias("files"), n("A", "added"), n("D", "deleted"), n("M", "modified"))


@query("""SELECT o_orderpriority AS scope, sum(a)::BIGINT AS additions, sum(d)::BIGINT AS deletions, count(*) FILTER (WHERE a IS NULL)::BIGINT AS unknown FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 40 END AS a, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 30 END AS d FROM orders) GROUP BY 1""", graph=False)
def change_totals(g):
    known = c("o_orderkey") % 13 != 0
    rows = g.table("orders").select(c("o_orderpriority").alias("scope"), F.when(known, c("o_custkey") % 40).alias("a"), F.when(known, c("o_custkey") % 30).alias("d"))
    return rows.groupBy("scope").agg(F.sum("a").alias("additions"), F.sum("d").alias("deletions"), F.count_if(c("a").isNull()).alias("unknown"))


# -- text -----------------------------------------------------------------------------------------------------------


@query("WITH t AS (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS w FROM part), q AS (SELECT string_split(min(p_name), ' ') AS q FROM part) SELECT p_partkey FROM t, q GROUP BY p_partkey HAVING bool_or(starts_with(w, substr(lower(q[1]), 1, 2))) AND bool_or(starts_with(w, lower(q[2])))", graph=False)
def search_prefix_and(g):
    part = g.table("part")
    words = part.agg(F.min("p_name")).first()[0].split(" ")
    index = search.postings(part.select(c("p_partkey").alias("id"), c("p_name").alias("name")))
    return search.search(index, f"{words[0][:2]} {words[1]}").select(c("node_id").alias("p_partkey"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, unnest(regexp_extract_all(line, '(?:^|[^0-9A-Za-z])((?:sha1:|sha256:|blake3:)?[0-9a-fA-F]{40}(?:[0-9a-fA-F]{24})?)\\b', 1)) AS digest FROM l""", graph=False)
def digest_tokens(g):
    return g.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.explode(S.digest_tokens(c("line"))).alias("digest"))


@query("SELECT o_orderkey, 'REQ_' || o_custkey % 9 || '-' || o_orderkey AS token FROM orders WHERE o_orderkey % 3 <> 0", graph=False)
def requirement_tokens(g):
    token = F.concat(F.lit("REQ_"), c("o_custkey") % 9, F.lit("-"), c("o_orderkey"))
    line = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("no x"), token)).when(c("o_orderkey") % 3 == 1, F.concat(F.lit("see ("), token, F.lit(")."))).otherwise(token)
    return g.table("orders").select("o_orderkey", F.explode(S.requirement_tokens(line)).alias("token"))


@query(f"SELECT doc_id, regexp_matches(lower(text), '{_SECURE}') AS sensitive FROM documents", graph=False)
def security_predicate(g):
    return g.table("documents").select("doc_id", S.security_sensitive(c("text")).alias("sensitive"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 2 * l_partkey + 1 ELSE 2 * l_partkey END AS start, CASE WHEN l_linenumber % 4 = 0 THEN 2 * l_partkey + 1 WHEN l_linenumber % 4 = 1 THEN 2 * l_partkey ELSE 2 * (l_partkey + l_linenumber - 1) END AS "end" FROM lineitem""", graph=False)
def hunk_parse(g):
    rows = F.when(c("l_linenumber") % 4 == 0, ",0").when(c("l_linenumber") % 4 == 1, "").otherwise(F.concat(F.lit(","), c("l_linenumber")))
    header = F.concat(F.lit("@@ -"), c("l_suppkey"), F.lit(",2 +"), c("l_partkey"), rows, F.lit(" @@ fn x()"))
    return g.table("lineitem").select("l_orderkey", "l_linenumber", S.hunk_span(header).alias("s")).select("l_orderkey", "l_linenumber", "s.start", "s.end")


@query("SELECT user_id, event_id, line FROM (SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT user_id, event_id, event_type || ' ' || event_id AS line FROM events)) WHERE used <= 1536", graph=False)
def bounded_review_lines(g):
    lines = g.table("events").select("user_id", "event_id", F.concat_ws(" ", "event_type", c("event_id").cast("string")).alias("line"))
    return bounded_lines(lines, "user_id", "event_id", "line", 1536)


@query("SELECT event_type AS source, nxt AS target, count(*)::BIGINT AS support FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY ALL", graph=False)
def event_transition_edges(g):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return g.table("events").select(c("event_type").alias("source"), F.lead("event_type").over(w).alias("target")).where("target is not null").groupBy("source", "target").agg(F.count("*").alias("support"))


@query("SELECT 'f' || o_orderkey AS path, 'v' || CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END || '-' || o_custkey AS content_key FROM orders WHERE o_orderkey % 10 <> 7", graph=False)
def incremental_equals_fresh(g):
    orders = g.table("orders")
    key = lambda v: F.concat(F.lit("v"), v.cast("string"), F.lit("-"), c("o_custkey"))
    side = lambda keep, v: orders.where(keep).select(F.concat(F.lit("f"), c("o_orderkey")).alias("path"), key(v).alias("content_key"))
    old, new = side("o_orderkey % 10 <> 3", F.lit(0)), side("o_orderkey % 10 <> 7", F.when(c("o_orderkey") % 11 == 0, 1).otherwise(0))
    changes = changed_files(old, new)
    return apply_delta(old, changes.select("path"), new.join(changes.where("change <> 'removed'"), "path", "left_semi"))


@query("SELECT o_custkey, o_orderkey AS seed FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", graph=False)
def seed_selection(g):
    best = F.max_by("o_orderkey", F.struct((c("o_orderstatus") == "F").alias("same"), c("o_totalprice").alias("generation"), (-c("o_orderkey")).alias("last")))
    return g.table("orders").groupBy("o_custkey").agg(best.alias("seed"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN 'n' || p_partkey WHEN p_partkey % 5 = 2 THEN 'a b' || p_partkey END AS name FROM part""", graph=False)
def scip_symbol_name(g):
    key, tail = c("p_partkey"), c("p_partkey") % 5
    symbol = F.when(tail == 0, F.concat(F.lit("cargo x 1 m/n"), key, F.lit("#"))).when(tail == 1, F.concat(F.lit("cargo x 1 m/T#n"), key, F.lit("(+1)."))).when(tail == 2, F.concat(F.lit("cargo x 1 `a b"), key, F.lit("`!")))
    symbol = symbol.when(tail == 3, F.concat(F.lit("cargo x 1 n"), key, F.lit("."))).otherwise(F.concat(F.lit("local n"), key))
    return g.table("part").select("p_partkey", S.symbol_name(symbol).alias("name"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most called nodes: references resolved, edges counted, fan-in tiers."""
    g = Graph.of(spark, sf_dir)
    calls = g.edges.where("kind in ('CALLS', 'DEPENDS_ON')").groupBy("target_id").agg(F.count("*").alias("callers"), F.sum("support").alias("support"))
    return calls.withColumn("tier", risk.fan_in(c("callers"))).orderBy(F.desc("support"), "target_id").limit(10)
