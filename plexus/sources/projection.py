"""A code graph laid over the relational tables: nodes, lookup keys, ranked references, heritage."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve, traverse
from ..plans.lineage import cut

#: First digits of node ids by table.
CODES = {"region": 1, "nation": 2, "supplier": 3, "customer": 4, "part": 5, "order": 6}


def node_id(kind: str, key: str | Column) -> Column:
    return F.lit(CODES[kind] * 10**17) + (F.col(key) if isinstance(key, str) else key).cast("long")


def text(head: str, *parts) -> Column:
    return F.concat(F.lit(head), *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts])


_IMAGES: dict[tuple, Graph] = {}


class Graph:
    """Tables of the graph as lazy DataFrames; nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Graph:
        """The graph of a folder, resolved once for its files as they are: its image is what all queries read."""
        path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        held = []
        while files.hasNext():
            f = files.next()
            held.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(held)))
        if key not in _IMAGES:
            _IMAGES.clear()
            _IMAGES[key] = cls(spark, sf_dir)
        return _IMAGES[key]

    def once(self, name: str, make: Callable):
        """What ``make`` gives, kept for this image."""
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nodes(self) -> DataFrame:
        """id, kind, name, file_id, parent_id, owner_key, line_start, line_end."""
        t, null = self.table, F.lit(None)
        start = lambda key: (F.col(key) % 1000 * 3 + 1).cast("long")
        nation_file = t("nation").select(F.col("n_nationkey").alias("_n"), node_id("region", "n_regionkey").alias("_file"))
        row = lambda i, kind, name, file, parent, owner, first, rows: [
            i.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), name.alias("name"), file.alias("file_id"), parent.cast("long").alias("parent_id"),
            owner.cast("string").alias("owner_key"), first.alias("line_start"), (first + rows).cast("long").alias("line_end"),
        ]
        region, nation = node_id("region", "r_regionkey"), node_id("nation", "n_nationkey")
        parts = [
            t("region").select(*row(region, "file", F.col("r_name"), region, null, null, F.lit(1).cast("long"), F.lit(4000))),
            t("nation").select(*row(nation, "type", F.col("n_name"), node_id("region", "n_regionkey"), node_id("region", "n_regionkey"), null, start("n_nationkey"), F.lit(90))),
        ]
        for kind, p in (("supplier", "s"), ("customer", "c")):
            key, home = f"{p}_{kind[:4]}key", f"{p}_nationkey"
            owned = t(kind).join(nation_file, F.col(home) == F.col("_n"))
            parts.append(owned.select(*row(node_id(kind, key), "function", text("m", F.col(key) % 7), F.col("_file"), node_id("nation", home), text("nation:", home), start(key), F.col(key) % 5)))
        parts.append(t("part").select(*row(node_id("part", "p_partkey"), "function", F.col("p_name"), node_id("region", F.col("p_partkey") % 5), null, null, start("p_partkey"), F.col("p_size"))))
        kind = F.when(F.col("o_orderpriority").startswith("1-"), "test").otherwise("function")
        parts.append(t("orders").select(*row(node_id("order", "o_orderkey"), kind, text("order_", "o_orderkey"), node_id("region", F.col("o_orderkey") % 5), null, null, start("o_orderkey"), F.col("o_orderkey") % 3)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cut(out, "nodes")

    @cached_property
    def node_keys(self) -> DataFrame:
        """key, node_id: names that references may use; part-sku keys are shared by several parts."""
        t = self.table
        plain = [("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("supplier", "supplier", "s_suppkey"), ("customer", "customer", "c_custkey"), ("part", "part", "p_partkey"), ("order", "orders", "o_orderkey")]
        out = t("part").select(text("part-sku:", "p_brand", F.lit("/"), "p_type", F.lit("/"), "p_size").alias("key"), node_id("part", "p_partkey").alias("node_id"))
        for kind, name, key in plain:
            out = out.unionByName(t(name).select(text(f"{kind}:", key).alias("key"), node_id(kind, key).alias("node_id")))
        return out

    @cached_property
    def refs(self) -> DataFrame:
        """ref_id (kind of reference and its key, as text), source_id, kind, line, keys (ranked), alias_key, source (static or scip)."""
        t, null = self.table, F.lit(None).cast("string")
        line, item = F.col("l_linenumber").cast("long"), t("lineitem")
        sku = t("part").select(F.col("p_partkey").alias("_p"), text("part-sku:", "p_brand", F.lit("/"), "p_type", F.lit("/"), (F.col("p_size") + F.col("p_partkey") % 2).cast("int")).alias("_sku"))
        part_key = text("part:", "l_partkey")
        keys = F.when(line % 5 == 0, F.array(text("gone:", "l_partkey"))).when(line % 3 == 0, F.array(F.col("_sku"), part_key)).otherwise(F.array(part_key))
        make = lambda code, n, src, kind, ln, ks, alias=null: [
            F.concat_ws(":", F.lit(str(code)), *[x.cast("string") for x in n]).alias("ref_id"), src.alias("source_id"), F.lit(kind).alias("kind"), ln.cast("long").alias("line"), ks.alias("keys"), alias.alias("alias_key"),
        ]
        number = [F.col("l_orderkey"), line, F.col("l_partkey"), F.col("l_suppkey")]
        c = F.col
        rows = [
            item.join(sku, c("l_partkey") == c("_p")).select(*make(1, number, node_id("order", "l_orderkey"), "CALLS", line, keys)),
            item.select(*make(2, number, node_id("part", "l_partkey"), "CALLS", line, F.array(text("supplier:", "l_suppkey")))),
            t("orders").select(*make(3, [c("o_orderkey")], node_id("customer", "o_custkey"), "CALLS", c("o_orderkey") % 100 + 1, F.array(text("order:", "o_orderkey")))),
            t("supplier").select(*make(4, [c("s_suppkey")], node_id("supplier", "s_suppkey"), "DEPENDS_ON", F.lit(1), F.array(text("nation:", "s_nationkey")))),
            t("customer").select(*make(5, [c("c_custkey")], node_id("customer", "c_custkey"), "DEPENDS_ON", F.lit(1), F.array(text("nation:", "c_nationkey")))),
            t("nation").select(*make(6, [c("n_nationkey")], node_id("nation", "n_nationkey"), "IMPORTS", F.lit(1), F.array(text("region:", "n_regionkey")))),
            t("events").select(*make(7, [c("event_id")], node_id("customer", "user_id"), "CALLS", c("event_id") % 100 + 1, F.array(text("customer:", c("user_id") * 20)))),
            t("supplier").where(c("s_suppkey") % 10 == 0).select(*make(8, [c("s_suppkey")], node_id("nation", "s_nationkey"), "IMPORTS", c("s_suppkey") % 100 + 1, F.array(text("supplier:", "s_suppkey")), text("export:", "s_nationkey"))),
            t("customer").where(c("c_custkey") % 5 == 0).select(*make(9, [c("c_custkey")], node_id("customer", "c_custkey"), "CALLS", c("c_custkey") % 100 + 1, F.array(text("export:", "c_nationkey"), text("gone:", "c_custkey")))),
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.withColumn("source", F.when((F.col("source_id") + F.col("line")) % 11 == 0, "scip").otherwise("static"))

    @cached_property
    def heritage(self) -> DataFrame:
        """implementor_key, trait_key: nation n (from 1) implements nation n div 5."""
        n = self.table("nation").where("n_nationkey >= 1")
        return n.select(text("nation:", "n_nationkey").alias("implementor_key"), text("nation:", F.floor(F.col("n_nationkey") / 5)).alias("trait_key"))

    @cached_property
    def resolved(self) -> DataFrame:
        return cut(resolve.references(self.refs, self.node_keys), "resolved")

    @cached_property
    def edges(self) -> DataFrame:
        return cut(resolve.edge_support(self.resolved, self.nodes), "edges")

    @cached_property
    def implements(self) -> DataFrame:
        return cut(resolve.heritage(self.heritage, self.node_keys, self.nodes), "implements")

    @cached_property
    def overrides(self) -> traverse.Overrides:
        return traverse.Overrides(self.implements, self.nodes)


#: The same tables in SQL, as the head of a query.
GRAPH_SQL = r"""
nodes AS (
  SELECT 100000000000000000::BIGINT + r_regionkey AS id, 'file' AS kind, r_name AS name, 100000000000000000::BIGINT + r_regionkey AS file_id, NULL::BIGINT AS parent_id, NULL::VARCHAR AS owner_key, 1::BIGINT AS line_start, 4001::BIGINT AS line_end FROM region
  UNION ALL SELECT 200000000000000000 + n_nationkey, 'type', n_name, 100000000000000000 + n_regionkey, 100000000000000000 + n_regionkey, NULL, n_nationkey % 1000 * 3 + 1, n_nationkey % 1000 * 3 + 91 FROM nation
  UNION ALL SELECT 300000000000000000 + s_suppkey, 'function', 'm' || s_suppkey % 7, 100000000000000000 + n_regionkey, 200000000000000000 + s_nationkey, 'nation:' || s_nationkey, s_suppkey % 1000 * 3 + 1, s_suppkey % 1000 * 3 + 1 + s_suppkey % 5 FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 400000000000000000 + c_custkey, 'function', 'm' || c_custkey % 7, 100000000000000000 + n_regionkey, 200000000000000000 + c_nationkey, 'nation:' || c_nationkey, c_custkey % 1000 * 3 + 1, c_custkey % 1000 * 3 + 1 + c_custkey % 5 FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 500000000000000000 + p_partkey, 'function', p_name, 100000000000000000 + p_partkey % 5, NULL, NULL, p_partkey % 1000 * 3 + 1, p_partkey % 1000 * 3 + 1 + p_size FROM part
  UNION ALL SELECT 600000000000000000 + o_orderkey, CASE WHEN o_orderpriority LIKE '1-%' THEN 'test' ELSE 'function' END, 'order_' || o_orderkey, 100000000000000000 + o_orderkey % 5, NULL, NULL, o_orderkey % 1000 * 3 + 1, o_orderkey % 1000 * 3 + 1 + o_orderkey % 3 FROM orders),
node_keys AS (
  SELECT 'part-sku:' || p_brand || '/' || p_type || '/' || p_size AS key, 500000000000000000::BIGINT + p_partkey AS node_id FROM part
  UNION ALL SELECT 'region:' || r_regionkey, 100000000000000000 + r_regionkey FROM region UNION ALL SELECT 'nation:' || n_nationkey, 200000000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 300000000000000000 + s_suppkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 400000000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 500000000000000000 + p_partkey FROM part UNION ALL SELECT 'order:' || o_orderkey, 600000000000000000 + o_orderkey FROM orders),
refs0 AS (
  SELECT '1:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS ref_id, 600000000000000000 + l_orderkey AS source_id, 'CALLS' AS kind, l_linenumber::BIGINT AS line,
         CASE WHEN l_linenumber % 5 = 0 THEN ['gone:' || l_partkey] WHEN l_linenumber % 3 = 0 THEN ['part-sku:' || p_brand || '/' || p_type || '/' || (p_size + p_partkey % 2), 'part:' || l_partkey] ELSE ['part:' || l_partkey] END AS keys, NULL::VARCHAR AS alias_key
  FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT '2:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 500000000000000000 + l_partkey, 'CALLS', l_linenumber, ['supplier:' || l_suppkey], NULL FROM lineitem
  UNION ALL SELECT '3:' || o_orderkey, 400000000000000000 + o_custkey, 'CALLS', o_orderkey % 100 + 1, ['order:' || o_orderkey], NULL FROM orders
  UNION ALL SELECT '4:' || s_suppkey, 300000000000000000 + s_suppkey, 'DEPENDS_ON', 1, ['nation:' || s_nationkey], NULL FROM supplier
  UNION ALL SELECT '5:' || c_custkey, 400000000000000000 + c_custkey, 'DEPENDS_ON', 1, ['nation:' || c_nationkey], NULL FROM customer
  UNION ALL SELECT '6:' || n_nationkey, 200000000000000000 + n_nationkey, 'IMPORTS', 1, ['region:' || n_regionkey], NULL FROM nation
  UNION ALL SELECT '7:' || event_id, 400000000000000000 + user_id, 'CALLS', event_id % 100 + 1, ['customer:' || user_id * 20], NULL FROM events
  UNION ALL SELECT '8:' || s_suppkey, 200000000000000000 + s_nationkey, 'IMPORTS', s_suppkey % 100 + 1, ['supplier:' || s_suppkey], 'export:' || s_nationkey FROM supplier WHERE s_suppkey % 10 = 0
  UNION ALL SELECT '9:' || c_custkey, 400000000000000000 + c_custkey, 'CALLS', c_custkey % 100 + 1, ['export:' || c_nationkey, 'gone:' || c_custkey], NULL FROM customer WHERE c_custkey % 5 = 0),
refs AS (SELECT *, CASE WHEN (source_id + line) % 11 = 0 THEN 'scip' ELSE 'static' END AS source FROM refs0),
heritage AS (SELECT 'nation:' || n_nationkey AS implementor_key, 'nation:' || n_nationkey // 5 AS trait_key FROM nation WHERE n_nationkey >= 1),
cand AS MATERIALIZED (SELECT key, count(DISTINCT node_id) AS n, min(node_id) AS target FROM node_keys GROUP BY key),
ref_keys AS MATERIALIZED (SELECT ref_id, alias_key, unnest(keys) AS key, unnest(range(len(keys))) AS rank FROM refs),
exported AS (SELECT ref_id, alias_key, arg_min(coalesce(n, 0), rank) FILTER (WHERE n > 0) AS n, arg_min(target, rank) FILTER (WHERE n > 0) AS target FROM ref_keys LEFT JOIN cand USING (key) WHERE alias_key IS NOT NULL GROUP BY ALL),
alias_cand AS MATERIALIZED (SELECT alias_key AS key, max((n > 1)::INT) AS amb, count(DISTINCT CASE WHEN n = 1 THEN target END) AS n, min(CASE WHEN n = 1 THEN target END) AS target FROM exported GROUP BY alias_key),
merged AS MATERIALIZED (SELECT r.ref_id, r.rank, CASE
             WHEN coalesce(c.n, 0) > 1 OR (r.alias_key IS NULL AND (coalesce(a.amb, 0) = 1 OR coalesce(a.n, 0) > 1)) THEN 2
             WHEN c.n = 1 AND r.alias_key IS NULL AND a.n = 1 AND a.target <> c.target THEN 2
             WHEN c.n = 1 OR (r.alias_key IS NULL AND a.n = 1) THEN 1 ELSE 0 END AS state, coalesce(c.target, CASE WHEN r.alias_key IS NULL THEN a.target END) AS target
           FROM ref_keys r LEFT JOIN cand c ON c.key = r.key LEFT JOIN alias_cand a ON a.key = r.key),
pick AS (SELECT ref_id, arg_min(state, rank) AS state, arg_min(target, rank) AS target FROM merged WHERE state > 0 GROUP BY ref_id),
resolved AS MATERIALIZED (SELECT refs.*, CASE p.state WHEN 1 THEN 'resolved' WHEN 2 THEN 'ambiguous' ELSE 'missing' END AS state, CASE WHEN p.state = 1 THEN p.target END AS target_id FROM refs LEFT JOIN pick p USING (ref_id)),
edges AS MATERIALIZED (SELECT source_id, target_id, CASE WHEN r.kind = 'CALLS' AND n.kind = 'test' THEN 'TEST_CALLS' ELSE r.kind END AS kind, count(*)::BIGINT AS support FROM resolved r JOIN nodes n ON n.id = r.source_id WHERE state = 'resolved' GROUP BY ALL),
implements AS (SELECT i.target AS implementor_id, t.target AS trait_id FROM heritage h JOIN cand i ON i.key = h.implementor_key AND i.n = 1 JOIN cand t ON t.key = h.trait_key AND t.n = 1 WHERE i.target <> t.target)
"""
