"""A review of changes as lines of sections: what the risk, flow and comparison operators found, in the order it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import risk as R


def risk_lines(risks: DataFrame) -> DataFrame:
    """section, sort, line of risks (id, kind, tests, direct, risk): the highest first, of equals the smallest id."""
    r = F.col("risk")
    text = F.concat(
        F.lit("risk "), S.score_text(r["score"]), F.lit(" n"), F.col("id").cast("string"), F.lit(" flow="), S.score_text(r["flow"]), F.lit(" tests="), S.score_text(r["tests"]),
        F.lit(" security="), S.score_text(r["security"]), F.lit(" callers="), S.score_text(r["callers"]), F.lit(" "), R.rationale(r, F.col("kind"), F.col("tests"), F.col("direct")),
    )
    return risks.select(F.lit("risk").alias("section"), F.struct((-r["score"]).alias("a"), F.col("id").cast("string").alias("b"), F.col("id").alias("c")).alias("sort"), text.alias("line"))


def flow_lines(flows: DataFrame) -> DataFrame:
    """section, sort, line of flows: the most critical first, of equals the smallest entry."""
    part = lambda name: F.concat(F.lit(f" {name}="), F.col(name).cast("string"))
    text = F.concat(F.lit("flow "), S.score_text(F.col("criticality")), F.lit(" n"), F.col("entry").cast("string"), *[part(c) for c in ("nodes", "files", "external", "security", "tested", "depth")])
    return flows.select(F.lit("flow").alias("section"), F.struct((-F.col("criticality")).alias("a"), F.col("entry").cast("string").alias("b"), F.col("entry").alias("c")).alias("sort"), text.alias("line"))


def api_lines(differences: DataFrame) -> DataFrame:
    """section, sort, line of an API comparison, by place and name."""
    place = F.coalesce("head_line", "base_line").cast("long")
    text = F.concat(F.lit("api "), F.col("status"), F.lit(" "), S.escaped(F.col("identity")), F.lit(" "), F.coalesce(F.col("base_line").cast("string"), F.lit("-")), F.lit(" "), F.coalesce(F.col("head_line").cast("string"), F.lit("-")))
    return differences.select(F.lit("api").alias("section"), F.struct(place.alias("a"), F.concat_ws("|", "identity", "status").alias("b"), F.coalesce("base_line", F.lit(0)).cast("long").alias("c")).alias("sort"), text.alias("line"))


def summary(risks: DataFrame, flows: DataFrame, differences: DataFrame) -> DataFrame:
    """section, sort, line: one line of totals; without changed symbols the overall risk is 0."""
    r = risks.agg(F.coalesce(F.max("risk.score"), F.lit(0)).cast("long").alias("top"), F.count("*").alias("symbols"), F.count_if(~F.col("kind").isin("test", "terraform") & (F.col("tests") == 0)).alias("gaps"))
    f = flows.agg(F.count("*").alias("flows"))
    d = differences.agg(F.count("*").alias("api"))
    text = F.concat(F.lit("summary overall="), S.score_text(F.col("top")), *[x for n in ("symbols", "flows", "gaps", "api") for x in (F.lit(f" {n}="), F.col(n).cast("string"))])
    one = r.join(F.broadcast(f)).join(F.broadcast(d))  # each is the one row of a total
    return one.select(F.lit("summary").alias("section"), F.struct(F.lit(0).cast("long").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c")).alias("sort"), text.alias("line"))


def review(risks: DataFrame, flows: DataFrame, differences: DataFrame) -> DataFrame:
    """section, n, line of the whole review; ``pages.page`` cuts it to a budget. A section is one window: a review's, not a corpus's."""
    made = [summary(risks, flows, differences), risk_lines(risks), flow_lines(flows), api_lines(differences)]
    rows = made[0]
    for m in made[1:]:
        rows = rows.unionByName(m)
    return rows.select("section", F.row_number().over(Window.partitionBy("section").orderBy("sort")).cast("long").alias("n"), "line")
