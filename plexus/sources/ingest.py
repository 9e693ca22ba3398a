"""Evidence and change files as rows: coverage exports, unified diffs, TSV, Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

_LLVM = "struct<version:string,data:array<struct<functions:array<struct<filenames:array<string>,regions:array<array<bigint>>>>,files:array<struct<filename:string,branches:array<array<bigint>>>>>>>"
_COVERAGE_PY = "struct<meta:struct<format:int>,files:map<string,struct<executed_lines:array<bigint>,missing_lines:array<bigint>>>>"


def llvm_regions(reports: DataFrame, content: str = "content") -> DataFrame:
    """path, start/end line and column, count: code regions of export versions 2 and 3, equal regions summed."""
    data = reports.select(F.from_json(content, _LLVM).alias("r")).where(F.col("r.version").rlike(r"^[23]\.")).select(F.explode("r.data").alias("d"))
    region = data.select(F.explode("d.functions").alias("f")).select(F.col("f.filenames").alias("names"), F.explode("f.regions").alias("g"))
    kept = region.where(F.get("g", F.lit(7)) == 0)
    cells = [F.get("g", F.lit(i)).alias(n) for i, n in enumerate(("start_line", "start_col", "end_line", "end_col", "count"))]
    return kept.select(F.get("names", F.get("g", F.lit(5)).cast("int")).alias("path"), *cells).groupBy("path", "start_line", "start_col", "end_line", "end_col").agg(F.sum("count").alias("count"))


def coverage_py_lines(reports: DataFrame, content: str = "content") -> DataFrame:
    """path, line, count (1 executed, 0 missing) of format 3 reports."""
    files = reports.select(F.from_json(content, _COVERAGE_PY).alias("r")).where("r.meta.format = 3").select(F.explode("r.files").alias("path", "f"))
    side = lambda name, n: files.select("path", F.explode(f"f.{name}").alias("line"), F.lit(n).alias("count"))
    return side("executed_lines", 1).unionByName(side("missing_lines", 0))


def patch_sections(lines: DataFrame, by: str = "patch", order: str = "n", text: str = "line") -> DataFrame:
    """by, section, path, additions, deletions, spans: one row a file of each unified diff, from its numbered lines."""
    w = Window.partitionBy(by).orderBy(order)
    cut = lines.withColumn("section", F.sum(F.when(F.col(text).startswith("diff --git "), 1).otherwise(0)).over(w)).where("section > 0")
    cut = cut.withColumn("hunks", F.sum(F.when(F.col(text).startswith("@@ "), 1).otherwise(0)).over(Window.partitionBy(by, "section").orderBy(order)))
    t, inside = F.col(text), F.col("hunks") > 0
    return cut.groupBy(by, "section").agg(
        F.min(F.regexp_extract(F.when(t.startswith("diff --git "), t), r" b/(.*)$", 1)).alias("path"),
        F.count_if(inside & t.startswith("+")).alias("additions"), F.count_if(inside & t.startswith("-")).alias("deletions"),
        F.array_sort(F.collect_list(F.when(t.startswith("@@ "), S.hunk_span(t)))).alias("spans"),
    )


def tsv_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, n, key, occurrence, width, expected, cells: rows of each TSV file, known by first column and occurrence.

    All rows are there, whatever their width. ``cells`` maps those column names that the header has once, and not empty, to
    what the row has under them.
    """
    lines = files.select(path, F.posexplode(F.split(F.regexp_replace(content, "\n$", ""), "\n")).alias("n", "_line"), F.split(F.substring_index(content, "\n", 1), "\t").alias("_head")).where("n > 0")
    rows = lines.select(path, "n", F.split("_line", "\t").alias("_cells"), "_head")
    key = F.get("_cells", F.lit(0))
    named = F.filter(F.arrays_zip("_head", "_cells"), lambda x: (x["_head"] != "") & x["_cells"].isNotNull() & (F.size(F.filter("_head", lambda h: h == x["_head"])) == 1))
    cells = F.map_from_arrays(F.transform(named, lambda x: x["_head"]), F.transform(named, lambda x: x["_cells"]))
    return rows.select(
        path, "n", key.alias("key"), F.row_number().over(Window.partitionBy(path, key).orderBy("n")).alias("occurrence"),
        F.size("_cells").alias("width"), F.size("_head").alias("expected"), cells.alias("cells"),
    )


def tsv_issues(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, kind, name, line, n: column names that repeat, rows of another width than the header's, keys that repeat."""
    head = files.select(path, F.explode(F.split(F.substring_index(content, "\n", 1), "\t")).alias("name"))
    none = F.lit(None).cast("long")
    twice = head.groupBy(path, "name").agg(F.count("*").alias("n")).where("n > 1").select(path, F.lit("duplicate-header").alias("kind"), "name", none.alias("line"), "n")
    rows = tsv_rows(files, path, content)
    wide = rows.where("width <> expected").select(path, F.lit("row-width").alias("kind"), F.lit(None).cast("string").alias("name"), (F.col("n") + 1).cast("long").alias("line"), F.col("width").cast("long").alias("n"))
    keys = rows.groupBy(path, "key").agg(F.count("*").alias("n")).where("n > 1").select(path, F.lit("duplicate").alias("kind"), F.col("key").alias("name"), none.alias("line"), "n")
    return twice.unionByName(wide).unionByName(keys)


def report_problems(reports: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, problem of coverage reports that the two readers above leave out: no JSON of a known kind, or an unsupported version."""
    llvm, py = F.from_json(content, _LLVM), F.from_json(content, _COVERAGE_PY)
    version, form = llvm["version"], py["meta"]["format"]
    problem = (
        F.when(version.isNotNull() & llvm["data"].isNotNull(), F.when(~version.rlike(r"^[23]\."), "unsupported-version"))
        .when(form.isNotNull() & py["files"].isNotNull(), F.when(form != 3, "unsupported-version")).otherwise("malformed")
    )
    return reports.select(path, problem.alias("problem")).where("problem is not null")


def _as_kind(kind: str) -> Callable[[Column], Column]:
    return lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def fences(lines: DataFrame, by: str, order: str = "n", text: str = "line") -> DataFrame:
    """lines with fence (null outside, else the number of its opening line) and role (open, inside, close).

    A fence is closed by a run of its own mark that is as long at least and stands alone. One fold over the lines that
    begin with a run, the few that can open or close anything, tells where; a fence that no line closes lasts to the end.
    """
    run = F.regexp_extract(text, r"^ {0,3}(`{3,}|~{3,})", 1)
    bare = F.col(text).rlike(r"^ {0,3}(`{3,}|~{3,})\s*$")
    marks = lines.where(run != "").groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("n"), F.substring(run, 1, 1).alias("mark"), F.char_length(run).alias("size"), bare.alias("bare")))).alias("marks"))
    start = F.struct(F.lit(None).cast("long").alias("n"), F.lit("").alias("mark"), F.lit(0).alias("size"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("found"))

    def step(a: Column, m: Column) -> Column:
        ends = a["n"].isNotNull() & (m["mark"] == a["mark"]) & (m["size"] >= a["size"]) & m["bare"]
        closed = F.struct(F.lit(None).cast("long").alias("n"), F.lit("").alias("mark"), F.lit(0).alias("size"), F.array_append(a["found"], F.struct(a["n"].alias("first"), m["n"].alias("last"))).alias("found"))
        opened = F.struct(m["n"].alias("n"), m["mark"].alias("mark"), m["size"].alias("size"), a["found"].alias("found"))
        return F.when(a["n"].isNull(), opened).when(ends, closed).otherwise(a)

    def whole(a: Column) -> Column:
        return F.when(a["n"].isNull(), a["found"]).otherwise(F.array_append(a["found"], F.struct(a["n"].alias("first"), F.lit(None).cast("long").alias("last"))))

    held = marks.select(by, F.aggregate("marks", start, step, whole).alias("_held"))
    rows = lines.join(held, by, "left")
    n = F.col(order).cast("long")
    own = F.get(F.filter("_held", lambda h: (h["first"] <= n) & (h["last"].isNull() | (n <= h["last"]))), F.lit(0))
    role = F.when(own["first"] == n, "open").when(own["last"] == n, "close").when(own.isNotNull(), "inside")
    return rows.select(*lines.columns, own["first"].alias("fence"), role.alias("role"), (own.isNotNull() & own["last"].isNull()).alias("unclosed"))


def markdown_records(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line, kind, value: links, reference definitions, inline code, requirement tokens, digests, fences and unclosed fences.

    Lines of fences are read like others, as an index of what a document names; a fence is a record of its own with the
    words after its mark and the sha-256 of its body.
    """
    split = files.select(path, F.posexplode(F.split(F.regexp_replace(content, "\r\n", "\n"), "\n")).alias("_i", "_t")).withColumn("n", (F.col("_i") + 1).cast("long"))
    line = F.col("_t")
    defined = S.reference_definition(line)
    made = [F.transform(find, _as_kind(kind)) for kind, find in (
        ("reference-definition", F.when(defined.isNotNull(), F.array(F.concat(defined["label"], F.lit(" "), defined["target"]))).otherwise(F.array().cast("array<string>"))),
        ("link", S.inline_links(line)), ("inline-code", S.inline_code(line)), ("requirement", S.requirement_tokens(line)), ("digest", S.digest_tokens(line)),
    )]
    inline = split.select(path, F.col("n").alias("line"), F.explode(F.concat(*made)).alias("r")).select(path, "line", "r.kind", "r.value")
    marked = fences(split, path, "n", "_t").where("fence is not null")
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "inside", F.struct("n", "_t")))), lambda x: x["_t"]))
    info = F.max(F.when(F.col("role") == "open", F.trim(F.regexp_replace("_t", r"^ {0,3}(`+|~+)", ""))))
    blocks = marked.groupBy(path, "fence").agg(F.concat_ws(" ", F.nullif(info, F.lit("")), F.sha2(body.cast("binary"), 256)).alias("value"), F.max("unclosed").alias("unclosed"))
    blocks = blocks.select(path, F.col("fence").alias("line"), F.explode(F.when(F.col("unclosed"), F.array(F.lit("fence"), F.lit("unclosed-fence"))).otherwise(F.array(F.lit("fence")))).alias("kind"), "value")
    return inline.unionByName(blocks.select(path, "line", "kind", "value"))
