"""Files and tables of the analysis: edges, walks, vectors, clusters, classes, relations, handlers, specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.records import lines

#: fixed values: the published table layouts
SCHEMAS = {
    "Handler": "id BIGINT, stack STRING, predicate_loc STRING, parent_function STRING",
    "Context": "handler BIGINT, item STRING, type STRING, tactic STRING",
    "Response": "handler BIGINT, item STRING, type STRING, tactic STRING",
    "Nesting": "parent_handler BIGINT, child_handler BIGINT",
    "Spec": "id BIGINT, support BIGINT, confidence DOUBLE",
    "SpecContext": "spec BIGINT, action STRING",
    "SpecAction": "spec BIGINT, action STRING",
    "Results": "spec BIGINT, handler BIGINT, violation INT",
    "MergedSpec": "spec BIGINT, supporting BIGINT",
    "MergedItem": "merged STRING, unmerged STRING",
}
EDGES = "source STRING, target STRING, label STRING, label_id ARRAY<INT>, location STRING"
SHEET_ROWS = 150


def read_edges(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The edge table from Parquet or JSON; a missing path is an error."""
    return spark.read.schema(EDGES).format(form).load(path)


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    edges.select("source", "target", "label", "label_id", "location").write.mode(mode).parquet(path)


def edge_lines(edges: DataFrame) -> DataFrame:
    """(value): ``source target [kind] [file:line]``."""
    return edges.select(F.concat_ws(" ", "source", "target", F.nullif(F.col("label"), F.lit("")), F.nullif(F.col("location"), F.lit(""))).alias("value"))


def walk_lines(walks: DataFrame) -> DataFrame:
    """(value): one line for each walk of two labels or more."""
    return walks.where(F.size("tokens") > 1).select(F.array_join("tokens", " ").alias("value"))


def read_walks(spark: SparkSession, path: str | DataFrame, remove: list[str] | None = None) -> DataFrame:
    """(tokens) without labels that start with one of the prefixes."""
    tokens = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    if remove:
        tokens = F.filter(tokens, lambda x: ~F.exists(F.array(*[F.lit(p) for p in remove]), lambda p: F.startswith(x, p)))
    return lines(spark, path).select(tokens.alias("tokens"))


def vector_lines(vectors: DataFrame, label: str = "word", vector: str = "vector") -> DataFrame:
    """(value): ``word v1 v2 ...`` lines, without the header."""
    return vectors.select(F.concat_ws(" ", label, F.array_join(F.col(vector).cast("array<string>"), " ")).alias("value"))


def read_vectors(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(word, vector) from text vectors; the header (two numbers) is skipped."""
    cells = F.split(F.trim("value"), r" +")
    rows = lines(spark, path).select(cells.alias("c")).where(F.size("c") > 2)
    return rows.select(F.get("c", F.lit(0)).alias("word"), F.slice("c", F.lit(2), F.size("c") - 1).cast("array<float>").alias("vector"))


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """(value): the names of each cluster in one line."""
    return clusters.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("value")).select("value")


def read_clusters(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(cluster_id, name) from one cluster per line; the id is the hash of the line's names."""
    names = F.array_sort(F.array_distinct(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")))
    rows = lines(spark, path).select(names.alias("names")).where(F.size("names") > 0)
    return rows.select(F.xxhash64("names").alias("cluster_id"), F.explode("names").alias("name")).distinct()


def read_class_labels(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(name, label) from ``function label`` lines; the first label wins.

    Lines are ordered within their file by a running id.
    """
    rows = lines(spark, path).withColumn("no", F.monotonically_increasing_id()).select(F.split(F.trim("value"), r"\s+").alias("c"), "no").where(F.size("c") > 1)
    return rows.groupBy(F.get("c", F.lit(0)).alias("name")).agg(F.min_by(F.get("c", F.lit(1)), "no").alias("label"))


def read_functions(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, name) from ``path name`` lines."""
    rows = lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") > 1)
    return rows.select(F.get("c", F.lit(0)).alias("path"), F.get("c", F.lit(1)).alias("name"))


def defined_functions(instructions: DataFrame) -> DataFrame:
    """(name, path): each function without its suffix, with the file of its first located instruction (fn, pos, file)."""
    rows = instructions.where(F.col("file").isNotNull()).select(F.substring_index("fn", ".", 1).alias("name"), "pos", "file")
    return rows.groupBy("name").agg(F.min_by("file", "pos").alias("path"))


def source_ranges(instructions: DataFrame, functions: DataFrame) -> DataFrame:
    """(fn, first, last): lines of the listed functions (name)."""
    keep = functions.select(F.col("name").alias("fn")).distinct()
    return instructions.join(keep, "fn", "left_semi").groupBy("fn").agg(F.min("line").alias("first"), F.max("line").alias("last"))


def read_relations(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(must, a, b, prov) from review lines ``T {a b}{c d}`` and ``F ...``; comments and blank lines are skipped.

    One set is paired with itself; a line of another form is an error.
    """
    text = F.regexp_replace(F.trim("value"), r"\}\s+\{", "}{")
    rows = lines(spark, path).withColumn("prov", F.concat(F.lit("line "), F.monotonically_increasing_id())).select(text.alias("t"), "prov")
    skip = (F.col("t") == "") | F.startswith("t", F.lit("#"))  # tested again where the error is raised, as filters move
    rows = rows.where(~skip)
    ok = F.col("t").rlike(r"^[TF] \{[^{}]*\}(\{[^{}]*\})?$")
    checked = rows.select(F.when(ok, F.col("t")).when(skip, None).otherwise(F.raise_error(F.concat(F.lit("malformed review line: "), "t")).cast("string")).alias("t"), "prov")
    sets = F.transform(F.regexp_extract_all("t", F.lit(r"\{([^{}]*)\}"), 1), lambda s: F.filter(F.split(s, r"\s+"), lambda x: x != ""))
    return checked.select(F.startswith("t", F.lit("T")).alias("must"), F.get(sets, F.lit(0)).alias("a"), F.coalesce(F.get(sets, F.lit(1)), F.get(sets, F.lit(0))).alias("b"), "prov")


def relation_lines(relations: DataFrame) -> DataFrame:
    """(value): review lines."""
    side = lambda c: F.concat(F.lit("{"), F.array_join(c, " "), F.lit("}"))
    return relations.select(F.concat(F.when(F.col("must"), "T ").otherwise("F "), side("a"), side("b")).alias("value"))


def read_names(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(name): one name per line, once each."""
    return lines(spark, path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def read_hints(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, line, how) from ``file:line branch|block``."""
    c = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).select(c.alias("c")).where(F.size("c") > 1)
    at = F.get("c", F.lit(0))
    return rows.select(F.substring_index(at, ":", 1).alias("file"), F.try_to_number(F.substring_index(at, ":", -1), F.lit("999999999")).cast("int").alias("line"), F.get("c", F.lit(1)).alias("how")).where(F.col("how").isin("branch", "block"))


def read_error_codes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(name, value): codes with the prefix TENTATIVE_."""
    c = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).select(c.alias("c")).where(F.size("c") > 1)
    return rows.select(F.concat(F.lit("TENTATIVE_"), F.get("c", F.lit(0))).alias("name"), F.get("c", F.lit(1)).cast("bigint").alias("value"))


def create_tables(spark: SparkSession, names: list[str], database: str = "default") -> None:
    """Empty tables of the published layouts."""
    for n in names:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{n} ({SCHEMAS[n]}) USING parquet")


def drop_tables(spark: SparkSession, names: list[str], database: str = "default") -> None:
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{n}")


def has_table(spark: SparkSession, name: str, database: str = "default") -> bool:
    return spark.catalog.tableExists(f"{database}.{name}")


def spec_tables(specs: DataFrame) -> dict[str, DataFrame]:
    """Spec, SpecContext and SpecAction of ``specs`` (rule_id, context, response, support, confidence).

    Items are written as ``tactic|name|type``; ids follow the rule ids.
    """
    from quarry.operators.skew import global_rank

    keyed = global_rank(specs, ["rule_id"], "id").withColumn("id", F.col("id").cast("bigint"))
    text = lambda tactic, c: F.transform(c, lambda x: F.concat(F.lit(f"{tactic}|"), x, F.lit("|CALL")))
    return {
        "Spec": keyed.select("id", "support", "confidence"),
        "SpecContext": keyed.select(F.col("id").alias("spec"), F.explode(text("PRE", "context")).alias("action")),
        "SpecAction": keyed.select(F.col("id").alias("spec"), F.explode(text("POST", "response")).alias("action")),
    }


def read_specs(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, support, confidence, context, response) from the tables of ``spec_tables``."""
    side = lambda t, name: tables[t].groupBy(F.col("spec").alias("id")).agg(F.array_sort(F.collect_set(F.split_part("action", F.lit("|"), F.lit(2)))).alias(name))
    out = tables["Spec"].join(side("SpecContext", "context"), "id", "left").join(side("SpecAction", "response"), "id", "left")
    return out.select("id", "support", "confidence", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("context", "response")])


def results_table(results: DataFrame, ids: DataFrame, handlers: DataFrame) -> DataFrame:
    """(spec, handler, violation) from (rule_id, loc, violation), (rule_id, id) and (loc, id)."""
    return results.join(ids.select("rule_id", F.col("id").alias("spec")), "rule_id").join(handlers.select("loc", F.col("id").alias("handler")), "loc").select("spec", "handler", "violation")


def merged_spec_table(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """(spec, supporting): each class's first spec with its members."""
    rows = groups.join(ids, "rule_id").select("group_id", "id")
    head = rows.groupBy("group_id").agg(F.min("id").alias("spec"))
    return rows.join(head, "group_id").select("spec", F.col("id").alias("supporting"))


def handler_tables(handlers: DataFrame) -> dict[str, DataFrame]:
    """Handler, Context and Response of nested handlers (id, stack, loc, fn, context, response), items as structs."""
    side = lambda c: handlers.select(F.col("id").alias("handler"), F.explode(c).alias("i")).select("handler", F.col("i.name").alias("item"), "i.type", "i.tactic")
    return {"Handler": handlers.select("id", "stack", F.col("loc").alias("predicate_loc"), F.col("fn").alias("parent_function")), "Context": side("context"), "Response": side("response")}


def sheet(specs: DataFrame, order: list[Column]) -> DataFrame:
    """The first 150 specs in order: the report that people review."""
    return specs.orderBy(*order).limit(SHEET_ROWS)


def matrix_rows(overlaps: DataFrame, value: str) -> DataFrame:
    """(class_id, cells): a class by cluster matrix in long rows, non-zero cells only, for a CSV."""
    return overlaps.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", value))).alias("cells"))


def judgement_lines(rows: DataFrame) -> DataFrame:
    """(value): ``judgement context response`` to be appended to the log."""
    return rows.select(F.concat_ws(" ", "judgement", "context", "response").alias("value"))


def read_judgements(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(context, response, judgement): the last line of each pair."""
    from quarry.operators.specs import judgements

    c = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).withColumn("seq", F.monotonically_increasing_id()).select("seq", c.alias("c")).where(F.size("c") > 2)
    return judgements(rows.select("seq", F.get("c", F.lit(0)).alias("judgement"), F.get("c", F.lit(1)).alias("context"), F.get("c", F.lit(2)).alias("response")))


def number_lines(text: DataFrame, file: str, order: str) -> DataFrame:
    """``text`` with ``no``, the 1-based line within its file."""
    return text.withColumn("no", F.row_number().over(Window.partitionBy(file).orderBy(order)))
