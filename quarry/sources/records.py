"""Delimited records, transactions, weights, selections and their writers.

Readers take a path or a DataFrame with the column ``value`` (lines); writers
return the lines, which ``save`` writes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.rules import appearance
from quarry.operators.transactions import items_of

BLANKS, FIELDS, COMMENT = " \t\r", " \t,", "#"


def lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(value): the lines of text files."""
    return path if isinstance(path, DataFrame) else spark.read.text(path)


def save(out: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write lines as text files."""
    out.select("value").write.mode(mode).text(path)


def _class(chars: str) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def fields(value: Column, separators: str = FIELDS, blanks: str = BLANKS, null: str = "") -> Column:
    """The fields of a record: cut at any separator, trimmed, empty ones dropped; fields of null characters are null."""
    cells = F.transform(F.split(value, _class(separators)), lambda x: F.btrim(x, F.lit(blanks)))
    cells = F.filter(cells, lambda x: x != "")
    return F.transform(cells, lambda x: F.when(~x.isin(*null), x)) if null else cells


def records(spark: SparkSession, path: str | DataFrame, separators: str = FIELDS, blanks: str = BLANKS, null: str = "", comment: str = COMMENT) -> DataFrame:
    """(fields) of the records that are not comments."""
    text = lines(spark, path)
    if comment:
        text = text.where(~F.substring("value", 1, 1).isin(*comment))
    return text.select(fields(F.col("value"), separators, blanks, null).alias("fields"))


def read_transactions(spark: SparkSession, path: str | DataFrame, *, weight: bool = False, duplicates: str = "ignore", select: list[str] | None = None, **reading) -> DataFrame:
    """(tid, items, wgt) of one transaction for each record; an empty record is an empty transaction.

    With ``weight`` the last field is the weight, also in brackets.  Repeated
    items are ignored, kept (``keep``) or an error (``error``).
    """
    rows = records(spark, path, **reading).withColumn("tid", F.monotonically_increasing_id())
    cells = F.filter("fields", lambda x: x.isNotNull())
    if weight:
        last = F.regexp_replace(F.element_at("fields", F.lit(-1)), r"[()\[\]{}]", "")
        rows = rows.where(F.size("fields") > 0).withColumn("wgt", last.cast("bigint"))
        cells = F.slice(cells, F.lit(1), F.greatest(F.size("fields") - 1, F.lit(0)))
    else:
        rows = rows.withColumn("wgt", F.lit(1).cast("bigint"))
    if duplicates == "error":
        cells = F.when(F.size(cells) == F.size(F.array_distinct(cells)), cells).otherwise(F.raise_error(F.lit("repeated item in a transaction")).cast("array<string>"))
    out = rows.select("tid", (F.array_sort(cells) if duplicates == "keep" else items_of(cells)).alias("items"), "wgt")
    if select is not None:
        out = out.withColumn("items", F.filter("items", lambda x: x.isin(*select)))
    return out


def read_weighted_items(spark: SparkSession, path: str | DataFrame, mark: str = ":", **reading) -> DataFrame:
    """(tid, items): structs of item and weight, 1 where none follows the mark."""
    rows = records(spark, path, **reading).withColumn("tid", F.monotonically_increasing_id())
    cell = lambda x: F.struct(F.substring_index(x, mark, 1).alias("item"), F.coalesce(F.when(F.contains(x, F.lit(mark)), F.substring_index(x, mark, -1).cast("float")), F.lit(1.0).cast("float")).alias("wgt"))
    return rows.select("tid", F.transform("fields", cell).alias("items"))


def read_selection(spark: SparkSession, path: str | DataFrame, **reading) -> DataFrame:
    """(item): the listed items."""
    return records(spark, path, **reading).select(F.explode("fields").alias("item")).distinct()


def read_appearances(rows: list[list[str]]) -> dict[str, str]:
    """Item to appearance from records: the first holds the default (key '')."""
    table = [r for r in rows if r]
    if not table:
        return {}
    out = {"": appearance(table[0][0])}
    for r in table[1:]:
        out[r[0]] = appearance(r[1] if len(r) > 1 else "both")
    return out


def read_penalties(rows: list[list[str]]) -> dict[str, float]:
    """Item to insertion penalty, the first record being the default; below 0 counts as 0, above 1 is an error."""
    table = [r for r in rows if r]
    if not table:
        return {}
    pairs = [("", table[0][0]), *((r[0], r[1] if len(r) > 1 else table[0][0]) for r in table[1:])]
    out = {k: max(0.0, float(v)) for k, v in pairs}
    if any(v > 1 for v in out.values()):
        raise ValueError("a penalty is at most 1")
    return out


def read_pairs(spark: SparkSession, path: str | DataFrame, **reading) -> DataFrame:
    """(tid, item) from records of two fields."""
    return records(spark, path, **reading).where(F.size("fields") > 1).select(F.get("fields", F.lit(0)).alias("tid"), F.get("fields", F.lit(1)).alias("item"))


def escaped(c: Column, quote: str = '"') -> Column:
    """A name as it stands in a file: quoted if it has blanks, separators, quotes or backslashes."""
    inner = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), quote, "\\\\" + quote)
    return F.when(c.rlike(r'[\s,"\\]') | (c == ""), F.concat(F.lit(quote), inner, F.lit(quote))).otherwise(c)


def unescaped(c: Column, quote: str = '"') -> Column:
    """The inverse of ``escaped``."""
    inner = F.regexp_replace(F.regexp_replace(F.substr(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0))), r'\\(")', "$1"), r"\\\\", r"\\")
    return F.when(F.startswith(c, F.lit(quote)) & (F.length(c) > 1), inner).otherwise(c)


def format_number(c: Column, digits: int) -> Column:
    """A number with so many decimals at most."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", c.cast("double")), r"\.0+$|(\.\d*[1-9])0+$", "$1")


#: codes of set information: column and factor
SET_INFO = {"i": "size", "n": "size", "d": "supp", "a": "supp", "s": ("rel_supp", 1.0), "S": ("rel_supp", 100.0), "x": ("rel_supp", 1.0), "X": ("rel_supp", 100.0), "w": "supp", "W": "supp", "r": ("rel_supp", 1.0), "R": ("rel_supp", 100.0), "z": "size", "e": ("value", 1.0), "E": ("value", 100.0), "p": ("value", 1.0), "P": ("value", 100.0)}
#: codes of rule information: expression over supp, body_supp, head_supp, total
RULE_INFO = {
    "i": lambda r: F.size("body") + 1,
    "a": lambda r: r("supp"),
    "b": lambda r: r("body_supp"),
    "h": lambda r: r("head_supp"),
    "s": lambda r: r("supp") / r("total"),
    "S": lambda r: r("supp") / r("total") * 100,
    "x": lambda r: r("body_supp") / r("total"),
    "X": lambda r: r("body_supp") / r("total") * 100,
    "y": lambda r: r("head_supp") / r("total"),
    "Y": lambda r: r("head_supp") / r("total") * 100,
    "c": lambda r: r("confidence"),
    "C": lambda r: r("confidence") * 100,
    "l": lambda r: r("lift"),
    "L": lambda r: r("lift") * 100,
    "e": lambda r: r("value"),
    "E": lambda r: r("value") * 100,
}


def info(template: str, of) -> Column:
    """A template such as `` (%a, %4S)``: each %[digits]code becomes ``of(code)`` with that many decimals."""
    parts = []
    for text, digits, code in re.findall(r"((?:[^%]|%%)+)|%(\d*)([A-Za-z])", template):
        if text:
            parts.append(F.lit(text.replace("%%", "%")))
        else:
            parts.append(format_number(of(code), int(digits or 6)))
    return F.concat(*parts) if parts else F.lit("")


def set_info(template: str) -> Column:
    """Information of an itemset; see SET_INFO."""

    def of(code: str) -> Column:
        spec = SET_INFO[code]
        return F.col(spec) if isinstance(spec, str) else F.col(spec[0]) * spec[1]

    return info(template, of)


def rule_info(template: str) -> Column:
    """Information of a rule; see RULE_INFO."""
    return info(template, lambda code: RULE_INFO[code](F.col))


def write_sets(sets: DataFrame, template: str = " (%a)", separator: str = " ") -> DataFrame:
    """(value): one line for each itemset, with its information."""
    return sets.select(F.concat(F.array_join(F.transform("items", escaped), separator), set_info(template)).alias("value"))


def write_weighted_sets(sets: DataFrame, template: str = " (%a)", mark: str = ":") -> DataFrame:
    """(value): lines with ``item:weight``; ``weights`` holds the weights in the order of ``items``."""
    cells = F.zip_with("items", "weights", lambda i, w: F.concat(escaped(i), F.lit(mark), format_number(w, 6)))
    return sets.select(F.concat(F.array_join(cells, " "), set_info(template)).alias("value"))


def write_rules(rules: DataFrame, template: str = " (%a, %C)", arrow: str = " <- ", head_last: bool = False) -> DataFrame:
    """(value): ``head <- body`` lines, or ``body -> head`` with the head last."""
    body, head = F.array_join(F.transform("body", escaped), " "), escaped(F.col("head"))
    line = F.concat(body, F.lit(" -> "), head) if head_last else F.concat(head, F.lit(arrow), body)
    return rules.select(F.concat(line, rule_info(template)).alias("value"))


def write_two_set_rules(rules: DataFrame, left: str, right: str, arrow: str = " -> ") -> DataFrame:
    """(value): rules between two sets."""
    side = lambda c: F.array_join(F.transform(c, escaped), " ")
    return rules.select(F.concat(side(left), F.lit(arrow), side(right)).alias("value"))


def write_tids(pairs: DataFrame, items: str = "items", tid: str = "tid") -> DataFrame:
    """(value): ``items: tids`` lines from (items, tid) rows, which may be long for frequent sets."""
    return pairs.groupBy(items).agg(F.array_sort(F.collect_list(tid)).alias("t")).select(F.concat(F.array_join(items, " "), F.lit(": "), F.array_join(F.col("t").cast("array<string>"), " ")).alias("value"))


def write_spectrum(spectrum: DataFrame, scale: float = 1.0) -> DataFrame:
    """(value): ``size support count`` lines."""
    return spectrum.select(F.concat_ws(" ", "size", format_number(F.col("supp"), 6), format_number(F.col("n") * scale, 6)).alias("value"))


def write_size_statistics(stats: DataFrame) -> DataFrame:
    """(value): ``all: n`` and ``size: n`` lines."""
    return stats.select(F.concat(F.coalesce(F.col("size").cast("string"), F.lit("all")), F.lit(": "), "n").alias("value"))


def write_transactions(tx: DataFrame, separator: str = " ", weight: bool = False) -> DataFrame:
    """(value): one line for each transaction, the weight last if asked for."""
    text = F.array_join(F.transform("items", escaped), separator)
    return tx.select((F.concat(text, F.lit(separator), F.col("wgt").cast("string")) if weight else text).alias("value"))
