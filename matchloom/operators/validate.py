"""Validation of match and candidate lists: findings as a table, no lists on the driver.

A finding is (file, rule, severity, n, examples): the number of offenders and the first five in order.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tsv import path_exists

MATCHING_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]
FINDING = "file string, rule string, severity string, n long, examples string"


def _finding(offenders: DataFrame, file: str, rule: str, severity: str = "error") -> DataFrame:
    """One row if a table with one column has rows."""
    col = offenders.columns[0]
    distinct = offenders.select(F.col(col).alias("x")).distinct()
    first = distinct.orderBy("x").limit(5).agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("examples"))
    return distinct.agg(F.count("*").alias("n")).crossJoin(first).where("n > 0").select(F.lit(file).alias("file"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def _note(spark: SparkSession, file: str, rule: str, severity: str = "error", text: str = "") -> DataFrame:
    return spark.createDataFrame([(file, rule, severity, 1, text)], FINDING)


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, tab, s1, ids, raw) of a list file's lines (line_no, value) after its header.

    Ids aren't trimmed; a list of white space is empty.
    """
    at = F.instr("value", "\t")
    rest = F.when(at > 0, F.expr("substring(value, instr(value, '\t') + 1)"))
    return lines.select(
        "line_no",
        (at > 0).alias("tab"),
        F.when(at > 0, F.substring_index("value", "\t", 1)).otherwise(F.col("value")).alias("s1"),
        F.when(F.trim(rest) != "", F.split(rest, ",")).otherwise(F.array().cast("array<string>")).alias("ids"),
        F.rtrim("value").alias("raw"),
    )


def counts(rows: DataFrame) -> DataFrame:
    """n_rows, n_empty, n_nonempty of parsed lines."""
    good = rows.where("tab")
    return good.agg(F.count("*").alias("n_rows"), F.count_if(F.size("ids") == 0).alias("n_empty"), F.count_if(F.size("ids") > 0).alias("n_nonempty"))


def malformed_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("tab") & (F.trim("s1") != "")).select(F.concat_ws(": ", F.lpad(F.col("line_no").cast("string"), 12, " "), "raw").alias("line"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.where("tab").groupBy("s1").count().where("count > 1").select("s1")


def repeated_ids(rows: DataFrame) -> DataFrame:
    return rows.where("tab").where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1").distinct()


def listed_ids(rows: DataFrame) -> DataFrame:
    """Distinct (s1, id) of all rows."""
    return rows.where("tab").select("s1", F.explode("ids").alias("id")).distinct()


def self_matches(rows: DataFrame) -> DataFrame:
    return listed_ids(rows).where(F.col("id").startswith("S1-")).select("id").distinct()


def wrong_prefixes(rows: DataFrame) -> DataFrame:
    return listed_ids(rows).where(~F.col("id").startswith("S1-") & ~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-")).select("id").distinct()


def unknown_ids(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids with a valid prefix that aren't among the targets (id)."""
    ids = listed_ids(rows).where(F.col("id").startswith("S2-") | F.col("id").startswith("S3-")).select("id").distinct()
    return ids.join(targets.select("id").distinct(), "id", "left_anti")


def missing_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return required.select("s1").distinct().join(rows.where("tab").select("s1"), "s1", "left_anti")


def unexpected_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    return rows.where("tab").select("s1").distinct().join(required.select("s1"), "s1", "left_anti")


def mapping(rows: DataFrame) -> DataFrame:
    """(s1, id); of rows that repeat a key the last counts."""
    last = rows.where("tab").groupBy("s1").agg(F.max_by("ids", "line_no").alias("ids"))
    return last.select("s1", F.explode("ids").alias("id")).distinct()


def outside_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """s1 with a matched id that isn't among its candidates."""
    return mapping(matched).join(mapping(candidates), ["s1", "id"], "left_anti").select("s1").distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, value), with line numbers by file order: a line's place in its part of the file, and the lines
    of the parts before it, of which there is one row each."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("__at"))
    lines = lines.withColumn("__part", F.shiftright("__at", 33))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = lines.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", before.alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return lines.join(parts, "__part").select((F.col("__before") + place + 1).alias("line_no"), "value")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed first fields after the header; blank lines are left out."""
    lines = read_lines(spark, path).where("line_no > 1").where(F.trim("value") != "")
    return lines.select(F.trim(F.substring_index("value", "\t", 1)).alias("id")).distinct()


def unreadable(spark: SparkSession, path: str) -> DataFrame | None:
    """The finding of a file that isn't UTF-8 or that storage fails to give (the error's first line); None if all of it can be read."""
    file = path.rsplit("/", 1)[-1]
    try:
        if spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count():
            return _note(spark, file, "not_utf8")
    except (PySparkException, Py4JJavaError) as e:
        told = str(e)
        if "FAILED_READ_FILE" not in told and "java.io." not in told and "AccessControlException" not in told:
            raise
        return _note(spark, file, "unreadable_file", text=told.strip().splitlines()[0][:200])
    return None


def validate_list(spark: SparkSession, path: str, header: list[str], required: DataFrame, targets: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(findings, parsed lines or None if the file can't be read on) of one list file."""
    file = path.rsplit("/", 1)[-1]
    if not path_exists(spark, path):
        return _note(spark, file, "missing_file"), None
    if (fault := unreadable(spark, path)) is not None:
        return fault, None
    lines = read_lines(spark, path)
    first = lines.where("line_no = 1").first()
    if first is None:
        return _note(spark, file, "empty_file"), None
    if "\t" not in first.value and "," in first.value:
        return _note(spark, file, "comma_separated", text=first.value[:100]), None
    if [c.strip().lower() for c in first.value.split("\t")] != header:
        return _note(spark, file, "unexpected_header", text=first.value[:100]), None
    rows = parse_lines(lines.where("line_no > 1")).cache()
    need = required.select(F.col("id").alias("s1"))
    found = [
        _finding(malformed_rows(rows), file, "row_without_tab"),
        _finding(duplicate_rows(rows), file, "duplicate_row"),
        _finding(repeated_ids(rows), file, "repeated_id"),
        _finding(self_matches(rows), file, "self_match"),
        _finding(wrong_prefixes(rows), file, "wrong_prefix"),
        *([_finding(unknown_ids(rows, targets), file, "unknown_id")] if targets is not None else []),
        _finding(missing_rows(rows, need), file, "missing_row"),
        _finding(unexpected_rows(rows, need), file, "unexpected_row"),
    ]
    return reduce(DataFrame.unionByName, found), rows


def validate(spark: SparkSession, matching: str, candidates: str | None, test_dir: str, check_ids: bool = False) -> DataFrame:
    """Findings over both files of a run against a test folder."""
    source = f"{test_dir}/test_source1.tsv"
    if not path_exists(spark, source):
        return _note(spark, "test_source1.tsv", "missing_file")
    others = [f"{test_dir}/test_source{k}.tsv" for k in (2, 3)]
    for path in (source, *(p for p in others if check_ids and path_exists(spark, p))):
        if (fault := unreadable(spark, path)) is not None:
            return fault
    required, targets, out = read_ids(spark, source), None, []
    if not check_ids:
        out.append(_note(spark, "", "ids_not_checked", "warning"))
    elif all(path_exists(spark, p) for p in others):
        targets = read_ids(spark, others[0]).union(read_ids(spark, others[1])).distinct()
    else:
        out.append(_note(spark, "", "ids_not_checked", "warning", "a test source is missing"))
    found, matched = validate_list(spark, matching, MATCHING_HEADER, required, targets)
    out.append(found)
    listed = None
    if candidates and path_exists(spark, candidates):
        found, listed = validate_list(spark, candidates, CANDIDATE_HEADER, required, targets)
        out.append(found)
    elif candidates:
        out.append(_note(spark, candidates.rsplit("/", 1)[-1], "missing_file", "warning"))
    if matched is not None and listed is not None:
        out.append(_finding(outside_candidates(matched, listed), matching.rsplit("/", 1)[-1], "outside_candidates", "warning"))
    return reduce(DataFrame.unionByName, out)


def exit_code(findings: DataFrame) -> int:
    """1 if any finding is an error."""
    return int(findings.where("severity = 'error'").limit(1).count() > 0)
