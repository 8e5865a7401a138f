"""Tab-separated files with line ends inside quotes, read by many tasks per file.

Spark's reader of such files takes a task per file, as a split can't tell whether it starts inside quotes.  Here:

1.  Files are read as lines, in splits.  Each split works out what it does to the state at its start: a line without
    quotes keeps it, others may open, close, or fix it.  A row per split comes of that.
2.  A window over the splits of a file composes these: the state at the start of each.
3.  The lines are read again; each split puts its own lines together to records.  What crosses a split's border comes
    out as fragments, two a split at most, which are joined by a small shuffle.

Only the splits that start inside quotes are told to the tasks, by a hash of 8 bytes each.  Any store that Spark reads will do, and
tasks keep nothing.

A quote opens at the start of a field; doubled quotes stand for one; text behind a closing quote goes on to the next
tab.  Lines end with \\n or \\r\\n, within quotes read as \\n; empty lines between records are left out.  A quote that never closes takes the rest
of its file.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINES = "file string, start long, line string"
_FATE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])
_RECORD = pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
#: Kinds of a split's rows: whole records, the end of an earlier split's record, and the start of one that goes on.
WHOLE, END, START = 0, 1, 2
ROWS, CHARS = 4096, 4 << 20


def stays_open(line: str, inside: bool) -> bool:
    """Whether a line that starts inside quotes, or outside, ends inside."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find("\t", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _fates(batches):
    """Per split: the state behind it if it starts outside, and if it starts inside."""
    split, outside, inside = None, False, True
    for b in batches:
        for file, start, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, start) != split:
                if split:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*split, outside, inside)], schema=_FATE)
                split, outside, inside = (file, start), False, True
            if '"' in line:
                same = outside == inside
                outside = stays_open(line, outside)
                inside = outside if same else stays_open(line, inside)
    if split:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*split, outside, inside)], schema=_FATE)


def _key(file: str = "file", start: str = "start"):
    return F.xxhash64(file, start)


def open_splits(lines: DataFrame) -> list[int]:
    """The hashes of the splits that start inside quotes."""
    fates = lines.mapInArrow(_fates, "file string, start long, outside boolean, inside boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # A split fixes the state, keeps it, or turns it; behind the last one that fixes it, the turns count.
    fixed = F.when(F.col("outside") == F.col("inside"), F.col("outside"))
    turns = F.sum((F.col("outside") & ~F.col("inside")).cast("long"))
    own = fates.withColumn("turned", turns.over(Window.partitionBy("file").orderBy("start")))
    mark = F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), F.col("turned")))
    own = own.withColumn("last", F.last(mark, ignorenulls=True).over(before)).withColumn("so_far", F.coalesce(F.max("turned").over(before), F.lit(0)))
    state = (F.coalesce(F.col("last.state"), F.lit(False)).cast("long") + F.col("so_far") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    return [r.k for r in own.where(state).select(_key().alias("k")).collect()]


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, at, text): a row per record, ordered within its file by (start, at); headers included."""
    lines = _lines(spark, path)
    opened = set(open_splits(lines))

    def put_together(batches):
        rows, size = [], 0
        split, at, held, inside, head = None, 0, [], False, False

        def flush():
            nonlocal rows, size
            out, rows, size = rows, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RECORD, strict=True)], schema=_RECORD)

        def add(kind: int, first: int):
            nonlocal size
            rows.append((*split, first, kind, "\n".join(held)))
            size += len(rows[-1][-1])

        first = 0
        for b in batches:
            for file, start, key, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, start) != split:
                    if held:
                        add(END if head else START, first)
                    split, at, held = (file, start), 0, []
                    inside = head = key in opened
                if not held:
                    first = at
                held.append(line)
                at += 1
                if '"' in line:
                    inside = stays_open(line, inside)
                if not inside:
                    add(END if head else WHOLE, first)
                    held, head = [], False
                    if len(rows) >= ROWS or size >= CHARS:
                        yield flush()
        if held:
            add(END if head else START, first)
        if rows:
            yield flush()

    found = lines.select("file", "start", _key().alias("key"), "line").mapInArrow(put_together, "file string, start long, at long, kind int, text string")
    # A record over several splits: its start, then the ends of splits up to the next start.
    cut = found.where(F.col("kind") != WHOLE).withColumn("group", F.sum((F.col("kind") == START).cast("int")).over(Window.partitionBy("file").orderBy("start", "at")))
    pieces = F.array_sort(F.collect_list(F.struct("start", "at", "text")))
    joined = cut.groupBy("file", "group").agg(pieces.alias("p")).select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["at"].alias("at"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return found.where(F.col("kind") == WHOLE).select("file", "start", "at", "text").unionByName(joined)


def read_quoted(spark: SparkSession, path: str, schema: T.StructType, place: bool = False) -> DataFrame:
    """Rows of tab-separated files with a header, as strings, '' for missing fields; ``place`` adds (file, start, at)."""
    rows = records(spark, path).where((F.col("start") != 0) | (F.col("at") != 0))
    text = F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\r$", "")
    fields = F.from_csv(text, F.lit(schema.simpleString()[len("struct<"):-1].replace(":", " ")), {"sep": "\t", "escape": '"', "maxCharsPerColumn": "-1"})
    own = rows.where(text != "").select("file", "start", "at", fields.alias("f"))
    return own.select(*(F.coalesce(F.col(f"f.{c}"), F.lit("")).alias(c) for c in schema.names), *(["file", "start", "at"] if place else []))


def write_quoted(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write strings as tab-separated fields, quoted where they must be.

    With ``order`` the part files, by name, and their lines follow these columns over the whole table: it is dealt by
    range, so no task sorts or writes more than its share.  Without it rows stay as they are dealt.
    """
    own = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns))
    if order:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = own.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    own.write.mode("overwrite").options(sep="\t", header=True, escape='"', emptyValue="", nullValue="", **spaces).csv(path)
