"""Quoted tab-separated files in splits of a few bytes, against the reader that takes a task per file."""

import random

import pytest
from pyspark.sql import types as T

from matchloom.sources import quoted, tsv

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


def nasty(seed, n):
    r, end = random.Random(seed), "\r\n" if seed % 2 else "\n"
    bits = ["x", "é", " ", '""', "\n", "\r\n", "\t", "word", ",", "'", "\n\n", '""\n""']

    def field():
        kind = r.random()
        if kind < 0.5:
            return '"' + "".join(r.choice(bits) for _ in range(r.randint(0, 12))) + '"'
        if kind < 0.6:
            return 'in"ch" of 5"'
        return "".join(r.choice(["x", "é", " ", "word", ","]) for _ in range(r.randint(0, 6)))

    return f"a\tb\tc{end}" + "".join("\t".join(field() for _ in range(3)) + end for _ in range(n))


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_same_as_a_task_per_file(spark, tmp_path, split):
    for i, n in enumerate((60, 200, 0, 1)):
        (tmp_path / f"f{i}.tsv").write_bytes(nasty(i, n).encode())
    (tmp_path / "g.tsv").write_bytes('a\tb\tc\n1\t2\n"one\n\nrecord\t\n over ""many"" lines'.encode() + b"\nx" * 400 + b'"\tb\tc\nlast\t\t"open\nto the end')
    plain = lambda rows: [tuple(x.replace("\r\n", "\n") for x in r) for r in rows]  # noqa: E731  line ends within quotes are read as \n
    want = sorted(plain(tsv.read_tsv(spark, str(tmp_path), SCHEMA).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = quoted.read_quoted(spark, str(tmp_path), SCHEMA, place=True)
        tasks = quoted._lines(spark, str(tmp_path)).rdd.getNumPartitions()
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.a, r.b, r.c) for r in rows) == want
    assert split > 64 or tasks > 50
    # In order of their places, a file's rows stand as they do in the file.
    one = [(r.a, r.b, r.c) for r in sorted((r for r in rows if r.file.endswith("f1.tsv")), key=lambda r: (r.start, r.at))]
    assert one == plain(tsv.read_tsv(spark, str(tmp_path / "f1.tsv"), SCHEMA).collect())


def test_written_in_order_and_read_back(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice(["fr", "us", None]), f"{i:04d}", r.choice([' lead "q" ', "two\nlines", "", None, "tab\there", "é"])) for i in range(500)]
    r.shuffle(rows)
    quoted.write_quoted(spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "out"), ["a", "b"])
    want = sorted(((a or "", b, c or "") for a, b, c in rows))
    assert sorted(map(tuple, quoted.read_quoted(spark, str(tmp_path / "out"), SCHEMA).collect())) == want
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    read = [tuple(x) for p in parts for x in tsv.read_tsv(spark, str(p), SCHEMA).collect()]
    assert len(parts) > 1 and [(a, b) for a, b, _ in read] == [(a, b) for a, b, _ in want]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("a\tb\tc\n")
    (tmp_path / "b.tsv").write_text("")
    assert quoted.read_quoted(spark, str(tmp_path), SCHEMA).count() == 0
