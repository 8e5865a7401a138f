"""Each list rule on lines that break it."""

import pytest

from matchloom.operators import validate as V

LINES = [
    "S1-1\tS2-1,S3-2", "S1-2\t", "S1-2\tS2-9", "S1-3\tS2-4,S2-4", "S1-4\tS1-9,S2-1", "S1-5\tX-1", "S1-6 without a tab", "",
    "S1-7\tS2-1, S3-2", "S1-99\tS3-7",
]
CANDIDATES = ["S1-1\tS2-1", "S1-2\tS2-9", "S1-3\tS2-4", "S1-4\tS2-1,S1-9", "S1-5\tX-1", "S1-7\tS2-1, S3-2", "S1-99\tS3-8"]


@pytest.fixture(scope="module")
def parsed(spark):
    return [V.parse_lines(spark.createDataFrame([(i + 2, x) for i, x in enumerate(lines)], "line_no long, value string")) for lines in (LINES, CANDIDATES)]


def test_rules(spark, parsed):
    rows, candidates = parsed
    required = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 3, 4, 5, 7, 8)], "s1 string")
    targets = spark.createDataFrame([(x,) for x in ("S2-1", "S3-2", "S2-4", "S3-7")], "id string")
    found = lambda df: {r[0] for r in df.collect()}
    assert tuple(V.counts(rows).first()) == (8, 1, 7)
    assert [x.strip() for x in found(V.malformed_rows(rows))] == ["8: S1-6 without a tab"]
    assert found(V.duplicate_rows(rows)) == {"S1-2"} and found(V.repeated_ids(rows)) == {"S1-3"}
    assert found(V.self_matches(rows)) == {"S1-9"} and found(V.wrong_prefixes(rows)) == {"X-1", " S3-2"}
    assert found(V.unknown_ids(rows, targets)) == {"S2-9"}
    assert found(V.missing_rows(rows, required)) == {"S1-8"} and found(V.unexpected_rows(rows, required)) == {"S1-99"}
    assert found(V.outside_candidates(rows, candidates)) == {"S1-1", "S1-99"}


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "test_source1.tsv").write_text("entity_id\tbusiness_name\nS1-1\tx\n")
    (tmp_path / "list.tsv.gz").write_bytes(b"no gzip at all\n" * 9)
    found = V.validate(spark, str(tmp_path / "list.tsv.gz"), None, str(tmp_path))
    assert {r.rule for r in found.collect()} == {"ids_not_checked", "unreadable_file"} and V.exit_code(found) == 1
    (tmp_path / "test_source2.tsv").write_bytes(b"entity_id\nS2-\xff\n")
    assert [(r.file, r.rule) for r in V.validate(spark, "none", None, str(tmp_path), check_ids=True).collect()] == [("test_source2.tsv", "not_utf8")]
    assert V.unreadable(spark, str(tmp_path / "test_source1.tsv")) is None
