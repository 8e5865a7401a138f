"""Files: findings that end a check early, line numbers, reading in parts, packaging."""

import zipfile

from matchloom.operators import validate
from matchloom.plans import linkage
from matchloom.sources import tsv


def check(spark, path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    need = spark.createDataFrame([("S1-1",)], "id string")
    found, rows = validate.validate_list(spark, str(path), validate.MATCHING_HEADER, need, None)
    return {r.rule for r in found.collect()} if "rule" in found.columns else {r[1] for r in found.collect()}, rows


def test_findings_that_end_a_check(spark, tmp_path):
    head = "\t".join(validate.MATCHING_HEADER)
    for name, text, want in (
        ("empty.tsv", "", "empty_file"), ("comma.tsv", "a,b\n", "comma_separated"), ("header.tsv", "a\tb\nS1-1\t\n", "unexpected_header"),
        ("bytes.tsv", head.encode() + b"\nS1-1\tS2-\xff\xfe\n", "not_utf8"),
    ):
        found, rows = check(spark, tmp_path / name, text)
        assert found == {want} and rows is None
    assert check(spark, tmp_path / "good.tsv", f"{head}\nS1-1\tS2-\u00e9\n")[1] is not None


def test_line_numbers_over_parts(spark, tmp_path):
    lines = [f"line {i}" for i in range(5000)]
    (tmp_path / "lines.tsv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = validate.read_lines(spark, str(tmp_path / "lines.tsv"))
        assert [(r.line_no, r.value) for r in got.orderBy("line_no").collect()] == list(enumerate(lines, 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_ends_within_quotes(spark, tmp_path):
    (tmp_path / "r.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a\nb"\tx\tUS\n')
    both = [tsv.read_tsv(spark, str(tmp_path / "r.tsv"), tsv.RECORD, multi_line=m).collect() for m in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 1 and both[0][0].business_name == "a\nb"


def test_lists_in_order_of_country_then_id(spark, tmp_path):
    rows = spark.createDataFrame([(f"S1-{i:03d}", f"S2-{i}", "fr" if i % 3 else "de") for i in range(200)], "source1_entity_id string, matched_entity_ids string, __country string").repartition(7)
    want = [(r[0], r[1]) for r in sorted(rows.collect(), key=lambda r: (r[2], r[0]))]
    for single in (True, False):
        tsv.write_tsv(rows, str(tmp_path / f"out{single}"), single, ["__country", "source1_entity_id"])
        parts = sorted(p for p in (tmp_path / f"out{single}").iterdir() if p.name.startswith("part-"))
        lines = [x.split("\t") for p in parts for x in p.read_text().splitlines()]
        assert [tuple(x) for x in lines if x[0] != "source1_entity_id"] == want and len(parts) == (1 if single else 4)


def test_package(tmp_path):
    (tmp_path / "root/src").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    for p in ("root/README.md", "root/src/a.py", "out/matching_results.tsv"):
        (tmp_path / p).write_text("x")
    args = ("team", str(tmp_path / "root"), str(tmp_path / "out"), str(tmp_path / "zip"))
    try:
        linkage.package_run(*args)
        raise AssertionError("a list is missing")
    except FileNotFoundError:
        pass
    (tmp_path / "out/candidate_pairs.tsv").mkdir()
    (tmp_path / "out/candidate_pairs.tsv/part-0").write_text("y")
    with zipfile.ZipFile(linkage.package_run(*args, code=("src", "none"))) as z:
        assert z.namelist() == ["README.md", "output/matching_results.tsv", "output/candidate_pairs.tsv/part-0", "code/src/a.py"]
