"""Sources, blocking properties, metrics, sampling, validation and the whole run on small tables."""

import itertools

import pytest

from matchloom.operators import blocking as B
from matchloom.operators import embedding, metrics, sampling, validate
from matchloom.plans import linkage
from matchloom.sources import tsv
from matchloom.streaming.predict_stream import predict_stream


def records(spark, rows):
    return tsv.records(spark.createDataFrame(rows, tsv.RECORD))


@pytest.fixture(scope="module")
def small(spark):
    names = ["Blue River Trading", "Green Hill Foods", "Red Stone Motors", "Silver Lake Software", "Golden Gate Bakery", "Iron Bridge Steel"]
    s1 = [(f"S1-{i}", n, f"{i} Main St 1234{i}", "US") for i, n in enumerate(names)]
    o = [(f"S2-{i}", n + " Inc", f"{i} Main Street 1234{i}", " us ") for i, n in enumerate(names[:4])] + [(f"S3-{i}", " ".join(reversed(n.split())), "x", "us") for i, n in enumerate(names)] + [("S3-99", names[0], "", "france")]
    return s1, o


def test_blocking_streams(spark, small):
    s1, o = records(spark, small[0]), records(spark, small[1])
    exact = {tuple(r) for r in B.exact_name_pairs(s1, o).collect()}
    assert exact == {(f"S1-{i}", f"S2-{i}") for i in range(4)}
    both = {tuple(r) for r in B.sorted_token_pairs(s1, o).collect()}
    assert both >= {(f"S1-{i}", f"S3-{i}") for i in range(6)} and all("99" not in b for _, b in both)


def test_fuzzy_equals_brute_force(spark):
    words = ["northern lights company group", "northern light company group", "northern lights compaxy group", "southern lights company group", "nor", "nox", "northern lights company groups"]
    s1 = records(spark, [(f"S1-{i}", w, "", "us") for i, w in enumerate(words)])
    o = records(spark, [(f"S2-{i}", w, "", "us") for i, w in enumerate(words)])
    norm = {r.entity_id: (r.norm_name, set(r.name_tokens)) for r in s1.union(o).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for i, j in itertools.product(range(len(words)), repeat=2):
        (a, ta), (b, tb) = norm[f"S1-{i}"], norm[f"S2-{j}"]
        if min(len(a), len(b)) >= 3 and ({a[:3]} | ta) & ({b[:3]} | tb) and abs(len(a) - len(b)) <= max(1, int(0.12 * len(a))) and 1 - lev(a, b) / max(len(a), len(b)) > 0.9 - 1e-12 and lev(a, b) * 10 < max(len(a), len(b)):
            want.add((f"S1-{i}", f"S2-{j}"))
    assert {tuple(r) for r in B.fuzzy_name_pairs(s1, o).collect()} == want


def test_metrics_edges(spark):
    truth = spark.createDataFrame([("a", "x"), ("b", "y")], "source1_entity_id string, entity_id string")
    entities = spark.createDataFrame([(e,) for e in "abcd"], "source1_entity_id string")
    pred = spark.createDataFrame([("a", "x"), ("c", "z")], "source1_entity_id string, candidate_entity_id string")
    # a right, b missed, c wrong, d rightly empty
    assert metrics.macro_f05(pred, truth, entities).first().macro_f05 == pytest.approx(0.5)


def test_sampling(spark):
    truth = spark.createDataFrame([(f"S1-{i}", "S2-1" if i % 2 else "") for i in range(100)], tsv.TRUTH)
    sample = sampling.stratified_truth(truth, 20)
    assert sample.count() == 20 and sample.where("matched_entity_ids <> ''").count() == 19
    with pytest.raises(ValueError):
        sampling.stratified_truth(truth.where("matched_entity_ids <> ''"), 20)


def test_truth_source(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\nS1-1\tS2-9\n")
    edges, keys = tsv.read_truth(spark, str(tmp_path / "t.tsv"))
    assert {tuple(r) for r in edges.collect()} == {("S1-1", "S2-9")} and keys.count() == 2


def test_whole_run(spark, small, tmp_path):
    def write(name, header, rows):
        (tmp_path / name).write_text("\n".join(["\t".join(header), *("\t".join(r) for r in rows)]) + "\n")

    s1 = [(f"S1-{i}", f"{n} {i}", a, c) for i, (_, n, a, c) in enumerate(small[0] * 8)]
    s2 = [(f"S2-{i}", f"{n} {i} Inc", a, c) for i, (_, n, a, c) in enumerate(small[0] * 7)]
    for part in ("train", "test"):
        write(f"{part}_source1.tsv", tsv.RECORD.names, s1)
        write(f"{part}_source2.tsv", tsv.RECORD.names, s2)
        write(f"{part}_source3.tsv", tsv.RECORD.names, [("S3-1", "Else", "Where", "us")])
    write("train_ground_truth.tsv", tsv.TRUTH.names, [(f"S1-{i}", f"S2-{i}" if i < len(s2) else "") for i in range(len(s1))])
    linker, ceiling = linkage.train_files(spark, str(tmp_path), str(tmp_path / "out"), iterations=3)
    assert ceiling.where("overall").first().recall > 0.9
    linkage.predict_files(spark, str(tmp_path), str(tmp_path / "out"))
    found = validate.validate(spark, str(tmp_path / "out/matching_results.tsv"), str(tmp_path / "out/candidate_pairs.tsv"), str(tmp_path), check_ids=True)
    assert validate.exit_code(found) == 0, found.collect()
    others = embedding.embed(tsv.read_others(spark, str(tmp_path / "test_source2.tsv"))).cache()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text((tmp_path / "test_source1.tsv").read_text())
    predict_stream(spark, str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "ckpt"), linker, others).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream/matches")).count() == len(s1)


def test_validator_files(spark, tmp_path):
    (tmp_path / "test_source1.tsv").write_text("entity_id\tx\nS1-1\t\n\nS1-2\t\n")
    (tmp_path / "m.tsv").write_text("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n")
    found = {r.rule for r in validate.validate(spark, str(tmp_path / "m.tsv"), str(tmp_path / "no.tsv"), str(tmp_path)).collect()}
    assert found == {"ids_not_checked", "comma_separated", "missing_file"}
    (tmp_path / "m.tsv").write_text("Source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\tS1-2\nbad\n")
    found = validate.validate(spark, str(tmp_path / "m.tsv"), None, str(tmp_path))
    assert {r.rule for r in found.where("severity = 'error'").collect()} == {"duplicate_row", "repeated_id", "self_match", "row_without_tab", "missing_row"}
    assert validate.exit_code(found) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], tsv.RECORD)
    r = embedding.embed(tsv.records(none))
    assert B.train_like(r, r).count() == 0 and B.predict_like(r, r).count() == 0
