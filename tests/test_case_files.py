"""Case JSON and many-header files, read from small files written here."""

import gzip
import json

import pytest
from pyspark.sql import Row

from assocgrid.operators.quality import QualityError
from assocgrid.sources import cases, file_tables, ingest

DIAGNOSES = [
    {"primary_diagnosis": "A", "age_at_diagnosis": 7305, "figo_stage": "I", "days_to_last_follow_up": "10.5", "follow_ups": [{"days_to_last_follow_up": 99, "odd": [1, 2.50]}], "novel": {"z": 1, "a": "ü"}},
    {"primary_diagnosis": "B", "age_at_diagnosis": "7305", "tumor_grade": "G2", "days_to_death": 4, "treatments": [{"t": 1}, {"t": None}]},
    {"primary_diagnosis": "A", "days_to_last_follow_up": "unknown", "days_to_death": 5},
]
CASES = [
    {"case_id": "c1", "submitter_id": "S1", "project": {"project_id": "TCGA-X"}, "disease_type": "d", "diagnoses": DIAGNOSES, "demographic": {"gender": "female", "days_to_death": 12, "new": True}},
    {"case_id": "c2", "project": {"project_id": "TCGA-Y"}, "primary_site": "p", "demographic": {"age_at_index": 50, "race": "r", "vital_status": "Dead"}, "samples": [
        {"sample_id": "s1", "portions": [{"portion_id": "p1", "analytes": [{"analyte_id": "n1", "analyte_type": "RNA", "aliquots": [{"aliquot_id": "a1", "extra": 1.0}, {"aliquot_id": "a2", "submitter_id": "u"}]}, {"analyte_id": "n2"}]}, {"portion_id": "p2"}], "sample_type": "T", "q": {"b": 1, "a": 2}},
        {"sample_id": "s2", "portions": []},
        {"portions": None, "sample_id": "s3"},
    ]},
    {"case_id": "c3", "project": {"project_id": "OTHER-Z"}},
    {"project": {"project_id": "TCGA-X"}},
]


def text(value):
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@pytest.fixture
def tables(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(CASES[:2], indent=1, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "two.json").write_text(json.dumps(CASES[2:], indent=1), encoding="utf-8")
    return cases.case_tables(spark, str(tmp_path), "TCGA-")


def test_clinical_rows(tables):
    one, two = tables[0].orderBy("case_id").collect()
    assert (one.primary_diagnosis, one.age, one.age_source, one.age_at_diagnosis_days) == ("A;B", 7305 / 365.25, cases.AGE_FROM_DAYS, 7305)
    assert (one.stage, one.grade, one.days_to_death, one.days_to_last_follow_up) == ("I", "G2", 12, 99)
    assert (one.sex, one.race, one.disease_type, one.submitter_id) == ("female", None, "d", "S1")
    assert json.loads(one.diagnoses_json) == DIAGNOSES and one.demographic_json == text(CASES[0]["demographic"])
    assert one.treatments == text(DIAGNOSES[1]["treatments"]) and json.loads(one.follow_ups_json) == DIAGNOSES[0]["follow_ups"]
    assert (two.age, two.age_source, two.primary_site, two.vital_status, two.stage) == (50, cases.AGE_FROM_INDEX, "p", "Dead", None)
    assert (two.diagnoses_json, two.treatments, two.days_to_last_follow_up, two.days_to_death) == ("[]", "[]", None, None)


def test_biospecimen_rows(tables):
    rows = {(r.sample_id, r.aliquot_id): r for r in tables[1].collect()}
    assert set(rows) == {("s1", "a1"), ("s1", "a2"), ("s2", None), ("s3", None)}
    assert (rows["s1", "a1"].portion_id, rows["s1", "a1"].analyte_type, rows["s1", "a2"].aliquot_submitter_id) == ("p1", "RNA", "u")
    assert json.loads(rows["s1", "a1"].aliquot_json) == {"aliquot_id": "a1", "extra": 1.0}
    assert rows["s1", "a1"].sample_json == '{"sample_id":"s1","sample_type":"T","q":{"b":1,"a":2}}'
    assert rows["s2", None].sample_json == '{"sample_id":"s2"}'
    assert json.loads(rows["s3", None].sample_json)["sample_id"] == "s3"


def test_problems_and_unknown_fields(spark, tables, tmp_path):
    assert {(r.case_id, r.problem) for r in tables[2].collect()} == {("c3", "foreign project"), (None, "no case id")}
    found = {(r.record, r.field, r.n) for r in cases.unknown_fields(cases.read_cases(spark, str(tmp_path))).collect()}
    assert found == {("demographic", "new", 1), ("diagnosis", "novel", 1), ("sample", "q", 1)}


def test_problems_alone_are_those_of_the_tables(spark, tmp_path):
    # a record whose samples are no list is unreadable for every reader, also for one that needs no samples
    (tmp_path / "lines.json").write_text(text(CASES[0]) + "\n" + text({**CASES[1], "samples": 5}) + "\n" + text(CASES[2]) + "\n")
    clinical, _, problems = cases.case_tables(spark, str(tmp_path), "TCGA-", multi_line=False)
    read = cases.read_cases(spark, str(tmp_path), multi_line=False)
    assert sorted(cases.case_problems(read, "TCGA-").collect()) == sorted(problems.collect())
    assert {r.problem for r in problems.collect()} == {"unreadable record", "foreign project"}
    assert cases.clinical_rows(cases.usable_cases(read, "TCGA-")).collect() == clinical.collect() and clinical.count() == 1


def test_lines_of_cases_with_a_broken_one(spark, tmp_path):
    (tmp_path / "lines.json").write_text(text(CASES[0]) + "\n" + text(CASES[1])[:40] + "\n", encoding="utf-8")
    clinical, _, problems = cases.case_tables(spark, str(tmp_path), "TCGA-", multi_line=False)
    assert [r.case_id for r in clinical.collect()] == ["c1"] and [r.problem for r in problems.collect()] == ["unreadable record"]


def bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_a_file_of_several_lines_is_read_once(spark, tmp_path):
    # under multiLine the reader opens the file again for every nested record
    file = tmp_path / "many.json"
    file.write_text(json.dumps([dict(CASES[0], case_id=f"c{k}") for k in range(300)], indent=1, ensure_ascii=False), encoding="utf-8")
    before = bytes_read(spark)
    rows = cases.read_cases(spark, str(tmp_path)).collect()
    assert len(rows) == 300 and {r.unreadable for r in rows} == {None} and rows[7].diagnoses == [text(d) for d in DIAGNOSES]
    assert bytes_read(spark) - before < 2 * file.stat().st_size


def test_texts_of_records_stay_as_they_are(spark, tmp_path):
    loose = '{"a": [1.50 , 1e400],\n\t"b c": "x , \\" : y"}'
    (tmp_path / "kept.json").write_text('[{"case_id": "c8",\n "demographic": %s}]\n' % loose)
    with gzip.open(tmp_path / "odd.json.gz", "wt") as f:
        f.write('[{"case_id": "c9",\n "samples": 5}]\n')
    rows = {r.case_id: r for r in cases.read_cases(spark, str(tmp_path)).collect()}
    assert rows["c8"].demographic == '{"a":[1.50,1e400],"b c":"x , \\" : y"}' and rows["c8"].unreadable is None
    assert rows["c9"].unreadable is not None


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.tsv").write_text("# made by hand\n#x\nid\tStart\tCopy\nr1\t5\tNA\nr2\t6\t1.5\n")
    (tmp_path / "b.tsv").write_text("Copy\tid\tNote\nnull\tr3\tN/A\n2\tr4\t \n")
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write("#c\nid\tStart\tCopy\nr5\tnan\tNaN\n")
    return str(tmp_path)


def test_files_with_differing_headers(spark, folder):
    rows = file_tables.read_file_tables(spark, folder)
    manifest = spark.createDataFrame([("a.tsv", "P1"), ("b.tsv", "P2"), ("c.tsv.gz", "P3"), ("d.tsv", "P4")], "file_name string, project string")
    typed = file_tables.typed_strictly(file_tables.with_constants(rows, manifest), {"Start": "long", "Copy": "double", "absent": "long"})
    got = {r.id: (r.Start, r.Copy, r.Note, r.project, r.source_file) for r in typed.collect()}
    assert got == {
        "r1": (5, None, None, "P1", "a.tsv"), "r2": (6, 1.5, None, "P1", "a.tsv"), "r3": (None, None, None, "P2", "b.tsv"),
        "r4": (None, 2.0, None, "P2", "b.tsv"), "r5": (None, None, None, "P3", "c.tsv.gz"),
    }
    assert {(r.file, r.side) for r in file_tables.unlisted_files(rows, manifest).collect()} == {("d.tsv", "without rows")}
    assert len({r.header for r in file_tables.file_headers(spark, folder).collect()}) == 2


def test_headers_are_found_without_sorting_the_lines(spark, folder):
    plan = file_tables.file_headers(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan
    found = {r.path.rsplit("/", 1)[1]: r.header for r in file_tables.file_headers(spark, folder).collect()}
    assert found == {"a.tsv": "id\tStart\tCopy", "b.tsv": "Copy\tid\tNote", "c.tsv.gz": "id\tStart\tCopy"}


def test_files_that_must_stop(spark, folder, tmp_path):
    rows = file_tables.read_file_tables(spark, folder)
    manifest = spark.createDataFrame([("a.tsv",), ("b.tsv",)], "file_name string")
    with pytest.raises(Exception, match="not in the manifest"):
        file_tables.with_constants(rows, manifest).collect()
    with pytest.raises(QualityError, match="listed twice"):
        file_tables.with_constants(rows, manifest.union(manifest))
    with pytest.raises(Exception, match="id is no long"):
        file_tables.typed_strictly(rows, {"id": "long"}).collect()
    bad = {(r.source_file, r.text, r.n) for r in file_tables.unreadable_cells(rows, {"id": "long", "Copy": "double"}).collect()}
    assert bad == {("a.tsv", "r1", 1), ("a.tsv", "r2", 1), ("b.tsv", "r3", 1), ("b.tsv", "r4", 1), ("c.tsv.gz", "r5", 1)}


def test_entity_files_know_every_missing_text(spark, tmp_path):
    gaps = ["NA", "NaN", "nan", "null", "N/A", ""]
    (tmp_path / "x.tsv").write_text("feature\tvalue\n" + "".join(f"f{k}\t{g}\n" for k, g in enumerate(gaps)) + "f9\t1.25\n")
    rows = ingest.read_entity_files(spark, str(tmp_path), "feature string, value double").orderBy("feature").collect()
    assert [r.value for r in rows] == [None] * 6 + [1.25] and rows[0].file_name == "x.tsv" and isinstance(rows[0], Row)
