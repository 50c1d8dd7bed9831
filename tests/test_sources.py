"""Readers, writers and the zone pipeline on small files."""

from __future__ import annotations

import pytest
from cohortwise.plans import prepare
from cohortwise.sources import tables, tolerant
from cohortwise.sources.specs import COURSE_SPECS
from pyspark.sql import functions as F


def test_csv_schema_is_matched_by_name(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("score,extra,id_student\n5,x,7\n,y,8\n")
    schema = COURSE_SPECS["student_assessment"].schema
    df = tables.read_csv(spark, str(path), schema)
    assert df.dtypes == [("id_student", "bigint"), ("score", "int")]
    assert sorted(tuple(r) for r in df.collect()) == [(7, 5), (8, None)]
    assert dict(tables.read_csv(spark, str(path)).dtypes)["score"] == "int"


@pytest.mark.parametrize("sep", [";", ","])
def test_delimited_probe(spark, tmp_path, sep):
    path = tmp_path / "grades.csv"
    lines = [sep.join(["name", "G3"])] + [sep.join([f"João{i}", str(i)]) for i in range(11)]
    path.write_bytes("\n".join(lines).encode("latin-1"))
    df = tables.read_delimited(spark, str(path), "G3")
    assert df.count() == 11 and df.first()["name"] == "João0" and dict(df.dtypes)["G3"] == "int"


def test_delimited_probe_refuses_short_files(spark, tmp_path):
    path = tmp_path / "grades.csv"
    path.write_text("name;G3\n" + "\n".join(f"a;{i}" for i in range(10)))
    with pytest.raises(ValueError):
        tables.read_delimited(spark, str(path), "G3")


@pytest.mark.parametrize("encoding, name", [("utf-8", "João–Zoë"), ("cp1252", "João–Zoë"), ("latin-1", "João\x81")])
def test_every_encoding_can_be_found(spark, tmp_path, encoding, name):
    path = tmp_path / "grades.csv"
    path.write_bytes("\n".join(["name;G3", *["a;1"] * 11, f"{name};2"]).encode(encoding))
    for df in (tables.read_delimited(spark, str(path), "G3"), tables.read_semicolon(spark, str(path))):
        assert df.filter("G3 = 2").first()["name"] == name and df.count() == 12


def test_semicolon_files_of_any_length(spark, tmp_path):
    path = tmp_path / "grades.csv"
    path.write_text("name;G3\na;1\n")
    assert tables.read_semicolon(spark, str(path)).first() == ("a", 1)
    with pytest.raises(ValueError):
        tables.read_semicolon(spark, str(path), "G4")


def test_source_status(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "good"))
    got = tolerant.source_status(spark, {"good": str(tmp_path / "good"), "bad": str(tmp_path / "none")})
    rows = {r["dataset"]: r for r in got.collect()}
    assert (rows["good"]["status"], rows["good"]["n_rows"], rows["good"]["message"]) == ("ok", 3, "")
    assert rows["bad"]["status"] == "unreadable" and rows["bad"]["message"]


def test_partitioned_table_and_results(spark, tmp_path):
    df = spark.range(100).withColumn("client_id", (F.col("id") % 3).cast("string"))
    tables.write_table(df, str(tmp_path / "t"), ["client_id"])
    assert (tmp_path / "t" / "client_id=0").is_dir()
    assert tables.read_table(spark, str(tmp_path / "t")).filter("client_id = 0").count() == 34
    for fmt in ("json", "csv", "parquet"):
        tables.write_results(df, str(tmp_path / fmt), fmt)
        back = tables.read_results(spark, str(tmp_path / fmt), df.schema, fmt)
        assert back.agg(F.sum("id")).first()[0] == 4950
    tables.write_results(df.limit(1), str(tmp_path / "text"), "text")
    assert spark.read.text(str(tmp_path / "text")).first()[0] == "id: 0, client_id: 0"


def test_zones(spark, tmp_path):
    files = {
        "studentVle.csv": "code_module,code_presentation,id_student,id_site,date,sum_click\nA,1,1,5,-3,3\nA,1,1,5,-3,4\nA,1,1,6,-3,2\n",
        "studentInfo.csv": "code_module,code_presentation,id_student,gender,region,highest_education,imd_band,age_band,num_of_prev_attempts,studied_credits,disability,final_result\n"
        "A,1,1,M,x,HE Qualification,10-20%,y,0,60,N,Withdrawn\nA,1,2,M,x,HE Qualification,,y,0,60,N,Pass\n",
        "studentAssessment.csv": "id_assessment,id_student,date_submitted,is_banked,score\n9,1,3,0,80\n9,1,4,0,90\n8,1,4,0,\n",
        "assessments.csv": "code_module,code_presentation,id_assessment,assessment_type,date,weight\nA,1,9,TMA,3,10\n",
    }
    (tmp_path / "raw" / "oulad").mkdir(parents=True)
    for name, text in files.items():
        (tmp_path / "raw" / "oulad" / name).write_text(text)
    interim = prepare.ingest(spark, COURSE_SPECS, str(tmp_path / "raw"), str(tmp_path / "interim"))
    assert "ingest_timestamp" in interim["student_vle"].columns
    cleaned = prepare.clean(spark, COURSE_SPECS, str(tmp_path / "interim"), str(tmp_path / "processed"))
    report = {(r["dataset"], r["check"]): r["value"] for r in prepare.validation_report(cleaned, COURSE_SPECS).collect()}
    assert report[("student_vle", "rows")] == 2 and report[("student_info", "rows")] == 1
    assert report[("student_assessment", "rows")] == 1 and report[("assessments", "rows")] == 1
    row = prepare.feature_table(cleaned, str(tmp_path / "features")).first()
    assert (row["total_clicks"], row["days_active"], row["label"], row["avg_score"], row["imd_band_num"]) == (6, 1, 1, 90.0, 1)


def test_broken_part_file_is_a_report_row(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/good")
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/bad")
    part = next((tmp_path / "bad").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:20])
    paths = {"good": f"{tmp_path}/good", "bad": f"{tmp_path}/bad", "none": f"{tmp_path}/none"}
    got = {r["dataset"]: r for r in tolerant.source_status(spark, paths).collect()}
    assert (got["good"]["status"], got["good"]["n_rows"]) == ("ok", 10)
    assert got["bad"]["status"] == got["none"]["status"] == "unreadable" and got["bad"]["message"]


def test_text_results_keep_null_columns(spark, tmp_path):
    df = spark.createDataFrame([("x", None, 3)], "a string, b string, c int")
    tables.write_results(df, f"{tmp_path}/t", "text")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()] == ["a: x, b: , c: 3"]
