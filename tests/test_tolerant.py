"""Scans of files with bad tokens and of damaged Parquet files."""

from __future__ import annotations

from cohortwise.sources import tables, tolerant
from cohortwise.sources.specs import COURSE_SPECS, ENGAGEMENT_SPEC, GRADE_SPECS
from pyspark.sql import functions as F


def test_bad_tokens_are_counted_rejects(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("school;G1;G2;absences;other\nGP;7;?;4;x\nMS;;8; ;y\nGP;abc;?;-1;z\nGP;99999999999;1;2.0;z\n")
    got = tolerant.scan(spark, str(path), GRADE_SPECS["math"])
    assert got.columns == ["school", "absences", "G1", "G2", "rejects"]
    rows = [(r.school, r.G1, r.G2, r.absences, [tuple(x) for x in r.rejects]) for r in got.collect()]
    assert rows[:3] == [
        ("GP", 7, None, 4, [("G2", "?")]),
        ("MS", None, 8, None, []),
        ("GP", None, None, -1, [("G1", "abc"), ("G2", "?")]),
    ]
    assert ("G1", "99999999999") in rows[3][4]
    side = {(r.column, r.token): r.n_rows for r in tolerant.rejected_tokens(got).collect()}
    assert side[("G2", "?")] == 2
    assert side[("G1", "abc")] == 1
    report = tolerant.write_checked(got, str(tmp_path / "zone"), "math", ["school", "G1", "G2", "missing"])
    values = {r.check: r.value for r in report.collect()}
    assert values == {
        "rows": 4, "null school": 0, "reject school": 0, "null G1": 3, "reject G1": 2, "null G2": 2, "reject G2": 2,
    }
    assert spark.read.parquet(str(tmp_path / "zone")).columns == ["school", "absences", "G1", "G2"]


def test_typed_scan_survives_a_bad_token(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id_assessment,id_student,score\n1,2,70\n1,x,?\n")
    rows = tables.read_csv(spark, str(path), COURSE_SPECS["student_assessment"].schema).collect()
    assert [(r.id_assessment, r.id_student, r.score) for r in rows] == [(1, 2, 70), (1, None, None)]


def test_scan_of_no_rows_and_of_text_columns_only(spark, tmp_path):
    (tmp_path / "e.csv").write_text("NationalITy,Class\n")
    got = tolerant.scan(spark, str(tmp_path / "e.csv"), ENGAGEMENT_SPEC)
    assert got.columns == ["NationalITy", "Class", "rejects"]
    report = tolerant.write_checked(got, str(tmp_path / "zone"), "engagement", ENGAGEMENT_SPEC.required)
    assert {r.check: r.value for r in report.collect()}["rows"] == 0


def test_damaged_data_pages_name_their_file(spark, tmp_path):
    wide = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(3)
    wide.write.parquet(f"{tmp_path}/bad")
    wide.limit(10).write.parquet(f"{tmp_path}/good")
    spark.range(0).write.parquet(f"{tmp_path}/empty")
    part = sorted((tmp_path / "bad").glob("part-*.parquet"))[1]
    raw = bytearray(part.read_bytes())
    raw[1_000 : len(raw) // 2] = b"\x55" * (len(raw) // 2 - 1_000)  # the footer stays readable
    part.write_bytes(bytes(raw))
    for crc in (tmp_path / "bad").glob(".*.crc"):
        crc.unlink()
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 60_000
    paths = {n: f"{tmp_path}/{n}" for n in ("good", "bad", "empty", "none")}
    got = {r.dataset: r for r in tolerant.source_status(spark, paths).collect()}
    assert (got["good"].status, got["good"].n_rows, got["good"].file) == ("ok", 10, None)
    assert (got["empty"].status, got["empty"].n_rows) == ("ok", 0)
    assert got["bad"].status == got["none"].status == "unreadable"
    assert got["bad"].file.endswith(part.name)
