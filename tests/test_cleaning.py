"""Row rules on hand-written tables."""

from __future__ import annotations

import pytest
from cohortwise.functions import scalar
from cohortwise.operators import cleaning, features
from cohortwise.operators.validation import validate
from cohortwise.sources.specs import COURSE_SPECS, RANGE_RULES
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ordinals_cover_every_code_and_the_rest(spark):
    texts = [*scalar.BAND_CODES, "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(scalar.band_ordinal("t")).collect()]
    assert got == [*range(10), 5, 5]
    texts = [*scalar.EDUCATION_CODES, "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalar.education_ordinal("t")).collect()] == [0, 1, 2, 3, 4, 2, 2]


def test_labels(spark):
    df = spark.createDataFrame([("Fail",), ("Withdrawn",), ("Pass",), (None,)], "r string")
    got = {r["r"]: r["label"] for r in cleaning.with_label(df, "r", negatives=["Fail"]).collect()}
    assert got == {"Fail": 0, "Withdrawn": 1, "Pass": 1, None: 1}
    df = spark.createDataFrame([(9,), (10,)], "g int")
    assert rows(cleaning.with_label(df, "g", threshold=10), "g", "label") == [(9, 0), (10, 1)]
    with pytest.raises(ValueError):
        cleaning.with_label(df, "g")


def test_client_keys(spark):
    df = spark.createDataFrame([("AAA", "2013J", " Saudi Arabia ")], "m string, p string, n string")
    row = df.select(
        scalar.client_key(["m", "p"]).alias("a"), scalar.client_key(["n"], prefix="xapi_", clean=True).alias("b")
    ).first()
    assert tuple(row) == ("AAA_2013J", "xapi_Saudi_Arabia")


def test_clip_and_zero_days(spark):
    df = spark.createDataFrame([(9, 0, 35), (8, 2, 10)], "clicks long, days long, absences int")
    out = df.select(scalar.safe_ratio("clicks", "days").alias("r"), scalar.clip(30 - F.col("absences"), 0, 30).alias("d"))
    assert [tuple(r) for r in out.collect()] == [(0.0, 0), (4.0, 20)]


def test_dedup_keeps_the_preferred_row_on_any_partitioning(spark):
    data = [(k, v, f"s{v}") for k in range(20) for v in range(5)] + [(0, 4, "s9")] * 200
    df = spark.createDataFrame(data, "k int, v int, s string")
    want = [(0, 4, "s9")] + [(k, 4, "s4") for k in range(1, 20)]
    for n in (1, 7):
        assert rows(cleaning.dedup(df.repartition(n), ["k"], ["v"]), "k", "v", "s") == want


def test_clean_table_drops_incomplete_rows_and_extra_columns(spark):
    spec = COURSE_SPECS["student_info"]
    cols = "code_module string, code_presentation string, id_student long, final_result string, num_of_prev_attempts int, studied_credits int, imd_band string, highest_education string, extra int"
    data = [("A", "1", 1, "Fail", 0, 60, "0-10%", "x", 7), ("A", "1", 2, "Withdrawn", 0, 60, None, "x", 7)]
    out = cleaning.clean_table(spark.createDataFrame(data, cols), spec)
    assert out.columns == [*spec.required, "client_id", "label"]
    assert rows(out, "client_id", "id_student", "label") == [("A_1", 1, 0)]


def test_min_group_bounds(spark):
    data = [("a", None)] * 19 + [("b", None)] * 20 + [("c", 1)] * 50 + [("d", 1)] * 51
    df = spark.createDataFrame(data, "k string, v int")
    assert rows(cleaning.min_group(df, "k", 20).distinct(), "k") == [("b",), ("c",), ("d",)]
    assert rows(cleaning.min_group(df, "k", 50, strict=True).distinct(), "k") == [("d",)]
    status = {r["k"]: r["status"] for r in cleaning.group_status(df, "k", 19, ["v"]).collect()}
    assert status == {"a": "skipped", "b": "failed", "c": "trained", "d": "trained"}


def test_range_rules_and_validation(spark):
    df = spark.createDataFrame([(0, 5), (1, 301), (1, -100), (3, None)], "sum_click int, date int")
    assert cleaning.range_rules(df, RANGE_RULES, "filter").count() == 1
    flagged = cleaning.range_rules(df, RANGE_RULES)
    assert flagged.filter("in_range = 0").count() == 3
    report = {r["check"]: r["value"] for r in validate(df, "t", ["sum_click", "date", "absent"]).collect()}
    assert report == {"rows": 4, "null sum_click": 0, "null date": 1}


def test_complete_features(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (float("nan"), 3)], "x double, i int")
    assert rows(cleaning.complete_features(df, ["x"]), "i") == [(1,)]
    zero = cleaning.complete_features(df, ["x"], how="zero")
    assert (2,) in rows(zero.filter("x = 0"), "i")


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert cleaning.project_required(df, ["y", "z", "x"]).columns == ["y", "x"]
    assert cleaning.available_features(df, ["q"]) == []
    assert cleaning.available_features(df, ["x", "q"]) == ["x"]
    assert cleaning.with_defaults(df, {"x": F.lit(0), "w": F.lit(5)}).first().asDict() == {"x": 1, "y": "a", "w": 5}
    many = spark.range(100).repartition(5)
    assert cleaning.with_row_id(many, "rid").select("rid").distinct().count() == 100


def course_tables(spark):
    activity = spark.createDataFrame(
        [("A_1", 1, 1, 3), ("A_1", 1, 1, 4), ("A_1", 2, 1, 5), ("A_1", 3, 1, 2), ("B_1", 3, 9, 6), ("A_1", 9, 1, 1)],
        "client_id string, id_student long, date int, sum_click long",
    )
    info = spark.createDataFrame(
        [("A_1", 1, 1), ("A_1", 2, 0), ("A_1", 3, 1), ("B_1", 3, 0)], "client_id string, id_student long, label int"
    ).selectExpr("*", "1 AS num_of_prev_attempts", "60 AS studied_credits", "'x' AS imd_band", "'x' AS highest_education")
    scores = spark.createDataFrame(
        [(100, 1, 50), (101, 1, 70), (102, 3, 80)], "id_assessment long, id_student long, score int"
    )
    assessments = spark.createDataFrame(
        [(100, "A_1"), (101, "A_1"), (102, "B_1")], "id_assessment long, client_id string"
    )
    return activity, info, scores, assessments


def test_features_repeat_clicks_per_score(spark):
    activity, info, scores, assessments = course_tables(spark)
    got = rows(
        features.build_features(activity, info, scores), "client_id", "id_student", "total_clicks", "days_active", "label", "avg_score"
    )
    assert got == [("A_1", 1, 14, 1, 1, 60.0), ("A_1", 2, 5, 1, 0, None), ("A_1", 3, 2, 1, 1, 80.0), ("B_1", 3, 6, 1, 0, 80.0)]
    fixed = features.build_features(activity, info, scores, assessments, fanout="corrected")
    got = rows(fixed, "client_id", "id_student", "total_clicks", "avg_score")
    assert got == [("A_1", 1, 7, 60.0), ("A_1", 2, 5, None), ("A_1", 3, 2, None), ("B_1", 3, 6, 80.0)]


def test_features_equal_the_plain_join(spark):
    activity, info, scores, _ = course_tables(spark)
    info = info.unionByName(info.filter("id_student = 1"))  # a repeated profile multiplies as well
    plain = (
        activity.join(info, ["client_id", "id_student"])
        .join(scores, "id_student", "left")
        .groupBy("client_id", "id_student", "label")
        .agg(F.sum("sum_click").alias("total_clicks"), F.avg("score").alias("avg_score"))
    )
    cols = ["client_id", "id_student", "label", "total_clicks", "avg_score"]
    assert rows(features.build_features(activity, info, scores), *cols) == rows(plain, *cols)


def test_grade_and_engagement_features(spark):
    grades = spark.createDataFrame(
        [(1, "GP", "math", 10, 12, 9, 2, 1, 4, 2, 3, 35, "yes", "no"), (2, "GP", "math", 6, 6, 10, 1, 0, 0, 1, 5, 4, "yes", "yes")],
        "id_student int, school string, subject string, G1 int, G2 int, G3 int, studytime int, failures int, Medu int, Fedu int, health int, absences int, schoolsup string, famsup string",
    )
    out = {r["id_student"]: r.asDict() for r in features.grade_features(grades).collect()}
    first = out[1]
    assert (first["label"], first["client_id"], first["avg_grade"], first["grade_trend"]) == (0, "GP_math", 11.0, 2)
    assert (first["study_effort"], first["parent_edu"], first["support"], first["days_active"]) == (3.0, 3.0, 1, 0)
    assert first["absence_rate"] == 35 / 36 and out[2]["absence_rate"] == 4 / 36 and out[2]["label"] == 1
    assert (first["total_clicks"], first["avg_score"]) == (1100.0, 55.0)
    people = spark.createDataFrame(
        [(1, "KW", 120, 2, 3, 4, "Above-7", "Yes", "Bad", "Second", "L"), (2, "KW", 1, 1, 1, 1, "Under-7", "No", "Good", "First", None)],
        "id_student int, NationalITy string, raisedhands int, VisITedResources int, AnnouncementsView int, Discussion int, StudentAbsenceDays string, ParentAnsweringSurvey string, ParentschoolSatisfaction string, Semester string, Class string",
    )
    got = rows(features.engagement_features(people), "id_student", "label", "total_engagement", "absence_flag", "parent_involved", "satisfaction", "semester_num", "avg_score")
    assert got == [(1, 0, 129, 1, 1, 0, 1, 100), (2, 1, 4, 0, 0, 1, 0, 1)]
