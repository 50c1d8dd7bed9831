"""Declared datasets: schema, required columns and deduplication keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_STRING, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    file: str
    required: tuple[str, ...]
    keys: tuple[str, ...]
    schema: T.StructType | None = None
    # order in which a surviving row is preferred, largest first
    prefer: tuple[str, ...] = field(default=())
    sep: str = ","


# Files, required columns and deduplication keys of the four course tables.
COURSE_SPECS = {
    "student_vle": DatasetSpec(
        "student_vle",
        "oulad/studentVle.csv",
        ("code_module", "code_presentation", "id_student", "id_site", "date", "sum_click"),
        ("code_module", "code_presentation", "id_student", "id_site", "date"),
        _schema(
            ("code_module", _STRING),
            ("code_presentation", _STRING),
            ("id_student", _LONG),
            ("id_site", _LONG),
            ("date", _INT),
            ("sum_click", _LONG),
        ),
        ("sum_click",),
    ),
    "student_info": DatasetSpec(
        "student_info",
        "oulad/studentInfo.csv",
        (
            "code_module",
            "code_presentation",
            "id_student",
            "final_result",
            "num_of_prev_attempts",
            "studied_credits",
            "imd_band",
            "highest_education",
        ),
        ("code_module", "code_presentation", "id_student"),
        _schema(
            ("code_module", _STRING),
            ("code_presentation", _STRING),
            ("id_student", _LONG),
            ("gender", _STRING),
            ("region", _STRING),
            ("highest_education", _STRING),
            ("imd_band", _STRING),
            ("age_band", _STRING),
            ("num_of_prev_attempts", _INT),
            ("studied_credits", _INT),
            ("disability", _STRING),
            ("final_result", _STRING),
        ),
    ),
    "student_assessment": DatasetSpec(
        "student_assessment",
        "oulad/studentAssessment.csv",
        ("id_assessment", "id_student", "score"),
        ("id_assessment", "id_student"),
        _schema(
            ("id_assessment", _LONG),
            ("id_student", _LONG),
            ("date_submitted", _INT),
            ("is_banked", _INT),
            ("score", _INT),
        ),
    ),
    "assessments": DatasetSpec(
        "assessments",
        "oulad/assessments.csv",
        ("id_assessment", "code_module", "code_presentation"),
        ("id_assessment",),
        _schema(
            ("code_module", _STRING),
            ("code_presentation", _STRING),
            ("id_assessment", _LONG),
            ("assessment_type", _STRING),
            ("date", _INT),
            ("weight", _INT),
        ),
    ),
}

# The engagement file, and the grades files of both subjects.
ENGAGEMENT_SPEC = DatasetSpec(
    "engagement",
    "xapi/xAPI-Edu-Data.csv",
    ("NationalITy", "raisedhands", "VisITedResources", "AnnouncementsView", "Discussion", "Class"),
    (),
    _schema(
        *[(c, _STRING) for c in ("gender", "NationalITy", "PlaceofBirth", "StageID", "GradeID", "SectionID", "Topic", "Semester", "Relation")],
        *[(c, _LONG) for c in ("raisedhands", "VisITedResources", "AnnouncementsView", "Discussion")],
        *[(c, _STRING) for c in ("ParentAnsweringSurvey", "ParentschoolSatisfaction", "StudentAbsenceDays", "Class")],
    ),
)
_GRADES = _schema(
    *[(c, _STRING) for c in ("school", "sex")],
    ("age", _INT),
    *[(c, _STRING) for c in ("address", "famsize", "Pstatus")],
    *[(c, _INT) for c in ("Medu", "Fedu")],
    *[(c, _STRING) for c in ("Mjob", "Fjob", "reason", "guardian")],
    *[(c, _INT) for c in ("traveltime", "studytime", "failures")],
    *[(c, _STRING) for c in ("schoolsup", "famsup", "paid", "activities", "nursery", "higher", "internet", "romantic")],
    *[(c, _INT) for c in ("famrel", "freetime", "goout", "Dalc", "Walc", "health", "absences", "G1", "G2", "G3")],
)
_GRADE_COLUMNS = ("school", "G1", "G2", "G3", "studytime", "failures", "Medu", "Fedu", "health", "absences", "schoolsup", "famsup")
GRADE_SPECS = {
    "math": DatasetSpec("math", "uci/student-mat.csv", _GRADE_COLUMNS, (), _GRADES, sep=";"),
    "portuguese": DatasetSpec("portuguese", "uci/student-por.csv", _GRADE_COLUMNS, (), _GRADES, sep=";"),
}

# Accepted ranges, and the feature list of each dataset.
RANGE_RULES = {"sum_click": (1, None), "date": (-100, 300), "score": (0, 100)}
FEATURES = {
    "oulad": [
        "total_clicks",
        "days_active",
        "avg_score",
        "clicks_per_day",
        "engagement",
        "num_prev_attempts",
        "studied_credits",
        "imd_band_num",
        "edu_level",
    ],
    "uci": [
        "avg_grade",
        "grade_trend",
        "study_effort",
        "parent_edu",
        "absence_rate",
        "failures",
        "health",
        "support",
    ],
    "xapi": [
        "raisedhands",
        "VisITedResources",
        "AnnouncementsView",
        "Discussion",
        "total_engagement",
        "absence_flag",
        "parent_involved",
        "satisfaction",
    ],
}
DEFAULT_FEATURES = ["total_clicks", "days_active", "avg_score"]
NEGATIVE_RESULTS = ("Fail",)
NEGATIVE_CLASSES = ("L",)
PASS_GRADE = 10
