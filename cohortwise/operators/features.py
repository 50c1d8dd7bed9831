"""Per-learner feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import scalar
from cohortwise.operators.attach import attach
from cohortwise.operators.cleaning import with_client_id, with_label
from cohortwise.sources.specs import NEGATIVE_CLASSES, PASS_GRADE


def build_features(
    activity: DataFrame,
    info: DataFrame,
    scores: DataFrame,
    assessments: DataFrame | None = None,
    fanout: str = "reference",
) -> DataFrame:
    """One row per (client, student, label) from activity, profile and score tables.

    `reference`: scores match on the student alone, so each activity row counts once per score of
    the student in any course. Both sides are aggregated before they meet and the click total is
    multiplied by the number of scores, which gives the sums of the many-to-many join without its rows.

    `corrected`: scores are first matched to their course through `assessments`, and clicks count once.
    """
    learner = ["client_id", "id_student"]
    clicks = activity.groupBy(*learner).agg(
        F.sum("sum_click").alias("clicks"), F.count_distinct("date").alias("days_active")
    )
    profile = info.groupBy(*learner, "label").agg(
        F.count("*").alias("copies"),
        F.max("num_of_prev_attempts").alias("num_prev_attempts"),
        F.max("studied_credits").alias("studied_credits"),
        F.max(scalar.band_ordinal("imd_band")).alias("imd_band_num"),
        F.max(scalar.education_ordinal("highest_education")).alias("edu_level"),
    )
    if fanout == "reference":
        score_keys = ["id_student"]
    elif fanout == "corrected":
        if assessments is None:
            raise ValueError("fanout='corrected' needs the assessments table")
        score_keys = learner
        scores = scores.join(assessments.select("id_assessment", "client_id"), "id_assessment")
    else:
        raise ValueError(f"unknown fanout {fanout!r}")
    graded = scores.groupBy(*score_keys).agg(F.count("*").alias("n_scores"), F.avg("score").alias("avg_score"))
    times = F.col("copies")
    if fanout == "reference":
        times = times * F.greatest(F.coalesce("n_scores", F.lit(0)), F.lit(1))
    return (
        clicks.join(profile, learner)
        .join(graded, score_keys, "left")
        .select(
            *learner,
            (F.col("clicks") * times).alias("total_clicks"),
            "days_active",
            "label",
            "avg_score",
            "num_prev_attempts",
            "studied_credits",
            "imd_band_num",
            "edu_level",
        )
    )


FEATURE_SQL = """
WITH clicks AS (
  SELECT client_id, id_student, SUM(sum_click) AS clicks, COUNT(DISTINCT date) AS days_active
  FROM vle GROUP BY client_id, id_student
), graded AS (
  SELECT id_student, COUNT(*) AS n_scores, AVG(score) AS avg_score FROM sa GROUP BY id_student
)
SELECT c.client_id, c.id_student, c.clicks * GREATEST(COALESCE(g.n_scores, 0), 1) AS total_clicks,
       c.days_active, i.label, g.avg_score
FROM clicks c
JOIN info i ON i.id_student = c.id_student AND i.client_id = c.client_id
LEFT JOIN graded g ON g.id_student = c.id_student
"""


def max_normalise(df: DataFrame, col: str, name: str, by: Sequence[str] = (), plus: float = 1) -> DataFrame:
    """col / (max(col) + plus), the maximum taken per group or over all rows."""
    top = df.groupBy(*by).agg(F.max(col).alias("__max"))
    return attach(df, top, by).withColumn(name, F.col(col) / (F.col("__max") + F.lit(plus))).drop("__max")


def activity_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "clicks_per_day": scalar.safe_ratio("total_clicks", "days_active"),
            "engagement": F.log1p(F.col("total_clicks").cast("double")),
        }
    )


def grade_features(df: DataFrame, absence_rate: bool = True) -> DataFrame:
    """Label, client key and derived columns of the grades table (one row per student and subject).

    `absence_rate` needs each subject's maximum, a pass over the table of its own; leave it out where nothing reads it.
    """
    df = with_client_id(with_label(df, "G3", threshold=PASS_GRADE), ["school", "subject"])
    df = df.withColumns(
        {
            "avg_grade": (F.col("G1") + F.col("G2")) / 2,
            "grade_trend": F.col("G2") - F.col("G1"),
            "study_effort": F.col("studytime") * (1 + F.col("failures") * F.lit(0.5)),
            "parent_edu": (F.col("Medu") + F.col("Fedu")) / 2,
            "support": scalar.flag("schoolsup", "yes") + scalar.flag("famsup", "yes"),
        }
    )
    if absence_rate:
        df = max_normalise(df, "absences", "absence_rate", by=["subject"])
    return df.withColumns(
        {
            "total_clicks": F.col("avg_grade") * 100,
            "days_active": scalar.clip(30 - F.col("absences"), 0, 30),
            "avg_score": F.col("avg_grade") * 5,
        }
    )


def engagement_features(df: DataFrame) -> DataFrame:
    """Label, client key and derived columns of the engagement table."""
    df = with_client_id(with_label(df, "Class", negatives=NEGATIVE_CLASSES), ["NationalITy"], prefix="xapi_", clean=True)
    total = F.col("raisedhands") + F.col("VisITedResources") + F.col("AnnouncementsView") + F.col("Discussion")
    return df.withColumns(
        {
            "total_engagement": total,
            "absence_flag": scalar.flag("StudentAbsenceDays", "Above-7"),
            "parent_involved": scalar.flag("ParentAnsweringSurvey", "Yes"),
            "satisfaction": scalar.flag("ParentschoolSatisfaction", "Good"),
            "semester_num": scalar.flag("Semester", "Second"),
            "total_clicks": total,
            "days_active": scalar.clip("Discussion", 0, 100),
            "avg_score": scalar.clip("raisedhands", 0, 100),
        }
    )
