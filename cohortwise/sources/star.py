"""Learner tables derived from a retail star schema, so that every query runs on the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.operators import cleaning
from cohortwise.operators.features import activity_features, build_features
from cohortwise.sources.specs import COURSE_SPECS


class StarSource:
    """Lazy learner views over `<root>/<table>.parquet`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """The lazy scan of a table; its schema is read from the footer once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    def info(self) -> DataFrame:
        finished = (
            self.table("orders")
            .filter(F.col("o_orderstatus") == "F")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.count("*").alias("nf"))
        )
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(finished, "c_custkey", "left")
            .selectExpr(
                "c_mktsegment AS code_module",
                "concat('R', n_regionkey) AS code_presentation",
                "c_custkey AS id_student",
                """CASE WHEN nf >= 4 THEN 'Fail' WHEN nf = 3 THEN 'Withdrawn' WHEN nf = 2 THEN 'Pass'
                   ELSE 'Distinction' END AS final_result""",
                "CAST(c_custkey % 4 AS INT) AS num_of_prev_attempts",
                "CAST(30 * (1 + c_nationkey % 4) AS INT) AS studied_credits",
                """CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal >= 9000 THEN 'unknown-band'
                   ELSE concat(floor(c_acctbal / 1000) * 10, '-', floor(c_acctbal / 1000) * 10 + 10, '%')
                   END AS imd_band""",
                """CASE c_nationkey % 6 WHEN 0 THEN 'No Formal quals' WHEN 1 THEN 'Lower Than A Level'
                   WHEN 2 THEN 'A Level or Equivalent' WHEN 3 THEN 'HE Qualification'
                   WHEN 4 THEN 'Post Graduate Qualification' ELSE 'other' END AS highest_education""",
            )
        )

    def _courses(self) -> DataFrame:
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_mktsegment").alias("code_module"),
                F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("code_presentation"),
                F.col("c_custkey").alias("id_student"),
            )
        )

    def vle(self) -> DataFrame:
        owners = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id_student"))
        # the smaller tables meet first, so that lines move only once
        return (
            self.table("lineitem")
            .join(owners.join(self._courses(), "id_student"), "l_orderkey")
            .select(
                "code_module",
                "code_presentation",
                "id_student",
                F.col("l_partkey").alias("id_site"),
                F.col("l_shipdate").cast("date").alias("date"),
                F.col("l_quantity").cast("bigint").alias("sum_click"),
            )
        )

    def sa(self) -> DataFrame:
        key = F.col("o_orderkey")
        return (
            self.table("orders")
            .filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .select(
                key.alias("id_assessment"),
                F.col("o_custkey").alias("id_student"),
                F.when(key % 10 != 0, (key % 101).cast("int")).alias("score"),
            )
        )

    def assessments(self) -> DataFrame:
        return (
            self.table("orders")
            .select(F.col("o_orderkey").alias("id_assessment"), F.col("o_custkey").alias("id_student"))
            .join(self._courses(), "id_student")
            .select("id_assessment", "code_module", "code_presentation")
        )

    def xapi(self) -> DataFrame:
        people = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        kinds = {
            "raisedhands": "click",
            "VisITedResources": "view",
            "AnnouncementsView": "signup",
            "Discussion": "purchase",
            "errors": "error",
        }
        per_user = (
            self.table("events")
            .groupBy("user_id")
            .agg(*[F.expr(f"count_if(event_type = '{kind}') AS {name}") for name, kind in kinds.items()])
        )
        return per_user.join(people, F.col("user_id") == F.col("c_custkey")).selectExpr(
            "user_id AS id_student",
            "concat(' ', replace(n_name, '_', ' '), ' ') AS NationalITy",
            "raisedhands",
            "VisITedResources",
            "AnnouncementsView",
            "Discussion",
            "if(errors > 13, 'Above-7', 'Under-7') AS StudentAbsenceDays",
            "if(user_id % 2 = 0, 'Yes', 'No') AS ParentAnsweringSurvey",
            "if(user_id % 3 = 0, 'Good', 'Bad') AS ParentschoolSatisfaction",
            "if(user_id % 5 < 2, 'Second', 'First') AS Semester",
            """CASE WHEN raisedhands + VisITedResources < 24 THEN 'L'
               WHEN raisedhands + VisITedResources < 29 THEN 'M' ELSE 'H' END AS Class""",
        )

    def uci(self) -> DataFrame:
        owners = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id_student"))
        return (
            self.table("lineitem")
            .join(owners, "l_orderkey")
            .groupBy("id_student")
            .agg(
                F.expr("max(if(l_linenumber <= 2, l_quantity, 0.0D)) AS q2"),
                F.expr("max(if(l_linenumber <= 3, l_quantity, 0.0D)) AS q3"),
                F.avg("l_linenumber").alias("mean_line"),
                F.count_distinct("l_orderkey").alias("n_orders"),
            )
            .selectExpr(
                "id_student",
                "if(id_student % 13 = 0, 'MS', 'GP') AS school",
                "if(id_student % 2 = 0, 'math', 'portuguese') AS subject",
                "CAST(floor(q2 * 0.4D) AS INT) AS G1",
                "CAST(floor(q3 * 0.4D) AS INT) AS G2",
                "CAST(floor(q2 * 0.14D + mean_line) AS INT) AS G3",
                "CAST(1 + id_student % 4 AS INT) AS studytime",
                "CAST(id_student % 3 AS INT) AS failures",
                "CAST(id_student % 5 AS INT) AS Medu",
                "CAST(id_student % 4 AS INT) AS Fedu",
                "CAST(1 + id_student % 5 AS INT) AS health",
                "CAST(n_orders AS INT) AS absences",
                "if(id_student % 7 = 0, 'yes', 'no') AS schoolsup",
                "if(id_student % 2 = 0, 'yes', 'no') AS famsup",
            )
        )

    def raw(self, name: str) -> DataFrame:
        views = {
            "student_vle": self.vle,
            "student_info": self.info,
            "student_assessment": self.sa,
            "assessments": self.assessments,
        }
        return views[name]()

    def cleaned(self, name: str) -> DataFrame:
        return cleaning.clean_table(self.raw(name), COURSE_SPECS[name])

    def features(self, fanout: str = "reference") -> DataFrame:
        """The per-learner feature table over the cleaned course tables."""
        return build_features(
            self.cleaned("student_vle"),
            self.cleaned("student_info"),
            self.cleaned("student_assessment"),
            self.cleaned("assessments") if fanout == "corrected" else None,
            fanout,
        )

    def learners(self, fanout: str = "reference") -> DataFrame:
        """The feature table with its derived columns."""
        return activity_features(self.features(fanout))
