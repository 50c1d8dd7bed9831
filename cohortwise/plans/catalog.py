"""Registered queries: every operator run over whole tables. Each takes (spark, folder of Parquet tables)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortwise.functions import scalar
from cohortwise.functions.scalar import tidy
from cohortwise.operators import (
    cleaning,
    combining,
    features,
    grouped_lbfgs,
    grouped_lr,
    metrics,
    pooled,
    profiling,
    scaling,
    score_histogram,
    splitting,
)
from cohortwise.operators.attach import attach
from cohortwise.operators.positions import with_positions
from cohortwise.operators.selection import exact_median
from cohortwise.operators.validation import validate
from cohortwise.plans import prepare, proximal, results, rounds
from cohortwise.session import at_once, materialise, path_state, scratch_path, tune
from cohortwise.sources import tables, tolerant
from cohortwise.sources.specs import COURSE_SPECS, ENGAGEMENT_SPEC, FEATURES, GRADE_SPECS, RANGE_RULES
from cohortwise.sources.star import StarSource

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Two features with closed-form 3 x 3 Newton steps, so SQL can check the fitted models.
PAIR = ["days_active", "avg_score"]
ENGAGEMENT_PAIR = ["raisedhands", "Discussion"]
# Activity day offsets count from this date.
DAY_ZERO = "1999-01-01"
# Engagement groups are small in the test data.
ENGAGEMENT_MIN_ROWS = 5


def query(fn: Callable[[StarSource], DataFrame]) -> Callable[[StarSource], DataFrame]:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return fn(StarSource(tune(spark), root))

    QUERIES[fn.__name__] = run
    return fn


def bigint(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: tidy(c, digits) for c in cols})


# --- sources, cleaning, validation ---------------------------------------------------------------


@query
def ingest_audit(src: StarSource) -> DataFrame:
    """The ingest time on every row of every table."""
    stamped = tables.run_all(COURSE_SPECS, lambda spec: tables.with_ingest_time(src.raw(spec.name)))
    return cleaning.union_all(
        [
            df.agg(F.count("*").alias("n_rows"), F.count("ingest_timestamp").alias("n_stamped")).withColumn(
                "dataset", F.lit(name)
            )
            for name, df in stamped.items()
        ]
    )


def _csv_copy(src: StarSource) -> str:
    """The course tables as header CSV files below a scratch folder; days become offsets from DAY_ZERO."""
    raw = scratch_path(src.spark, "raw")
    for spec in COURSE_SPECS.values():
        df = src.raw(spec.name)
        if "date" in df.columns:
            df = df.withColumn("date", F.datediff("date", F.lit(DAY_ZERO).cast("date")))
        df.write.option("header", True).csv(f"{raw}/{spec.file}")
    return raw


@query
def zone_pipeline(src: StarSource) -> DataFrame:
    """CSV to interim to cleaned Parquet, then the validation report."""
    raw, zones = _csv_copy(src), scratch_path(src.spark, "zones")
    prepare.ingest(src.spark, COURSE_SPECS, raw, f"{zones}/interim")
    cleaned = prepare.clean(src.spark, COURSE_SPECS, f"{zones}/interim", f"{zones}/processed")
    return prepare.validation_report(cleaned, COURSE_SPECS)


@query
def delimited_scan(src: StarSource) -> DataFrame:
    """One semicolon file per subject, probed and by its fixed separator, then stacked."""
    parts = []
    for subject in ("math", "portuguese"):
        path = scratch_path(src.spark, subject)
        rows = src.uci().filter(F.col("subject") == subject).drop("subject")
        rows.write.options(header=True, sep=";").csv(path)
        found = tables.read_delimited(src.spark, path, "G3") if subject == "math" else tables.read_semicolon(src.spark, path)
        parts.append(found.withColumn("subject", F.lit(subject)))
    return cleaning.union_all(parts, allow_missing=True).groupBy("subject").agg(
        F.count("*").alias("n"), bigint(F.sum("G3")).alias("sum_g3"), bigint(F.max("absences")).alias("max_absences")
    )


@query
def results_round_trip(src: StarSource) -> DataFrame:
    """A result table written as JSON, CSV and text, then read back."""
    profile = profiling.rate_by_group(src.features(), "client_id")
    json_path, csv_path, text_path = (scratch_path(src.spark, n) for n in ("json", "csv", "text"))
    profile = materialise(profile, "rates")
    tables.write_results(profile, json_path, "json")
    tables.write_results(profile, csv_path, "csv")
    tables.write_results(profile, text_path, "text")
    from_json = tables.read_results(src.spark, json_path, profile.schema, "json")
    from_csv = tables.read_results(src.spark, csv_path, profile.schema, "csv")
    lines = src.spark.read.text(text_path).agg(F.count("*").alias("n_lines"))
    joined = from_json.join(from_csv.select("client_id", F.col("rate").alias("rate_csv")), "client_id")
    return attach(rounded(joined, "rate", "rate_csv"), lines)


@query
def source_status(src: StarSource) -> DataFrame:
    """Row counts of readable sources; a missing one becomes a report row."""
    names = ["customer", "orders", "lineitem", "events", "not_there"]
    status = tolerant.source_status(src.spark, {n: f"{src.root}/{n}.parquet" for n in names})
    return status.select("dataset", "status", "n_rows")


def _scanned(src: StarSource) -> dict[str, DataFrame]:
    """The grades and engagement tables written as header files with some bad tokens, and scanned by their specs."""
    bad = lambda c, n, token: F.when(F.col("id_student") % n == 0, F.lit(token)).otherwise(F.col(c).cast("string"))
    out = {}
    for name, spec in {**GRADE_SPECS, "engagement": ENGAGEMENT_SPEC}.items():
        if name == "engagement":
            rows = src.xapi().withColumns({"raisedhands": bad("raisedhands", 5, "?"), "Discussion": bad("Discussion", 7, "")})
        else:
            rows = src.uci().filter(F.col("subject") == name).drop("subject")
            rows = rows.withColumns({"G1": bad("G1", 7, "?"), "absences": bad("absences", 11, "n/a"), "health": bad("health", 10, " ")})
        path = f"{scratch_path(src.spark, 'raw')}/{spec.file}"
        rows.write.options(header=True, sep=spec.sep).csv(path)
        out[name] = tolerant.scan(src.spark, path, spec)
    return out


@query
def tolerant_scan(src: StarSource) -> DataFrame:
    """Files with bad tokens to Parquet; rows, NULLs and rejects counted by the write itself."""
    zone = scratch_path(src.spark, "zone")
    specs = {**GRADE_SPECS, "engagement": ENGAGEMENT_SPEC}
    reports = [
        tolerant.write_checked(df, f"{zone}/{name}", name, specs[name].required) for name, df in _scanned(src).items()
    ]
    return cleaning.union_all(reports)


@query
def rejected_tokens(src: StarSource) -> DataFrame:
    """Every bad token with its column and number of rows."""
    parts = [tolerant.rejected_tokens(df).withColumn("dataset", F.lit(name)) for name, df in _scanned(src).items()]
    return cleaning.union_all(parts)


@query
def row_positions(src: StarSource) -> DataFrame:
    """P20: customers numbered by balance, largest first, then key."""
    people = src.table("customer").select("c_custkey", "c_acctbal")
    return with_positions(people, [F.col("c_acctbal").desc(), "c_custkey"], "row_id")


@query
def range_rules_scores(src: StarSource) -> DataFrame:
    """The declared ranges on the score table."""
    flagged = cleaning.range_rules(src.sa(), RANGE_RULES)
    return flagged.groupBy("in_range").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query
def clean_activity(src: StarSource) -> DataFrame:
    """P1-P4 on the activity table."""
    return src.cleaned("student_vle").select("client_id", "id_student", "id_site", "date", "sum_click")


@query
def clean_info_label(src: StarSource) -> DataFrame:
    """P1, P2, P4, P7 on the profile table."""
    return src.cleaned("student_info")


@query
def clean_scores(src: StarSource) -> DataFrame:
    """P1, P2, P3 on the score table."""
    return src.cleaned("student_assessment")


@query
def dedup_keys(src: StarSource) -> DataFrame:
    """P3 with real duplicates: the dearest line per (order, line number)."""
    cols = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"]
    return cleaning.dedup(src.table("lineitem").select(*cols), cols[:2], ["l_extendedprice"])


@query
def range_rules(src: StarSource) -> DataFrame:
    """Rows inside and outside the declared ranges per course."""
    offset = F.datediff("date", F.lit(DAY_ZERO).cast("date"))
    days = src.vle().withColumn("date", offset)
    flagged = cleaning.range_rules(days, {"sum_click": (1, None), "date": (-100, 300)})
    return flagged.groupBy("code_module", "in_range").agg(F.count("*").alias("n"), F.sum("sum_click").alias("clicks"))


@query
def validate_nulls(src: StarSource) -> DataFrame:
    """Row and NULL counts of the uncleaned profile and score tables."""
    specs = [COURSE_SPECS["student_info"], COURSE_SPECS["student_assessment"]]
    return cleaning.union_all([validate(src.raw(s.name), s.name, s.required, cap=None) for s in specs])


@query
def min_group_filter(src: StarSource) -> DataFrame:
    """Rows of nations with at least a 25th of all customers."""
    people = src.table("customer").select("c_custkey", "c_nationkey")
    total = people.agg(F.count("*").alias("n")).first()["n"]
    return cleaning.min_group(people, "c_nationkey", int(total / 25))


@query
def group_model_status(src: StarSource) -> DataFrame:
    """L8 bookkeeping, P16: groups trained, skipped as too small, or left without complete rows."""
    status = cleaning.group_status(src.features(), "client_id", 50, ["total_clicks", "days_active", "avg_score"])
    return status.groupBy("status").agg(
        F.count("*").alias("n_groups"), F.sum("n_rows").alias("n_rows"), F.sum("n_complete").alias("n_complete")
    )


# --- feature tables ------------------------------------------------------------------------------


@query
def feature_table(src: StarSource) -> DataFrame:
    """The flagship table, scores matched on the student alone."""
    return rounded(src.features(), "avg_score")


@query
def feature_table_preagg(src: StarSource) -> DataFrame:
    """The same sums as one SQL statement over registered views."""
    views = {"vle": "student_vle", "info": "student_info", "sa": "student_assessment"}
    tables.register(src.spark, {view: src.cleaned(name) for view, name in views.items()})
    return rounded(src.spark.sql(features.FEATURE_SQL), "avg_score")


@query
def feature_table_corrected(src: StarSource) -> DataFrame:
    """Scores matched to their course first, clicks counted once."""
    return rounded(src.features("corrected"), "avg_score")


@query
def derived_features(src: StarSource) -> DataFrame:
    """F1, F2."""
    cols = ["client_id", "id_student", "clicks_per_day", "engagement"]
    return rounded(src.learners().select(*cols), "clicks_per_day", "engagement")


@query
def ordinal_bands(src: StarSource) -> DataFrame:
    """F3, F4 on the uncleaned profile table, NULL and unknown codes included."""
    return src.info().select(
        "id_student",
        scalar.band_ordinal("imd_band").alias("imd_band_num"),
        scalar.education_ordinal("highest_education").alias("edu_level"),
    )


@query
def xapi_features(src: StarSource) -> DataFrame:
    """P6, P9, P19, F5-F7, F14, F15."""
    return features.engagement_features(src.xapi()).select(
        "client_id",
        "id_student",
        "label",
        *FEATURES["xapi"],
        "semester_num",
        "total_clicks",
        bigint("days_active").alias("days_active"),
        bigint("avg_score").alias("avg_score"),
    )


@query
def grade_features(src: StarSource) -> DataFrame:
    """P5, P8, P19, F7, F10-F13, A17."""
    out = features.grade_features(src.uci()).select(
        "client_id", "id_student", "label", *FEATURES["uci"], "total_clicks", "days_active", "avg_score"
    )
    return rounded(out, "avg_grade", "study_effort", "parent_edu", "absence_rate", "total_clicks", "avg_score")


@query
def union_subjects(src: StarSource) -> DataFrame:
    """Subject tables with different columns stacked into one."""
    math = src.uci().filter(F.col("subject") == "math").drop("famsup")
    other = src.uci().filter(F.col("subject") == "portuguese")
    return cleaning.union_all([math, other], allow_missing=True).select(
        "id_student", "school", "subject", "G1", "G2", "G3", "schoolsup", "famsup"
    )


# --- profiles ------------------------------------------------------------------------------------

ACTIVITY_METRICS = {
    "avg_clicks": ("total_clicks", 1),
    "avg_days": ("days_active", 1),
    "avg_score": ("avg_score", 2),
    "avg_prev_attempts": ("num_prev_attempts", 2),
    "avg_credits": ("studied_credits", 1),
}
GRADE_METRICS = {
    "final_grade": ("G3", 2),
    "avg_grade": ("avg_grade", 2),
    "grade_trend": ("grade_trend", 2),
    "studytime": ("studytime", 2),
    "absences": ("absences", 2),
}
ENGAGEMENT_METRICS = {
    "raisedhands": ("raisedhands", 1),
    "VisITedResources": ("VisITedResources", 1),
    "AnnouncementsView": ("AnnouncementsView", 1),
    "Discussion": ("Discussion", 1),
    "total_engagement": ("total_engagement", 1),
}


@query
def label_profile(src: StarSource) -> DataFrame:
    """A7, O1, F8."""
    return profiling.label_profile(src.features(), ACTIVITY_METRICS)


@query
def profile_diff_ratio(src: StarSource) -> DataFrame:
    """A8-A10, R1."""
    out = profiling.profile_by_label(src.features(), ACTIVITY_METRICS)
    return rounded(out, "pos", "neg", "diff", "ratio")


@query
def class_distribution(src: StarSource) -> DataFrame:
    """A11."""
    return rounded(profiling.class_distribution(src.xapi(), "Class"), "pct")


@query
def grade_profile(src: StarSource) -> DataFrame:
    """Per subject."""
    rows = features.grade_features(src.uci(), absence_rate=False)
    out = profiling.profile_by_label(rows, GRADE_METRICS, by=["subject"])
    return rounded(out, "pos", "neg", "diff", "ratio")


@query
def engagement_profile(src: StarSource) -> DataFrame:
    """A13, R3."""
    out = profiling.profile_by_label(features.engagement_features(src.xapi()), ENGAGEMENT_METRICS)
    return rounded(out, "pos", "neg", "diff", "ratio")


@query
def top_groups(src: StarSource) -> DataFrame:
    """The five nations with the highest positive rate, ties by name."""
    rates = profiling.rate_by_group(features.engagement_features(src.xapi()), "NationalITy")
    return rounded(profiling.top_k(rates, [F.desc("rate")], 5, ["NationalITy"]), "rate")


@query
def heterogeneity_cv(src: StarSource) -> DataFrame:
    """A15, A19, A20."""
    return rounded(profiling.heterogeneity(src.features(), "client_id"), "rate", "cv")


@query
def class_weights(src: StarSource) -> DataFrame:
    """A18, J3 per group."""
    return rounded(scaling.class_weights(src.features(), by=["client_id"]), "w_pos", "w_neg")


@query
def row_weights(src: StarSource) -> DataFrame:
    """A18, J3 over all rows: weight sums per label."""
    weighted = scaling.with_class_weight(materialise(src.features(), "features"))
    out = weighted.groupBy("label").agg(F.count("*").alias("n"), F.sum("class_weight").alias("weight"))
    return rounded(out, "weight")


# --- splits and scaling --------------------------------------------------------------------------


@query
def stratified_split(src: StarSource) -> DataFrame:
    """Exact split by label within every course."""
    out = splitting.stratified_split(materialise(src.features(), "features"), "id_student", by=["client_id"])
    return out.select("client_id", "id_student", "label", "is_test")


@query
def pooled_split(src: StarSource) -> DataFrame:
    """Exact split by label over all rows."""
    rows = materialise(src.features(), "features")
    return splitting.stratified_split(rows, ["client_id", "id_student"]).select("client_id", "id_student", "is_test")


@query
def hashed_split(src: StarSource) -> DataFrame:
    """Independent draw per row."""
    out = splitting.hashed_split(src.features(), ["client_id", "id_student"])
    return out.select("client_id", "id_student", "is_test")


@query
def split_fallbacks(src: StarSource) -> DataFrame:
    """D3: stratified, random and positional splits by class counts, on the small engagement groups."""
    rows = materialise(features.engagement_features(src.xapi()).select("client_id", "id_student", "label"), "rows")
    return splitting.stratified_split(rows, "id_student", by=["client_id"], fallback=True)


@query
def head_tail_split(src: StarSource) -> DataFrame:
    """The first 80 % of each subject by student id."""
    rows = src.uci().select("subject", "id_student")
    return splitting.head_tail_split(rows, "id_student", by=["subject"])


SCALED = ["total_clicks", "days_active", "studied_credits"]


@query
def group_standardize(src: StarSource) -> DataFrame:
    """Statistics of each course's training rows."""
    rows = materialise(src.features(), "features")
    split = splitting.stratified_split(rows, "id_student", by=["client_id"])
    out = scaling.standardise(split, SCALED, by=["client_id"])
    return rounded(out.select("client_id", "id_student", "is_test", *SCALED), *SCALED)


@query
def global_standardize(src: StarSource) -> DataFrame:
    """Statistics of all rows."""
    out = scaling.standardise(materialise(src.features(), "features"), SCALED, fit_on="all")
    return rounded(out.select("client_id", "id_student", *SCALED), *SCALED)


# --- metrics -------------------------------------------------------------------------------------


def _thresholded(src: StarSource) -> DataFrame:
    """Feature rows predicted positive below 20 active days."""
    rows = src.features().withColumn("pred", (F.col("days_active") < 20).cast("int"))
    return rows.withColumn("prob", -F.col("days_active").cast("double"))


@query
def auc_exact(src: StarSource) -> DataFrame:
    """M1 of one feature over all rows."""
    return rounded(metrics.auc(src.features(), score="days_active"), "auc")


@query
def auc_by_client(src: StarSource) -> DataFrame:
    """M1, M7: per course."""
    return rounded(metrics.auc(src.features(), score="total_clicks", by=["client_id"]), "auc")


@query
def auc_binned(src: StarSource) -> DataFrame:
    """M2 against M1 per course: area from a histogram of 50 bins, its bound, and whether the exact area is inside."""
    rows = materialise(src.features().select("client_id", "label", "days_active"), "scores")
    rows = rows.withColumn("prob", F.col("days_active") / (F.col("days_active") + F.lit(30.0)))
    binned = score_histogram.binned_auc(rows, by=["client_id"], bins=50)
    exact = metrics.auc(rows, score="prob", by=["client_id"]).select("client_id", F.col("auc").alias("exact"))
    inside = (F.abs(F.col("exact") - F.col("auc")) <= F.col("error_bound") + 1e-12).cast("int").alias("inside")
    out = binned.join(exact, "client_id").select("client_id", "n_pos", "n_neg", "auc", "error_bound", inside)
    return rounded(out, "auc", "error_bound")


@query
def confusion_metrics(src: StarSource) -> DataFrame:
    """A21, A22, M3, M5 per course."""
    cells = metrics.confusion(_thresholded(src), by=["client_id"])
    out = metrics.classification_metrics(cells)
    return rounded(out, "accuracy", "precision", "recall", "f1", "sensitivity", "specificity")


@query
def weighted_metrics(src: StarSource) -> DataFrame:
    """M4: weighted recall equals accuracy."""
    out = metrics.classification_metrics(metrics.confusion(_thresholded(src)), average="weighted")
    return rounded(out, "accuracy", "precision", "recall", "f1", "sensitivity", "specificity")


@query
def client_evaluation(src: StarSource) -> DataFrame:
    """M6, M7: loss and metrics per nation of the engagement table, degenerate groups zeroed."""
    rows = features.engagement_features(src.xapi()).withColumn("prob", F.col("total_engagement").cast("double"))
    rows = rows.withColumn("pred", (F.col("total_engagement") > 60).cast("int"))
    out = metrics.evaluate_by_client(rows, ["client_id"])
    return rounded(out, "loss", *metrics.METRICS)


@query
def weighted_round_mean(src: StarSource) -> DataFrame:
    """M9: client metrics averaged by their rows, per course module."""
    per_client = metrics.evaluate_by_client(_thresholded(src), ["client_id"])
    module = F.substring_index("client_id", "_", 1)
    out = metrics.weighted_round_mean(per_client.withColumn("module", module), ["module"])
    return rounded(out, *metrics.METRICS)


# --- per-group models and their combination ------------------------------------------------------


def _client_rows(src: StarSource, cols: list[str]) -> DataFrame:
    return prepare.client_rows(materialise(src.learners(), "learners"), cols)


def _engagement_rows(src: StarSource, cols: list[str] = ENGAGEMENT_PAIR) -> DataFrame:
    return prepare.client_rows(features.engagement_features(src.xapi()), cols, min_rows=ENGAGEMENT_MIN_ROWS)


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("is_test") == 0)


def _line_models(src: StarSource) -> DataFrame:
    """Closed-form models per course: straight lines of the label on two features."""
    y = F.col("label").cast("double")
    lines = src.features().groupBy("client_id").agg(
        F.regr_slope(y, F.col("days_active")).alias("s1"),
        F.regr_slope(y, F.col("total_clicks") / 1000.0).alias("s2"),
        F.regr_intercept(y, F.col("days_active")).alias("intercept"),
        F.count("*").alias("n_train"),
    )
    return lines.select("client_id", F.array("s1", "s2").alias("coef"), "intercept", "n_train", F.lit(True).alias("trainable"))


@query
def fed_avg(src: StarSource) -> DataFrame:
    """G4."""
    return rounded(combining.combine_mean(_line_models(src), by=[]), "value")


@query
def fed_median(src: StarSource) -> DataFrame:
    """G7."""
    return rounded(combining.combine_median(_line_models(src), by=[]), "value")


@query
def initial_model(src: StarSource) -> DataFrame:
    """G8."""
    start = combining.initial_model(_line_models(src), by=[])
    return rounded(start.select("pos", "value"), "value")


@query
def fed_adam_step(src: StarSource) -> DataFrame:
    """The first two server steps."""
    models = materialise(_line_models(src), "models")
    targets, start = combining.mean_targets(models, by=[]), combining.initial_model(models, by=[])
    return rounded(combining.combine_adam(targets, start.select("pos", "value"), 2), "value", digits=8)


@query
def pad_truncate(src: StarSource) -> DataFrame:
    """Two coefficients installed where three, and where one, are expected."""
    models = _line_models(src)
    wide = combining.resize_coef(models, 3).withColumn("p", F.lit(3))
    narrow = combining.resize_coef(models, 1).withColumn("p", F.lit(1))
    out = cleaning.union_all([wide, narrow]).select("client_id", "p", F.posexplode("coef").alias("pos", "value"))
    return rounded(out, "value")


@query
def gradient_at_zero(src: StarSource) -> DataFrame:
    """Loss and gradient of the first Newton step per course."""
    out = grouped_lr.gradient_at_zero(_train(_client_rows(src, PAIR)), "client_id", PAIR)
    return rounded(out, "loss", "g_0", "g_1", "g_2")


@query
def local_logit(src: StarSource) -> DataFrame:
    """One regression per course and strength, two features."""
    models = grouped_lr.fit_grouped_lr(_train(_client_rows(src, PAIR)), "client_id", PAIR, mus=(0.0, 0.1))
    out = models.select(
        "client_id", "mu", F.col("coef")[0].alias("w0"), F.col("coef")[1].alias("w1"), "intercept", "n_train"
    )
    return rounded(out, "w0", "w1", "intercept")


@query
def local_scores(src: StarSource) -> DataFrame:
    """Test rows scored by their own course's model."""
    rows = _client_rows(src, PAIR)
    models = grouped_lr.fit_grouped_lr(_train(rows), "client_id", PAIR)
    out = grouped_lr.score(rows.filter(F.col("is_test") == 1), models.drop("mu"), PAIR)
    return rounded(out.select("client_id", "id_student", "prob", "pred"), "prob")


@query
def local_logit_full(src: StarSource) -> DataFrame:
    """L9 with all nine features."""
    cols = FEATURES["oulad"]
    models = grouped_lr.fit_grouped_lr(_train(_client_rows(src, cols)), "client_id", cols)
    return models.select("client_id", "coef", "intercept", "n_train", "trainable", "converged")


@query
def local_logit_residual(src: StarSource) -> DataFrame:
    """L9 with all nine features: whether the objective's gradient vanishes at every fitted model."""
    cols = FEATURES["oulad"]
    train = _train(_client_rows(src, cols))
    models = materialise(grouped_lr.fit_grouped_lr(train, "client_id", cols, mus=(0.0, 0.1)), "models")
    found = grouped_lr.residuals(train, models, "client_id", cols)
    solved = F.coalesce(F.col("residual") < 1e-6, F.lit(False)).cast("int").alias("solved")
    return models.join(found, ["client_id", "mu"], "left").select("client_id", "mu", "n_train", "trainable", solved)


def _course_rows(src: StarSource, cols: list[str]) -> DataFrame:
    """Complete rows of the courses with more than 50 rows, scaled per course. The feature table is worked out once."""
    learners = materialise(src.features().select("client_id", "label", *cols), "features")
    rows = cleaning.complete_features(cleaning.min_group(learners, "client_id", 50, strict=True), cols)
    rows = materialise(rows, "complete_rows")
    return materialise(scaling.standardise(rows, cols, by=["client_id"], fit_on="all"), "rows")


@query
def course_steps(src: StarSource) -> DataFrame:
    """At most ten quasi-Newton steps per course with more than 50 rows, from a padded two-feature model.

    Reports the rows, the budget kept, and whether the loss fell below that of the zero model.
    """
    cols = ["total_clicks", "days_active", "avg_score"]
    rows = _course_rows(src, cols)
    short = grouped_lbfgs.fit_grouped_lbfgs(rows, "client_id", cols[:2], budget=2, l2=0.0, balanced=False)
    models = grouped_lbfgs.fit_grouped_lbfgs(rows, "client_id", cols, budget=10, l2=0.0, balanced=False, start=short)
    return models.select(
        "client_id",
        "n_train",
        "trainable",
        (F.col("n_steps") <= 10).cast("int").alias("in_budget"),
        (F.col("loss") < F.col("n_train") * F.log(F.lit(2.0))).cast("int").alias("improved"),
    )


@query
def course_logit(src: StarSource) -> DataFrame:
    """Ten unpenalised steps per course with more than 50 rows, three features."""
    cols = ["total_clicks", "days_active", "avg_score"]
    rows = _course_rows(src, cols)
    models = grouped_lr.fit_grouped_lr(rows, "client_id", cols, l2=0.0, balanced=False, max_iter=10)
    return models.select("client_id", "coef", "intercept", "n_train", "trainable")


@query
def fed_rounds(src: StarSource) -> DataFrame:
    """Four strategies over ten rounds, two features."""
    return rounded(rounds.run_rounds(_client_rows(src, PAIR), PAIR), *metrics.METRICS)


@query
def fed_rounds_full(src: StarSource) -> DataFrame:
    """G4-G11 with all nine features."""
    cols = FEATURES["oulad"]
    return rounded(rounds.run_rounds(_client_rows(src, cols), cols), *metrics.METRICS)


@query
def fed_rounds_engagement(src: StarSource) -> DataFrame:
    """G4-G11 on the engagement table, whose small groups include idle and degenerate ones."""
    cols = FEATURES["xapi"]
    return rounded(rounds.run_rounds(_engagement_rows(src, cols), cols), *metrics.METRICS)


@query
def fed_rounds_small(src: StarSource) -> DataFrame:
    """Two features on the small engagement groups, idle and degenerate ones among them."""
    return rounded(rounds.run_rounds(_engagement_rows(src), ENGAGEMENT_PAIR), *metrics.METRICS)


@query
def proximal_path(src: StarSource) -> DataFrame:
    """The combined model of three rounds whose local fits are pulled towards it, two features."""
    return rounded(proximal.proximal_path(_train(_client_rows(src, PAIR)), PAIR, rounds=3), "value")


@query
def proximal_rounds(src: StarSource) -> DataFrame:
    """The same rounds on the test rows of every course."""
    return rounded(proximal.proximal_rounds(_client_rows(src, PAIR), PAIR, rounds=3), *metrics.METRICS)


@query
def client_status(src: StarSource) -> DataFrame:
    """Eligible groups at three thresholds."""
    rows = materialise(src.features(), "features")
    return cleaning.union_all(
        [rounds.client_status(rows, min_rows=n).withColumn("min_rows", F.lit(n)) for n in (20, 50, 100_000)]
    )


@query
def mu_sweep(src: StarSource) -> DataFrame:
    """Final scores by proximal strength, two features."""
    return rounded(rounds.mu_sweep(_client_rows(src, PAIR), PAIR), *metrics.METRICS)


# --- pooled models -------------------------------------------------------------------------------


def _pooled_rows(learners: DataFrame, cols: list[str]) -> DataFrame:
    """Complete rows scaled over all rows, then split by label."""
    rows = cleaning.complete_features(learners, cols).select("client_id", "id_student", "label", *cols)
    rows = materialise(scaling.standardise(materialise(rows, "complete"), cols, fit_on="all"), "scaled")
    return materialise(splitting.stratified_split(rows, ["client_id", "id_student"]), "pooled_rows")


def _pooled(learners: DataFrame, cols: list[str], models: list[str]) -> DataFrame:
    return pooled.compare_models(_pooled_rows(learners, cols), cols, {m: pooled.SCALED_MODELS[m] for m in models})


@query
def pooled_lr(src: StarSource) -> DataFrame:
    """L4, M1, M3, M5: pooled regression on two features."""
    out = _pooled(src.learners(), PAIR, ["LR"]).select("model", *metrics.METRICS, "tn", "fp", "fn", "tp", "n_train", "n_test")
    return rounded(out, *metrics.METRICS)


@query
def pooled_models(src: StarSource) -> DataFrame:
    """L1-L3, O3, M4: the activity candidates, weighted metrics, weights over all rows, hashed split."""
    cols = FEATURES["oulad"]
    split = splitting.hashed_split(src.learners(), ["client_id", "id_student"])
    out = pooled.compare_models(materialise(split, "split"), cols, pooled.ACTIVITY_MODELS, average="weighted", weights_on="all")
    return rounded(out, *metrics.METRICS)


@query
def pooled_audit(src: StarSource) -> DataFrame:
    """Sizes, confusion sums and the one best of the three candidates on all nine features."""
    found = pooled.compare_models(_pooled_rows(src.learners(), FEATURES["oulad"]), FEATURES["oulad"], pooled.SCALED_MODELS)
    all_models = Window.partitionBy(F.lit(0))  # three rows
    found = found.withColumns({"top": F.max("auc").over(all_models), "n_best": F.count_if("is_best").over(all_models)})
    held = F.abs(F.col("accuracy") * F.col("n_test") - (F.col("tp") + F.col("tn"))) < 1e-6
    return found.select(
        "model",
        "n_train",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_cells"),
        (F.col("tp") + F.col("fn")).alias("n_positive"),
        held.cast("int").alias("consistent"),
        (~F.col("is_best") | (F.col("auc") == F.col("top"))).cast("int").alias("best_is_top"),
        "n_best",
    )


@query
def pooled_models_scaled(src: StarSource) -> DataFrame:
    """L4-L7 on scaled, stratified rows."""
    cols = FEATURES["oulad"]
    return rounded(pooled.compare_models(_pooled_rows(src.learners(), cols), cols, pooled.SCALED_MODELS), *metrics.METRICS)


@query
def pooled_models_grades(src: StarSource) -> DataFrame:
    """L4-L7 per subject with the head/tail split."""
    cols = FEATURES["uci"]
    rows = cleaning.complete_features(features.grade_features(src.uci()), cols, how="zero")
    split = splitting.head_tail_split(materialise(rows, "grades"), "id_student", by=["subject"])
    scaled = materialise(scaling.standardise(split, cols, by=["subject"]), "scaled")
    parts = {s: scaled.filter(F.col("subject") == s) for s in ("math", "portuguese")}
    return rounded(pooled.compare_by(parts, cols, pooled.SCALED_MODELS), *metrics.METRICS)


@query
def pooled_models_engagement(src: StarSource) -> DataFrame:
    """L4-L7 on the engagement table with the head/tail split."""
    cols = FEATURES["xapi"]
    rows = cleaning.complete_features(features.engagement_features(src.xapi()), cols, how="zero")
    split = splitting.head_tail_split(materialise(rows, "engagement"), "id_student")
    scaled = materialise(scaling.standardise(split, cols), "scaled")
    return rounded(pooled.compare_models(scaled, cols, pooled.SCALED_MODELS), *metrics.METRICS)


# --- result tables -------------------------------------------------------------------------------


_STORED: dict[tuple, dict[str, str]] = {}


def _stored_results(src: StarSource, full: bool) -> dict[str, str]:
    """Train on both datasets, write the results as JSON; the report queries read them.

    `full`: on the whole feature lists with all three pooled models; else on two features each and the
    pooled regression, which SQL can check. Results are reused while the tables they come from are
    unchanged and the files still exist.
    """
    key = (src.spark.sparkContext.applicationId, src.root, full, path_state(src.spark, f"{src.root}/*.parquet"))
    known = _STORED.get(key)
    if known and all(path_state(src.spark, f"{path}/_SUCCESS") for path in known.values()):
        return known
    paths = {name: scratch_path(src.spark, name) for name in ("history", "pooled")}
    lists = {"courses": FEATURES["oulad"], "engagement": FEATURES["xapi"]} if full else {"courses": PAIR, "engagement": ENGAGEMENT_PAIR}
    views = {"courses": src.learners, "engagement": lambda: features.engagement_features(src.xapi())}
    least = {"courses": {}, "engagement": {"min_rows": ENGAGEMENT_MIN_ROWS}}
    names = list(pooled.SCALED_MODELS) if full else ["LR"]

    def train(dataset: str) -> list[DataFrame]:
        cols, name = lists[dataset], F.lit(dataset).alias("dataset")
        # both kinds of models read one written table
        learners = materialise(views[dataset](), "learners")

        def combined() -> DataFrame:
            rows = prepare.client_rows(learners, cols, **least[dataset])
            return rounds.run_rounds(rows, cols, sweep=rounds.SWEEP).select(name, "*")

        return at_once(src.spark, [combined, lambda: _pooled(learners, cols, names).select(name, "*")])

    history, models = zip(*at_once(src.spark, [partial(train, dataset) for dataset in lists]), strict=True)
    stored = {"history": cleaning.union_all(history), "pooled": cleaning.union_all(models)}
    at_once(src.spark, [partial(tables.write_results, df, paths[name]) for name, df in stored.items()])
    _STORED[key] = paths
    return paths


class Report:
    """The stored histories and pooled results, of the two-feature runs or the full ones."""

    def __init__(self, src: StarSource, full: bool = False):
        paths = _stored_results(src, full)
        values = ", ".join(f"{m} double" for m in metrics.METRICS)
        self.history = tables.read_results(
            src.spark,
            paths["history"],
            f"dataset string, strategy string, mu double, round int, n_clients bigint, {values}",
        )
        self.pooled = tables.read_results(
            src.spark,
            paths["pooled"],
            f"dataset string, model string, {values}, n_train bigint, n_test bigint, is_best boolean",
        )
        self.run = results.strategy_finals(self.history)
        finals = results.final_rounds(self.history)
        self.finals = results.strategy_finals(finals)
        self.sweep = finals.filter(F.col("strategy").isin("FedAvg", "FedProx")).select("dataset", "mu", "auc")


@query
def round_deltas(src: StarSource) -> DataFrame:
    """R6."""
    return rounded(results.round_deltas(Report(src).run), "auc", "delta")


@query
def round_completeness(src: StarSource) -> DataFrame:
    """G13."""
    return rounds.round_completeness(Report(src).run)


@query
def verdict(src: StarSource) -> DataFrame:
    """Per dataset against the best pooled model."""
    report = Report(src)
    out = results.dataset_summary(report.pooled, report.finals)
    return rounded(out, "pooled_auc", "combined_auc", "diff")


@query
def verdict_by_course(src: StarSource) -> DataFrame:
    """R7 on many differences: course pass rates against the overall one."""
    rates = materialise(profiling.rate_by_group(src.features(), "client_id"), "rates")
    overall = rates.agg((F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("overall"))
    rates = attach(rates, overall)
    out = rates.withColumn("diff", F.round(F.col("rate") - F.col("overall"), 9))
    return rounded(out.select("client_id", "diff", results.verdict("diff").alias("verdict")), "diff")


@query
def pooled_vs_combined(src: StarSource) -> DataFrame:
    """Metric by metric."""
    report = Report(src)
    return rounded(results.compare_pooled(report.pooled, report.finals), "pooled", "combined", "diff")


@query
def best_strategy(src: StarSource) -> DataFrame:
    """O4."""
    return rounded(results.best_strategy(Report(src).finals), "auc")


@query
def best_mu(src: StarSource) -> DataFrame:
    """O5."""
    return rounded(results.best_mu(Report(src).sweep), "auc")


@query
def result_long(src: StarSource) -> DataFrame:
    """R4."""
    report = Report(src)
    return results.result_table(report.pooled, report.finals, report.sweep)


@query
def strategy_table(src: StarSource) -> DataFrame:
    """R8."""
    report = Report(src)
    return rounded(results.strategy_table(report.finals, report.pooled), "auc", "f1", "precision", "recall", "diff_vs_lr")


@query
def mu_table(src: StarSource) -> DataFrame:
    """R9."""
    return rounded(results.mu_table(Report(src).sweep), "auc")


@query
def pooled_table(src: StarSource) -> DataFrame:
    """R10."""
    return rounded(results.pooled_table(Report(src).pooled), "LR", "RF", "GBT")


@query
def series_rounds(src: StarSource) -> DataFrame:
    """AUC by round."""
    report = Report(src)
    return rounded(results.series_rounds(report.run, report.pooled), "auc", "lr_auc")


@query
def series_bars(src: StarSource) -> DataFrame:
    """Pooled models and strategies."""
    report = Report(src)
    return rounded(results.series_bars(report.pooled, report.finals), "auc")


@query
def series_mu(src: StarSource) -> DataFrame:
    """AUC by strength."""
    return rounded(results.series_mu(Report(src).sweep), "auc")


@query
def series_strategies(src: StarSource) -> DataFrame:
    """Strategy by dataset."""
    return rounded(results.series_strategies(Report(src).finals), "auc")


@query
def result_long_full(src: StarSource) -> DataFrame:
    """R4 on the whole feature lists: every pooled model, strategy and strength of both datasets."""
    report = Report(src, full=True)
    return results.result_table(report.pooled, report.finals, report.sweep)


@query
def pooled_table_full(src: StarSource) -> DataFrame:
    """R10 with the regression and both ensembles."""
    return rounded(results.pooled_table(Report(src, full=True).pooled), "LR", "RF", "GBT")


@query
def mu_table_full(src: StarSource) -> DataFrame:
    """G12, R9 on the whole feature lists."""
    return rounded(results.mu_table(Report(src, full=True).sweep), "auc")


@query
def series_bars_full(src: StarSource) -> DataFrame:
    """Three pooled models and the strategies."""
    report = Report(src, full=True)
    return rounded(results.series_bars(report.pooled, report.finals), "auc")


@query
def report_audit(src: StarSource) -> DataFrame:
    """What the full reports rest on: rounds or models, values within 0 and 1, groups or rows, and the best."""
    report = Report(src, full=True)
    within = F.forall(F.array(*metrics.METRICS), lambda m: (m >= 0) & (m <= 1))
    runs = report.history.groupBy("dataset", F.col("strategy").alias("name"), "mu").agg(
        F.count_if(within).alias("n_within"), F.min("n_clients").alias("size"), F.lit(0).cast("bigint").alias("n_best")
    )
    each = report.pooled.groupBy("dataset", F.col("model").alias("name"), F.lit(None).cast("double").alias("mu")).agg(
        F.count_if(within).alias("n_within"), F.max(F.col("n_train") + F.col("n_test")).alias("size")
    )
    best = report.pooled.groupBy("dataset").agg(F.count_if("is_best").alias("n_best"))
    return runs.unionByName(each.join(best, "dataset"))


@query
def best_course(src: StarSource) -> DataFrame:
    """O3: per module the course with the highest pass rate, ties by the smaller presentation number."""
    rates = profiling.rate_by_group(src.features(), "client_id").select(
        F.substring_index("client_id", "_", 1).alias("module"),
        F.substring_index("client_id", "_R", -1).cast("int").alias("presentation"),
        "n",
        "rate",
    )
    return rounded(profiling.best_by(rates, ["module"], "rate", "presentation"), "rate")


@query
def median_score(src: StarSource) -> DataFrame:
    """G7's exact median on large groups: median click count per course module."""
    return rounded(exact_median(src.vle(), ["code_module"], "sum_click"), "median")
