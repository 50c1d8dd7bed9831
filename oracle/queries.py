"""The DuckDB statement of every registered query that SQL can express."""

from __future__ import annotations

from oracle.fragments import (
    ACC,
    F0,
    F1,
    MEAN_METRICS,
    P0,
    P1,
    ROUNDED_METRICS,
    SENS,
    SPEC,
    cells,
    client_eval,
    hash_of,
    r,
    ranked,
    split_views,
    weighted,
)
from oracle.models import MODEL_SQL
from oracle.views import BAND_CASE, EDUCATION_CASE, with_views

SQL: dict[str, str] = {}


def add(name: str, body: str, local: dict[str, str] | None = None) -> None:
    SQL[name] = with_views(body, local)


def null_counts(view: str, dataset: str, cols: list[str]) -> str:
    parts = [f"SELECT '{dataset}' AS dataset, 'rows' AS \"check\", COUNT(*) AS value FROM {view}"]
    parts += [f"SELECT '{dataset}', 'null {c}', COUNT(*) FILTER (WHERE {c} IS NULL) FROM {view}" for c in cols]
    return "\nUNION ALL ".join(parts)


INFO_COLS = [
    "code_module",
    "code_presentation",
    "id_student",
    "final_result",
    "num_of_prev_attempts",
    "studied_credits",
    "imd_band",
    "highest_education",
]

add(
    "ingest_audit",
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS dataset, COUNT(*) AS n_rows, COUNT(*) AS n_stamped FROM {view}"
        for name, view in (
            ("student_vle", "vle"),
            ("student_info", "info"),
            ("student_assessment", "sa"),
            ("assessments", "assessments"),
        )
    ),
)
add(
    "zone_pipeline",
    "\nUNION ALL ".join(
        [
            null_counts("vle_c6", "student_vle", ["code_module", "code_presentation", "id_student", "id_site", "date", "sum_click"]),
            null_counts("info_c", "student_info", INFO_COLS),
            null_counts("sa_c", "student_assessment", ["id_assessment", "id_student", "score"]),
            null_counts("assessments", "assessments", ["id_assessment", "code_module", "code_presentation"]),
        ]
    ),
    {"vle_c6": "SELECT DISTINCT ON (code_module, code_presentation, id_student, id_site, date) * FROM vle"},
)
add(
    "delimited_scan",
    """SELECT subject, COUNT(*) AS n, CAST(SUM(G3) AS BIGINT) AS sum_g3, CAST(MAX(absences) AS BIGINT) AS max_absences
    FROM uci GROUP BY subject""",
)
add(
    "results_round_trip",
    f"""SELECT client_id, COUNT(*) AS n, {r('AVG(label)', 'rate')}, {r('AVG(label)', 'rate_csv')},
      (SELECT COUNT(DISTINCT client_id) FROM feat) AS n_lines
    FROM feat GROUP BY client_id""",
)
SQL["source_status"] = "\nUNION ALL ".join(
    [f"SELECT '{t}' AS dataset, 'ok' AS status, COUNT(*) AS n_rows FROM {t}" for t in ("customer", "orders", "lineitem", "events")]
    + ["SELECT 'not_there', 'unreadable', NULL"]
)
SCANNED = {
    "math": ("uci WHERE subject = 'math'", "school G1 G2 G3 studytime failures Medu Fedu health absences schoolsup famsup"),
    "portuguese": ("uci WHERE subject = 'portuguese'", "school G1 G2 G3 studytime failures Medu Fedu health absences schoolsup famsup"),
    "engagement": ("xapi", "NationalITy raisedhands VisITedResources AnnouncementsView Discussion Class"),
}
# column: the ids with a bad token, the token, and whether it is a reject or just empty
BAD = {"G1": (7, "?", 1), "absences": (11, "n/a", 1), "health": (10, " ", 0), "raisedhands": (5, "?", 1), "Discussion": (7, "", 0)}


def scan_counts(dataset: str) -> str:
    source, cols = SCANNED[dataset]
    parts = [f"SELECT '{dataset}' AS dataset, 'rows' AS \"check\", COUNT(*) AS value FROM {source}"]
    for c in cols.split():
        n, _, reject = BAD.get(c, (0, "", 0))
        missing = f"COUNT(*) FILTER (WHERE id_student % {n} = 0)" if n else "COUNT(*) * 0"
        parts.append(f"SELECT '{dataset}', 'null {c}', {missing} FROM {source}")
        parts.append(f"SELECT '{dataset}', 'reject {c}', {missing if reject else 'COUNT(*) * 0'} FROM {source}")
    return "\nUNION ALL ".join(parts)


add("tolerant_scan", "\nUNION ALL ".join(scan_counts(d) for d in SCANNED))
add(
    "rejected_tokens",
    "\nUNION ALL ".join(
        f"""SELECT '{d}' AS dataset, '{c}' AS "column", '{BAD[c][1]}' AS token, COUNT(*) AS n_rows
        FROM (SELECT * FROM {source}) WHERE id_student % {BAD[c][0]} = 0 HAVING COUNT(*) > 0"""
        for d, (source, cols) in SCANNED.items()
        for c in cols.split()
        if BAD.get(c, (0, "", 0))[2]
    ),
)
SQL["row_positions"] = """
SELECT c_custkey, c_acctbal, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS row_id FROM customer"""
add(
    "range_rules_scores",
    """SELECT CAST(ok AS INT) AS in_range, COUNT(*) AS n, CAST(SUM(score) AS BIGINT) AS total FROM (
      SELECT score, COALESCE(score BETWEEN 0 AND 100, FALSE) AS ok FROM sa) GROUP BY ok""",
)
_SHARE = "days_active / (days_active + 30::DOUBLE)"
add(
    "auc_binned",
    f"""SELECT client_id, CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg,
      {r('SUM(pos * (below + neg / 2::DOUBLE)) / NULLIF(SUM(pos) * SUM(neg), 0)', 'auc')},
      {r('SUM(pos * neg) / NULLIF(2::DOUBLE * SUM(pos) * SUM(neg), 0)', 'error_bound')},
      CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN 1 END AS inside
    FROM (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY client_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
          FROM (SELECT client_id, LEAST(FLOOR({_SHARE} * 50), 49) AS bin, COUNT(*) FILTER (WHERE label = 1) AS pos,
                  COUNT(*) FILTER (WHERE label = 0) AS neg FROM feat GROUP BY ALL))
    GROUP BY client_id""",
)
add("clean_activity", "SELECT client_id, id_student, id_site, date, sum_click FROM vle_c")
add("clean_info_label", f"SELECT {', '.join(INFO_COLS)}, client_id, label FROM info_c")
add("clean_scores", "SELECT id_assessment, id_student, score FROM sa_c")
SQL["dedup_keys"] = """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1"""
add(
    "range_rules",
    """SELECT code_module, CAST(ok AS INT) AS in_range, COUNT(*) AS n, CAST(SUM(sum_click) AS BIGINT) AS clicks FROM (
      SELECT code_module, sum_click, sum_click >= 1 AND date - DATE '1999-01-01' BETWEEN -100 AND 300 AS ok FROM vle)
    GROUP BY code_module, ok""",
)
add(
    "validate_nulls",
    null_counts("info", "student_info", INFO_COLS)
    + "\nUNION ALL "
    + null_counts("sa", "student_assessment", ["id_assessment", "id_student", "score"]),
)
SQL["min_group_filter"] = """
SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS n,
  COUNT(*) OVER () AS total FROM customer) WHERE n >= total // 25"""
add(
    "group_model_status",
    """SELECT status, COUNT(*) AS n_groups, CAST(SUM(n_rows) AS BIGINT) AS n_rows, CAST(SUM(n_complete) AS BIGINT) AS n_complete
    FROM (SELECT client_id, COUNT(*) AS n_rows, COUNT(avg_score) AS n_complete,
      CASE WHEN COUNT(*) <= 50 THEN 'skipped' WHEN COUNT(avg_score) = 0 THEN 'failed' ELSE 'trained' END AS status
      FROM feat GROUP BY client_id) GROUP BY status""",
)

FEAT_COLS = "client_id, id_student, total_clicks, days_active, label"
FEAT_TAIL = "num_prev_attempts, studied_credits, imd_band_num, edu_level"
add("feature_table", f"SELECT {FEAT_COLS}, {r('avg_score', 'avg_score')}, {FEAT_TAIL} FROM feat")
add("feature_table_preagg", f"SELECT {FEAT_COLS}, {r('avg_score', 'avg_score')} FROM feat")
add(
    "feature_table_corrected",
    f"""SELECT c.client_id, c.id_student, c.total_clicks, c.days_active, i.label, {r('g.avg_score', 'avg_score')},
      i.num_of_prev_attempts AS num_prev_attempts, i.studied_credits, {BAND_CASE} AS imd_band_num, {EDUCATION_CASE} AS edu_level
    FROM (SELECT client_id, id_student, CAST(SUM(sum_click) AS BIGINT) AS total_clicks, COUNT(DISTINCT date) AS days_active
          FROM vle_c GROUP BY client_id, id_student) c
    JOIN info_c i ON i.client_id = c.client_id AND i.id_student = c.id_student
    LEFT JOIN (SELECT a.client_id, s.id_student, AVG(s.score) AS avg_score FROM sa_c s
               JOIN assessments_c a ON a.id_assessment = s.id_assessment GROUP BY a.client_id, s.id_student) g
      ON g.client_id = c.client_id AND g.id_student = c.id_student""",
    {"assessments_c": "SELECT DISTINCT id_assessment, client_id FROM assessments"},
)
add(
    "derived_features",
    f"""SELECT client_id, id_student,
      {r('CASE WHEN days_active > 0 THEN total_clicks / CAST(days_active AS DOUBLE) ELSE 0 END', 'clicks_per_day')},
      {r('LN(1 + total_clicks)', 'engagement')} FROM feat""",
)
add("ordinal_bands", f"SELECT id_student, {BAND_CASE} AS imd_band_num, {EDUCATION_CASE} AS edu_level FROM info")
add(
    "xapi_features",
    """SELECT client_id, id_student, label, raisedhands, VisITedResources, AnnouncementsView, Discussion, total_engagement,
      absence_flag, parent_involved, satisfaction, semester_num, total_engagement AS total_clicks,
      GREATEST(0, LEAST(100, Discussion)) AS days_active, GREATEST(0, LEAST(100, raisedhands)) AS avg_score FROM xfeat""",
)
add(
    "grade_features",
    f"""SELECT client_id, id_student, label, {r('avg_grade', 'avg_grade')}, grade_trend, {r('study_effort', 'study_effort')},
      {r('parent_edu', 'parent_edu')}, {r('absence_rate', 'absence_rate')}, failures, health, support,
      {r('avg_grade * 100', 'total_clicks')}, GREATEST(0, LEAST(30, 30 - absences)) AS days_active,
      {r('avg_grade * 5', 'avg_score')} FROM gfeat""",
)
add(
    "union_subjects",
    """SELECT id_student, school, subject, G1, G2, G3, schoolsup,
      CASE WHEN subject = 'math' THEN NULL ELSE famsup END AS famsup FROM uci""",
)
add(
    "label_profile",
    """SELECT label, COUNT(*) AS count, ROUND(AVG(total_clicks), 1) AS avg_clicks, ROUND(AVG(days_active), 1) AS avg_days,
      ROUND(AVG(avg_score), 2) AS avg_score, ROUND(AVG(num_prev_attempts), 2) AS avg_prev_attempts,
      ROUND(AVG(studied_credits), 1) AS avg_credits FROM feat GROUP BY label ORDER BY label DESC""",
)


def profile(view: str, items: dict[str, tuple[str, int]], by: str = "") -> str:
    """Outcome profile, one SELECT per metric."""
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    one, zero = "FILTER (WHERE label = 1)", "FILTER (WHERE label = 0)"
    pairs = {
        "count": (f"COUNT(*) {one}", f"COUNT(*) {zero}"),
        "percent": (f"COUNT(*) {one} * (CAST(100 AS DOUBLE) / COUNT(*))", f"COUNT(*) {zero} * (CAST(100 AS DOUBLE) / COUNT(*))"),
    }
    for name, (col, digits) in items.items():
        pairs[name] = (f"ROUND(AVG({col}) {one}, {digits})", f"ROUND(AVG({col}) {zero}, {digits})")
    parts = [
        f"SELECT {head}'{name}' AS metric, CAST({p} AS DOUBLE) AS pos, CAST({n} AS DOUBLE) AS neg FROM {view}{group}"
        for name, (p, n) in pairs.items()
    ]
    union = "\nUNION ALL ".join(parts)
    ratio = r("CASE WHEN neg > 0 THEN pos / neg ELSE 0 END", "ratio")
    return f"SELECT {head}metric, {r('pos', 'pos')}, {r('neg', 'neg')}, {r('pos - neg', 'diff')}, {ratio} FROM (\n{union})"


add(
    "profile_diff_ratio",
    profile(
        "feat",
        {
            "avg_clicks": ("total_clicks", 1),
            "avg_days": ("days_active", 1),
            "avg_score": ("avg_score", 2),
            "avg_prev_attempts": ("num_prev_attempts", 2),
            "avg_credits": ("studied_credits", 1),
        },
    ),
)
add(
    "grade_profile",
    profile(
        "gfeat",
        {
            "final_grade": ("G3", 2),
            "avg_grade": ("avg_grade", 2),
            "grade_trend": ("grade_trend", 2),
            "studytime": ("studytime", 2),
            "absences": ("absences", 2),
        },
        "subject",
    ),
)
add(
    "engagement_profile",
    profile(
        "xfeat",
        {c: (c, 1) for c in ("raisedhands", "VisITedResources", "AnnouncementsView", "Discussion", "total_engagement")},
    ),
)
add(
    "class_distribution",
    f"""SELECT Class AS class, COUNT(*) AS n, {r('COUNT(*) * CAST(100 AS DOUBLE) / (SELECT COUNT(*) FROM xapi)', 'pct')}
    FROM xapi GROUP BY Class""",
)
add(
    "top_groups",
    f"""SELECT NationalITy, COUNT(*) AS n, {r('AVG(label)', 'rate')} FROM xfeat
    GROUP BY NationalITy ORDER BY AVG(label) DESC, NationalITy LIMIT 5""",
)
add(
    "heterogeneity_cv",
    f"""SELECT COUNT(*) AS n_groups, {r('SUM(pos) / SUM(n)', 'rate')}, {r('STDDEV_SAMP(rate) / AVG(rate)', 'cv')}
    FROM (SELECT COUNT(*) AS n, SUM(label) AS pos, AVG(label) AS rate FROM feat GROUP BY client_id)""",
)
WEIGHTS = "COUNT(*) AS n, COUNT(*) FILTER (WHERE label = 1) AS n_pos, COUNT(*) FILTER (WHERE label = 0) AS n_neg"
add(
    "class_weights",
    f"""SELECT client_id, n, n_pos, n_neg, {r('CASE WHEN n_pos > 0 THEN n / (2.0 * n_pos) END', 'w_pos')},
      {r('CASE WHEN n_neg > 0 THEN n / (2.0 * n_neg) END', 'w_neg')}
    FROM (SELECT client_id, {WEIGHTS} FROM feat GROUP BY client_id)""",
)
add(
    "row_weights",
    f"""SELECT label, COUNT(*) AS n, {r('SUM(w)', 'weight')} FROM (
      SELECT label, COUNT(*) OVER () / (2.0 * COUNT(*) OVER (PARTITION BY label)) AS w FROM feat) GROUP BY label""",
)


IN_COURSE = split_views("feat", "client_id", "id_student", False)
add("stratified_split", "SELECT client_id, id_student, label, is_test FROM split", IN_COURSE)
add(
    "pooled_split",
    "SELECT client_id, id_student, is_test FROM split",
    split_views("feat", "", "client_id, id_student", False),
)
add(
    "hashed_split",
    f"""SELECT client_id, id_student,
      CAST(CAST('0x' || SUBSTR({hash_of('client_id, id_student')}, 1, 13) AS BIGINT) / CAST({16**13} AS DOUBLE) < CAST(0.2 AS DOUBLE) AS INT) AS is_test
    FROM feat""",
)
add(
    "split_fallbacks",
    "SELECT client_id, id_student, label, is_test FROM split",
    split_views("xfeat", "client_id", "id_student", True),
)
add(
    "head_tail_split",
    """SELECT subject, id_student, CAST(ROW_NUMBER() OVER (PARTITION BY subject ORDER BY id_student)
      > CAST(FLOOR(COUNT(*) OVER (PARTITION BY subject) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS INT) AS is_test FROM uci""",
)
SCALED = ("total_clicks", "days_active", "studied_credits")


def z(col: str, over: str, cond: str = "") -> str:
    mean = f"AVG({col}) {cond} OVER ({over})"
    std = f"STDDEV_POP({col}) {cond} OVER ({over})"
    return r(f"({col} - {mean}) / CASE WHEN {std} > 0 THEN {std} ELSE 1 END", col)


TRAIN_ONLY = "FILTER (WHERE is_test = 0)"
add(
    "group_standardize",
    f"""SELECT client_id, id_student, is_test, {', '.join(z(c, 'PARTITION BY client_id', TRAIN_ONLY) for c in SCALED)} FROM split""",
    IN_COURSE,
)
add("global_standardize", f"SELECT client_id, id_student, {', '.join(z(c, '') for c in SCALED)} FROM feat")


add("auc_exact", f"SELECT n_pos, n_neg, {r('auc', 'auc')} FROM ({ranked('feat', 'days_active')})")
add("auc_by_client", f"SELECT client_id, n_pos, n_neg, {r('auc', 'auc')} FROM ({ranked('feat', 'total_clicks', 'client_id')})")
THRESHOLDED = {"thresholded": "SELECT *, CAST(days_active < 20 AS INT) AS pred, -days_active AS score FROM feat"}
BINARY = f"{r(ACC, 'accuracy')}, {r(P1, 'precision')}, {r(SENS, 'recall')}, {r(F1, 'f1')}, {r(SENS, 'sensitivity')}, {r(SPEC, 'specificity')}"
add(
    "confusion_metrics",
    f"SELECT client_id, tn, fp, fn, tp, {BINARY} FROM ({cells('client_id')})",
    THRESHOLDED,
)
add(
    "weighted_metrics",
    f"""SELECT tn, fp, fn, tp, {r(ACC, 'accuracy')}, {r(weighted(P1, P0), 'precision')}, {r(weighted(SENS, SPEC), 'recall')},
      {r(weighted(F1, F0), 'f1')}, {r(SENS, 'sensitivity')}, {r(SPEC, 'specificity')} FROM ({cells()})""",
    THRESHOLDED,
)


add(
    "client_evaluation",
    f"SELECT client_id, {r('loss', 'loss')}, n_samples, {ROUNDED_METRICS} FROM ({client_eval('thresholded', 'client_id')})",
    {"thresholded": "SELECT *, CAST(total_engagement > 60 AS INT) AS pred, total_engagement AS score FROM xfeat"},
)
add(
    "weighted_round_mean",
    f"""SELECT SPLIT_PART(client_id, '_', 1) AS module, COUNT(*) AS n_clients, {MEAN_METRICS}
    FROM ({client_eval('thresholded', 'client_id')}) GROUP BY module""",
    THRESHOLDED,
)

LINES = {
    "lines": """SELECT client_id, REGR_SLOPE(label, days_active) AS w0, REGR_SLOPE(label, total_clicks / CAST(1000 AS DOUBLE)) AS w1,
      REGR_INTERCEPT(label, days_active) AS w2, COUNT(*) AS n FROM feat GROUP BY client_id""",
    "lines_long": """SELECT client_id, n, 0 AS pos, w0 AS value FROM lines UNION ALL SELECT client_id, n, 1, w1 FROM lines
      UNION ALL SELECT client_id, n, 2, w2 FROM lines""",
    "lines_mean": "SELECT pos, SUM(n * value) / SUM(n) AS value FROM lines_long GROUP BY pos",
    "lines_start": "SELECT pos, ARG_MIN(value, client_id) AS x0 FROM lines_long GROUP BY pos",
}
add("fed_avg", f"SELECT pos, {r('value', 'value')} FROM lines_mean", LINES)
add("fed_median", f"SELECT pos, {r('MEDIAN(value)', 'value')} FROM lines_long GROUP BY pos", LINES)
add("initial_model", f"SELECT pos, {r('x0', 'value')} FROM lines_start", LINES)
ADAM_ONE = "SELECT pos, value, x0, 0.1::DOUBLE * (value - x0) AS m1, 0.01::DOUBLE * (value - x0) ** 2 AS v1 FROM lines_mean JOIN lines_start USING (pos)"
ADAM = {
    **LINES,
    "step1": ADAM_ONE,
    "step1x": "SELECT *, x0 + 0.001::DOUBLE * m1 / (SQRT(v1) + 1e-9::DOUBLE) AS x1 FROM step1",
    "step2": "SELECT *, 0.9::DOUBLE * m1 + 0.1::DOUBLE * (value - x1) AS m2, 0.99::DOUBLE * v1 + 0.01::DOUBLE * (value - x1) ** 2 AS v2 FROM step1x",
    "step2x": "SELECT *, x1 + 0.001::DOUBLE * m2 / (SQRT(v2) + 1e-9::DOUBLE) AS x2 FROM step2",
}
add(
    "fed_adam_step",
    f"SELECT 1 AS round, pos, {r('x1', 'value', 8)} FROM step2x UNION ALL SELECT 2, pos, {r('x2', 'value', 8)} FROM step2x",
    ADAM,
)
add(
    "pad_truncate",
    f"""SELECT client_id, p, pos, {r('value', 'value')} FROM (
      SELECT client_id, 3 AS p, pos, CASE WHEN pos < 2 THEN value ELSE 0 END AS value FROM lines_long
      UNION ALL SELECT client_id, 1, pos, value FROM lines_long WHERE pos = 0)""",
    LINES,
)
add(
    "client_status",
    "\nUNION ALL ".join(
        f"""SELECT COUNT(*) AS n_clients, CASE WHEN COUNT(*) < 2 THEN 'insufficient_clients' ELSE 'ok' END AS status, {n} AS min_rows
        FROM (SELECT client_id FROM feat GROUP BY client_id HAVING COUNT(*) >= {n})"""
        for n in (20, 50, 100_000)
    ),
)
add(
    "verdict_by_course",
    f"""SELECT client_id, {r('diff', 'diff')},
      CASE WHEN diff > CAST(0.005 AS DOUBLE) THEN 'better' WHEN diff > CAST(-0.01 AS DOUBLE) THEN 'comparable' ELSE 'worse' END AS verdict
    FROM (SELECT client_id, ROUND(AVG(label) - (SELECT AVG(label) FROM feat), 9) AS diff FROM feat GROUP BY client_id)""",
)
add(
    "best_course",
    f"""SELECT module, presentation, n, {r('rate', 'rate')} FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY module ORDER BY rate DESC, presentation) AS k FROM (
        SELECT SPLIT_PART(client_id, '_', 1) AS module, CAST(SPLIT_PART(client_id, '_R', 2) AS INT) AS presentation,
          COUNT(*) AS n, AVG(label) AS rate FROM feat GROUP BY client_id)) WHERE k = 1""",
)
add("median_score", f"SELECT code_module, {r('MEDIAN(sum_click)', 'median')} FROM vle GROUP BY code_module")

SQL.update(MODEL_SQL)
