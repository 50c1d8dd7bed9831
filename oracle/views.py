"""DuckDB views the checks build on, and the helper that puts the needed ones in front of a query."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["info"] = """
SELECT c.c_mktsegment AS code_module, CONCAT('R', CAST(n.n_regionkey AS STRING)) AS code_presentation, c.c_custkey AS id_student,
  CASE WHEN COALESCE(o.nf,0) >= 4 THEN 'Fail' WHEN COALESCE(o.nf,0) = 3 THEN 'Withdrawn'
       WHEN COALESCE(o.nf,0) = 2 THEN 'Pass' ELSE 'Distinction' END AS final_result,
  CAST(c.c_custkey % 4 AS INT) AS num_of_prev_attempts, CAST(30 * (1 + c.c_nationkey % 4) AS INT) AS studied_credits,
  CASE WHEN c.c_acctbal < 0 THEN NULL WHEN c.c_acctbal >= 9000 THEN 'unknown-band'
       ELSE CONCAT(CAST(CAST(FLOOR(c.c_acctbal/1000) AS INT)*10 AS STRING),'-',
                   CAST(CAST(FLOOR(c.c_acctbal/1000) AS INT)*10+10 AS STRING),'%') END AS imd_band,
  CASE c.c_nationkey % 6 WHEN 0 THEN 'No Formal quals' WHEN 1 THEN 'Lower Than A Level' WHEN 2 THEN 'A Level or Equivalent'
       WHEN 3 THEN 'HE Qualification' WHEN 4 THEN 'Post Graduate Qualification' ELSE 'other' END AS highest_education
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, COUNT(*) AS nf FROM orders WHERE o_orderstatus='F' GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

VIEWS["vle"] = """
SELECT i.code_module, i.code_presentation, o.o_custkey AS id_student, l.l_partkey AS id_site,
  CAST(l.l_shipdate AS DATE) AS date, CAST(l.l_quantity AS BIGINT) AS sum_click
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN info i ON i.id_student=o.o_custkey
"""

VIEWS["sa"] = """
SELECT o_orderkey AS id_assessment, o_custkey AS id_student,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS INT) END AS score
FROM orders WHERE o_orderstatus='O' AND o_orderpriority IN ('1-URGENT','2-HIGH')
"""

VIEWS["assessments"] = """
SELECT o.o_orderkey AS id_assessment, i.code_module, i.code_presentation,
  CONCAT_WS('_', i.code_module, i.code_presentation) AS client_id
FROM orders o JOIN info i ON i.id_student=o.o_custkey
"""

VIEWS["xapi"] = """
SELECT e.user_id AS id_student, CONCAT(' ', REPLACE(n.n_name,'_',' '), ' ') AS NationalITy,
  CAST(SUM(CASE WHEN e.event_type='click' THEN 1 ELSE 0 END) AS BIGINT) AS raisedhands,
  CAST(SUM(CASE WHEN e.event_type='view' THEN 1 ELSE 0 END) AS BIGINT) AS VisITedResources,
  CAST(SUM(CASE WHEN e.event_type='signup' THEN 1 ELSE 0 END) AS BIGINT) AS AnnouncementsView,
  CAST(SUM(CASE WHEN e.event_type='purchase' THEN 1 ELSE 0 END) AS BIGINT) AS Discussion,
  CASE WHEN SUM(CASE WHEN e.event_type='error' THEN 1 ELSE 0 END) > 13 THEN 'Above-7' ELSE 'Under-7' END AS StudentAbsenceDays,
  CASE WHEN e.user_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS ParentAnsweringSurvey,
  CASE WHEN e.user_id % 3 = 0 THEN 'Good' ELSE 'Bad' END AS ParentschoolSatisfaction,
  CASE WHEN e.user_id % 5 < 2 THEN 'Second' ELSE 'First' END AS Semester,
  CASE WHEN SUM(CASE WHEN e.event_type IN ('click','view') THEN 1 ELSE 0 END) < 24 THEN 'L'
       WHEN SUM(CASE WHEN e.event_type IN ('click','view') THEN 1 ELSE 0 END) < 29 THEN 'M' ELSE 'H' END AS Class
FROM events e JOIN customer c ON c.c_custkey=e.user_id JOIN nation n ON n.n_nationkey=c.c_nationkey GROUP BY e.user_id, n.n_name
"""

VIEWS["uci"] = """
SELECT o.o_custkey AS id_student, CASE WHEN o.o_custkey % 13 = 0 THEN 'MS' ELSE 'GP' END AS school,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'math' ELSE 'portuguese' END AS subject,
  CAST(FLOOR(MAX(CASE WHEN l.l_linenumber<=2 THEN l.l_quantity ELSE 0 END)*0.4) AS INT) AS G1,
  CAST(FLOOR(MAX(CASE WHEN l.l_linenumber<=3 THEN l.l_quantity ELSE 0 END)*0.4) AS INT) AS G2,
  CAST(FLOOR(MAX(CASE WHEN l.l_linenumber<=2 THEN l.l_quantity ELSE 0 END)*0.14 + AVG(CAST(l.l_linenumber AS DOUBLE))) AS INT) AS G3,
  CAST(1 + o.o_custkey % 4 AS INT) AS studytime, CAST(o.o_custkey % 3 AS INT) AS failures,
  CAST(o.o_custkey % 5 AS INT) AS Medu, CAST(o.o_custkey % 4 AS INT) AS Fedu, CAST(1 + o.o_custkey % 5 AS INT) AS health,
  CAST(COUNT(DISTINCT o.o_orderkey) AS INT) AS absences,
  CASE WHEN o.o_custkey % 7 = 0 THEN 'yes' ELSE 'no' END AS schoolsup,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS famsup
FROM orders o JOIN lineitem l ON l.l_orderkey=o.o_orderkey GROUP BY o.o_custkey
"""

VIEWS["info_c"] = """
SELECT *, CONCAT_WS('_', code_module, code_presentation) AS client_id,
  CASE WHEN final_result = 'Fail' THEN 0 ELSE 1 END AS label
FROM info WHERE imd_band IS NOT NULL
"""

VIEWS["vle_c"] = """
SELECT CONCAT_WS('_', code_module, code_presentation) AS client_id, id_student, id_site, date, MAX(sum_click) AS sum_click
FROM vle GROUP BY code_module, code_presentation, id_student, id_site, date
"""

VIEWS["sa_c"] = "SELECT * FROM sa WHERE score IS NOT NULL"

# The codes of the deprivation bands and of the education levels.
BAND_CASE = """CASE imd_band WHEN '0-10%' THEN 0 WHEN '10-20%' THEN 1 WHEN '20-30%' THEN 2 WHEN '30-40%' THEN 3
         WHEN '40-50%' THEN 4 WHEN '50-60%' THEN 5 WHEN '60-70%' THEN 6 WHEN '70-80%' THEN 7
         WHEN '80-90%' THEN 8 WHEN '90-100%' THEN 9 ELSE 5 END"""
EDUCATION_CASE = """CASE highest_education WHEN 'No Formal quals' THEN 0 WHEN 'Lower Than A Level' THEN 1
         WHEN 'A Level or Equivalent' THEN 2 WHEN 'HE Qualification' THEN 3
         WHEN 'Post Graduate Qualification' THEN 4 ELSE 2 END"""

# A student's scores as one list, or a list of one NULL; the clicks of a profile count once per element.
VIEWS["score_lists"] = "SELECT id_student, LIST(score) AS scores FROM sa_c GROUP BY id_student"
VIEWS["scored_profiles"] = f"""
SELECT client_id, id_student, label, num_of_prev_attempts, studied_credits, {BAND_CASE} AS band, {EDUCATION_CASE} AS education,
  UNNEST(COALESCE(scores, [NULL])) AS score
FROM info_c LEFT JOIN score_lists USING (id_student)
"""
VIEWS["profiles"] = """
SELECT client_id, id_student, label, COUNT(*) AS times, AVG(score) AS avg_score, MAX(num_of_prev_attempts) AS num_prev_attempts,
  MAX(studied_credits) AS studied_credits, MAX(band) AS imd_band_num, MAX(education) AS edu_level
FROM scored_profiles GROUP BY client_id, id_student, label
"""
VIEWS["feat"] = """
SELECT client_id, id_student, CAST(clicks * times AS BIGINT) AS total_clicks, days_active, label, avg_score, num_prev_attempts,
  studied_credits, imd_band_num, edu_level
FROM profiles JOIN (SELECT client_id, id_student, SUM(sum_click) AS clicks, COUNT(DISTINCT date) AS days_active
  FROM vle_c GROUP BY client_id, id_student) USING (client_id, id_student)
"""

VIEWS["xfeat"] = """
SELECT *, CONCAT('xapi_', REPLACE(TRIM(NationalITy), ' ', '_')) AS client_id,
  CASE WHEN Class = 'L' THEN 0 ELSE 1 END AS label,
  raisedhands + VisITedResources + AnnouncementsView + Discussion AS total_engagement,
  CAST(StudentAbsenceDays = 'Above-7' AS INT) AS absence_flag,
  CAST(ParentAnsweringSurvey = 'Yes' AS INT) AS parent_involved,
  CAST(ParentschoolSatisfaction = 'Good' AS INT) AS satisfaction,
  CAST(Semester = 'Second' AS INT) AS semester_num
FROM xapi
"""

VIEWS["gfeat"] = """
SELECT *, CONCAT(school, '_', subject) AS client_id, CASE WHEN G3 >= 10 THEN 1 ELSE 0 END AS label,
  (G1 + G2) / 2.0 AS avg_grade, G2 - G1 AS grade_trend, studytime * (1 + failures * CAST(0.5 AS DOUBLE)) AS study_effort,
  (Medu + Fedu) / 2.0 AS parent_edu, absences / CAST(MAX(absences) OVER (PARTITION BY subject) + 1 AS DOUBLE) AS absence_rate,
  CAST(schoolsup = 'yes' AS INT) + CAST(famsup = 'yes' AS INT) AS support
FROM uci
"""


def with_views(body: str, local: dict[str, str] | None = None) -> str:
    """`WITH` the views the body names, directly or through other views, in order of need."""
    known = {**VIEWS, **(local or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in ordered and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({known[name].strip()})" for name in ordered)
    return f"WITH {ctes}\n{body.strip()}"
