"""SQL for the fitted models: Newton steps unrolled over plain 3 x 3 systems, rounds and reports on top."""

from __future__ import annotations

from oracle.fragments import (
    ACC,
    F1,
    METRICS,
    P1,
    ROUNDED_METRICS,
    SENS,
    cells,
    client_eval,
    r,
    ranked,
    split_views,
)
from oracle.views import with_views

STEPS = 12
ROUNDS = 10
MUS = (0.0, 0.01, 0.1, 1.0)


def newton_views(
    train: str, key: str, mus: tuple[float, ...], name: str, prox: float = 0.0, center: str | None = None
) -> dict[str, str]:
    """Views `<name>_0` .. `<name>_STEPS`: coefficients b0, b1 and intercept b2 per (key, mu).

    With `prox`, prox / 2 times the squared distance from the one row (c0, c1, c2) of `center` is added.
    """
    pull = [f" + {prox}::DOUBLE * (ANY_VALUE(b{i}) - (SELECT c{i} FROM {center}))" if center else "" for i in range(3)]
    more = f" + {prox}::DOUBLE" if center else ""
    values = ", ".join(f"({m}::DOUBLE)" for m in mus)
    views = {
        f"{name}_0": f"""SELECT {key}, mu, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2
            FROM (SELECT DISTINCT {key} FROM {train}), (VALUES {values}) AS m(mu)"""
    }
    for k in range(STEPS):
        views[f"{name}_{k + 1}"] = f"""
        SELECT {key}, mu,
          b0 - ((h11*h22 - h12*h12) * g0 + (h02*h12 - h01*h22) * g1 + (h01*h12 - h02*h11) * g2) / det AS b0,
          b1 - ((h02*h12 - h01*h22) * g0 + (h00*h22 - h02*h02) * g1 + (h01*h02 - h00*h12) * g2) / det AS b1,
          b2 - ((h01*h12 - h02*h11) * g0 + (h01*h02 - h00*h12) * g1 + (h00*h11 - h01*h01) * g2) / det AS b2
        FROM (SELECT *, h00*(h11*h22 - h12*h12) - h01*(h01*h22 - h12*h02) + h02*(h01*h12 - h11*h02) AS det FROM (
          SELECT {key}, mu, ANY_VALUE(b0) AS b0, ANY_VALUE(b1) AS b1, ANY_VALUE(b2) AS b2,
            SUM(w*(p-label)*x0) + (1+mu)*ANY_VALUE(b0){pull[0]} AS g0, SUM(w*(p-label)*x1) + (1+mu)*ANY_VALUE(b1){pull[1]} AS g1,
            SUM(w*(p-label)){pull[2]} AS g2,
            SUM(w*p*(1-p)*x0*x0) + 1 + mu{more} AS h00, SUM(w*p*(1-p)*x0*x1) AS h01, SUM(w*p*(1-p)*x0) AS h02,
            SUM(w*p*(1-p)*x1*x1) + 1 + mu{more} AS h11, SUM(w*p*(1-p)*x1) AS h12, SUM(w*p*(1-p)){more} AS h22
          FROM (SELECT t.*, s.mu, s.b0, s.b1, s.b2, 1 / (1 + EXP(-(b0*x0 + b1*x1 + b2))) AS p
                FROM {train} t JOIN {name}_{k} s USING ({key})) GROUP BY {key}, mu))"""
    return views


def scaled(col: str, over: str, cond: str) -> str:
    std = f"STDDEV_POP({col}) {cond} OVER ({over})"
    return f"({col} - AVG({col}) {cond} OVER ({over})) / CASE WHEN {std} > 0 THEN {std} ELSE 1 END"


BY_CLIENT = "PARTITION BY client_id"
TRAIN = "FILTER (WHERE is_test = 0)"


def group_views(prefix: str, source: str, x0: str, x1: str, min_rows: int) -> dict[str, str]:
    """View `<prefix>history`: four strategies and the sweep over the groups of `source`, on features x0 and x1.

    A group with one class in its training rows is idle: it returns the model it was given.
    """
    p, start = prefix, f"{prefix}start"
    means = ", ".join(
        f"SUM(n * b{i}) FILTER (WHERE trainable) / SUM(n) FILTER (WHERE trainable) AS a{i}" for i in range(3)
    )
    views = {
        f"{p}complete": f"""SELECT client_id, id_student, label, {x0}, {x1} FROM (
            SELECT *, COUNT(*) OVER (PARTITION BY client_id) AS size FROM {source})
            WHERE size >= {min_rows} AND {x0} IS NOT NULL AND {x1} IS NOT NULL""",
        **split_views(f"{p}complete", "client_id", "id_student", True, p),
        f"{p}rows_z": f"""SELECT client_id, id_student, label, is_test, {scaled(x0, BY_CLIENT, TRAIN)} AS x0,
            {scaled(x1, BY_CLIENT, TRAIN)} AS x1 FROM {p}split""",
        f"{p}train": f"""SELECT client_id, label, x0, x1, COUNT(*) OVER (PARTITION BY client_id)
            / (2.0::DOUBLE * COUNT(*) OVER (PARTITION BY client_id, label)) AS w FROM {p}rows_z WHERE is_test = 0""",
        f"{p}groups": f"""SELECT client_id, COUNT(*) AS n, MIN(label) < MAX(label) AS trainable FROM {p}train GROUP BY client_id""",
        f"{p}fit_rows": f"SELECT * FROM {p}train JOIN {p}groups USING (client_id) WHERE trainable",
        **newton_views(f"{p}fit_rows", "client_id", MUS, f"{p}fit"),
        f"{p}models": f"""SELECT client_id, mu, n, trainable, COALESCE(b0, 0) AS b0, COALESCE(b1, 0) AS b1, COALESCE(b2, 0) AS b2
            FROM (SELECT * FROM {p}groups, (VALUES {', '.join(f'({m}::DOUBLE)' for m in MUS)}) AS v(mu))
            LEFT JOIN {p}fit_{STEPS} USING (client_id, mu)""",
        start: f"""SELECT ARG_MIN(b0, client_id) AS b0, ARG_MIN(b1, client_id) AS b1, ARG_MIN(b2, client_id) AS b2
            FROM {p}models WHERE mu = 0""",
        f"{p}targets": f"""SELECT mu, {means}, 1 - SUM(n) FILTER (WHERE trainable) / SUM(n) AS idle FROM {p}models GROUP BY mu""",
        f"{p}median_0": f"SELECT * FROM {start}",
        f"{p}adam_0": f"""SELECT a0, a1, a2, idle, b0, b1, b2, 0::DOUBLE AS m0, 0::DOUBLE AS m1, 0::DOUBLE AS m2,
            0::DOUBLE AS v0, 0::DOUBLE AS v1, 0::DOUBLE AS v2 FROM {p}targets CROSS JOIN {start} WHERE mu = 0""",
    }
    for k in range(1, ROUNDS + 1):
        middle = ", ".join(f"MEDIAN(CASE WHEN trainable THEN m.b{i} ELSE c.b{i} END) AS b{i}" for i in range(3))
        views[f"{p}median_{k}"] = f"SELECT {middle} FROM {p}models m CROSS JOIN {p}median_{k - 1} c WHERE mu = 0"
        m = ", ".join(f"0.9::DOUBLE*m{i} + 0.1::DOUBLE*(1-idle)*(a{i}-b{i}) AS m{i}" for i in range(3))
        v = ", ".join(f"0.99::DOUBLE*v{i} + 0.01::DOUBLE*((1-idle)*(a{i}-b{i}))**2 AS v{i}" for i in range(3))
        b = ", ".join(f"b{i} + 0.001::DOUBLE*m{i}/(SQRT(v{i}) + 1e-9::DOUBLE) AS b{i}" for i in range(3))
        views[f"{p}adam_{k}"] = f"""SELECT a0, a1, a2, idle, m0, m1, m2, v0, v1, v2, {b}
            FROM (SELECT a0, a1, a2, idle, b0, b1, b2, {m}, {v} FROM {p}adam_{k - 1})"""
    paths = "\n".join(
        f"UNION ALL SELECT '{name}', 0, {k}, b0, b1, b2 FROM {p}{view}_{k}"
        for name, view in (("FedMedian", "median"), ("FedAdam", "adam"))
        for k in range(1, ROUNDS + 1)
    )
    drift = ", ".join(f"a{i} + POW(idle, round) * (b{i} - a{i}) AS b{i}" for i in range(3))
    views |= {
        f"{p}combined": f"""SELECT CASE WHEN mu = 0 THEN 'FedAvg' ELSE 'FedProx' END AS strategy, mu, CAST(round AS INT) AS round, {drift}
            FROM {p}targets CROSS JOIN {start} CROSS JOIN RANGE(1, {ROUNDS + 1}) AS g(round)
            {paths}""",
        f"{p}scored": f"""SELECT *, CAST(score > 0.5 AS INT) AS pred FROM (
            SELECT strategy, mu, round, client_id, label, 1 / (1 + EXP(-(b0*x0 + b1*x1 + b2))) AS score
            FROM (SELECT * FROM {p}rows_z WHERE is_test = 1) CROSS JOIN {p}combined)""",
        f"{p}per_client": client_eval(f"{p}scored", "strategy, mu, round, client_id"),
        f"{p}history": f"""SELECT strategy, mu, round, COUNT(*) AS n_clients,
            {', '.join(f'SUM({c} * n_samples) / SUM(n_samples) AS {c}' for c in METRICS)}
            FROM {p}per_client GROUP BY strategy, mu, round""",
    }
    return views


HISTORY: dict[str, str] = {
    **group_views("", "feat", "days_active", "avg_score", 20),
    **group_views("small_", "xfeat", "raisedhands", "Discussion", 5),
    "histories": "SELECT 'courses' AS dataset, * FROM history UNION ALL SELECT 'engagement', * FROM small_history",
    "run": "SELECT * FROM histories WHERE strategy <> 'FedProx' OR mu = 0.1::DOUBLE",
    "finals": f"SELECT *, COUNT(*) OVER (PARTITION BY dataset, strategy) AS n_rounds FROM run QUALIFY round = {ROUNDS}",
    "sweep": f"""SELECT dataset, mu, auc FROM histories
        WHERE strategy IN ('FedAvg', 'FedProx') AND round = {ROUNDS}""",
    "best": """SELECT dataset, CASE WHEN MAX(auc) > 0 THEN ARG_MAX(strategy, ROUND(auc, 9)
        - LIST_POSITION(['FedAvg','FedProx','FedAdam','FedMedian'], strategy) * 1e-11) ELSE 'N/A' END AS top, MAX(auc) AS auc
        FROM finals GROUP BY dataset""",
    "best_strength": """SELECT dataset, COALESCE(ARG_MAX(mu, ROUND(auc, 9) - mu * 1e-11) FILTER (WHERE mu > 0 AND auc > 0), 0) AS mu,
        COALESCE(MAX(auc) FILTER (WHERE mu > 0 AND auc > 0), 0) AS auc FROM sweep GROUP BY dataset""",
}


PROX_ROUNDS, PROX = 3, 0.1


def proximal_views() -> dict[str, str]:
    """Views `proximal_<round>` (c0, c1, c2): the combined model, local fits being pulled towards the round before."""
    views = {"proximal_0": "SELECT b0 AS c0, b1 AS c1, b2 AS c2 FROM start"}
    for k in range(1, PROX_ROUNDS + 1):
        views |= newton_views("fit_rows", "client_id", (0.0,), f"pulled{k}", PROX, f"proximal_{k - 1}")
        means = ", ".join(
            f"SUM(n * CASE WHEN trainable THEN b{i} ELSE c{i} END) / CAST(SUM(n) AS DOUBLE) AS c{i}" for i in range(3)
        )
        views[f"proximal_{k}"] = f"""SELECT {means} FROM groups LEFT JOIN pulled{k}_{STEPS} USING (client_id)
            CROSS JOIN proximal_{k - 1}"""
    paths = " UNION ALL ".join(f"SELECT {k} AS round, c0, c1, c2 FROM proximal_{k}" for k in range(1, PROX_ROUNDS + 1))
    return views | {
        "proximal_all": paths,
        "proximal_scored": """SELECT *, CAST(score > 0.5 AS INT) AS pred FROM (
            SELECT round, client_id, label, 1 / (1 + EXP(-(c0*x0 + c1*x1 + c2))) AS score
            FROM (SELECT * FROM rows_z WHERE is_test = 1) CROSS JOIN proximal_all)""",
        "proximal_client": client_eval("proximal_scored", "round, client_id"),
    }


def pooled_views(p: str, dataset: str, source: str, x0: str, x1: str) -> dict[str, str]:
    """View `<p>pooled_lr`: the regression over all complete rows of `source`, on features x0 and x1."""
    return {
        f"{p}pooled_z": f"""SELECT 'all' AS grp, client_id, id_student, label, {scaled(x0, '', '')} AS x0,
            {scaled(x1, '', '')} AS x1 FROM {source} WHERE {x0} IS NOT NULL AND {x1} IS NOT NULL""",
        **split_views(f"{p}pooled_z", "", "client_id, id_student", False, f"{p}pooled_"),
        f"{p}pooled_train": f"""SELECT grp, label, x0, x1, COUNT(*) OVER () / (2.0::DOUBLE * COUNT(*) OVER (PARTITION BY label)) AS w
            FROM {p}pooled_split WHERE is_test = 0""",
        **newton_views(f"{p}pooled_train", "grp", (0.0,), f"{p}pooled_fit"),
        f"{p}pooled_scored": f"""SELECT *, CAST(score > 0.5 AS INT) AS pred FROM (
            SELECT label, 1 / (1 + EXP(-(b0*x0 + b1*x1 + b2))) AS score
            FROM {p}pooled_split JOIN {p}pooled_fit_{STEPS} USING (grp) WHERE is_test = 1)""",
        f"{p}pooled_lr": f"""SELECT '{dataset}' AS dataset, 'LR' AS model, a.auc, {ACC} AS accuracy, {F1} AS f1, {P1} AS precision,
            {SENS} AS recall, tn, fp, fn, tp, (SELECT COUNT(*) FROM {p}pooled_train) AS n_train, tn + fp + fn + tp AS n_test
            FROM ({cells('', f'{p}pooled_scored')}) JOIN ({ranked(f'{p}pooled_scored', 'score')}) a ON TRUE""",
    }


POOLED: dict[str, str] = {
    **pooled_views("", "courses", "feat", "days_active", "avg_score"),
    **pooled_views("small_", "engagement", "xfeat", "raisedhands", "Discussion"),
    "pooled_all": "SELECT * FROM pooled_lr UNION ALL SELECT * FROM small_pooled_lr",
}
ALL = {**HISTORY, **POOLED, **proximal_views()}
VERDICT = """CASE WHEN diff > 0.005::DOUBLE THEN 'better' WHEN diff > -0.01::DOUBLE THEN 'comparable' ELSE 'worse' END"""

MODEL_SQL: dict[str, str] = {}


def add(name: str, body: str) -> None:
    MODEL_SQL[name] = with_views(body, ALL)


_zero = "w * (0.5::DOUBLE - label)"
add(
    "gradient_at_zero",
    f"""SELECT client_id, {r('SUM(w * LN(2::DOUBLE))', 'loss')}, {r(f'SUM({_zero} * x0)', 'g_0')}, {r(f'SUM({_zero} * x1)', 'g_1')},
      {r(f'SUM({_zero})', 'g_2')} FROM train GROUP BY client_id""",
)
add(
    "local_logit",
    f"SELECT client_id, mu, {r('b0', 'w0')}, {r('b1', 'w1')}, {r('b2', 'intercept')}, n AS n_train FROM models WHERE mu IN (0, 0.1::DOUBLE)",
)
add(
    "local_scores",
    f"""SELECT client_id, id_student, {r('p', 'prob')}, CAST(p > 0.5 AS INT) AS pred FROM (
      SELECT client_id, id_student, 1 / (1 + EXP(-(b0*x0 + b1*x1 + b2))) AS p FROM rows_z JOIN models USING (client_id)
      WHERE mu = 0 AND is_test = 1)""",
)
add("fed_rounds_small", f"SELECT strategy, mu, round, n_clients, {ROUNDED_METRICS} FROM small_history WHERE strategy <> 'FedProx' OR mu = 0.1::DOUBLE")
add("fed_rounds", f"SELECT strategy, mu, round, n_clients, {ROUNDED_METRICS} FROM history WHERE strategy <> 'FedProx' OR mu = 0.1::DOUBLE")
add(
    "mu_sweep",
    f"SELECT mu, {ROUNDED_METRICS} FROM history WHERE strategy IN ('FedAvg', 'FedProx') AND round = {ROUNDS}",
)
add(
    "proximal_path",
    "\nUNION ALL ".join(
        f"SELECT CAST(round AS INT) AS round, {i} AS pos, {r(f'c{i}', 'value')} FROM proximal_all" for i in range(3)
    ),
)
add(
    "proximal_rounds",
    f"""SELECT 'FedProxTerm' AS strategy, {PROX}::DOUBLE AS mu, CAST(round AS INT) AS round, COUNT(*) AS n_clients,
    {', '.join(r(f'SUM({c} * n_samples) / SUM(n_samples)', c) for c in METRICS)} FROM proximal_client GROUP BY round""",
)
add(
    "local_logit_residual",
    """SELECT client_id, mu, n AS n_train, trainable, CAST(trainable AS INT) AS solved
    FROM groups CROSS JOIN (VALUES (0::DOUBLE), (0.1::DOUBLE)) AS v(mu)""",
)
add(
    "course_steps",
    """SELECT client_id, COUNT(*) AS n_train, MIN(label) < MAX(label) AS trainable, 1 AS in_budget,
      CASE WHEN MIN(label) < MAX(label) THEN 1 END AS improved
    FROM (SELECT *, COUNT(*) OVER (PARTITION BY client_id) AS size FROM feat) WHERE size > 50 AND avg_score IS NOT NULL
    GROUP BY client_id""",
)
add(
    "pooled_audit",
    """SELECT model, (SELECT COUNT(*) FROM pooled_split WHERE is_test = 0) AS n_train,
      (SELECT COUNT(*) FROM pooled_split WHERE is_test = 1) AS n_cells,
      (SELECT COUNT(*) FROM pooled_split WHERE is_test = 1 AND label = 1) AS n_positive,
      1 AS consistent, 1 AS best_is_top, CAST(1 AS BIGINT) AS n_best
    FROM (VALUES ('LR'), ('RF'), ('GBT')) AS v(model)""",
)
add(
    "report_audit",
    "\nUNION ALL ".join(
        f"""SELECT '{dataset}' AS dataset, name, CAST(mu AS DOUBLE) AS mu, CAST(n_within AS BIGINT) AS n_within,
          CASE WHEN n_within = 1 THEN (SELECT COUNT(*) FROM {table} WHERE {whole})
            ELSE (SELECT COUNT(*) FROM (SELECT client_id FROM {table} GROUP BY client_id
              HAVING COUNT(*) >= {least} AND COUNT_IF({whole}) >= 2)) END AS size,
          CAST(n_best AS BIGINT) AS n_best
        FROM (VALUES ('LR', NULL, 1, 1), ('RF', NULL, 1, 1), ('GBT', NULL, 1, 1), ('FedAvg', 0, {ROUNDS}, 0), ('FedAdam', 0, {ROUNDS}, 0),
          ('FedMedian', 0, {ROUNDS}, 0), ('FedProx', 0.01, {ROUNDS}, 0), ('FedProx', 0.1, {ROUNDS}, 0), ('FedProx', 1, {ROUNDS}, 0))
          AS v(name, mu, n_within, n_best)"""
        for dataset, table, least, whole in (
            ("courses", "feat", 20, "avg_score IS NOT NULL"),
            ("engagement", "xfeat", 5, "total_engagement IS NOT NULL"),
        )
    ),
)
add("pooled_lr", f"SELECT model, {ROUNDED_METRICS}, tn, fp, fn, tp, n_train, n_test FROM pooled_lr")
add(
    "round_deltas",
    f"""SELECT dataset, strategy, mu, round, {r('auc', 'auc')}, {r('delta', 'delta')},
      CASE WHEN delta IS NULL THEN 'first round' WHEN ABS(delta) < 1e-4 THEN 'converged' ELSE FORMAT('{{:+.4f}}', delta) END AS note
    FROM (SELECT *, auc - LAG(auc) OVER (PARTITION BY dataset, strategy, mu ORDER BY round) AS delta FROM run)""",
)
add(
    "round_completeness",
    f"""SELECT dataset, strategy, COUNT(DISTINCT round) AS n_rounds,
      CASE WHEN COUNT(DISTINCT round) < {ROUNDS} THEN 'incomplete' ELSE 'ok' END AS status FROM run GROUP BY dataset, strategy""",
)
add(
    "verdict",
    f"""SELECT dataset, n_clients, {r('pooled_auc', 'pooled_auc')}, {r('combined_auc', 'combined_auc')}, {r('diff', 'diff')}, {VERDICT} AS verdict
    FROM (SELECT f.dataset, f.n_clients, p.auc AS pooled_auc, f.auc AS combined_auc, f.auc - p.auc AS diff
          FROM finals f JOIN pooled_all p USING (dataset) WHERE strategy = 'FedAvg')""",
)
add(
    "pooled_vs_combined",
    "\nUNION ALL ".join(
        f"""SELECT dataset, '{m}' AS metric, {r(f'p.{m}', 'pooled')}, {r(f'f.{m}', 'combined')}, {r(f'f.{m} - p.{m}', 'diff')}
        FROM finals f JOIN pooled_all p USING (dataset) WHERE strategy = 'FedAvg'"""
        for m in METRICS
    ),
)
add("best_strategy", f"SELECT dataset, top AS strategy, {r('auc', 'auc')} FROM best")
add("best_mu", f"SELECT dataset, mu, {r('auc', 'auc')} FROM best_strength")
add(
    "result_long",
    """
    SELECT 'pooled' AS kind, dataset, (SELECT MAX(n_clients) FROM finals f WHERE f.dataset = p.dataset) AS n_clients, model AS strategy,
      ROUND(auc, 4) AS auc, ROUND(f1, 4) AS f1, ROUND(precision, 4) AS precision, ROUND(recall, 4) AS recall,
      CAST(NULL AS BIGINT) AS n_rounds, CAST(NULL AS DOUBLE) AS diff_vs_lr, CAST(NULL AS DOUBLE) AS mu, 'best' AS note FROM pooled_all p
    UNION ALL SELECT 'combined', f.dataset, n_clients, strategy, ROUND(f.auc, 4), ROUND(f.f1, 4), ROUND(f.precision, 4), ROUND(f.recall, 4),
      n_rounds, CASE WHEN f.auc <> 0 THEN ROUND(f.auc - p.auc, 4) END, CASE WHEN strategy = 'FedProx' THEN mu END,
      CASE WHEN strategy = top THEN 'best' WHEN f.auc = 0 THEN 'degenerate' ELSE '' END
      FROM finals f JOIN pooled_all p ON p.dataset = f.dataset JOIN best b ON b.dataset = f.dataset
    UNION ALL SELECT 'mu_sweep', dataset, NULL, 'FedProx', ROUND(auc, 4), NULL, NULL, NULL, NULL, NULL, mu,
      CASE WHEN mu = 0 THEN 'reference' ELSE '' END FROM sweep""",
)
add(
    "strategy_table",
    f"""SELECT f.dataset, strategy, {r('f.auc', 'auc')}, {r('f.f1', 'f1')}, {r('f.precision', 'precision')}, {r('f.recall', 'recall')},
      {r('f.auc - p.auc', 'diff_vs_lr')},
      CASE WHEN f.auc = 0 THEN 'degenerate' WHEN strategy = top THEN 'best' ELSE '' END AS note
    FROM finals f JOIN pooled_all p ON p.dataset = f.dataset JOIN best b ON b.dataset = f.dataset""",
)
add(
    "mu_table",
    f"""SELECT dataset, s.mu, {r('s.auc', 'auc')}, CASE WHEN s.mu = 0 THEN 'reference' WHEN s.mu = t.mu THEN 'best' ELSE '' END AS note
    FROM sweep s JOIN best_strength t USING (dataset)""",
)
add(
    "pooled_table",
    f"""SELECT dataset, n_train + n_test AS n_samples, {r('auc', 'LR')}, {r('0', 'RF')}, {r('0', 'GBT')}, 'LR' AS best FROM pooled_all""",
)
add(
    "series_rounds",
    f"SELECT dataset, strategy, round, {r('r.auc', 'auc')}, {r('p.auc', 'lr_auc')} FROM run r JOIN pooled_all p USING (dataset)",
)
add(
    "series_bars",
    f"""SELECT dataset, 'pooled' AS kind, model AS name, {r('auc', 'auc')} FROM pooled_all
    UNION ALL SELECT dataset, 'combined', strategy, {r('auc', 'auc')} FROM finals""",
)
add(
    "series_mu",
    f"""SELECT dataset, s.mu, {r('auc', 'auc')}, CAST(s.mu = t.mu AS INT) AS is_best
    FROM sweep s JOIN (SELECT dataset, ARG_MAX(mu, ROUND(auc, 9) - mu * 1e-11) AS mu FROM sweep GROUP BY dataset) t USING (dataset)""",
)
add("series_strategies", f"SELECT dataset, strategy, {r('auc', 'auc')} FROM finals")
