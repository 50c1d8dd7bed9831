"""SQL fragments shared by the checks: rounding, splits by row number, AUC by ranks, metrics."""

from __future__ import annotations

def r(expr: str, name: str, digits: int = 6) -> str:
    """Round and drop the sign of zero, as the Spark side does."""
    return f"ROUND(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"


def hash_of(cols: str) -> str:
    return f"MD5(CONCAT_WS('|', '42', {cols}))"


def half_up(num: str, den: str) -> str:
    return f"((2 * {num} + {den}) // (2 * {den}))"


def split_views(source: str, by: str, ids: str, fallback: bool, prefix: str = "") -> dict[str, str]:
    """View `<prefix>split` of an exact stratified split by plain row numbers, and the views it needs."""
    part = f"PARTITION BY {by}" if by else ""
    both = "LEAST(n1, n0) >= 2 AND test1 BETWEEN 1 AND n1 - 1 AND test0 BETWEEN 1 AND n0 - 1"
    mode = f"CASE WHEN n0 = 0 OR n1 = 0 OR n < 5 THEN 'p' WHEN {both} THEN 's' ELSE 'r' END" if fallback else "'s'"
    first = ids.split(",")[0]
    comma = f"{by}, " if by else ""
    return {
        f"{prefix}sized": f"""SELECT *, {hash_of(ids)} AS h, COUNT(*) OVER ({part}) AS n,
            COUNT(*) FILTER (WHERE label = 1) OVER ({part}) AS n1, COUNT(*) FILTER (WHERE label = 0) OVER ({part}) AS n0
            FROM {source}""",
        f"{prefix}counted": f"SELECT *, CAST(CEIL(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS nt FROM {prefix}sized",
        f"{prefix}planned": f"""SELECT *, n1 - {half_up('(n1 * (n - nt))', 'n')} AS test1,
            nt - (n1 - {half_up('(n1 * (n - nt))', 'n')}) AS test0 FROM {prefix}counted""",
        f"{prefix}moded": f"SELECT *, {mode} AS split_mode FROM {prefix}planned",
        f"{prefix}split": f"""SELECT *, CAST(CASE
            WHEN split_mode = 'p' THEN ROW_NUMBER() OVER ({part} ORDER BY {first}) > CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT)
            WHEN split_mode = 'r' THEN ROW_NUMBER() OVER ({part} ORDER BY h) <= nt
            ELSE ROW_NUMBER() OVER (PARTITION BY {comma}label ORDER BY h) <= CASE WHEN label = 1 THEN test1 ELSE test0 END
            END AS INT) AS is_test FROM {prefix}moded""",
    }


def ranked(source: str, score: str, by: str = "") -> str:
    """AUC by average ranks."""
    part = f"PARTITION BY {by} " if by else ""
    comma = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {comma}COUNT(*) FILTER (WHERE label = 1) AS n_pos, COUNT(*) FILTER (WHERE label = 0) AS n_neg,
      CASE WHEN COUNT(*) FILTER (WHERE label = 1) > 0 AND COUNT(*) FILTER (WHERE label = 0) > 0 THEN
        (SUM(rk) FILTER (WHERE label = 1) - COUNT(*) FILTER (WHERE label = 1) * (COUNT(*) FILTER (WHERE label = 1) + 1) / CAST(2 AS DOUBLE))
        / (CAST(COUNT(*) FILTER (WHERE label = 1) AS DOUBLE) * COUNT(*) FILTER (WHERE label = 0)) END AS auc
      FROM (SELECT {comma}label, RANK() OVER ({part}ORDER BY {score}) + (COUNT(*) OVER (PARTITION BY {comma}{score}) - 1) / CAST(2 AS DOUBLE) AS rk
            FROM {source}) {group}"""


def cells(by: str = "", source: str = "thresholded") -> str:
    comma = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {comma}COUNT(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, COUNT(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
      COUNT(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, COUNT(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM {source} {group}"""


def div(num: str, den: str) -> str:
    return f"(CASE WHEN {den} > 0 THEN ({num}) / CAST({den} AS DOUBLE) ELSE 0 END)"


SENS, SPEC = div("tp", "(tp + fn)"), div("tn", "(tn + fp)")
P1, P0 = div("tp", "(tp + fp)"), div("tn", "(tn + fn)")
F1, F0 = div("2 * tp", "(2 * tp + fp + fn)"), div("2 * tn", "(2 * tn + fp + fn)")
ACC = div("tp + tn", "(tn + fp + fn + tp)")


def weighted(one: str, zero: str) -> str:
    return div(f"{one} * (tp + fn) + {zero} * (tn + fp)", "(tn + fp + fn + tp)")


def client_eval(source: str, by: str) -> str:
    """Loss and metrics per group, zeroed where one class is missing."""
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"a.{k} = c.{k}" for k in keys)
    head = ", ".join(f"c.{k}" for k in keys)

    def ok(expr: str, name: str, other: str = "0") -> str:
        return f"CASE WHEN a.auc IS NULL THEN CAST({other} AS DOUBLE) ELSE {expr} END AS {name}"

    return f"""SELECT {head}, {ok('1 - a.auc', 'loss', '1')}, tn + fp + fn + tp AS n_samples, {ok('a.auc', 'auc')}, {ok(ACC, 'accuracy')},
      {ok(F1, 'f1')}, {ok(P1, 'precision')}, {ok(SENS, 'recall')}
      FROM ({cells(by, source)}) c JOIN ({ranked(source, 'score', by)}) a ON {on}"""


METRICS = ("auc", "accuracy", "f1", "precision", "recall")
ROUNDED_METRICS = ", ".join(r(m, m) for m in METRICS)


MEAN_METRICS = ", ".join(r(f"SUM({m} * n_samples) / SUM(n_samples)", m) for m in METRICS)
