"""Column expressions: ordinals, derived features, labels and keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordinal codes of the deprivation bands and education levels, and the codes
# of anything else.
BAND_CODES = {
    "0-10%": 0,
    "10-20%": 1,
    "20-30%": 2,
    "30-40%": 3,
    "40-50%": 4,
    "50-60%": 5,
    "60-70%": 6,
    "70-80%": 7,
    "80-90%": 8,
    "90-100%": 9,
}
BAND_OTHER = 5
EDUCATION_CODES = {
    "No Formal quals": 0,
    "Lower Than A Level": 1,
    "A Level or Equivalent": 2,
    "HE Qualification": 3,
    "Post Graduate Qualification": 4,
}
EDUCATION_OTHER = 2


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal(c: str | Column, codes: Mapping[str, int], other: int) -> Column:
    """Code of each listed string, `other` for the rest and for NULL."""
    c = _col(c)
    out = None
    for text, code in codes.items():
        out = F.when(c == text, F.lit(code)) if out is None else out.when(c == text, F.lit(code))
    return out.otherwise(F.lit(other))


def band_ordinal(c: str | Column) -> Column:
    return ordinal(c, BAND_CODES, BAND_OTHER)


def education_ordinal(c: str | Column) -> Column:
    return ordinal(c, EDUCATION_CODES, EDUCATION_OTHER)


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(c)))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den where den > 0, else 0."""
    num, den = _col(num), _col(den)
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def flag(c: str | Column, value: str) -> Column:
    """1 where the column equals `value`, else 0 (also for NULL)."""
    return _col(c).eqNullSafe(F.lit(value)).cast("int")


def client_key(parts: Iterable[str | Column], sep: str = "_", prefix: str = "", clean: bool = False) -> Column:
    """Group key from one or more columns; `clean` trims and turns blanks into underscores."""
    cols = [_col(p) for p in parts]
    if clean:
        cols = [F.replace(F.trim(c), F.lit(" "), F.lit("_")) for c in cols]
    key = F.concat_ws(sep, *cols)
    return F.concat(F.lit(prefix), key) if prefix else key


def label_from_value(c: str | Column, negatives: Iterable[str]) -> Column:
    """0 for the listed values, 1 for everything else, NULL included."""
    return F.when(_col(c).isin(*negatives), F.lit(0)).otherwise(F.lit(1))


def label_from_threshold(c: str | Column, threshold: float) -> Column:
    return F.when(_col(c) >= threshold, F.lit(1)).otherwise(F.lit(0))


def row_hash(cols: Iterable[str], seed: int) -> Column:
    """Portable pseudo-random order of rows: md5 over the seed and the row's key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def unsigned_zero(c: Column) -> Column:
    """Turn -0.0 into 0.0."""
    return c + F.lit(0.0)


def tidy(c: str | Column, digits: int = 6) -> Column:
    """Round to `digits` and drop the sign of zero."""
    return unsigned_zero(F.round(_col(c).cast("double"), digits))
