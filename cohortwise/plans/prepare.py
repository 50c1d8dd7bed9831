"""From raw files to cleaned tables and feature rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from cohortwise.operators.cleaning import available_features, clean_table, complete_features, min_group, union_all
from cohortwise.operators.features import build_features
from cohortwise.operators.scaling import standardise
from cohortwise.operators.splitting import stratified_split
from cohortwise.operators.validation import validate
from cohortwise.session import materialise
from cohortwise.sources.specs import DatasetSpec
from cohortwise.sources.tables import read_csv, read_table, run_all, with_ingest_time, write_table


def ingest(spark: SparkSession, specs: Mapping[str, DatasetSpec], raw: str, interim: str) -> dict[str, DataFrame]:
    """CSV files below `raw` to Parquet tables below `interim`, with the ingest time."""

    def one(spec: DatasetSpec) -> DataFrame:
        write_table(with_ingest_time(read_csv(spark, f"{raw}/{spec.file}", spec.schema)), f"{interim}/{spec.name}")
        return read_table(spark, f"{interim}/{spec.name}")

    return run_all(specs, one)


def clean(spark: SparkSession, specs: Mapping[str, DatasetSpec], interim: str, processed: str) -> dict[str, DataFrame]:
    """Interim tables to cleaned tables below `processed`."""

    def one(spec: DatasetSpec) -> DataFrame:
        write_table(clean_table(read_table(spark, f"{interim}/{spec.name}"), spec), f"{processed}/{spec.name}")
        return read_table(spark, f"{processed}/{spec.name}")

    return run_all(specs, one)


def validation_report(tables: Mapping[str, DataFrame], specs: Mapping[str, DatasetSpec], cap: int | None = None) -> DataFrame:
    return union_all([validate(tables[name], name, spec.required, cap) for name, spec in specs.items()])


def feature_table(tables: Mapping[str, DataFrame], out: str, fanout: str = "reference") -> DataFrame:
    """Write the feature table of the cleaned course tables and read it back; no second run for the row count."""
    activity, info, scores = (tables[n] for n in ("student_vle", "student_info", "student_assessment"))
    write_table(build_features(activity, info, scores, tables.get("assessments"), fanout), out)
    return read_table(activity.sparkSession, out)


def client_rows(
    df: DataFrame,
    features: Sequence[str],
    key: str = "client_id",
    id_col: str = "id_student",
    min_rows: int = 20,
    test: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Rows (key, id, label, is_test, features...) of the groups with at least `min_rows` rows.

    Small groups go first, then incomplete rows; what is left is split within each group and scaled
    by the statistics of the group's own training rows. Features that `df` lacks are left out; where it
    has none of them the default ones take their place.
    """
    features = available_features(df, features)
    rows = df.select(key, id_col, "label", *features)
    rows = complete_features(min_group(rows, key, min_rows), [*features, "label"])
    rows = materialise(rows, "complete_rows")
    rows = materialise(stratified_split(rows, id_col, by=[key], test=test, seed=seed, fallback=True), "split_rows")
    return materialise(standardise(rows, features, by=[key]), "client_rows")
