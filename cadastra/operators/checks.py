"""Guards: required columns, unique keys, row counts and source statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from cadastra.session import observed_stage


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return sorted(set(after.columns) - set(before.columns))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def has_unique_keys(df: DataFrame, keys: list[str]) -> bool:
    return duplicate_keys(df, keys).isEmpty()


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_same_rows(before: int, after: int) -> None:
    """The fan-out guard of left joins."""
    if before != after:
        raise ValueError(f"row count changed by joins: before={before}, after={after}; a joined key is not unique")


class RowGuard:
    """Rows before and after joins, counted by the pass that writes the result.

    Put ``before`` on the rows that the joins start from and ``after`` on their
    result; once that is written, ``counts`` has both and ``check`` refuses a
    result whose joins changed the number of rows.
    """

    def __init__(self) -> None:
        self._before, self._after = Observation(), Observation()

    def before(self, df: DataFrame) -> DataFrame:
        return df.observe(self._before, F.count(F.lit(1)).alias("rows"))

    def after(self, df: DataFrame) -> DataFrame:
        return df.observe(self._after, F.count(F.lit(1)).alias("rows"))

    def counts(self) -> tuple[int, int]:
        return self._before.get["rows"], self._after.get["rows"]

    def check(self) -> None:
        require_same_rows(*self.counts())


def split_counts(df: DataFrame, year: str, first_test_year: int) -> DataFrame:
    """Rows on either side of a time split, in one pass."""
    return df.agg(
        F.count_if(F.col(year) < first_test_year).alias("train_rows"),
        F.count_if(F.col(year) >= first_test_year).alias("test_rows"),
    )


def time_split(df: DataFrame, year: str, first_test_year: int) -> tuple[DataFrame, DataFrame]:
    """Train rows before the year, test rows from it on; neither may be empty."""
    counts = split_counts(df, year, first_test_year).first()
    _require_split(counts["train_rows"], counts["test_rows"])
    return df.where(F.col(year) < first_test_year), df.where(F.col(year) >= first_test_year)


def _require_split(train_rows: int, test_rows: int) -> None:
    if not train_rows or not test_rows:
        raise ValueError("the time split leaves no train or no test rows")


def staged_split(df: DataFrame, year: str, first_test_year: int) -> tuple[DataFrame, DataFrame, dict[str, object]]:
    """``time_split`` of a table that is written first; the pass that writes it counts both sides and finds the last year."""
    before = F.col(year) < first_test_year
    table, seen = observed_stage(df, train_rows=F.count_if(before), test_rows=F.count_if(~before), last_year=F.max(year))
    _require_split(seen["train_rows"], seen["test_rows"])
    return table.where(before), table.where(~before), seen


def usable_numeric_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least one value, found in one aggregate over all of them."""
    if not columns:
        return []
    row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]
