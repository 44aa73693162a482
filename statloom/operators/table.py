"""Table verbs: projections, filters, missing values, write-back, numeric parsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import is_numeric, normalize
from .features import LabelEncoder, OneHotEncoder

#: What a number at the start of a text looks like.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def columns_of(df: DataFrame) -> list[str]:
    return df.columns


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if is_numeric(k)]


def to_matrix(df: DataFrame, columns: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Columns (default: all numeric ones) as doubles, or as one array column ``name``."""
    columns = columns or numeric_columns(df)
    kinds = dict(df.dtypes)
    if bad := [c for c in columns if not is_numeric(kinds[c])]:
        raise ValueError(f"not numeric: {bad}")
    cast = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(F.array(*cast).alias(name)) if name else df.select(*cast)


def to_vector(df: DataFrame, column: str) -> DataFrame:
    return df.select(column)


def to_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One array per column, for tables that are small by construction."""
    return df.agg(*[F.collect_list(c).alias(c) for c in columns])


def number_range(spark: SparkSession, start: float, stop: float, step: float = 1) -> DataFrame:
    """start, start + step, ... up to stop, which is included if it is met; descending with a negative step."""
    if step == 0:
        raise ValueError("a step of 0 goes nowhere")
    n = max(0, int((stop - start) / step + 1e-9) + 1) if (stop - start) / step >= 0 else 0
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * float(step)).alias("value"))


def keep(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(condition)


def keep_by(df: DataFrame, columns: list[str], predicate) -> DataFrame:
    """Rows for which ``predicate``, a function of a pandas DataFrame of ``columns`` giving booleans, holds."""

    @F.pandas_udf("boolean")
    def test(*series):
        import pandas as pd

        return pd.Series(predicate(pd.concat(series, axis=1, keys=columns)), dtype="boolean")

    return df.filter(test(*[F.col(c) for c in columns]))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in order; one that ``df`` lacks is NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])


def write_back(df: DataFrame, values: DataFrame, key: str = "_row_id") -> DataFrame:
    """``df`` with the columns of ``values`` put in by key, replacing those of the same name."""
    new = [c for c in values.columns if c != key]
    return df.drop(*new).join(values, key, "left")


def na_policy(na_omit: bool | None = None, omit_missing: bool | None = None) -> bool:
    """One answer from two spellings; the first wins, and leaving rows out is the default."""
    return na_omit if na_omit is not None else omit_missing if omit_missing is not None else True


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in ``columns``."""
    return normalize(df).dropna(subset=columns)


def parse_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers at the start of texts as doubles ("12abc" is 12); NULL where there is none."""
    return df.withColumns({c: F.expr(f"try_cast(nullif(regexp_extract(cast(`{c}` as string), '{NUMBER.replace(chr(92), chr(92) * 2)}', 1), '') as double)") for c in columns})


def clean_categorical(df: DataFrame, valid: dict[str, list]) -> DataFrame:
    """Rows whose every listed column has one of its valid categories; NULL is never valid."""
    for c, values in valid.items():
        df = df.filter(F.coalesce(F.col(c).isin(values), F.lit(False)))
    return df


@dataclass
class Prepared:
    """A model's inputs: the table with ``x`` (and ``y``) columns ready, other columns kept for lineage."""

    data: DataFrame
    x: list[str]
    y: str | None
    encoders: dict


def prepare(df: DataFrame, x: list[str], y: str | None = None, na_omit: bool = True, encode: dict[str, str] | None = None, encoders: dict | None = None) -> Prepared:
    """Check, drop rows with missing values, encode. encode: "label" or "onehot" by column; text y is label-encoded.

    encoders: fitted ones of an earlier call, used again.
    """
    if missing := [c for c in (*x, *([y] if y else [])) if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    df, encode, fitted, names = normalize(df), dict(encode or {}), dict(encoders or {}), []
    if na_omit:
        df = df.dropna(subset=[*x, *([y] if y else [])])
    kinds = dict(df.dtypes)
    if y and not is_numeric(kinds[y]):
        if encode.get(y, "label") != "label":
            raise ValueError("a response can only be label-encoded")
        encode[y] = "label"
    for c in (*x, *([y] if y else [])):
        how = encode.get(c)
        if how is None:
            if not is_numeric(kinds[c]):
                raise ValueError(f"{c} is not numeric and has no encoding")
            made = [c]
        elif how == "label":
            enc = fitted.setdefault(c, None) or LabelEncoder.fit(df, c)
            fitted[c], df, made = enc, enc.transform(df, c, f"{c}_idx"), [f"{c}_idx"]
        else:
            enc = fitted.setdefault(c, None) or OneHotEncoder.fit(df, [c])
            fitted[c], df, made = enc, enc.transform(df, keep=True), enc.names()
        if c == y:
            y = made[0]
        else:
            names += made
    return Prepared(df, names, y, fitted)


@dataclass
class Preprocessor:
    """Parsing, cleaning, label- and one-hot-encoding in this order, with the encoders that were fitted."""

    numeric: list[str]
    valid: dict[str, list]
    labels: dict[str, LabelEncoder]
    one_hot: OneHotEncoder | None
    removed: int = 0

    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str] = (), valid: dict[str, list] | None = None, label: list[str] = (), one_hot: list[str] = (), drop_first: bool = False) -> Preprocessor:
        n = df.count() if valid else 0
        df = clean_categorical(parse_numeric(df, list(numeric)), valid or {})
        hot = OneHotEncoder.fit(df, list(one_hot), drop_first=drop_first) if one_hot else None
        return cls(list(numeric), valid or {}, {c: LabelEncoder.fit(df, c) for c in label}, hot, n - df.count() if valid else 0)

    def transform(self, df: DataFrame) -> DataFrame:
        df = clean_categorical(parse_numeric(df, self.numeric), self.valid)
        for c, e in self.labels.items():
            df = e.transform(df, c, f"{c}_idx")
        return self.one_hot.transform(df) if self.one_hot else df


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows by the smallest hashes of a unique key (a sampling operator)."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
