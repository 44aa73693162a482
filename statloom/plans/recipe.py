"""Declarative preprocessing: steps are recorded, ``prep`` fits them in order, ``bake`` applies them to new data.

With a split the steps are fitted on its training rows (fit_on="all" fits them on all rows). Steps that
drop or repeat rows act in ``prep`` only; ``bake`` keeps every row it is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import impute, outliers, resample
from ..operators.ordination import LDA, PCA, RDA
from ..operators.table import clean_categorical, numeric_columns, parse_numeric

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class Step:
    name: str
    fit: Callable[[DataFrame], tuple[Transform, object]]
    rows: bool = False  # drops or repeats rows: not for new data


@dataclass
class Prepped:
    """What prep() gives: the baked training (and test) rows and the fitted steps."""

    data: DataFrame
    train: DataFrame
    test: DataFrame | None
    steps: list[tuple[str, Transform, bool]]
    models: dict[str, object]

    def bake(self, df: DataFrame) -> DataFrame:
        for _, apply, rows in self.steps:
            if not rows:
                df = apply(df)
        return df


@dataclass
class Recipe:
    data: DataFrame
    x: list[str]
    y: str | None = None
    key: str = "_row_id"
    steps: list[Step] = field(default_factory=list)
    _split: dict | None = None

    def _add(self, name: str, fit: Callable, rows: bool = False) -> Recipe:
        self.steps.append(Step(name, fit, rows))
        return self

    def _plain(self, name: str, apply: Transform, rows: bool = False) -> Recipe:
        return self._add(name, lambda df: (apply, None), rows)

    def parse_numeric(self, columns: list[str]) -> Recipe:
        return self._plain("parse_numeric", lambda df: parse_numeric(df, columns))

    def clean(self, valid: dict[str, list]) -> Recipe:
        return self._plain("clean", lambda df: clean_categorical(df, valid), True)

    def one_hot(self, columns: list[str], drop_first: bool = True, prefix: bool = True) -> Recipe:
        def fit(df):
            e = ft.OneHotEncoder.fit(df, columns, drop_first=drop_first, prefix=prefix)
            return e.transform, e

        return self._add("one_hot", fit)

    def scale(self, columns: list[str], method: str = "standard") -> Recipe:
        def fit(df):
            s = ft.Scaler.standard(df, columns) if method == "standard" else ft.Scaler.minmax(df, columns)
            return s.transform, s

        return self._add("scale", fit)

    def _ordination(self, name: str, make: Callable, columns: list[str], prefix: str) -> Recipe:
        def fit(df):
            m = make(df)
            return (lambda d: m.transform(d, prefix=prefix).drop(*columns)), m

        return self._add(name, fit)

    def pca(self, columns: list[str], components: int | None = None, scale: bool = True) -> Recipe:
        return self._ordination("pca", lambda df: PCA.fit(df, columns, scale, components), columns, "PC")

    def lda(self, columns: list[str], components: int | None = None) -> Recipe:
        return self._ordination("lda", lambda df: LDA.fit(df, columns, self.y, components), columns, "LD")

    def rda(self, responses: list[str], explanatory: list[str]) -> Recipe:
        return self._ordination("rda", lambda df: RDA.fit(df, responses, explanatory), responses, "RDA")

    def _impute(self, strategy: str, columns: list[str]) -> Recipe:
        def fit(df):
            m = impute.SimpleImputer.fit(df, columns, strategy, order=self.key if self.key in df.columns else None)
            return m.transform, m

        return self._add(f"impute_{strategy}", fit)

    def impute_mean(self, columns: list[str]) -> Recipe:
        return self._impute("mean", columns)

    def impute_median(self, columns: list[str]) -> Recipe:
        return self._impute("median", columns)

    def impute_mode(self, columns: list[str]) -> Recipe:
        return self._impute("most_frequent", columns)

    def impute_knn(self, columns: list[str], k: int = 5) -> Recipe:
        def fit(df):
            m = impute.KNNImputer.fit(df, columns, self.key, k)
            return (lambda d: m.transform(d, self.key)), m

        return self._add("impute_knn", fit)

    def impute_iterative(self, columns: list[str], max_iter: int = 10, tol: float = 1e-3) -> Recipe:
        def fit(df):
            m = impute.IterativeImputer.fit(df, columns, max_iter=max_iter, tol=tol)
            return m.transform, m

        return self._add("impute_iterative", fit)

    def remove_outliers(self, columns: list[str], method: str = "mahalanobis", contamination: float = 0.1) -> Recipe:
        def fit(df):
            if method == "mahalanobis":
                m = outliers.Mahalanobis.fit(df, columns, contamination)
                return (lambda d: m.label(d, "__o").filter("__o = 1").drop("__o")), m
            if method == "isolation_forest":
                m = outliers.IsolationForest.fit(df, columns, self.key, contamination=contamination)
                return (lambda d: m.label(d, "__o").filter("__o = 1").drop("__o")), m
            if method == "lof":
                labels = outliers.local_outlier_factor(df, columns, self.key, contamination=contamination)
                return (lambda d: outliers.write_labels(d, labels, self.key, "outlier").filter("outlier = 1").drop("outlier")), None
            raise ValueError(f"unknown method {method!r}")

        return self._add("remove_outliers", fit, True)

    def clip_outliers(self, columns: list[str], factor: float = 1.5) -> Recipe:
        def fit(df):
            c = ft.Clipper.fit(df, columns, factor)
            return c.transform, c

        return self._add("clip_outliers", fit)

    def interactions(self, columns: list[str]) -> Recipe:
        return self._plain("interactions", lambda df: ft.interactions(df, columns))

    def polynomial(self, columns: list[str], degree: int = 2) -> Recipe:
        def apply(df):
            for c in columns:
                df = ft.powers(df, c, degree)
            return df

        return self._plain("polynomial", apply)

    def bin(self, columns: list[str], bins: int = 5) -> Recipe:
        def fit(df):
            made = [ft.EqualWidthBins.fit(df, c, bins) for c in columns]

            def apply(d):
                for b in made:
                    d = b.transform(d)
                return d

            return apply, made

        return self._add("bin", fit)

    def upsample(self, target: float = 1.0, seed: int = 42) -> Recipe:
        return self._plain("upsample", lambda df: resample.upsample(df, self.y, [self.key], target, seed), True)

    def downsample(self, ratio: float | None = None, seed: int = 42) -> Recipe:
        return self._plain("downsample", lambda df: resample.downsample(df, self.y, [self.key], ratio, seed), True)

    def _select(self, name: str, choose: Callable) -> Recipe:
        def fit(df):
            have = [c for c in numeric_columns(df) if c not in (self.y, self.key)]
            keep = choose(df, have)
            gone = [c for c in have if c not in keep]
            return (lambda d: d.drop(*gone)), keep

        return self._add(name, fit)

    def select_by_variance(self, threshold: float = 0.0) -> Recipe:
        return self._select("select_by_variance", lambda df, cs: ft.varying(df, cs, threshold))

    def select_by_correlation(self, threshold: float = 0.95) -> Recipe:
        return self._select("select_by_correlation", lambda df, cs: ft.uncorrelated(df, cs, threshold))

    def split(self, ratio: float = 0.7, shuffle: bool = True, seed: int = 42) -> Recipe:
        self._split = {"ratio": ratio, "shuffle": shuffle, "seed": seed}
        return self

    def prep(self, fit_on: str = "train") -> Prepped:
        train, test = self.data, None
        if self._split and fit_on == "train":
            marked = resample.train_test_split(self.data, [self.key], **self._split)
            train, test = (marked.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
        fitted, models = [], {}
        for i, step in enumerate(self.steps):
            apply, model = step.fit(train)
            train = apply(train)
            if test is not None and not step.rows:
                test = apply(test)
            fitted.append((step.name, apply, step.rows))
            if model is not None:
                models[f"{i}_{step.name}"] = model
        data = train
        if self._split and fit_on == "all":
            marked = resample.train_test_split(train, [self.key], **self._split)
            train, test = (marked.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
        return Prepped(data, train, test, fitted, models)

    def summary(self) -> str:
        lines = [f"recipe: y = {self.y}, x = {', '.join(self.x)}"]
        lines += [f"  {i + 1}. {s.name}" for i, s in enumerate(self.steps)]
        return "\n".join(lines + ([f"  split: {self._split}"] if self._split else []))
