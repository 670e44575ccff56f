"""Balancing as steps of a pyspark.ml pipeline.

A step is fitted on training rows, which it balances: the stages after it in a `BalancedPipeline` are fitted on the balanced
rows. New rows pass through a fitted step unchanged (`skip`), since they are to be scored, not balanced, and so do the training
rows when they are scored after such a pipeline is fitted; with skip=False it balances whatever it is given. Any other loop
that fits stages would hand the training rows to the step, to go on with what it returns; a step can't tell that from scoring
them, so the very DataFrame that it was fitted on is refused then, rather than passed on unbalanced: `training` has the
balanced rows, and a copy of the DataFrame, as df.select("*"), is scored.

Steps and their models have params, so that they can be copied with others, tuned, saved and loaded; a loaded model has
no training rows.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession

from evenkeel.errors import BalanceError
from evenkeel.operators import balance, checks
from evenkeel.operators.result import BalanceResult

#: The call, its ratios and its neighbour counts by method; the uniform family's defaults are its own.
METHODS = {
    "adasyn": (balance.adasyn, ("ratio",), ("k",)),
    "nearmiss": (balance.nearmiss, ("ratio",), ("k",)),
    "adanear": (balance.adanear, ("adasyn_ratio", "nearmiss_ratio"), ("over_k", "under_k")),
    "adasyn_uniform": (balance.adasyn_uniform, ("ratio",), ("k",)),
    "nearmiss_uniform": (balance.nearmiss_uniform, ("ratio",), ("k",)),
    "adanear_uniform": (balance.adanear_uniform, ("adasyn_ratio", "nearmiss_ratio"), ("over_k", "under_k")),
}


class _Shared(Params):
    """method, outcome, skip, audit, step_id; ratios, neighbours and seed; `options`, all else that the call takes."""

    method = Param(Params._dummy(), "method", "one of METHODS", TypeConverters.toString)
    outcome = Param(Params._dummy(), "outcome", "the target's name, or a list that must name just one column")
    skip = Param(Params._dummy(), "skip", "whether new rows pass unchanged", TypeConverters.toBoolean)
    audit = Param(Params._dummy(), "audit", "whether the training result has diagnostics", TypeConverters.toBoolean)
    step_id = Param(Params._dummy(), "step_id", "the step's name in tidy tables", TypeConverters.toString)
    ratio = Param(Params._dummy(), "ratio", "as of the call")
    adasyn_ratio = Param(Params._dummy(), "adasyn_ratio", "as of the call")
    nearmiss_ratio = Param(Params._dummy(), "nearmiss_ratio", "as of the call")
    k = Param(Params._dummy(), "k", "as of the call")
    over_k = Param(Params._dummy(), "over_k", "as of the call")
    under_k = Param(Params._dummy(), "under_k", "as of the call")
    seed = Param(Params._dummy(), "seed", "as of the call")
    options = Param(Params._dummy(), "options", "further named parameters of the call, as a dict")

    OWN = ("ratio", "adasyn_ratio", "nearmiss_ratio", "k", "over_k", "under_k", "seed")

    def value(self, name: str):
        return self.getOrDefault(name) if self.isDefined(name) else None

    def parameters(self) -> dict:
        """What the call is given."""
        return {n: self.getOrDefault(n) for n in self.OWN if self.isSet(n)} | (self.value("options") or {})

    def check(self) -> None:
        """Raises if a param's value can't be meant."""
        if self.value("method") not in METHODS:
            raise BalanceError(f"method must be one of {tuple(METHODS)}, not {self.value('method')!r}")
        _, ratios, ks = METHODS[self.value("method")]
        p = self.parameters()
        for name in self.OWN:
            if name in p and name not in (*ratios, *ks, "seed"):
                raise BalanceError(f"{self.value('method')} has no {name}")
        for name in set(ratios) & set(p):
            checks.ratio(p[name], name, zero=len(ratios) > 1)
        for name in set(ks) & set(p):
            checks.positive_integer(p[name], name)
        if "seed" in p:
            checks.seed(p["seed"])

    def balanced(self, df: DataFrame, outcome: str) -> BalanceResult:
        self.check()
        if outcome not in df.columns:
            raise BalanceError(f"the outcome {outcome!r} isn't a column")
        if len(df.columns) < 2:
            raise BalanceError("there must be at least one feature besides the outcome")
        return METHODS[self.value("method")][0](df, outcome, audit=self.value("audit"), **self.parameters())


class BalanceStep(_Shared, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, method: str | None = None, outcome: str | list[str] | None = None, skip: bool = True, audit: bool = False, id: str | None = None, **parameters):
        super().__init__()
        self._setDefault(skip=True, audit=False)
        if method is None:  # as when a saved step is read
            return
        own = {n: parameters.pop(n) for n in self.OWN if n in parameters}
        for n in [n for n in own if n not in (*METHODS.get(method, (0, (), ()))[1], *METHODS.get(method, (0, (), ()))[2], "seed")]:
            parameters[n] = own.pop(n)  # the call will say that it has none
        self._set(method=method, outcome=outcome, skip=checks.flag(skip, "skip"), audit=checks.flag(audit, "audit"), step_id=id or f"{method}_{uuid.uuid4().hex[:5]}", options=parameters or None, **own)
        self.check()

    def _fit(self, df: DataFrame) -> BalanceStepModel:
        self.check()
        outcome = self.value("outcome")
        names = [outcome] if isinstance(outcome, str) else list(outcome or [])
        if len(names) != 1:
            raise BalanceError("the selection must pick exactly one outcome")
        if names[0] not in df.columns:
            raise BalanceError(f"the outcome {names[0]!r} isn't a column")
        model = self._copyValues(BalanceStepModel())
        model._set(outcome=names[0])
        model._train = df
        return model

    def fit_resample(self, df: DataFrame) -> DataFrame:
        """The training rows, balanced."""
        return self.fit(df).training().data

    def tidy(self, spark: SparkSession) -> DataFrame:
        """One row of the step's parameters; terms is null before fitting if the outcome isn't one name."""
        outcome = self.value("outcome")
        return _tidy(spark, self, outcome if isinstance(outcome, str) else None, False)

    def __repr__(self):
        return f"BalanceStep({self.value('method')} of {self.value('outcome')})"


class BalanceStepModel(_Shared, Model, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(skip=True, audit=False)
        self._train, self._settled = None, False

    def training(self) -> BalanceResult:
        """The balanced training rows, with diagnostics if the step audits."""
        if self._train is None:
            raise BalanceError("a step that was loaded has no training rows")
        return self.balanced(self._train, self.value("outcome"))

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self.value("skip"):
            return self.balanced(df, self.value("outcome")).data
        if df is self._train and not self._settled:
            raise BalanceError("these are the rows that the step was fitted on: fit later stages by a BalancedPipeline or on training().data, and score a copy of them")
        return df

    def tidy(self, spark: SparkSession) -> DataFrame:
        return _tidy(spark, self, self.value("outcome"), True)

    def __repr__(self):
        return f"BalanceStep({self.value('method')} of {self.value('outcome')}) [trained]"


class BalancedPipeline(Pipeline):
    """A pipeline whose stages after a balancing step are fitted on the balanced rows; what it fits is a plain PipelineModel."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stages, fitted = self.getStages(), []
        last = max((i for i, s in enumerate(stages) if isinstance(s, Estimator)), default=-1)
        for i, stage in enumerate(stages):
            fitted.append(stage.fit(dataset) if isinstance(stage, Estimator) else stage)
            if i < last:
                dataset = fitted[-1].training().data if isinstance(fitted[-1], BalanceStepModel) else fitted[-1].transform(dataset)
        for model in fitted:
            if isinstance(model, BalanceStepModel):
                model._settled = True
        return PipelineModel(fitted)


def _tidy(spark: SparkSession, step: _Shared, terms: str | None, trained: bool) -> DataFrame:
    p = step.parameters()
    value = lambda k: None if p.get(k) is None else float(p[k])
    row = (terms, step.value("method"), value("ratio") if "ratio" in p else value("adasyn_ratio"), value("nearmiss_ratio"), step.value("skip"), trained, step.value("step_id"))
    return spark.createDataFrame([row], "terms string, method string, ratio double, nearmiss_ratio double, skip boolean, trained boolean, id string")


def step_adasyn(outcome, **p) -> BalanceStep:
    return BalanceStep("adasyn", outcome, **p)


def step_nearmiss(outcome, **p) -> BalanceStep:
    return BalanceStep("nearmiss", outcome, **p)


def step_adanear(outcome, **p) -> BalanceStep:
    return BalanceStep("adanear", outcome, **p)


def step_adasyn_uniform(outcome, **p) -> BalanceStep:
    return BalanceStep("adasyn_uniform", outcome, **p)


def step_nearmiss_uniform(outcome, **p) -> BalanceStep:
    return BalanceStep("nearmiss_uniform", outcome, **p)


def step_adanear_uniform(outcome, **p) -> BalanceStep:
    return BalanceStep("adanear_uniform", outcome, **p)


def runtime_report(spark: SparkSession) -> dict:
    """Version, parallelism and the settings that decide how a plan runs."""
    conf = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")
    return {"version": spark.version, "cores": spark.sparkContext.defaultParallelism, "runtime": "spark"} | {k: spark.conf.get(k, None) for k in conf}
