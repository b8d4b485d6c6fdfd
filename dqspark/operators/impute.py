"""Filling missing values: baselines, learned strategies, a benchmark, group modes, and the engine."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dqspark.functions.hashing import order_key
from dqspark.operators import boosting, evidence
from dqspark.operators.contract import SEQ
from dqspark.operators.lookup import look_up
from dqspark.operators.metrics import macro_f1
from dqspark.operators.missing import diagnose, missing_profile
from dqspark.operators.neighbors import nearest
from dqspark.operators.ranking import stratified_split
from dqspark.operators.report import next_version
from dqspark.sources.durable import pin

# --- fixed values -------------------------------------------------------------
NEIGHBOURS = 5
TEST_SHARE = 0.2
SEED = 42
PROCESSING_ORDER = (
    "company_size", "country", "state", "city", "zip_code", "description", "address",
)
BENCHMARKED = {
    "company_size": (("state", "country", "city"), "ordinal"),
    "country": (("state", "city", "zip_code", "company_size"), "categorical"),
}
GROUP_MODE = {
    "state": ("country",),
    "city": ("state", "country"),
    "zip_code": ("state", "country"),
}
SKIPPED = ("address", "description")
# ------------------------------------------------------------------------------
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _smallest_most_frequent(value: str, count: str) -> Column:
    return F.min_by(F.col(value), F.struct((-F.col(count)).alias("c"), F.col(value).alias("v")))


def median_of(df: DataFrame, target: str) -> DataFrame:
    """One row: the median of known codes, rounded half to even."""
    return df.agg(F.bround(F.median(target)).cast("bigint").alias("fill"))


def mode_of(df: DataFrame, target: str) -> DataFrame:
    """One row: the most frequent known value, the smallest on a tie."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(_smallest_most_frequent(target, "n").alias("fill"))


def frequency_shares(train: DataFrame, column: str) -> DataFrame:
    """(value, share among non-null training rows)."""
    known = train.filter(F.col(column).isNotNull())
    total = known.agg(F.count(F.lit(1)).alias("t"))
    counts = known.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("value", (F.col("n") / total.scalar()).alias("share"))


@dataclass
class Encoder:
    """Predictors as numbers: text by its training share (unseen and null 0), numbers as they are.

    A missing number takes the training mean.
    """

    predictors: tuple[str, ...]
    shares: dict[str, DataFrame] = field(default_factory=dict)
    means: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, predictors: tuple[str, ...]) -> Encoder:
        kinds = dict(train.dtypes)
        enc = cls(tuple(predictors))
        for p in predictors:
            if kinds[p] in _NUMERIC:
                enc.means[p] = train.agg(F.coalesce(F.avg(p), F.lit(0.0)).alias("m"))
            else:
                enc.shares[p] = frequency_shares(train, p)
        return enc

    def save(self, path: str) -> None:
        for p, shares in self.shares.items():
            shares.write.parquet(f"{path}/shares-{p}")
        for p, mean in self.means.items():
            mean.coalesce(1).write.parquet(f"{path}/mean-{p}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, predictors: tuple[str, ...], numbers: list[str]) -> Encoder:
        return cls(
            tuple(predictors), {p: spark.read.parquet(f"{path}/shares-{p}") for p in predictors if p not in numbers},
            {p: spark.read.parquet(f"{path}/mean-{p}") for p in numbers})

    @property
    def axes(self) -> list[str]:
        return [f"x_{p}" for p in self.predictors]

    def transform(self, df: DataFrame) -> DataFrame:
        for p in self.predictors:
            if p in self.shares:
                shares = self.shares[p].select(F.col("value").alias(p), F.col("share").alias(f"__s_{p}"))
                df = look_up(df, shares, p).withColumn(
                    f"x_{p}", F.coalesce(F.col(f"__s_{p}"), F.lit(0.0))
                ).drop(f"__s_{p}")
            else:
                df = df.withColumn(f"x_{p}", F.coalesce(F.col(p).cast("double"), self.means[p].scalar()))
        return df


def class_codes(train: DataFrame, target: str) -> DataFrame:
    """(__class, __code): position of each known class in sorted order; one row per class."""
    classes = train.filter(F.col(target).isNotNull()).select(F.col(target).alias("__class")).distinct()
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__class"))
    return classes.select("__class", (place - 1).cast("double").alias("__code"))


def _to_class(df: DataFrame, raw_code: Column, codes: DataFrame) -> DataFrame:
    """Round half to even, clip to known codes, translate back."""
    top = codes.agg(F.max("__code")).scalar()
    code = F.least(F.greatest(F.rint(raw_code), F.lit(0.0)), top)
    names = codes.select(F.col("__class").alias("predicted"), F.col("__code").alias("__c"))
    return look_up(df.withColumn("__c", code), names, "__c").drop("__c")


def _coded(known: DataFrame, target: str, codes: DataFrame) -> DataFrame:
    """Known rows with the ``__code`` of their class."""
    return look_up(known, codes.withColumnRenamed("__class", target), target, "inner")


class Baseline:
    """Median for ordinal targets, mode for nominal ones."""

    def __init__(self, name: str):
        self.name = name

    def fit(self, known, target, predictors, key):
        self.fill = (median_of if self.name == "median" else mode_of)(known, target)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("predicted", self.fill.scalar())

    def save(self, path: str) -> dict:
        self.fill.coalesce(1).write.parquet(f"{path}/fill")
        return {}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> Baseline:
        out = cls(meta["winner"])
        out.fill = spark.read.parquet(f"{path}/fill")
        return out


class _Encoded:
    """What the strategies on encoded predictors keep: class codes and the encoder."""

    def _prepare(self, known: DataFrame, target: str, predictors: tuple[str, ...]) -> DataFrame:
        self.codes = pin(class_codes(known, target), "codes")
        self.encoder = Encoder.fit(known, predictors)
        return self.encoder.transform(_coded(known, target, self.codes))

    def _save(self, path: str) -> dict:
        self.codes.write.parquet(f"{path}/codes")
        self.encoder.save(path)
        return {"predictors": list(self.encoder.predictors), "numbers": list(self.encoder.means)}

    @classmethod
    def _load(cls, spark: SparkSession, path: str, meta: dict):
        out = cls()
        out.codes = spark.read.parquet(f"{path}/codes")
        out.encoder = Encoder.load(spark, path, tuple(meta["predictors"]), meta["numbers"])
        return out


class KNearest(_Encoded):
    name = "knn"

    def fit(self, known, target, predictors, key):
        self.train = self._prepare(known, target, predictors).select(
            *self.encoder.axes, "__code", order_key(SEED, F.col(key)).alias("__o")
        )
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        encoded = self.encoder.transform(rows)
        axes = self.encoder.axes
        means = nearest(self.train, encoded, axes, "__code", "__o", NEIGHBOURS)
        joined = encoded.join(means, axes, "left")
        return _to_class(joined, F.col("mean"), self.codes).select(*rows.columns, "predicted")

    def save(self, path: str) -> dict:
        self.train.write.parquet(f"{path}/train")
        return self._save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> KNearest:
        out = cls._load(spark, path, meta)
        out.train = spark.read.parquet(f"{path}/train")
        return out


class Ridge(_Encoded):
    """Bayesian ridge regression: what chained regression is with only the target missing."""

    name = "ridge"

    def fit(self, known, target, predictors, key):
        self.model = evidence.fit(self._prepare(known, target, predictors), self.encoder.axes, "__code")
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        scored = self.encoder.transform(rows)
        return _to_class(scored, self.model.predict(), self.codes).select(*rows.columns, "predicted")

    def save(self, path: str) -> dict:
        return self._save(path) | {"ridge": self.model.to_json()}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> Ridge:
        out = cls._load(spark, path, meta)
        out.model = evidence.EvidenceRidge.from_json(meta["ridge"])
        return out


class Trees:
    """Boosted trees; a text predictor gives its value, a number its place between quantiles.

    Unseen values count as missing, and every cut has learned which side those go to.
    """

    name = "boosted"

    def __init__(self, rounds: int = boosting.ROUNDS, depth: int = boosting.DEPTH, rate: float = boosting.RATE):
        self.rounds, self.depth, self.rate = rounds, depth, rate

    def fit(self, known, target, predictors, key):
        self.codes = pin(class_codes(known, target), "codes")
        kinds = dict(known.dtypes)
        self.predictors = tuple(predictors)
        self.edges = {p: boosting.number_edges(known, p) for p in predictors if kinds[p] in _NUMERIC}
        self.levels = {p: pin(boosting.text_bins(known, p), "bins") for p in predictors if p not in self.edges}
        binned = self._binned(_coded(known, target, self.codes)).select("bins", F.col("__code").cast("int").alias("class"))
        self.booster = boosting.fit(
            binned, self.codes.count(), [p in self.levels for p in predictors], self.rounds, self.depth, self.rate)
        return self

    def _binned(self, rows: DataFrame) -> DataFrame:
        own = rows.columns
        for i, p in enumerate(self.predictors):
            if p in self.levels:
                met = self.levels[p].select(F.col("value").alias(p), F.col("bin").alias(f"__b{i}"))
                rows = look_up(rows, met, p).withColumn(f"__b{i}", F.coalesce(f"__b{i}", F.lit(0)))
            else:
                rows = rows.withColumn(f"__b{i}", boosting.number_bin(F.col(p), self.edges[p]))
        return rows.select(*own, F.array(*[F.col(f"__b{i}").cast("int") for i in range(len(self.predictors))]).alias("bins"))

    def predict(self, rows: DataFrame) -> DataFrame:
        scored = self._binned(rows).withColumn("__y", self.booster.best(F.col("bins")))
        return _to_class(scored, F.col("__y").cast("double"), self.codes).select(*rows.columns, "predicted")

    def save(self, path: str) -> dict:
        self.codes.write.parquet(f"{path}/codes")
        for p, levels in self.levels.items():
            levels.write.parquet(f"{path}/levels-{p}")
        self.booster.save(self.codes.sparkSession, f"{path}/booster")
        return {"predictors": list(self.predictors), "edges": self.edges}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> Trees:
        out = cls()
        out.predictors, out.edges = tuple(meta["predictors"]), meta["edges"]
        out.codes = spark.read.parquet(f"{path}/codes")
        out.levels = {p: spark.read.parquet(f"{path}/levels-{p}") for p in out.predictors if p not in out.edges}
        out.booster = boosting.Booster.load(spark, f"{path}/booster")
        return out


class GroupMode:
    """Most frequent value per group with the overall mode behind it."""

    name = "group_mode"

    def fit(self, df: DataFrame, target: str, groups: tuple[str, ...]):
        self.target, self.groups = target, tuple(groups)
        self.modes, self.overall = pin(fit_group_mode(df, target, groups), "modes"), mode_of(df, target)
        return self

    def fill(self, df: DataFrame) -> DataFrame:
        return apply_group_mode(df, self.target, self.groups, self.modes, self.overall)

    def save(self, path: str) -> dict:
        self.modes.write.parquet(f"{path}/modes")
        self.overall.coalesce(1).write.parquet(f"{path}/overall")
        return {"groups": list(self.groups)}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> GroupMode:
        out = cls()
        out.target, out.groups = meta["column"], tuple(meta["groups"])
        out.modes, out.overall = spark.read.parquet(f"{path}/modes"), spark.read.parquet(f"{path}/overall")
        return out


def build_strategies(kind: str) -> list:
    """Baseline of the kind, then the learned strategies, in tie-break order."""
    return [Baseline("median" if kind == "ordinal" else "mode"), KNearest(), Ridge(), Trees()]


def class_coverage(known: DataFrame, target: str) -> DataFrame:
    """total, evaluated (two or more rows), singleton classes, ratio."""
    counts = known.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("total_classes"), F.count_if(F.col("n") >= 2).alias("evaluated_classes")
    ).select(
        "total_classes", "evaluated_classes",
        (F.col("total_classes") - F.col("evaluated_classes")).alias("singleton_classes"),
        F.when(F.col("total_classes") == 0, 0.0)
        .otherwise(F.col("evaluated_classes") / F.col("total_classes")).alias("coverage_ratio"),
    )


def benchmark(
    known: DataFrame, target: str, predictors: tuple[str, ...], kind: str, key: str,
    strategies: list | None = None,
) -> dict:
    """Hide a fifth of the known values and score every strategy by macro-F1 on it."""
    split = pin(
        stratified_split(known.select(key, target, *predictors), target, key, TEST_SHARE, SEED), "split"
    )
    train, test = split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")
    scores = {}
    for strategy in strategies or build_strategies(kind):
        predicted = strategy.fit(train, target, predictors, key).predict(test)
        scores[strategy.name] = macro_f1(predicted, target, "predicted").first()["macro_f1"] or 0.0
    winner = max(scores, key=scores.get)  # the first of equals
    coverage = class_coverage(known, target).first().asDict()
    return {"scores": scores, "winner": winner, "class_coverage": coverage}


def fit_group_mode(df: DataFrame, target: str, groups: tuple[str, ...]) -> DataFrame:
    """(groups..., mode, n): most frequent known value per complete group key."""
    known = df.filter(F.col(target).isNotNull())
    for g in groups:
        known = known.filter(F.col(g).isNotNull())
    counts = known.groupBy(*groups, target).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*groups).agg(
        _smallest_most_frequent(target, "n").alias("mode"), F.sum("n").alias("n")
    )


def apply_group_mode(df: DataFrame, target: str, groups: tuple[str, ...], modes: DataFrame, overall: DataFrame) -> DataFrame:
    """Own value, else the group's mode, else the overall mode; a null key matches no group."""
    named = modes.select(*groups, F.col("mode").alias("__mode"))
    filled = F.coalesce(F.col(target), F.col("__mode"), overall.scalar())
    return look_up(df, named, list(groups)).withColumn(target, filled).select(*df.columns)


def fill_group_mode(df: DataFrame, target: str, groups: tuple[str, ...]) -> DataFrame:
    """Fit on the table itself and fill it."""
    return apply_group_mode(df, target, groups, fit_group_mode(df, target, groups), mode_of(df, target))


def group_mode_coverage(df: DataFrame, target: str, groups: tuple[str, ...]) -> DataFrame:
    """missing rows, those whose group has a mode, and their ratio (null when none is missing)."""
    modes = fit_group_mode(df, target, groups).select(*groups, F.lit(1).alias("__hit"))
    missing = look_up(df.filter(F.col(target).isNull()), modes, list(groups))
    return missing.agg(
        F.count(F.lit(1)).alias("missing"), F.count("__hit").alias("group_hits")
    ).withColumn("hit_rate", F.when(F.col("missing") > 0, F.col("group_hits") / F.col("missing")))


def limitation(coverage: dict) -> str | None:
    """What a benchmark score says nothing about."""
    singles, total = coverage["singleton_classes"], coverage["total_classes"]
    if not singles:
        return None
    return (
        f"untested: {singles} of {total} values occur once and can only be trained on; "
        f"the score speaks for the other {coverage['evaluated_classes']}"
    )


REPORT = (
    "column string, decision string, diagnosis string, missing_count bigint, missing_ratio double, "
    "scores map<string,double>, winner string, winner_score double, total_classes bigint, "
    "evaluated_classes bigint, singleton_classes bigint, coverage_ratio double, hit_rate double, "
    "known_limitation string, model_version string, registered_new_version boolean, artifact string"
)


def fill_holes(df: DataFrame, column: str, strategy) -> DataFrame:
    """The table with nulls of the column predicted by a fitted strategy; known values stay."""
    kind = dict(df.dtypes)[column]
    filled = strategy.predict(df.filter(F.col(column).isNull()))
    return df.filter(F.col(column).isNotNull()).unionByName(
        filled.withColumn(column, F.col("predicted").cast(kind)).select(*df.columns))


def run_engine(
    df: DataFrame, key: str = "company_id", strategies: dict | None = None, store: ImputerStore | None = None
) -> tuple[DataFrame, DataFrame]:
    """(filled table, report) over the columns with nulls, in dependency order.

    Diagnoses look at the table as it came; each fill sees the earlier ones.
    The table is written once after every learned fill, so a lost executor
    never repeats a model fit.  With a store, every fitted model goes there and
    the report names its version and folder.
    """
    profile = {r["column"]: r for r in missing_profile(df).collect()}
    holes = [c for c in df.columns if c in profile and profile[c]["missing_count"] > 0]
    ordered = [c for c in PROCESSING_ORDER if c in holes] + [c for c in holes if c not in PROCESSING_ORDER]
    verdicts = {r["column"]: r["verdict"] for r in diagnose(df, holes).collect()} if holes else {}
    entries = []
    for col in ordered:
        entry = {
            "column": col, "diagnosis": verdicts[col],
            "missing_count": profile[col]["missing_count"], "missing_ratio": profile[col]["missing_ratio"],
        }
        all_null = df.filter(F.col(col).isNotNull()).isEmpty()
        if all_null and (col in BENCHMARKED or col in GROUP_MODE):
            entry["decision"] = "left null: no known value to learn from"
        elif col in BENCHMARKED:
            winner, more = _benchmarked(df, col, key, (strategies or {}).get(col))
            entry |= more | (store.save(col, winner) if store else {})
            df = pin(fill_holes(df, col, winner), f"fill-{col}")
        elif col in GROUP_MODE:
            groups = GROUP_MODE[col]
            entry["decision"] = f"most frequent value per {' + '.join(groups)}"
            entry["hit_rate"] = group_mode_coverage(df, col, groups).first()["hit_rate"]
            modes = GroupMode().fit(df, col, groups)
            entry |= store.save(col, modes) if store else {}
            df = pin(modes.fill(df), f"fill-{col}")
        elif col in SKIPPED:
            entry["decision"] = "left null on purpose"
        else:
            entry["decision"] = "left null: nothing set up for this column"
        entries.append(entry)
    fields = [f.split()[0] for f in REPORT.split(", ")]
    rows = [tuple(e.get(f) for f in fields) for e in entries]
    return df, df.sparkSession.createDataFrame(rows, REPORT)


def _benchmarked(df: DataFrame, col: str, key: str, strategies: list | None) -> tuple[object, dict]:
    """The winner of the benchmark, fitted on all known rows, and its part of the report."""
    predictors, kind = BENCHMARKED[col]
    known = df.filter(F.col(col).isNotNull())
    candidates = strategies or build_strategies(kind)
    result = benchmark(known, col, predictors, kind, key, candidates)
    winner = next(s for s in candidates if s.name == result["winner"])
    winner.fit(known.select(key, col, *predictors), col, predictors, key)
    coverage = result["class_coverage"]
    return winner, {
        "decision": "benchmarked", "scores": result["scores"], "winner": result["winner"],
        "winner_score": result["scores"][result["winner"]], **coverage,
        "known_limitation": limitation(coverage),
    }


VERSIONS = "model string, version string, winner string, registered boolean, path string, place bigint"


class ImputerStore:
    """Fitted imputation models by column, under one folder every executor can reach.

    Each save makes a folder of its own, holding the model's tables and one row of
    metadata.  The index gets a row after the folder is complete, so a save that
    breaks off is never read.  A new version is counted only when the winner of a
    column changed; ``version`` asks for the model saved when it was registered,
    otherwise the newest save counts.
    """

    KINDS = {"knn": KNearest, "ridge": Ridge, "boosted": Trees, "group_mode": GroupMode, "median": Baseline, "mode": Baseline}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> DataFrame:
        """One row per save."""
        empty = self.spark.createDataFrame([], VERSIONS)
        if not self._there():
            return empty
        return self.spark.read.schema(VERSIONS).parquet(f"{self.folder}/index")

    def _there(self) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/index")
        return path.getFileSystem(conf).exists(path)

    def save(self, column: str, strategy) -> dict:
        """Write a fitted strategy; version, whether it is new, and folder."""
        known = self.versions()
        version, new = next_version(known.filter("registered"), column, strategy.name)
        path = f"{self.folder}/models/{column}-{uuid.uuid4().hex}"
        meta = strategy.save(path) | {"column": column, "winner": strategy.name, "version": version}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/metadata")
        row = [(column, version, strategy.name, new, path, known.count())]
        self.spark.createDataFrame(row, VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.folder}/index")
        return {"model_version": version, "registered_new_version": new, "artifact": path}

    def load(self, column: str, version: str | None = None):
        """(fitted strategy, metadata) of a column; None if there is none."""
        rows = self.versions().filter(F.col("model") == column)
        if version is not None:
            rows = rows.filter("registered").filter(F.col("version") == version)
        row = rows.orderBy(F.desc("place")).first()
        if row is None:
            return None
        meta = json.loads(self.spark.read.parquet(f"{row['path']}/metadata").first()["meta"])
        return self.KINDS[meta["winner"]].load(self.spark, row["path"], meta), meta

    def apply(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(filled table, report) of a later batch: stored models in dependency order, nothing is fitted."""
        entries = []
        for col in [c for c in PROCESSING_ORDER if c in df.columns]:
            missing = df.filter(F.col(col).isNull()).count()
            found = self.load(col) if missing else None
            if found is None:
                continue
            strategy, meta = found
            filled = strategy.fill(df) if isinstance(strategy, GroupMode) else fill_holes(df, col, strategy)
            df = pin(filled, f"applied-{col}")
            left = df.filter(F.col(col).isNull()).count()
            entries.append((col, meta["winner"], meta["version"], missing, missing - left))
        return df, self.spark.createDataFrame(
            entries, "column string, winner string, model_version string, missing_count bigint, filled_count bigint")
