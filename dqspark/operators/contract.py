"""Row contracts: every rule on every row, every failure kept, one pass over the table.

A contract is a list of :class:`Field`.  ``annotate`` compiles it into columns:
``raw`` (the row as it came), ``record`` (typed values) and ``reasons`` (all
failures in field order).  Nothing is shuffled and no Python runs per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions import text as tx
from dqspark.functions.url import http_url

SEQ = "_seq"
REASONS_TYPE = (
    "array<struct<rule:string,message:string,severity:string,"
    "model_version:string,score:double,features:map<string,double>>>"
)

# --- fixed values: failure messages ------------------------------------------
ABSENT = "Field required"
INT_TYPE = "Input should be a valid integer"
INT_PARSE = "Input should be a valid integer, unable to parse string as an integer"
INT_FRACTION = "Input should be a valid integer, got a number with a fractional part"
AT_LEAST = "Input should be greater than or equal to {}"
AT_MOST = "Input should be less than or equal to {}"
STR_TYPE = "Input should be a valid string"
STR_PATTERN = "String should match pattern '{}'"
FLOAT_TYPE = "Input should be a valid number"
FLOAT_PARSE = "Input should be a valid number, unable to parse string as a number"
BOOL_TYPE = "Input should be a valid boolean"
BOOL_PARSE = "Input should be a valid boolean, unable to interpret input"
DATE_TYPE = "Input should be a valid date"
DATE_PARSE = "Input should be a valid date or datetime"
TRUE_WORDS = ("1", "true", "yes", "y", "t", "on")
FALSE_WORDS = ("0", "false", "no", "n", "f", "off")
# ------------------------------------------------------------------------------

_INT_TEXT = rf"^[{tx.SPACE}]*[+-]?[0-9]+(?:_[0-9]+)*(?:\.0+)?[{tx.SPACE}]*\z"
_SPARK_TYPE = {
    "int": "bigint", "str": "string", "url": "string",
    "float": "double", "bool": "boolean", "date": "date",
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "str"
    required: bool = False
    ge: int | None = None
    le: int | None = None
    pattern: str | None = None
    null_words: tuple[str, ...] = ()
    alias: str | None = None

    @property
    def source(self) -> str:
        """Column name in the raw table."""
        return self.alias or self.name


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    key: str | None = None
    text_columns: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


COMPANY = Contract(
    fields=(
        Field("company_id", "int", required=True),
        Field("name"),
        Field("description"),
        Field("company_size", "int", ge=1, le=7),
        Field("state", null_words=("0",)),
        Field("country", null_words=("0",)),
        Field("city"),
        Field("zip_code"),
        Field("address"),
        Field("url", "url", required=True),
    ),
    key="company_id",
    text_columns=("name", "description", "state", "country", "city", "address", "zip_code"),
)


def sentinel_to_null(value: Column, words: tuple[str, ...]) -> Column:
    """Null where the stripped value is a stand-in for "unknown"; untouched otherwise."""
    if not words:
        return value
    return F.when(~tx.strip(value.cast("string")).isin(*words), value)


def _as_int(raw: Column, dtype: T.DataType) -> tuple[Column, Column]:
    if isinstance(dtype, T.StringType):
        digits = F.regexp_replace(tx.strip(raw), r"\.0+\z|_", "")
        value = F.when(raw.rlike(_INT_TEXT), digits.try_cast("bigint"))
        return value, F.when(raw.isNull(), INT_TYPE).when(value.isNull(), INT_PARSE)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        value = F.when(raw == F.floor(raw), raw.try_cast("bigint"))
        return value, F.when(raw.isNull(), INT_TYPE).when(value.isNull(), INT_FRACTION)
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return raw.cast("bigint"), F.when(raw.isNull(), INT_TYPE)
    return F.lit(None).cast("bigint"), F.lit(INT_TYPE)


def _as_float(raw: Column, dtype: T.DataType) -> tuple[Column, Column]:
    if isinstance(dtype, T.StringType):
        value = F.when(raw.rlike(tx.FLOAT), parse_float(raw))
        return value, F.when(raw.isNull(), FLOAT_TYPE).when(value.isNull(), FLOAT_PARSE)
    if isinstance(dtype, T.NumericType):
        return raw.cast("double"), F.when(raw.isNull(), FLOAT_TYPE)
    return F.lit(None).cast("double"), F.lit(FLOAT_TYPE)


def parse_float(raw: Column) -> Column:
    """Double for text in Python's float grammar; guard with ``tx.FLOAT`` first."""
    return F.regexp_replace(tx.strip(raw), "_", "").try_cast("double")


def _as_bool(raw: Column, dtype: T.DataType) -> tuple[Column, Column]:
    if isinstance(dtype, T.StringType):
        low = F.lower(raw)
        value = F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
        return value, F.when(raw.isNull(), BOOL_TYPE).when(value.isNull(), BOOL_PARSE)
    if isinstance(dtype, T.BooleanType):
        return raw, F.when(raw.isNull(), BOOL_TYPE)
    return F.lit(None).cast("boolean"), F.lit(BOOL_TYPE)


def _as_date(raw: Column, dtype: T.DataType) -> tuple[Column, Column]:
    if isinstance(dtype, T.StringType):
        shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ]00:00(?::00(?:\.0+)?)?(?:Z|[+-]00:?00)?)?\z"
        value = F.when(raw.rlike(shape), F.substring(raw, 1, 10).try_cast("date"))
        return value, F.when(raw.isNull(), DATE_TYPE).when(value.isNull(), DATE_PARSE)
    if isinstance(dtype, T.DateType):
        return raw, F.when(raw.isNull(), DATE_TYPE)
    return F.lit(None).cast("date"), F.lit(DATE_TYPE)


def _as_str(raw: Column, dtype: T.DataType, pattern: str | None) -> tuple[Column, Column]:
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("string"), F.lit(STR_TYPE)
    error = F.when(raw.isNull(), STR_TYPE)
    if pattern:
        error = error.when(~raw.rlike(pattern), STR_PATTERN.format(pattern))
    return raw, error


def _check(f: Field, dtype: T.DataType | None) -> tuple[Column, Column]:
    """(typed value, failure message or null) of one field."""
    none = F.lit(None).cast("string")
    if dtype is None:
        return F.lit(None).cast(_SPARK_TYPE[f.kind]), F.lit(ABSENT) if f.required else none
    raw = sentinel_to_null(F.col(f"`{f.source}`"), f.null_words)
    if f.kind == "url":
        value, error = http_url(raw)
    elif f.kind == "int":
        value, error = _as_int(raw, dtype)
    elif f.kind == "float":
        value, error = _as_float(raw, dtype)
    elif f.kind == "bool":
        value, error = _as_bool(raw, dtype)
    elif f.kind == "date":
        value, error = _as_date(raw, dtype)
    else:
        value, error = _as_str(raw, dtype, f.pattern)
    if f.ge is not None:
        error = F.coalesce(error, F.when(value < f.ge, AT_LEAST.format(f.ge)))
    if f.le is not None:
        error = F.coalesce(error, F.when(value > f.le, AT_MOST.format(f.le)))
    if not f.required:
        error = F.when(raw.isNull(), none).otherwise(error)
    return value, error


def reason(rule: Column | str, message: Column, severity: str = "error") -> Column:
    """One failure; the model fields stay null for contract rules."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(
        rule.alias("rule"), message.alias("message"), F.lit(severity).alias("severity"),
        F.lit(None).cast("string").alias("model_version"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("map<string,double>").alias("features"),
    )


def annotate(df: DataFrame, contract: Contract = COMPANY) -> DataFrame:
    """``_seq`` (when present), ``raw``, ``record``, ``reasons`` for every row."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    raw_columns = [c for c in df.columns if c != SEQ]
    checks = [(f, *_check(f, dtypes.get(f.source))) for f in contract.fields]
    # values and messages become columns first, so each rule is computed once per row
    staged = df.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[v.alias(f"__v_{f.name}") for f, v, _ in checks],
        *[e.alias(f"__e_{f.name}") for f, _, e in checks],
    )
    reasons = F.filter(
        F.array(*[
            F.when(F.col(f"__e_{f.name}").isNotNull(), reason(f.name, F.col(f"__e_{f.name}")))
            for f in contract.fields
        ]),
        lambda r: r.isNotNull(),
    )
    return staged.select(
        *([SEQ] if SEQ in df.columns else []),
        F.struct(*[F.col(f"`{c}`") for c in raw_columns]).alias("raw"),
        F.struct(*[F.col(f"__v_{f.name}").alias(f.name) for f in contract.fields]).alias("record"),
        reasons.cast(REASONS_TYPE).alias("reasons"),
    )


def _seq(df: DataFrame) -> list[str]:
    return [SEQ] if SEQ in df.columns else []


def valid_records(annotated: DataFrame) -> DataFrame:
    """Typed records of the rows without a failure."""
    return annotated.filter(F.size("reasons") == 0).select(*_seq(annotated), "record.*")


def invalid_rows(annotated: DataFrame) -> DataFrame:
    """Raw rows with at least one failure, next to all their reasons."""
    return annotated.filter(F.size("reasons") > 0).select(*_seq(annotated), "raw", "reasons")


def validate_rows(df: DataFrame, contract: Contract = COMPANY) -> tuple[DataFrame, DataFrame]:
    """(valid records, invalid raw rows with reasons): a partition of the input."""
    annotated = annotate(df, contract)
    return valid_records(annotated), invalid_rows(annotated)


def explode_reasons(annotated: DataFrame) -> DataFrame:
    """One row per failure."""
    return annotated.select(*_seq(annotated), F.explode("reasons").alias("r")).select(
        *_seq(annotated), "r.rule", "r.message", "r.severity"
    )


def violation_count(df: DataFrame, contract: Contract = COMPANY) -> DataFrame:
    """The input with the number of contract failures of each row."""
    annotated = annotate(df, contract)
    return annotated.select(
        *_seq(annotated), "raw.*", F.size("reasons").cast("bigint").alias("violations")
    )


def pass_rates(df: DataFrame, contracts: dict[str, Contract]) -> DataFrame:
    """Rows and passes under each named contract, all counted in one scan of the table."""
    flags = df
    for name, contract in contracts.items():
        dtypes = {f.name: f.dataType for f in df.schema.fields}
        failed = F.lit(False)
        for f in contract.fields:
            failed = failed | _check(f, dtypes.get(f.source))[1].isNotNull()
        flags = flags.withColumn(f"__ok_{name}", (~failed).cast("bigint"))
    counted = flags.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.coalesce(F.sum(f"__ok_{n}"), F.lit(0)).alias(f"__ok_{n}") for n in contracts],
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("contract"), F.col(f"__ok_{n}").alias("passed")) for n in contracts
    ]))
    return counted.select("total", rows.alias("p")).select(
        "p.contract", "total", "p.passed", (F.col("total") - F.col("p.passed")).alias("failed"),
        F.when(F.col("total") > 0, F.col("p.passed") / F.col("total")).alias("pass_rate"),
    )
