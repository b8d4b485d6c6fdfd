"""Labeled training rows: real rows, some damaged in one of four known ways.

All choices come from md5 of seed and key, so the table is the same on every
run and any lost task redoes its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.hashing import draw, draw_between, order_key
from dqspark.operators.ranking import at_or_before, nth_by_hash
from dqspark.operators.rowfeat import OPTIONAL, ROW_FEATURES, row_features
from dqspark.operators.zip3 import state_clean, with_eligibility, zip3_pool, zip3_reference
from dqspark.sources.durable import pin

# --- fixed values ---------------------------------------------------------------
KINDS = ("encoding", "truncation", "zip_state_mismatch", "null_storm")
MISREAD = {"'": "â€™", '"': "â€œ", "-": "â€“", "e": "Ã©", " ": "Â "}
FRAGMENT = "Ã©â€™"
GARBLE = "kjfhqxzKJFHQXZ#@%&*0198"
SEED = 42
# --------------------------------------------------------------------------------


def _target() -> Column:
    """Damage goes to the description, or to the name when there is none."""
    return F.coalesce(F.col("description"), F.lit("")) != ""


def _with_text(df: DataFrame, where: Column | None) -> DataFrame:
    """Add ``__where``, ``__use`` (description or name) and ``__text``, null outside ``where``."""
    use = _target()
    text = F.when(use, F.col("description")).otherwise(F.coalesce(F.col("name"), F.lit("")))
    return df.withColumns({"__where": F.lit(True) if where is None else where, "__use": use}).withColumn(
        "__text", F.when(F.col("__where"), text)
    )


def _put_back(df: DataFrame, damaged: Column, columns: list[str]) -> DataFrame:
    hit = F.coalesce("__where", F.lit(False))
    put = {
        "description": F.when(hit & F.col("__use"), F.col("__bad")).otherwise(F.col("description")),
        "name": F.when(hit & ~F.col("__use"), F.col("__bad")).otherwise(F.col("name")),
    }
    return df.withColumn("__bad", damaged).select(*[put[c].alias(c) if c in put else f"`{c}`" for c in columns])


def damage_encoding(df: DataFrame, key: str, seed: int = SEED, where: Column | None = None) -> DataFrame:
    """One to three of the characters ``' " - e`` and space become their misread form."""
    k = F.col(key)
    swaps = F.create_map(*[F.lit(x) for pair in MISREAD.items() for x in pair])
    hit_words = list(MISREAD)
    text = F.col("__text")
    places = F.filter(
        F.transform(F.split(text, ""), lambda c, i: F.when(c.isin(*hit_words), i)), lambda i: i.isNotNull()
    )
    staged = _with_text(df, where).withColumn("__places", places).withColumn("__m", F.size("__places"))
    m = F.col("__m")
    # three different indexes into the candidates, each drawn from what is left
    a = draw(f"{seed}a", k) % F.greatest(m, F.lit(1))
    b0 = draw(f"{seed}b", k) % F.greatest(m - 1, F.lit(1))
    b = b0 + (b0 >= a).cast("bigint")
    c0 = draw(f"{seed}c", k) % F.greatest(m - 2, F.lit(1))
    c1 = c0 + (c0 >= F.least(a, b)).cast("bigint")
    c = c1 + (c1 >= F.greatest(a, b)).cast("bigint")
    hits = F.least(m, draw_between(f"{seed}hits", k, 1, 3))
    staged = staged.withColumn("__picks", F.slice(F.array(a, b, c), 1, F.greatest(hits, F.lit(0))))
    chosen = F.sort_array(F.transform("__picks", lambda p: F.get("__places", p.cast("int"))), asc=False)
    # from the last place to the first, so earlier places keep their numbers
    swapped = F.aggregate(chosen, text, lambda t, p: F.concat(
        F.substring(t, F.lit(1), p), swaps[F.substring(t, p + 1, F.lit(1))], F.substring(t, p + 2, F.length(t))
    ))
    at = (draw(f"{seed}at", k) % (F.length(text) + 1)).cast("int")
    inserted = F.concat(F.substring(text, F.lit(1), at), F.lit(FRAGMENT), F.substring(text, at + 1, F.length(text)))
    return _put_back(staged, F.when(m == 0, inserted).otherwise(swapped), df.columns)


def damage_truncation(df: DataFrame, key: str, seed: int = SEED, where: Column | None = None) -> DataFrame:
    """Keep 15 to 50 percent (at least one character) and append 3 to 8 garble characters."""
    k = F.col(key)
    share = F.lit(0.15) + F.lit(0.35) * (draw(f"{seed}cut", k) / F.lit(float(2**32)))
    letters = F.concat(*[
        F.when(
            F.lit(i) <= draw_between(f"{seed}len", k, 3, 8),
            F.substring(F.lit(GARBLE), (draw(f"{seed}g{i}", k) % len(GARBLE) + 1).cast("int"), F.lit(1)),
        ).otherwise(F.lit(""))
        for i in range(1, 9)
    ])

    text = F.col("__text")
    keep = F.greatest(F.lit(1), F.floor(F.length(text) * share)).cast("int")
    return _put_back(_with_text(df, where), F.concat(F.substring(text, F.lit(1), keep), letters), df.columns)


def damage_nulls(df: DataFrame, key: str, seed: int = SEED, where: Column | None = None) -> DataFrame:
    """Five to seven of the seven optional fields become null."""
    k = F.col(key)
    hashes = {f: order_key(f"{seed}{f}", k) for f in OPTIONAL}
    hit = F.lit(True) if where is None else where
    ranked = df.withColumn("__ranks", F.when(hit, F.array_sort(F.array(*hashes.values())))).withColumn(
        "__k", draw_between(f"{seed}nulls", k, 5, len(OPTIONAL))
    )
    return ranked.withColumns({
        f: F.when(F.col("__ranks").isNull() | (F.array_position("__ranks", h) > F.col("__k")), F.col(f))
        for f, h in hashes.items()
    }).drop("__ranks", "__k")


def damage_zip(
    df: DataFrame, key: str, reference: DataFrame, pool: DataFrame, seed: int = SEED, where: Column | None = None
) -> DataFrame:
    """Swap in an observed zip of another state; the state stays.

    The reference sorted by state makes "any prefix of another state" an index
    that jumps over one contiguous run, so the choice is an equi-join.
    """
    k = F.col(key)
    line = Window.partitionBy(F.lit(0))  # at most 1,000 prefixes
    by_state = line.orderBy("state", "zip3")
    indexed = reference.select(
        "zip3", "state", (F.row_number().over(by_state) - 1).alias("__i"), F.count(F.lit(1)).over(line).alias("__all")
    )
    runs = indexed.groupBy("state", "__all").agg(F.min("__i").alias("__from"), F.count(F.lit(1)).alias("__own"))
    runs = runs.withColumnRenamed("state", "__run_state")
    size = reference.agg(F.count(F.lit(1))).scalar()
    copies = pool.groupBy("zip3").agg(F.sum("n").alias("__copies"))
    targets = indexed.join(copies, "zip3").select(
        F.col("__i").alias("__target"), F.col("zip3").alias("__zip3"), "__copies"
    )
    # only rows to be damaged go through the joins
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    picked = df.filter(hit).withColumn("__state", state_clean()).join(
        F.broadcast(runs.drop("__all")), F.col("__state") == F.col("__run_state"), "left"
    )
    own, start = F.coalesce("__own", F.lit(0)), F.coalesce("__from", F.lit(0))
    left = size - own
    j = draw(f"{seed}zip3", k) % F.greatest(left, F.lit(1))
    picked = picked.withColumn("__j", F.when(left > 0, F.when(j >= start, j + own).otherwise(j)))
    picked = picked.join(F.broadcast(targets), F.col("__j") == F.col("__target"), "left").withColumn(
        "__copy", draw(f"{seed}zip", k) % F.greatest(F.col("__copies"), F.lit(1))
    )
    zips = pool.select(
        F.col("zip3").alias("__pool3"), F.col("zip_code").alias("__new"),
        F.col("first_index").alias("__lo"), (F.col("first_index") + F.col("n")).alias("__hi"),
    )
    swapped = picked.join(
        zips,
        (F.col("__zip3") == F.col("__pool3")) & (F.col("__copy") >= F.col("__lo")) & (F.col("__copy") < F.col("__hi")),
        "left",
    )
    done = swapped.withColumn("zip_code", F.coalesce("__new", "zip_code")).select(*df.columns)
    return done if where is None else done.unionByName(df.filter(~hit))


def assign_kinds(df: DataFrame, key: str, reference: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """Add ``corruption_type``: disjoint groups of ``share`` of the rows each, zip swaps first.

    Groups are cut in hash order by the n-th key, so nothing but counts and a
    few cut values is shuffled.  The cut values are written; the rows get their
    kind as they are read.
    """
    quota = df.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("n"))
    marked = with_eligibility(df, reference)
    eligible = marked.filter("eligible").select(key, F.lit("zip").alias("__g"))
    n_eligible = eligible.agg(F.count(F.lit(1))).scalar()
    want_zip = quota.select(F.lit("zip").alias("__g"), F.least(F.col("n"), n_eligible).alias("n"))
    cut = pin(nth_by_hash(eligible, "__g", want_zip, f"{seed}zip", key).select(
        "__g", F.col("cut_hash").alias("__zh"), F.col("cut_key").alias("__zk")
    ).coalesce(1), "cut")
    tagged = marked.withColumn("__g", F.when(F.col("eligible"), "zip")).join(F.broadcast(cut), "__g", "left")
    tagged = tagged.withColumn(
        "__zip", F.col("eligible") & at_or_before(f"{seed}zip", F.col(key), F.col("__zh"), F.col("__zk"))
    ).drop("__g", "__zh", "__zk", "eligible")
    rest = tagged.filter(~F.col("__zip")).select(key, F.lit("rest").alias("__g"))
    wanted = quota.select(
        F.lit("rest").alias("__g"),
        F.explode(F.array(F.col("n"), F.col("n") * 2, F.col("n") * 3)).alias("n"),
    ).distinct()
    cuts = nth_by_hash(rest, "__g", wanted, f"{seed}rest", key).join(
        quota.withColumnRenamed("n", "__quota").withColumn("__g", F.lit("rest")), "__g"
    )

    def cut_at(times: int, column: str) -> Column:
        return F.max(F.when(F.col("n") == F.col("__quota") * times, F.col(column)))

    row = pin(cuts.groupBy("__g").agg(*[
        cut_at(t, c).alias(f"__{c}_{t}") for t in (1, 2, 3) for c in ("cut_hash", "cut_key")
    ]).coalesce(1), "cuts")
    k = F.col(key)
    below = {t: at_or_before(f"{seed}rest", k, F.col(f"__cut_hash_{t}"), F.col(f"__cut_key_{t}")) for t in (1, 2, 3)}
    kinds = (
        F.when(F.col("__zip"), "zip_state_mismatch")
        .when(below[1], "encoding").when(below[2], "truncation").when(below[3], "null_storm")
        .otherwise("clean")
    )
    return (
        tagged.withColumn("__g", F.lit("rest")).join(F.broadcast(row), "__g", "left")
        .withColumn("corruption_type", kinds).select(*df.columns, "corruption_type")
    )


def labeled_rows(
    df: DataFrame, key: str = "company_id", share: float = 800 / 24473, seed: int = SEED, written: bool = False
) -> DataFrame:
    """Rows with ``corruption_type``, ``is_synthetic``, ``label`` and the features after damage.

    ``written`` says that ``df`` is a written table.
    """
    # counts, cuts and damage all read the table, so it is written once
    df = df if written else pin(df, "rows")
    reference = pin(zip3_reference(df), "zip3")
    pool = pin(zip3_pool(df, reference), "pool")
    typed = assign_kinds(df, key, reference, share, seed)
    kind = F.col("corruption_type")
    # one pass: each damage touches only its own rows, the others flow through
    rows = damage_zip(typed, key, reference, pool, seed, kind == "zip_state_mismatch")
    rows = damage_encoding(rows, key, seed, kind == "encoding")
    rows = damage_truncation(rows, key, seed, kind == "truncation")
    rows = damage_nulls(rows, key, seed, kind == "null_storm")
    synthetic = kind != "clean"
    return row_features(rows, reference).withColumns({
        "is_synthetic": synthetic, "label": synthetic.cast("int"),
    })


def labeled_dataset(
    df: DataFrame, key: str = "company_id", share: float = 800 / 24473, seed: int = SEED, written: bool = False
) -> DataFrame:
    """Key, labels and features only."""
    return labeled_rows(df, key, share, seed, written).select(
        key, "is_synthetic", "label", "corruption_type", *ROW_FEATURES
    )


def row_label(df: DataFrame) -> Column:
    """The explicit label where there is one, else whether the row is synthetic."""
    known = [F.col(c).cast("int") for c in ("label", "is_synthetic") if c in df.columns]
    return F.coalesce(*known)
