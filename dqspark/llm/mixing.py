"""Mixing sources to target weights by hierarchical budgets.

Documents hang under a tree domain - language - source.  The domain is the column
``domain`` where there is one, else the letters a source name starts with.  A node's weight
is given per path, or else the whole root of its tokens, so that large nodes are held back.

From the top down each node's budget is dealt among its children by weight.  A node can
take its tokens times ``max_epochs``; what a child cannot take goes to its siblings by
weight, and since a node's limit is that of all leaves under it, budget leaves a family
only when the whole family is full: shortages move among siblings before ancestors.

A leaf's budget is whole epochs of its documents plus a prefix of one more.  The order of
the last epoch is the MD5 of (seed, epoch, doc_id); the document in which the budget ends
gives its first tokens only.  The prefix is found in rounds: tokens of 256 hash buckets a
leaf are summed, and only the bucket in which the budget ends goes on to the next round,
so a leaf with a third of all rows is never brought to one task; what is sorted at the end
is a 16-millionth of it.

Tokens are words.  Documents without words are left out.  Null languages and sources count
as the empty name, null ids as the empty id.  Rows with equal id and size are ordered
arbitrarily, which changes no result; where they must be told apart, carry a column that does.
An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import pin, text_of, words

LEVELS = ("domain", "lang", "source")
BUDGET_SHARE = (3, 5)
MAX_EPOCHS = 3
SEED = 17
#: Hash digits a round, and rounds, in the search for the end of a budget.
DIGITS, ROUNDS = 2, 3


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, domain, lang, source, tokens) of every row with words, and the columns to carry."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    domain = name("domain") if "domain" in docs.columns else F.regexp_extract(name("source"), "^[A-Za-z]*", 0)
    return docs.select(
        F.col(doc_id).alias("doc_id"), domain.alias("domain"), name("lang").alias("lang"), name("source").alias("source"),
        F.size(words(text_of(text))).cast("long").alias("tokens"), *carry,
    ).filter("tokens > 0")


def deal(children: DataFrame, parent: list[str], own: str) -> DataFrame:
    """``budget`` of each child from its parent's ``given``, by ``weight``, none above ``most``.

    Children are taken in order of most / weight.  The first whose fair part of what the
    earlier ones left is within its limit fixes the rate for itself and all later ones.
    """
    w = Window.partitionBy(*parent).orderBy("ratio", own)
    ratio = children.withColumn("ratio", F.col("most") / F.col("weight"))
    rate = (F.col("given") - F.coalesce(F.sum("most").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(
        "weight"
    ).over(w.rowsBetween(0, Window.unboundedFollowing))
    rated = ratio.withColumn("rate", rate).withColumn("fits", F.col("rate") <= F.col("ratio"))
    fixed = F.first(F.when(F.col("fits"), F.col("rate")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    dealt = F.least(F.col("most"), F.floor(F.col("fixed") * F.col("weight")).cast("long"))
    return rated.withColumn("fixed", fixed).withColumn("budget", F.coalesce(dealt, F.col("most"))).drop(
        "ratio", "rate", "fits", "fixed", "given"
    )


def weight_of(level: int, targets: dict[tuple[str, ...], int]) -> Column:
    """Given weight of a path, else the whole root of its tokens."""
    out = F.floor(F.sqrt("tokens")).cast("long")
    for path, value in targets.items():
        if len(path) == level:
            same = F.lit(True)
            for name, part in zip(LEVELS, path, strict=False):
                same = same & (F.col(name) == part)
            out = F.when(same, F.lit(int(value)).cast("long")).otherwise(out)
    return out


def budgets(
    rows: DataFrame, share: tuple[int, int] = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS,
    targets: dict[tuple[str, ...], int] | None = None,
) -> DataFrame:
    """(domain, lang, source, tokens, budget) of every leaf; the root's budget is a share of all tokens."""
    leaves = pin(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    above = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * share[0]).alias("t")).select(
        F.expr(f"t div {share[1]}").alias("given"), F.lit(0).alias("root")
    )
    parent: list[str] = ["root"]
    for depth, own in enumerate(LEVELS, 1):
        path = list(LEVELS[:depth])
        nodes = leaves.withColumn("root", F.lit(0)).groupBy("root", *path).agg(F.sum("tokens").alias("tokens")).withColumns({
            "most": F.col("tokens") * max_epochs, "weight": weight_of(depth, targets or {}),
        })
        above = deal(nodes.join(above.select(*parent, "given"), parent), parent, own).select("root", *path, "tokens", F.col("budget").alias("given"))
        parent = ["root", *path]
    return above.select(*LEVELS, "tokens", F.col("given").alias("budget"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: tuple[int, int] = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS, targets: dict[tuple[str, ...], int] | None = None, seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, tokens, taken): each time a document is taken, and how much of it.

    Columns in ``carry`` are passed on and tell rows of one id apart in the order of the last epoch.
    """
    rows = pin(measured(docs, doc_id, text, carry), "measured")
    leaf = list(LEVELS)
    plan = pin(budgets(rows, share, max_epochs, targets).select(
        *leaf, F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest")), "plan")
    with_plan = rows.join(plan, leaf)
    whole = with_plan.filter("full > 0").select(
        "doc_id", *leaf, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "tokens", F.col("tokens").alias("taken"), *carry
    )
    key = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("full").cast("string"),
                            F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            *[F.col(c).cast("string") for c in carry]).cast("binary"))
    out = ["doc_id", *leaf, F.col("full").alias("epoch"), "tokens", "taken", *carry]
    at_edge = pin(with_plan.filter("rest > 0").withColumns({"key": key, "base": F.lit(0).cast("long")}), "last-epoch")
    parts = []
    for i in range(ROUNDS):
        inside, at_edge = split_at(at_edge, leaf, F.substring("key", DIGITS * i + 1, DIGITS))
        parts.append(inside)
        at_edge = pin(at_edge, "edge")
    order = Window.partitionBy(*leaf).orderBy("key", "tokens", *carry).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("base") - F.coalesce(F.sum("tokens").over(order), F.lit(0))
    edge = at_edge.withColumn("taken", F.least("tokens", left)).filter("taken > 0")
    for part in (*parts, edge):
        whole = whole.unionAll(part.select(*out))
    return whole


def split_at(rows: DataFrame, leaf: list[str], bucket: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of the buckets that lie inside each leaf's ``rest``, and those of the one in which it ends.

    ``base`` is what came before the given rows of a leaf; a leaf has at most
    16 ** DIGITS buckets, each summed before the shuffle.
    """
    placed = rows.withColumn("bucket", bucket)
    sums = placed.groupBy(*leaf, "bucket").agg(
        F.sum("tokens").alias("inside"), F.max("base").alias("base"), F.max("rest").alias("rest")
    )
    start = F.col("base") + F.sum("inside").over(Window.partitionBy(*leaf).orderBy("bucket")) - F.col("inside")
    reached = sums.withColumn("start", start).filter("start < rest").select(*leaf, "bucket", "start", "inside")
    begun = placed.drop("base").join(reached, [*leaf, "bucket"])
    fits = F.col("start") + F.col("inside") <= F.col("rest")
    return begun.filter(fits).withColumn("taken", F.col("tokens")), begun.filter(~fits).withColumn("base", F.col("start")).drop(
        "start", "inside", "bucket"
    )


def _level(depth: int) -> str:
    """SQL of one level of ``deal``."""
    names = ("root", *LEVELS)
    path, parent = ", ".join(names[: depth + 1]), ", ".join(names[:depth])
    return f"""n{depth} AS (
  SELECT {path}, CAST(sum(tokens) AS BIGINT) AS tokens FROM leaf GROUP BY ALL
), r{depth} AS (
  SELECT n.*, {MAX_EPOCHS} * tokens AS most, CAST(floor(sqrt(tokens)) AS BIGINT) AS weight, given,
    ({MAX_EPOCHS} * tokens) / CAST(floor(sqrt(tokens)) AS BIGINT) AS ratio
  FROM n{depth} n JOIN (SELECT {parent}, given FROM g{depth - 1}) USING ({parent})
), f{depth} AS (
  SELECT *, (given - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM r{depth} WINDOW w AS (PARTITION BY {parent} ORDER BY ratio, {names[depth]})
), x{depth} AS (
  SELECT {parent}, min_by(rate, ratio) AS fixed FROM f{depth} WHERE rate <= ratio GROUP BY ALL
), g{depth} AS (
  SELECT {path}, tokens, coalesce(least(most, CAST(floor(fixed * weight) AS BIGINT)), most) AS given
  FROM f{depth} LEFT JOIN x{depth} USING ({parent})
)"""


#: The same in DuckDB with plain running sums.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, regexp_extract(coalesce(source, ''), '^[A-Za-z]*') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS tokens
  FROM documents
), leaf AS (
  SELECT 0 AS root, domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d WHERE tokens > 0 GROUP BY ALL
), g0 AS (
  SELECT 0 AS root, CAST(sum(tokens) * {BUDGET_SHARE[0]} // {BUDGET_SHARE[1]} AS BIGINT) AS given FROM leaf
), {_level(1)}, {_level(2)}, {_level(3)}, p AS (
  SELECT d.*, g.given // g.tokens AS full_, g.given % g.tokens AS rest
  FROM d JOIN g3 g USING (domain, lang, source) WHERE d.tokens > 0
), o AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5(concat('{SEED}:', full_, ':', coalesce(CAST(doc_id AS VARCHAR), ''))), tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM p
), taken AS (
  SELECT doc_id, domain, lang, source, unnest(range(full_)) AS epoch, tokens, tokens AS taken FROM p
  UNION ALL
  SELECT doc_id, domain, lang, source, full_ AS epoch, tokens, CAST(least(tokens, rest - before) AS BIGINT) AS taken FROM o WHERE before < rest
)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, tokens, taken FROM taken
"""
