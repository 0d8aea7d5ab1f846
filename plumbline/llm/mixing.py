"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source; its leaves are the sources of a language. From the root down,
a node's budget of tokens is dealt to its children by their weights; a child whose whole subtree
can't give its share (its tokens times the allowed epochs) gives all it has, and what it lacks is
dealt to its siblings by their weights. Only what all of them together lack falls to the node's own
siblings: a node's capacity is that of its subtree, so its parent has dealt with that before.

A leaf's budget is met by whole epochs and a prefix of a further one. Each epoch orders the leaf's
documents by a seeded digest; a document belongs to the prefix if it begins before the budget ends.
The prefix is found in two steps, so that no task orders a whole leaf: tokens are summed by leaf and
by slice of the digest (at most 4096 sums per leaf), and only the documents of the one slice in which
the budget ends are put in order. Each leaf then has one last key, and each row is decided by itself.

All arithmetic is on integers. Everything here is DataFrame operations.

Defined results: a null text has no tokens; a null or empty name of a level is the name ''. A name
without a weight has `DEFAULT_WEIGHT`; a weight of zero or less takes a branch out. Shares are
rounded down, so each level may leave less than one token per node undealt. Rows of one leaf with
equal doc_id (null like any other) are taken together. An empty table or budget gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import settle

LEAF = ["domain", "language", "origin"]
DEFAULT_WEIGHT = 100
EPOCHS = 2
SEED = 7
SLICE_DIGITS = 3  # leading hex digits of a digest: 4096 slices


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def domain(source: Column, domains: int = 4) -> Column:
    """A source's domain: the number it ends in modulo `domains`; 'other' if there is none."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    named = F.concat(F.lit("d"), (F.when(number != "", number).cast("long") % domains).cast("string"))
    return F.coalesce(named, F.lit("other"))


def _weight(level: int, weights: Mapping[str, int]) -> Column:
    """The weight of a node: that of its path, else of its name, else the default."""
    found = F.lit(DEFAULT_WEIGHT).cast("long")
    if weights:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        path = F.concat_ws("/", *LEAF[:level + 1])
        found = F.coalesce(table[path], table[F.col(LEAF[level])], F.lit(DEFAULT_WEIGHT)).cast("long")
    return found


def _deal(children: DataFrame, level: int) -> DataFrame:
    """The budget of each child. Children have weight, capacity and the budget `given` to their parent.

    By rising capacity per weight, a child is full if its capacity is at most its share of what is
    left when all before it are full. The others share what the full ones leave, by weight.
    """
    parent = LEAF[:level] or [F.lit(0)]
    ratio = F.col("capacity").cast("double") / F.col("weight").cast("double")
    order = Window.partitionBy(*parent).orderBy(ratio, LEAF[level])
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    df = children.withColumn("capacity_", F.col("capacity").cast("decimal(18,0)")).withColumn(
        "weight_", F.col("weight").cast("decimal(9,0)"))
    df = df.withColumn("left", F.greatest(F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0)))
    df = df.withColumn("left", F.col("left").cast("decimal(18,0)")).withColumn(
        "sharing", F.sum("weight").over(behind).cast("decimal(18,0)"))
    df = df.withColumn("open", F.col("capacity_") * F.col("sharing") > F.col("left") * F.col("weight_"))
    # The first open child has the most left, and the most weight to share it by.
    whole = Window.partitionBy(*parent)
    df = df.withColumn("shared", F.max(F.when(F.col("open"), F.col("left"))).over(whole)).withColumn(
        "by", F.max(F.when(F.col("open"), F.col("sharing"))).over(whole))
    budget = F.when(F.col("open"), F.expr("(shared * weight_) div `by`")).otherwise(F.col("capacity"))
    return df.select(*LEAF[:level + 1], budget.cast("long").alias("given"))


def budgets(leaves: DataFrame, budget: int, weights: Mapping[str, int], epochs: int = EPOCHS) -> DataFrame:
    """Tokens to take from each leaf (column `given`); leaves have their tokens."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * epochs)
    for level in range(len(LEAF)):
        nodes = nodes.withColumn(f"weight{level}", _weight(level, weights)).where(F.col(f"weight{level}") > 0)
    given = None
    for level in range(len(LEAF)):
        path = LEAF[:level + 1]
        children = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.max(f"weight{level}").alias("weight"))
        above = children.withColumn("given", F.lit(budget).cast("long")) if given is None else children.join(given, LEAF[:level])
        given = _deal(above, level)
    return given


def _digest(seed: int, epoch: Column, doc_id: Column) -> Column:
    named = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), named).cast("binary"))


def with_leaf(docs: DataFrame, domains: int = 4) -> DataFrame:
    """doc_id and the names of a row's leaf, before the columns of the row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("id_"), domain(F.col("source"), domains).alias("domain_"),
        F.coalesce("lang", F.lit("")).alias("language_"), F.coalesce("source", F.lit("")).alias("origin_"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))


def plan(docs: DataFrame, weights: Mapping[str, int], share: tuple[int, int] = (1, 2), epochs: int = EPOCHS,
         seed: int = SEED, domains: int = 4) -> tuple[DataFrame, DataFrame]:
    """The counted documents, and for each leaf its whole epochs and the last key of its prefix.

    `share` is the budget as a fraction of all tokens.
    """
    rows = with_leaf(docs, domains)
    names = [F.col(f"{c}_").alias(c) for c in LEAF]
    counted = settle(rows.select(F.col("id_").alias("doc_id"), *names, tokens(F.col("row_.text")).alias("tokens")), "mix-tokens")
    leaves = settle(counted.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share[0] // share[1]
    given = leaves.join(budgets(leaves, budget, weights, epochs), LEAF).where("given > 0")
    # A leaf without tokens has no budget, so tokens are never zero here.
    given = given.selectExpr(*LEAF, "given", "given div tokens AS whole", "given % tokens AS rest")
    given = settle(given, "mix-budgets")
    keyed = counted.join(given.where("rest > 0"), LEAF).withColumn("digest", _digest(seed, F.col("whole"), F.col("doc_id")))
    keyed = keyed.select(*LEAF, "rest", "digest", F.substring("digest", 1, SLICE_DIGITS).alias("slice"), "tokens")
    sums = keyed.groupBy(*LEAF, "slice").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"))
    by_slice = Window.partitionBy(*LEAF).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(by_slice), F.lit(0))).where("before < rest")
    ends = sums.groupBy(*LEAF).agg(F.max_by(F.struct("slice", "before"), "slice").alias("end")).select(*LEAF, "end.*")
    last = keyed.join(ends, [*LEAF, "slice"]).groupBy(*LEAF, "digest").agg(
        F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    by_key = Window.partitionBy(*LEAF).orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("tokens").over(by_key), F.lit(0))
    last = last.withColumn("start", start).where("start < rest")
    cuts = given.select(*LEAF, "whole").join(last.groupBy(*LEAF).agg(F.max("digest").alias("last")), LEAF, "left")
    return counted, settle(cuts, "mix-cuts")


def _copies(seed: int, doc_id: Column) -> Column:
    partly = F.coalesce(_digest(seed, F.col("whole"), doc_id) <= F.col("last"), F.lit(False))
    return F.col("whole") + partly.cast("long")


def selection(docs: DataFrame, weights: Mapping[str, int], share: tuple[int, int] = (1, 2), epochs: int = EPOCHS,
              seed: int = SEED, domains: int = 4) -> DataFrame:
    """doc_id, domain, language, origin, tokens and copies of each document that is taken."""
    counted, cuts = plan(docs, weights, share, epochs, seed, domains)
    taken = counted.join(cuts, LEAF).withColumn("copies", _copies(seed, F.col("doc_id")))
    return taken.where("copies > 0").select("doc_id", *LEAF, "tokens", "copies")


def mix(docs: DataFrame, weights: Mapping[str, int], share: tuple[int, int] = (1, 2), epochs: int = EPOCHS,
        seed: int = SEED, domains: int = 4) -> DataFrame:
    """The rows that are taken, as they are, each once per epoch that holds it."""
    _, cuts = plan(docs, weights, share, epochs, seed, domains)
    cuts = cuts.select(*[F.col(c).alias(f"{c}_") for c in LEAF], "whole", "last")
    taken = with_leaf(docs, domains).join(cuts, [f"{c}_" for c in LEAF])
    return taken.select("row_", F.explode(F.array_repeat(F.lit(0), _copies(seed, F.col("id_")).cast("int")))).select("row_.*")
