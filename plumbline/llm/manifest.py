"""A Merkle manifest of a dataset: a root, a proof for every row, and the check of changed rows.

The leaves are the rows: the sha256 (hex) of their fields, each with its length. Within a group the
leaves stand in order; every `FAN` nodes become the hash of their digests until one is left, the
group's subroot. The subroots, in the order of their groups, become the root the same way.

A level of a tree is kept as strings, not as rows: an aligned block of FAN ** LEVELS nodes holds each
of its levels as one string of hex digests. Parents are hashes of its substrings of fixed width; a
row's siblings are the substrings on both sides of its own, found by its place alone. The tops of the
blocks are the nodes of the next round, until every group has one block. Going back down, a block
joins the siblings of its top once, and its rows add their own: no row meets another row.

Blocks are bounded (512 digests, 32 kB), whatever the size of a group, and texts are read once and
never shuffled. Rounds are written to the shared folder. The strings are ASCII and kept as binary, in
which Spark finds a substring without reading what is before it.

Defined results: a null field is `-`; rows without group or doc_id come first; rows with equal doc_id
stand in the order of their leaves. Equal rows have equal leaves, and each has its place. A table of
one row has its leaf as root and an empty proof; an empty table has no rows. A row without doc_id is
not tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import settle
from plumbline.llm.ordered import running

FAN = 8
LEVELS = 3  # of a block: FAN ** LEVELS nodes at the bottom
WIDTH = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_text(value: Column) -> Column:
    """A field as it is hashed: its bytes, a colon and its text; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """The hash of a row's fields, some of them changed."""
    return F.sha2(F.concat(*[field_text(changed.get(name, F.col(name))) for name in FIELDS]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _cut(level: Column, first: Column, n: Column) -> Column:
    """n digests of a level from number `first` on; fewer where it ends."""
    return F.substring(level, (first * WIDTH + 1).cast("int"), (n * WIDTH).cast("int"))


def _parents(level: Column) -> Column:
    """The next level: the hashes of every FAN digests."""
    last = F.ceil(F.octet_length(level) / (WIDTH * FAN)).cast("int") - 1
    hashes = F.transform(F.sequence(F.lit(0), last), lambda run: F.sha2(_cut(level, run * FAN, F.lit(FAN)), 256))
    return F.array_join(hashes, "").cast("binary")


def _climb(nodes: DataFrame, sizes: DataFrame, purpose: str) -> DataFrame:
    """The blocks of nodes (grp, place, node, ...), written: their rows, levels and top; `sizes` has
    the n nodes of each group.

    `l0` to `l2` are the levels below the top. A group of one block climbs until one node is left; all
    other blocks climb all levels.
    """
    size = FAN ** LEVELS
    rows = nodes.groupBy("grp", F.floor(F.col("place") / size).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(*[c for c in nodes.columns if c != "grp"]))).alias("rows"))
    # Sizes meet the blocks one by one, so a hot group is as many keys as it has blocks.
    each = sizes.select("grp", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("block"))
    blocks = rows.join(each, ["grp", "block"])
    climbs = F.when(F.col("n") <= 1, 0)
    for k in range(1, LEVELS):
        climbs = climbs.when(F.col("n") <= FAN ** k, k)
    digests = F.array_join(F.transform("rows", lambda row: row["node"]), "").cast("binary")
    blocks = blocks.withColumn("climbs", climbs.otherwise(LEVELS)).withColumn("l0", digests)
    for k in range(1, LEVELS + 1):
        blocks = blocks.withColumn(f"l{k}", F.when(F.col("climbs") >= k, _parents(F.col(f"l{k - 1}"))))
    top = F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)]).cast("string").alias("top")
    below = [F.when(F.col("climbs") > k, F.col(f"l{k}")).alias(f"l{k}") for k in range(LEVELS)]
    return settle(blocks.select("grp", "block", "rows", "n", "climbs", *below, top), purpose)


def trees(nodes: DataFrame, sizes: DataFrame, purpose: str) -> list[DataFrame]:
    """The rounds of blocks over the nodes of every group; the blocks of the last are one for each group."""
    rounds = [_climb(nodes, sizes, f"{purpose}-0")]
    while rounds[-1].where("block > 0").limit(1).count():
        # A group that has one node already goes on as it is.
        sizes = sizes.withColumn("n", F.ceil(F.col("n") / FAN ** LEVELS))
        nodes = rounds[-1].select("grp", F.col("block").alias("place"), F.col("top").alias("node"))
        rounds.append(_climb(nodes, sizes, f"{purpose}-{len(rounds)}"))
    return rounds


def _siblings(place: Column) -> Column:
    """The siblings of a row of a block on each level that the block climbs: (left, right)."""
    at, found = place % FAN ** LEVELS, []
    for k in range(LEVELS):
        own = F.floor(at / FAN ** k)
        first, level = own - own % FAN, F.col(f"l{k}")
        found.append(F.struct(_cut(level, first, own - first).alias("left"), _cut(level, own + 1, first + FAN - 1 - own).alias("right")))
    return F.slice(F.array(*found), F.lit(1), F.col("climbs"))


def paths(rounds: list[DataFrame], heads: DataFrame) -> DataFrame:
    """Every row of the first round with the siblings from it upwards (column `path`).

    `heads` has for each group the path above its root; its other columns go down to the rows.
    """
    carried = [c for c in heads.columns if c not in ("grp", "path")]
    above = heads.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        rows = blocks.join(above, ["grp", "block"]).select(
            "grp", "climbs", *[f"l{k}" for k in range(LEVELS)], "path", *carried, F.explode("rows").alias("row"))
        rows = rows.select("grp", "row.*", *carried, F.concat(_siblings(F.col("row.place")), "path").alias("path"))
        above = rows.withColumnRenamed("place", "block")
    return rows


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    The rows that `tampered` chooses had their text lower-cased after the manifest was made; what they
    fold to is made from the changed row and the siblings of the manifest.
    """
    shown = docs.select(*FIELDS)
    # A group's name in which a null is less than any other, and equal to itself.
    name = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    changed = F.when(tampered(F.col("doc_id")), leaf_hash(text=lowered(F.col("text"))))
    one = F.lit(1).cast("long").alias("one")
    leaves = settle(shown.select(
        name.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash().alias("node"), changed.alias("changed"),
        F.monotonically_increasing_id().alias("row"), one), "manifest-leaves")
    placed = running(leaves, ["grp", "doc_id", "node", "row"], ["one"], "manifest-order", "grp")
    rounds = trees(placed.select("grp", F.col("one_before").alias("place"), "node", "doc_id", "changed"), _sizes(leaves), "manifest")

    # The subroots are the leaves of the one tree above them.
    subroots = rounds[-1].select(F.col("grp").alias("name"), F.col("top").alias("node"), one)
    heads = running(subroots, ["name"], ["one"], "manifest-groups").select(
        F.lit("").alias("grp"), F.col("one_before").alias("place"), "node", "name")
    upper = trees(heads, _sizes(heads), "manifest-top")
    empty = F.expr("CAST(array() AS array<struct<left: binary, right: binary>>)").alias("path")
    named = paths(upper, upper[-1].select("grp", F.col("top").alias("root"), empty))
    named = settle(named.select(F.col("name").alias("grp"), F.col("node").alias("subroot"), "root", "path"), "manifest-paths")

    rows = paths(rounds, named)
    siblings = F.aggregate("path", F.lit("").cast("binary"), lambda done, s: F.concat(done, s["left"], s["right"]))
    start = F.coalesce("changed", "node").cast("binary")
    folded = F.aggregate("path", start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256).cast("binary"))
    rows = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                       folded.cast("string").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
