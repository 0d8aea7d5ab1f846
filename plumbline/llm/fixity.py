"""Merkle fixity audit of WARC replicas.

A replica is a table of WARC records: file, offset, length and digest of the bytes. The leaves of its
tree are the records; a leaf's hash covers its offset, length and digest. Above them stand ranges of offsets: node k
of level n covers the offsets from k * width * fan^(n-1) on, and hashes its children in order. The top
level has one node per file, its root.

Replicas are compared from the roots down. A level's nodes are compared only below nodes of the level
above that differ, so each step joins the differing parents with their children and reads nothing of
branches that agree. Ranges are by offset, not by count, so a lost or added record only changes the
branches its bytes stand in. What is left at the bottom are the records to repair.

A range has at most `fan` children, and the lowest ranges hold as many records as fit in `width` bytes;
so no task gathers more than that, whatever the size of a file. Levels are written once, as tables in the
shared folder.

Defined results: null urls and bodies are empty; records of a file are laid out by page_id, ties by
digest; a null page_id is file -1, one file of its own. Files that only one replica has differ as a
whole. Empty replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import settle

WIDTH = 1 << 16  # bytes of a lowest range
FAN = 16         # ranges of a range
PER_FILE = 500   # page ids of a file


def warc_records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Response records of pages: file, page_id, record (binary)."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    page = F.col("page_id").cast("long")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.coalesce(F.floor(page / per_file), F.lit(-1)).cast("long").alias("file"), page.alias("page_id"),
                        F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def place(records: DataFrame) -> DataFrame:
    """Records in the order of their file: file, page_id, offset, length, digest of the bytes.

    Only digests are shuffled; the bytes are read where they are.
    """
    rows = records.select("file", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


class Tree:
    """The levels of a replica's tree, leaves first, written below the shared folder."""

    def __init__(self, records: DataFrame, n_levels: int, width: int = WIDTH, fan: int = FAN):
        leaf = F.sha2(F.concat_ws(":", "offset", "length", "digest").cast("binary"), 256)
        self.levels = [settle(records.select(
            "file", F.col("offset").alias("node"), F.floor(F.col("offset") / width).alias("above"), "length", leaf.alias("hash")), "fixity-0")]
        for level in range(1, n_levels + 1):
            kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
            shown = F.transform(kids, lambda kid: F.concat_ws(":", kid["node"].cast("string"), kid["hash"]))
            up = F.floor(F.col("above") / fan) if level < n_levels else F.lit(0).cast("long")
            nodes = self.levels[-1].groupBy("file", "above").agg(shown.alias("kids"))
            nodes = nodes.select("file", F.col("above").alias("node"), up.alias("above"), F.sha2(
                F.concat_ws("\n", "kids").cast("binary"), 256).alias("hash"))
            self.levels.append(settle(nodes, f"fixity-{level}"))


def height(sizes: list[int | None], width: int = WIDTH, fan: int = FAN) -> int:
    """Levels of ranges that files up to these sizes need."""
    ranges, levels = max([1, *(-(-s // width) for s in sizes if s)]), 1
    while ranges > 1:
        ranges, levels = -(-ranges // fan), levels + 1
    return levels


def audit(first: DataFrame, second: DataFrame, width: int = WIDTH, fan: int = FAN) -> DataFrame:
    """The records in which two replicas differ: file, offset, length and status.

    The status is `damaged` if both have a record there, `missing` if only the first has, `added` if
    only the second has. Replicas are tables of file, offset, length and digest (`place`).
    """
    sizes = [df.agg(F.max(F.col("offset") + F.col("length"))).first()[0] for df in (first, second)]
    n_levels = height(sizes, width, fan)
    trees = [Tree(df, n_levels, width, fan) for df in (first, second)]
    differing = None
    for level in range(n_levels, -1, -1):
        sides = [tree.levels[level] for tree in trees]
        if differing is not None:
            sides = [side.join(differing, ["file", "above"], "left_semi") for side in sides]
        columns = ["hash", "length"] if level == 0 else ["hash"]
        one, two = (side.select("file", "node", *[F.col(c).alias(f"{c}_{k}") for c in columns]) for k, side in enumerate(sides))
        compared = one.join(two, ["file", "node"], "full").where(~F.col("hash_0").eqNullSafe(F.col("hash_1")))
        if level:
            differing = settle(compared.select("file", F.col("node").alias("above")), f"fixity-differing-{level}")
    status = F.when(F.col("hash_1").isNull(), "missing").when(F.col("hash_0").isNull(), "added").otherwise("damaged")
    return compared.select("file", F.col("node").alias("offset"), F.coalesce("length_0", "length_1").alias("length"), status.alias("status"))


def damage(records: DataFrame, damaged: Column) -> DataFrame:
    """The records of a replica in which one byte of the `damaged` ones is another."""
    before = F.expr("substring(record, 1, octet_length(record) - 5)")
    changed = F.concat(before, F.lit("~").cast("binary"), F.expr("substring(record, octet_length(record) - 3, 4)"))
    return records.withColumn("record", F.when(F.coalesce(damaged, F.lit(False)), changed).otherwise(F.col("record")))
