"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's bytes (a window of 32 bytes, computed for all places at once by
doubling). A chunk ends where the hash has zero bits under a mask; the mask is stricter before the
normal size and looser behind it (normalised chunking), with a least and a greatest size. An edit
moves only the boundaries near it. The fingerprint of a text is the set of its chunks' digests,
each weighted by its length; the containment of one text in another is the weight of the chunks
that both have over the weight of its own.

The neighbour of a document, here the next in descending order of doc_id, is found without a window
over the corpus: ranges of doc_id are cut at approximate quantiles, every range gets the last
document of the range before it as a lead (one row per range), and a sorted pass over each range
sees every document behind its neighbour. Texts are shuffled once.

Defined results: a null text is empty; an empty text has the empty fingerprint, which is like itself
(1) and unlike any other (0). Rows with equal doc_id are ordered by their texts; rows without doc_id
come after all others in descending order. A single document is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import texts

LEAST, NORMAL, MOST = 8, 32, 128
# Boundary bits before and behind the normal size.
STRICT_BITS, LOOSE_BITS = 5, 3


def _gear() -> np.ndarray:
    """A number for each byte value, from its digest."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = _gear()
STRICT = np.uint32(((1 << STRICT_BITS) - 1) << 32 - STRICT_BITS)
LOOSE = np.uint32(((1 << LOOSE_BITS) - 1) << 32 - LOOSE_BITS)


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash behind each byte: the sum of gear[b] << distance over the last 32 bytes."""
    rolled = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        if len(rolled) <= width:
            break
        longer = rolled.copy()
        longer[width:] += rolled[:-width] << np.uint32(width)
        rolled = longer
    return rolled


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    rolled = gear_hashes(data)
    loose = np.flatnonzero(rolled & LOOSE == 0)
    strict = (rolled[loose] & STRICT == 0).tolist()
    ends, start, k, found = [], 0, 0, (loose + 1).tolist()
    count = len(found)
    while n - start > LEAST:
        end = min(start + MOST, n)
        while k < count and found[k] < start + LEAST:
            k += 1
        while k < count and found[k] < end:
            if found[k] >= start + NORMAL or strict[k]:
                end = found[k]
                break
            k += 1
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def fingerprint(text: str) -> dict[str, int]:
    """Digest (12 hex digits) and length in bytes of each distinct chunk."""
    from xxhash import xxh64_hexdigest

    data, found, start = text.encode(), {}, 0
    for end in boundaries(data):
        found[xxh64_hexdigest(data[start:end])[4:]] = end - start
        start = end
    return found


def listed(chunks: dict[str, int]) -> str:
    """The fingerprint as text: digest and length of each chunk, in order of digests."""
    return " ".join([f"{digest}:{chunks[digest]:x}" for digest in sorted(chunks)])


def containment(own: dict[str, int], other: dict[str, int]) -> float:
    if not own:
        return 0.0 if other else 1.0
    return sum(own[digest] for digest in own.keys() & other.keys()) / sum(own.values())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of another."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def with_next(docs: DataFrame, function, schema: str, ranges: int | None = None) -> DataFrame:
    """Applies function(rows, next_texts) to batches of documents beside the text of the next one.

    Next is in descending order of doc_id; behind the last comes the first. `ranges` bounds the
    number of ranges of doc_id, and with it the rows that go through the driver (one id per range);
    without it there are four for each shuffle partition, so that ranges of long texts spread.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    # The number of cuts below an id; ids are null first.
    listed_cuts = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    part = F.coalesce(F.size(F.filter(listed_cuts, lambda c: c < F.col("doc_id"))), F.lit(0))
    lasts = ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("doc_id")).orderBy("part").collect()
    follows = [(lasts[k].doc_id, lasts[(k + 1) % len(lasts)].part) for k in range(len(lasts))]
    leads = spark.createDataFrame(follows, "doc_id long, part int")
    leading = rows.alias("rows").join(F.broadcast(leads.alias("leads")), F.expr("rows.doc_id <=> leads.doc_id"))
    leading = leading.select("leads.part", "rows.doc_id", "rows.text")
    both = rows.select(part.cast("int").alias("part"), F.lit(1).alias("own"), "doc_id", "text").unionByName(
        leading.withColumn("own", F.lit(0)))

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            found = batch["text"].tolist()
            following = [before, *found[:-1]]
            before = found[-1] if found else before
            own = batch["own"].to_numpy() == 1
            if own.any():
                yield function(batch[own], [t for t, o in zip(following, own, strict=True) if o])

    dealt = both.repartition(len(lasts) or 1, "part").sortWithinPartitions("part", "own", "doc_id", "text")
    return dealt.mapInPandas(paired, schema)


def document_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how like they and the next one are."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def compared(rows: pd.DataFrame, following: list[str]) -> pd.DataFrame:
        found, last_text, last = [], None, {}
        for text, then in zip(rows["text"], following, strict=True):
            own, changed = fingerprint(text), edited(text, then)
            following_print = last if then is last_text else fingerprint(then)
            last_text, last = text, own
            other = fingerprint(changed)
            found.append((len(text), hashlib.sha256(changed.encode()).hexdigest(), listed(own), listed(other),
                          containment(own, other), containment(own, following_print)))
        out = pd.DataFrame(found, columns=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                           "near_edited", "near_next"])
        out.insert(0, "doc_id", rows["doc_id"].to_numpy())
        return out

    return with_next(docs, compared, schema, ranges)
