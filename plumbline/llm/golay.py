"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Fingerprints that differ in two
bits or fewer have, by the pigeonhole principle over the cyclic pairs (a,b), (b,c), (c,a), a pair
whose first segment is equal and whose second differs in at most one bit:

    errors 0 in a, <= 1 in b    or    0 in b, <= 1 in c    or    0 in c, <= 1 in a

The second segment, padded to 23 bits, is decoded with the binary Golay code (23,12,7). That code is
perfect: every word has one codeword within distance 3. A word at distance 0 to 2 gives the index of
that codeword; a word at distance 3 gives that of the five codewords at distance 4 too, six keys.
Two words that differ in one bit always share a key: if w is at distance 2 or less of its codeword,
the other is at 3 or less of the same one; if w is at 3 and the other decodes to another codeword,
then that one is at distance 4 of w and so among its keys. (first segment, index) is the join key.

Only distinct fingerprints are joined, so exact copies cost nothing. A bucket of two is compared
natively; up to `bucket` fingerprints are compared in one array; the fingerprints of larger buckets
are linked exactly in another way, by what they have in common: two of them are linked when they
are in the ball of radius one of the same 64-bit word, so each is sent to its 65 words and a word
(which gets at most 65) links all it got. Buckets give out the edges of a spanning forest, not all
pairs; components come from alternating large and small stars, written after each step.

Defined results: null or blank texts have fingerprint zero, which links like any other; rows with a
null doc_id are kept and labelled by the smallest doc_id of their component (null if it has none);
repeated rows are members like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import packed, settle, text_or_empty, texts, unpacked

WORDS = 3     # words of a shingle
SEED = 42     # of XXH64
MAX_BITS = 2  # the pigeonhole above is for two
BUCKET = 512  # fingerprints of a bucket that are compared in one array

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _syndromes() -> np.ndarray:
    """The remainder of x^i by the generator, for the 23 places i."""
    found, value = [], 1
    for _ in range(23):
        found.append(value)
        value <<= 1
        if value >> 11:
            value ^= GENERATOR
    return np.array(found, np.int64)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte place the syndromes of a word's bytes; per syndrome its leader and, where that has
    weight three, the five patterns of weight four."""
    place = _syndromes()
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for bit in range(min(8, 23 - 8 * k)):
            by_byte[k] ^= np.where(np.arange(256) >> bit & 1, place[8 * k + bit], 0)
    leader, near = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in range(1, 5):
        for places in combinations(range(23), weight):
            syndrome, pattern = 0, 0
            for p in places:
                syndrome, pattern = syndrome ^ int(place[p]), pattern | 1 << p
            if weight < 4:
                leader[syndrome] = pattern
            else:
                near[syndrome].append(pattern)
    return by_byte, leader, np.array([(x + [0] * 5)[:5] if len(x) == 5 else [0] * 5 for x in near], np.int64)


BY_BYTE, LEADER, NEAR = _tables()
BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def codeword_indices(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword; places of the words at distance three; their five further
    indices each. A codeword is known by its upper twelve bits."""
    syndrome = BY_BYTE[0][word & 255] ^ BY_BYTE[1][word >> 8 & 255] ^ BY_BYTE[2][word >> 16]
    far = np.flatnonzero(NEAR[syndrome, 0])
    return (word ^ LEADER[syndrome]) >> 11, far, (word[far, None] ^ NEAR[syndrome[far]]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints (unsigned): key and place of the fingerprint, several for each."""
    bits = prints.astype(np.uint64)
    a, b, c = ((bits >> np.uint64(42)).astype(np.int64), (bits >> np.uint64(21) & np.uint64(0x1FFFFF)).astype(np.int64),
               (bits & np.uint64(0x1FFFFF)).astype(np.int64))
    keys, places = [], []
    for family, (equal, fuzzy) in enumerate(((a, b), (b, c), (c, a))):
        head = (family << 22 | equal) << 12
        index, far, further = codeword_indices(fuzzy)
        keys += [head | index, (head[far, None] | further).ravel()]
        places += [np.arange(len(bits)), np.repeat(far, 5)]
    return np.concatenate(keys), np.concatenate(places)


def simhash(text: str, n_words: int = WORDS) -> int:
    """The fingerprint of a whole text."""
    from xxhash import xxh64_intdigest as digest

    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n_words:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - n_words + 1].tolist()
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[n_words - 1:].tolist(), strict=True)],
                      "<u8").view(np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n_words: int = WORDS, hashed_text: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; with the text's hash as text_hash if asked for."""
    more = ["text_hash"] if hashed_text else []

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([simhash(t, n_words) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": prints.view(np.int64), **{c: batch[c] for c in more}})

    rows = texts(docs).withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text", *more)
    return rows.mapInPandas(hashed, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in more)]))


def forest(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among a few fingerprints."""
    root, left, right = list(range(len(prints))), [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints) - 1):
        for j in (np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= max_bits) + i + 1).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[y] = x
                left.append(i)
                right.append(j)
    return prints[left], prints[right]


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u < v) that connect all distinct fingerprints within `max_bits` bits; column fp."""
    if max_bits != 2:
        raise ValueError("the segments and their keys are laid out for two differing bits")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            keys, places = fuzzy_keys(fp.view(np.uint64))
            yield pd.DataFrame({"key": keys, "fp": fp[places]})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fps in batch["fps"]:
                u, v = forest(np.sort(np.asarray(fps, np.int64)), max_bits)
                yield pd.DataFrame({"u": u, "v": v})

    keys = prints.mapInPandas(keyed, "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count("fp").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    sizes = settle(sizes.where("n > 1"), "golay-sizes")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    edges = sizes.where("n = 2").where(near).select("u", "v")
    crowded = sizes.where("n > 2").select("key", "n")
    members = settle(keys.join(crowded, "key").select("key", "n", "fp"), "golay-members")
    small = members.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    edges = edges.union(small.select("fps").mapInPandas(compared, "u long, v long"))
    hot = members.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    pairs = hot.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("word"))
    met = pairs.groupBy("word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u != v")
    return edges.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest vertex that each vertex of the edges (u, v) can reach: columns v and root.

    Alternating large and small stars: neighbours beyond a vertex are joined to its smallest
    neighbour, then those before it. Ends when a round changes nothing. Minima are taken before
    shuffling, so a vertex with very many neighbours is one row per task.
    """

    def linked(stars: DataFrame, purpose: str) -> DataFrame:
        return settle(stars.where("u != v").distinct(), purpose)

    def checksum(df: DataFrame):
        return df.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    # (v, u): v is linked to the smaller u.
    edges = linked(edges.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")), "links")
    state = checksum(edges)
    while state[0]:
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("low")).withColumn("low", F.least("low", "v"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("low").alias("u"))
        edges = linked(large, "large-stars")
        least = edges.groupBy("v").agg(F.min("u").alias("low"))
        joined = edges.join(least, "v")
        small = joined.select(F.col("u").alias("v"), F.col("low").alias("u")).union(joined.select("v", F.col("low").alias("u")))
        edges = linked(small, "small-stars")
        now = checksum(edges)
        if now == state:
            break
        state = now
    return edges.select("v", F.col("u").alias("root"))


def _rooted(prints: DataFrame, low, max_bits: int, bucket: int) -> DataFrame:
    """fp, low and root of each distinct fingerprint; `low` is an aggregate of its rows."""
    distinct = settle(prints.groupBy("fp").agg(low.alias("low")), "fingerprints")
    roots = components(links(distinct.select("fp"), max_bits, bucket)).withColumnRenamed("v", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, n_words: int = WORDS, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id."""
    prints = settle(fingerprints(docs, n_words), "simhash")
    rooted = _rooted(prints, F.min("doc_id"), max_bits, bucket)
    labels = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labelled = rooted.select("fp", "root").join(labels, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, n_words: int = WORDS, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all its columns.

    Of rows with that doc_id and different texts the one with the smallest hash of its text stays, and
    of repeated rows one. A row without doc_id stays where no row of its component has one.
    """
    prints = settle(fingerprints(docs, n_words, True), "simhash")
    low = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash"))
    kept = _rooted(prints, low, max_bits, bucket).groupBy("root").agg(F.min("low").alias("low")).select(
        F.col("low.doc_id").alias("kept_"), F.col("low.text_hash").alias("hash_"))
    # The row goes along as one column, so that none of its columns can clash.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("hash"), packed(docs))
    same = F.col("id").eqNullSafe(F.col("kept_")) & (F.col("hash") == F.col("hash_"))
    first = rows.join(kept, same, "left_semi").dropDuplicates(["id", "hash"])
    return first.select(*unpacked(docs))
