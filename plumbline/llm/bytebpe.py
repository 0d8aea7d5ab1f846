"""Byte-level BPE encoding and decoding with a rank queue.

The distinct pre-tokens of some documents are merged together. Their bytes, with a separator between
pre-tokens, form one linked list of tokens. Every pair of neighbours that the vocabulary can merge
waits in the bucket of its merge rank; a hierarchical bitmap (256-way, one bit per bucket) finds the
lowest rank that waits by find-first-set, level by level. The positions of that bucket are merged
from left to right, until one of them makes a pair of a lower rank: then that rank is next. Entries
whose pair has changed meanwhile are stale and skipped. Pre-tokens do not touch each other, so each
sees its own pairs in the order of their ranks, leftmost first. n bytes cost O(n log n), in one
long pre-token or in many short ones.

Defined results: a null text counts as empty and has no ids; the decimal ids of an empty text are
the empty string. Rows are independent: repeated rows and repeated ids give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Collection, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plumbline.llm.common import texts

# Pre-tokens whose ids a worker keeps; a full cache starts anew. One that is lost is merged again.
PRETOKENS = 500_000
# Code points of the documents that are encoded at a time (a longer document: alone), and bytes of
# the pre-tokens that are merged at a time (a longer one: alone).
HELD, MERGED = 500_000, 25_000
# Bits of one word of the rank bitmap.
WORD = 256
BITS = [1 << k for k in range(WORD)]
# No UTF-8 text holds this byte, so no pair across it is in the vocabulary.
SEPARATOR = b"\xff"


def _portions(items: Collection, sizes: Iterator[int], most: int) -> Iterator[list]:
    """Consecutive items whose sizes add up to `most` at least, but for the last ones."""
    portion, held = [], 0
    for item, size in zip(items, sizes, strict=True):
        portion.append(item)
        held += size
        if held >= most:
            yield portion
            portion, held = [], 0
    if portion:
        yield portion


class ByteBpe:
    """Encoder and decoder of one vocabulary of ranks, with the pattern that cuts pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.ids = list(range(len(self.bytes_of)))  # one object per id, for all results
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.merges = {token: rank for token, rank in ranks.items() if len(token) > 1 and SEPARATOR not in token}
        self.of_two = np.full(65_536, -1)
        for token, rank in self.merges.items():
            if len(token) == 2:
                self.of_two[token[0] << 8 | token[1]] = rank
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of every pre-token. The queue's operations stand inline: calls would cost more."""
        data = SEPARATOR + SEPARATOR.join(pieces) + SEPARATOR * 2
        n, rank_of = len(data), self.merges.get
        values = np.frombuffer(data, np.uint8).astype(np.int64)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens = self.of_byte[values].tolist()  # the id of the token that begins at a position
        pair = self.of_two[values[:-1] << 8 | values[1:]]
        current = [*pair.tolist(), -1]  # the rank of the pair that begins at a position
        buckets, words, top = self._first_buckets(pair)
        while top:
            high = (top & -top).bit_length() - 1  # find-first-set at both levels
            word = words[high]
            low = (word & -word).bit_length() - 1
            rank = high << 8 | low
            bucket = buckets.pop(rank)
            words[high] = word = word ^ BITS[low]
            if not word:
                top ^= 1 << high
            bucket.sort()
            positions, lower = iter(bucket), False
            for i in positions:
                if current[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[gone]
                after[i], before[end], tokens[i] = end, i, rank
                tokens[gone] = current[gone] = -1
                left = before[i]
                current[i] = fresh = rank_of(data[i:after[end]], -1)
                if fresh >= 0:  # push
                    if fresh in buckets:
                        buckets[fresh].append(i)
                    else:
                        buckets[fresh] = [i]
                        words[fresh >> 8] |= BITS[fresh & 255]
                        top |= 1 << (fresh >> 8)
                    lower = fresh < rank
                current[left] = fresh = rank_of(data[left:end], -1)
                if fresh >= 0:
                    if fresh in buckets:
                        buckets[fresh].append(left)
                    else:
                        buckets[fresh] = [left]
                        words[fresh >> 8] |= BITS[fresh & 255]
                        top |= 1 << (fresh >> 8)
                    lower = lower or fresh < rank
                if lower:  # the others of this rank wait again
                    rest = list(positions)
                    if rest:
                        buckets.setdefault(rank, []).extend(rest)
                        words[high] |= BITS[low]
                        top |= 1 << high
                    break
        left_over = np.array(tokens)
        begins = np.cumsum([1, *[len(piece) + 1 for piece in pieces]])
        left_over[begins - 1] = left_over[n - 1] = -1
        ends = np.cumsum(left_over >= 0)[begins[1:] - 1].tolist()
        flat = list(map(self.ids.__getitem__, left_over[left_over >= 0].tolist()))
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def _first_buckets(self, pair: np.ndarray) -> tuple[dict[int, list[int]], list[int], int]:
        """The queue of all pairs of two bytes: buckets, and both levels of the bitmap."""
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        found, starts = np.unique(pair[at], return_index=True)
        buckets = {rank: part.tolist() for rank, part in zip(found.tolist(), np.split(at, starts[1:]))}
        words, top = [0] * (len(self.bytes_of) // WORD + 1), 0
        for rank in buckets:
            words[rank >> 8] |= BITS[rank & 255]
            top |= 1 << (rank >> 8)
        return buckets, words, top

    def _learn(self, pretokens: set[str]) -> None:
        """Have the ids of all these pre-tokens in the cache."""
        new = pretokens.difference(self.known)
        if len(self.known) + len(new) > PRETOKENS:
            self.known.clear()
            new = pretokens
        pieces = []
        for pretoken in new:
            piece = pretoken.encode()
            whole = self.ranks.get(piece)
            if whole is None:
                pieces.append((pretoken, piece))
            else:
                self.known[pretoken] = (self.ids[whole],)
        for portion in _portions(pieces, (len(piece) for _, piece in pieces), MERGED):
            self.known.update(zip([p for p, _ in portion], self.merge([piece for _, piece in portion])))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        for portion in _portions(texts, map(len, texts), HELD):
            cuts = list(map(self.cut, portion))
            self._learn(set(chain.from_iterable(cuts)))
            for cut in cuts:
                yield list(chain.from_iterable(map(self.known.__getitem__, cut)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """A vocabulary file of ranks, read once by each worker."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return ByteBpe({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, digests of its ids and of the bytes they decode to.

    `with_ids` adds the ids themselves (array<int>). The vocabulary file must be at the same path
    on every machine.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path, pattern)
        decimal = [str(i) for i in range(len(bpe.bytes_of))]
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        for batch in batches:
            for part in _portions(range(len(batch)), batch["text"].str.len(), HELD):
                rows = []
                for ids in bpe.encode_all(batch["text"].iloc[part].tolist()):
                    listed = ",".join(map(decimal.__getitem__, ids))
                    row = (len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                           hashlib.sha256(bpe.decode(ids)).hexdigest())
                    rows.append((*row, np.array(ids, np.int32)) if with_ids else row)
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "doc_id", batch["doc_id"].iloc[part].to_numpy())
                yield out

    return texts(docs).mapInPandas(encoded, schema + (", ids array<int>" if with_ids else ""))
