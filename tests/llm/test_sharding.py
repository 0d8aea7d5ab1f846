"""Minimax sharding against a brute-force partition."""

import hashlib
import random
import zlib
from itertools import accumulate

import pytest

from plumbline.llm import shards
from tests.llm.test_llm import odd_docs, pairs


def brute_ends(sizes, n_shards):
    """Ends of the shards of the smallest capacity; a group that decides it is set apart, and the rest cut again."""
    alone, ends = set(), list(accumulate(sizes))
    while True:
        def filled(capacity):
            out, i = [], 0
            while i < len(sizes) and len(out) <= n_shards:
                first, held = i, 0
                if i in alone:
                    i += 1
                while first not in alone and i < len(sizes) and i not in alone and held + sizes[i] <= capacity:
                    held, i = held + sizes[i], i + 1
                if i == first:
                    return None
                out.append(ends[i - 1])
            return out if len(out) <= n_shards else None

        low, high = 1, ends[-1]
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if filled(middle) else (middle + 1, high)
        deciding = [i for i, s in enumerate(sizes) if s == low and i not in alone]
        if not deciding or low < max(s for i, s in enumerate(sizes) if i not in alone):
            return filled(low)
        alone.add(deciding[0])


def brute_shards(rows, n_shards=shards.SHARDS):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text, []).append(doc_id)

    def order(text):
        known = [d for d in groups[text] if d is not None]
        return bool(known), min(known, default=0), hashlib.sha256(text.encode()).digest()

    texts = sorted(groups, key=order)
    sizes = [len(groups[t]) * (len(t.encode()) + 1) for t in texts]
    ends = brute_ends(sizes, n_shards) if sizes else []
    out, slots, at = [], {}, 0
    for text, size in zip(texts, sizes, strict=True):
        at += size
        shard = sum(at > end for end in ends)
        for doc_id in sorted(groups[text], key=lambda d: (d is not None, d or 0)):
            slots[shard] = slots.get(shard, -1) + 1
            out.append((doc_id, len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", shard, slots[shard], None))
    return out


def check(df, n_buckets=shards.BUCKETS):
    got = sorted((tuple(r) for r in shards.shards(df, n_buckets=n_buckets).collect()), key=repr)
    assert got == sorted(brute_shards(pairs(df)), key=repr)
    return got


def test_documents(spark, data_dir):
    check(spark.read.parquet(f"{data_dir}/documents.parquet"))


def test_odd_rows(spark):
    check(odd_docs(spark))
    empty = odd_docs(spark).limit(0)
    assert check(empty) == []


@pytest.mark.parametrize("n_buckets", [64, shards.BUCKETS])
def test_a_hot_text_is_a_shard_by_itself(spark, n_buckets):
    rng = random.Random(5)
    rows = [(i, "hot " * 40 if i % 3 == 0 else "x" * rng.randint(0, 300)) for i in range(600)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), n_buckets)
    crc = zlib.crc32(b"hot " * 40)
    hot = {r[4] for r in got if r[2] == crc}
    assert len(hot) == 1 and len({r[4] for r in got}) == shards.SHARDS
    assert {r[2] for r in got if r[4] in hot} == {crc}


def test_capacities_of_many_partitions(monkeypatch):
    rng = random.Random(9)
    for trial in range(150):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        if trial % 2:
            sizes[rng.randrange(len(sizes))] = rng.randint(100, 2000)
        ends = list(accumulate(sizes))

        def between(_, windows, n_buckets):
            width, found = -(-shards._width(windows) // n_buckets), {}
            for k, (low, high) in enumerate(windows):
                for end in ends:
                    if low <= end <= high:
                        found.setdefault((k, (end - low) // width), []).append(end)
            return shards.Ends([(min(f), max(f)) for f in found.values()])

        monkeypatch.setattr(shards, "ends_between", between)
        wanted = brute_ends(sizes, 16)
        alone, capacity = [], None
        largest = sorted(((e - s, e) for e, s in zip(ends, sizes, strict=True)), key=lambda g: (g[0] - g[1], g[1]))
        while True:
            rest = [g for g in largest if g not in alone]
            least = max((b - a for a, b in rest[:1]), default=1)
            capacity, found = shards.smallest_capacity(
                None, 16, ends[-1], least, alone, between(None, [(0, ends[-1])], 16), 16)
            deciding = [g for g in rest if g[1] - g[0] == capacity]
            if not deciding:
                break
            alone = sorted([*alone, deciding[0]])
        assert found == wanted + [ends[-1]] * (16 - len(wanted)), sizes
