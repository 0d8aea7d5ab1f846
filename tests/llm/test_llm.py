"""The training-data operators against brute force, on odd rows and on small tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import arrowids, bytebpe, chat, chunks, fixity, golay, maxscore, mixing, pii, toxicity
from plumbline.llm.oracles import ORACLES
from plumbline.llm.queries import BYTE_BPE, END_ID, QUERIES, SHARE, WEIGHTS, WORD_BPE
from tests.compare import connect, oracle_result, spark_result

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, start long"
LONG = "the clown said 4111 1111 1111 1111 to a.b@c.de " * 3000


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, equal ids, and columns named like results."""
    texts = [None, "", "   \n\t ", "a", "one two", LONG, LONG, LONG + "x", "İstanbul ß <|endoftext|> you're  \n x", "1" * 3000, "a" * 5000]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 1 else f"src{i}", None, 0.5, 9, 1) for i, t in enumerate(texts)]
    rows += [rows[5], (7, "another text with the id of one before", "en", "src7", 3, 0.1, 1, 1), (None, "no id here", "en", None, 2, None, None, 2)]
    return spark.createDataFrame(rows, DOCS)


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, data_dir, name):
    assert spark_result(QUERIES[name](spark, data_dir)) == oracle_result(connect(data_dir), ORACLES[name])


# Personal data

def brute_spans(text):
    found = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and sum(
                    sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns(docs):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab.@-+ 0123456789()_%é") for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    for text in [t for _, t in pairs(docs)] + made + ["a.b@c.d@e.f", "@@a@b.c", "1.2.3.4.5.6.7.8", "1.2.3.256.4.5.6.7", "x@y", "a@b.c.", "٣@a.b"]:
        assert pii.base_spans(text) == brute_spans(text), text


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [f"please call the office +1 555 010 {1000 + i} today" for i in range(12)]
    seeds += [f"send mail to user{i}@example.com now" for i in range(8)]
    unseen = ["please call the office (555) 010-9999 today", "send mail to root@localhost now", "part 5550109998 was sold"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(seeds + unseen)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert [got[20 + i].spans for i in range(3)] == ["phone:23:37", "email:13:27", ""]
    assert all(got[i].n_phone == 1 and got[i].n_found == 0 for i in range(12))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[20] == "please call the office [PHONE] today" and clean[22] == unseen[2] and clean[12] == "send mail to [EMAIL] now"


def offered(text):
    return {(text[a:b], pii.KINDS[k]) for a, k, b in pii.candidates(text, pii.base_spans(text))}


def test_numbers_side_by_side_are_candidates_by_themselves():
    # Texts of the sf0.1 documents 46, 1262, 1377 and 7052.
    assert {("7536784127813050", "card"), ("4845168114407329", "card")} <= offered("Éçan 7536784127813050 4845168114407329 èaique")
    assert {("2353820953013749", "card"), ("4550997810720808", "card")} <= offered("Esanwh 2353820953013749 4550997810720808 thheed")
    assert ("+1 (826) 555-4081", "phone") in offered("éreé. Des +1 (826) 555-4081 190.137.223.204 du anviou")
    assert ("+1 (843) 555-7672", "phone") in offered("éaiépa un. +1 (843) 555-7672 170.106.47.218 Et, éan")
    assert {("5550109999", "phone"), ("5550109999. 20", "card")} <= offered("call 5550109999. 20 came")
    assert {("5550109999", "phone"), ("4845168114407328", "card")} <= offered("5550109999-4845168114407328")
    assert offered("1" * 3000) == set()


def test_numbers_side_by_side_are_found(spark):
    seeds = [f"please call the office +1 555 010 {1000 + i} today" for i in range(12)]
    merged = ["please call the office 5550109999 4845168114407328 of", "+1 (826) 555-4081 190.137.223.204", "see +1 (826) 555-4081",
              "please call the office 555 010 9997 today"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(seeds + merged)], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_found) for r in pii.find(df).collect()}
    assert got[12] == ("phone:23:33", 1)
    assert got[13] == ("phone:0:17,ip:18:33", 1)  # a seed elsewhere
    assert got[15] == ("phone:23:35", 1)


def test_contexts_are_followed_until_nothing_changes(spark):
    # Each place hands unseen numbers on to the next, which has no seed of its own.
    texts = [f"call the office a +1 555 010 {1000 + i} x{i}" for i in range(16)]
    for place, handed in enumerate((12, 8, 4, 2)):
        for i in range(handed):
            texts += [f"call the office {"abcde"[place]} 555010{place}{10 + i}7 y", f"call the office {"abcde"[place + 1]} 555010{place}{10 + i}7 z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.n_found for r in pii.find(df).orderBy("doc_id").collect()] == [0] * 16 + [1] * 52


def test_kinds_of_long_numbers_follow_their_contexts(spark):
    texts = [f"please call the office +1 555 010 {1000 + i} today" for i in range(12)]
    texts += [f"it was paid with card 4111 1111 1000 {k:04} there" for k in range(200) if pii.luhn(f"411111111000{k:04}")][:12]
    texts += ["please call the office 919876543210 today", "please call the office 0049 151 23456789 today",
              "it was paid with card 411111111113 there", "it took 919876543211 steps"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [got[24 + i] for i in range(4)] == ["phone:23:35", "phone:23:40", "card:22:34", ""]


def test_pii_of_odd_rows(spark):
    df = odd_docs(spark)
    want = Counter((i, hashlib.sha256(pii.shown(brute_spans(t)).encode()).hexdigest()) for i, t in pairs(df))
    assert Counter((r.doc_id, r.base_sha256) for r in pii.find(df).collect()) == want
    assert pii.find(df.limit(0)).count() == 0
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.count() == df.count()


# Search

def brute_top(vectors, every, k):
    out = []
    for q, a in vectors.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), v) for v, b in vectors.items() if v != q)
            out += [(q, rank, v, -s) for rank, (s, v) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(50, 3), (4096, 2048)])
def test_search_equals_brute_force(spark, shard, block):
    rng = random.Random(5)
    vectors = {i: [rng.choice([0, 0, -3, 1, 2, 7]) for _ in range(12)] for i in range(700)}
    vectors |= {i: vectors[0] for i in range(700, 760)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, parts array<double>")
    got = maxscore.top_k(df, F.col("vec_id") % 20 == 0, 5, shard, block)
    assert sorted(map(tuple, got.collect())) == brute_top(vectors, 20, 5)


@pytest.mark.parametrize("shard,block", [(50, 3), (4096, 2048)])
def test_search_takes_every_vector_of_an_id(spark, shard, block):
    rng = random.Random(8)
    rows = [(rng.randint(0, 150), [float(rng.choice([0, -3, 1, 2, 7])) for _ in range(6)]) for _ in range(600)]
    best = {}
    for q, a in rows:
        for v, b in rows:
            if q % 10 == 0 and v != q:
                best[q, v] = max(best.get((q, v), -10**9), int(sum(x * y for x, y in zip(a, b, strict=True))))
    want = []
    for q in {q for q, _ in best}:
        top = sorted((-s, v) for (p, v), s in best.items() if p == q)[:5]
        want += [(q, rank, v, -s) for rank, (s, v) in enumerate(top, 1)]
    table = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<float>")
    got = maxscore.top_k(maxscore.integer_vectors(table, 1), F.col("vec_id") % 10 == 0, 5, shard, block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, []), (5, [float("inf")]), (0, [1.0, 2.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, maxscore.search_embeddings(df).collect()))
    assert got == [(0, 1, 50, 256 * 128), (0, 2, 4, 0), (50, 1, 0, 256 * 128), (50, 2, 4, 0)]
    assert maxscore.search_embeddings(df.limit(0)).count() == 0


# Token ids

def test_arrow_ids_of_special_strings_equal_the_plain_call(spark, tmp_path):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = ["a <|endoftext|> b", "x<|startoftext|>Y. <|endoftext|>!", "<|endoftext|", "\t<|ENDOFTEXT|> é<|endoftext|>é\n<|startoftext|>"]
    odd_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) \
        .coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, END_ID], "<u4").tobytes())) for i, t in pairs(df)]
    got = QUERIES["op3_arrow_ids"](spark, str(tmp_path)).select("doc_id", "ids_crc32").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_arrow_ids_equal_the_library(spark, docs, tmp_path):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    tokenizer.encode_special_tokens = True
    for df in (docs, odd_docs(spark)):
        start, want, stream = 0, [], []
        for doc_id, text in sorted(pairs(df), key=lambda p: (p[0] is not None, p)):
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, END_ID]
            want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
            stream += ids
        manifest = arrowids.write_ids(df, str(tmp_path / str(len(want))), WORD_BPE, END_ID, length=64, rows=8)
        assert Counter(map(tuple, arrowids.read_documents(manifest).collect())) == Counter(want)
        for file in manifest.collect():
            for k in {0, file.n_tokens // 64 // 2, (file.n_tokens - 1) // 64}:
                ids, mask = arrowids.sequence(file.ids_file, k)
                own = stream[file.base + 64 * k:file.base + min(64 * k + 64, file.n_tokens)]
                assert ids[mask].tolist() == own and len(ids) == 64
    assert arrowids.token_ids(docs.limit(0), WORD_BPE, END_ID, str(tmp_path / "none")).count() == 0


# Near-duplicates

def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints):
    roots = {p: p for p in prints}

    def find(p):
        while roots[p] != p:
            p = roots[p]
        return p

    listed = sorted(roots)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= 2:
                roots[find(a)] = find(b)
    return {p: find(p) for p in roots}


@pytest.mark.parametrize("bucket", [2, 512])
def test_components_equal_brute_force(spark, docs, bucket):
    for df in (docs, odd_docs(spark)):
        prints = [(i, brute_print(t)) for i, t in pairs(df)]
        roots = brute_roots([p for _, p in prints])
        least = {}
        for i, p in prints:
            if i is not None:
                least[roots[p]] = min(least.get(roots[p], i), i)
        want = Counter((i, f"{p:016x}", least.get(roots[p])) for i, p in prints)
        assert Counter(map(tuple, golay.near_duplicates(df, bucket=bucket).collect())) == want


def test_one_row_of_each_component_stays(spark):
    body = [f"group {g} " + " ".join(f"w{g}x{k}" for k in range(400)) for g in range(4)]
    rows = [(1, body[0]), (None, body[0].upper()), (None, body[1]), (None, body[1].upper()), (5, body[2]), (5, body[2].upper()),
            (5, body[3]), (4, body[3].upper()), (4, body[3].upper()), (None, body[3])]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert len({golay.simhash(t) for t in body}) == 4
    got = [tuple(r) for r in golay.keep_first(df).collect()]
    assert Counter(t.lower().split()[1] for _, t in got) == Counter("0123")
    assert {t.lower().split()[1]: i for i, t in got} == {"0": 1, "1": None, "2": 5, "3": 4}


def test_no_pair_of_fingerprints_is_missed(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64) for _ in range(2)]
    hub = base[0] ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))  # a crowded neighbourhood
    every = np.unique(np.concatenate([base, base ^ flips[0], base ^ flips[0] ^ flips[1], hub]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    want = brute_roots([int(x) for x in every])
    groups = Counter(want.values())
    for bucket in (3, 512):
        roots = {r.v: r.root for r in golay.components(golay.links(df, bucket=bucket)).collect()}
        got = Counter(roots.get(int(x), int(x)) for x in every.view(np.int64))
        assert sorted(got.values()) == sorted(groups.values())


def test_golay_keys_tolerate_any_single_error():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    own = [set() for _ in prints]
    for key, place in zip(*golay.fuzzy_keys(prints), strict=True):
        own[place].add(int(key))
    for a in range(64):
        for b in range(a + 1):
            changed = prints ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b) if a != b else np.uint64(0))
            met = np.zeros(len(prints), bool)
            for key, place in zip(*golay.fuzzy_keys(changed), strict=True):
                met[place] |= int(key) in own[place]
            assert met.all()


# Fixity

def test_audit_finds_every_fault(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(1200)] + [(None, None, None), (5, "http://h/5", "again")],
                                  "page_id long, url string, html string")
    records = fixity.warc_records(pages)
    first = fixity.place(records)
    second = fixity.place(fixity.damage(records, F.col("page_id").isin(3, 700))).where("page_id IS NULL OR page_id NOT IN (44, 1199)")
    place = {(r.page_id, r.offset): r for r in first.collect()}
    got = {(r.file, r.offset): r.status for r in fixity.audit(first, second, width=2048, fan=4).collect()}
    want = {(r.file, r.offset): "damaged" if i in (3, 700) else "missing" for (i, _), r in place.items() if i in (3, 44, 700, 1199)}
    assert got == want
    assert fixity.audit(first, first).count() == 0 and fixity.audit(first.limit(0), first.limit(0)).count() == 0
    assert {r.status for r in fixity.audit(second, first).collect()} == {"damaged", "added"}


# Toxicity

def test_classifier_on_held_out_documents(spark, docs, data_dir):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    corpus = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = toxicity.toxicity(corpus, labels).join(labels, "doc_id").join(corpus.select("doc_id", "lang"), "doc_id")
    tested = got.where("held_out AND lang = 'en'").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in tested)
    assert sum(r.predicted for r in tested if r.toxic == 0) == 0
    assert sum(r.predicted for r in tested if r.toxic) >= 0.7 * sum(r.toxic for r in tested)


def test_toxicity_of_odd_rows(spark):
    df = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(df, none).collect()} == {(0.5, 0)}
    labels = spark.createDataFrame([(1, 0, None), (5, 0, 1), (5, 0, 0), (None, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.keep_clean(df, none).columns == df.columns


# Byte-level BPE

@pytest.fixture(scope="module")
def library():
    with open(BYTE_BPE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, docs, library):
    for df in (docs, odd_docs(spark)):
        want = Counter()
        for doc_id, text in pairs(df):
            ids = library.encode_ordinary(text)
            want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter(map(tuple, bytebpe.encode_documents(df, BYTE_BPE, public_tokenizers.PATTERN).collect())) == want


def test_bpe_of_long_and_odd_pretokens(library):
    own, rng = bytebpe.load(BYTE_BPE, public_tokenizers.PATTERN), random.Random(4)
    made = ["".join(rng.choice(" \n\t'aàbs1.\x1c\x85 日é") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for text in [*made, "a" * 20_000, "ab" * 9000, "".join(rng.choice("abcde") for _ in range(20_000)), " ", "  a", " a  b"]:
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def brute_merge(ranks, piece):
    """Whole pieces first, then always the leftmost pair of the lowest rank."""
    parts = [piece] if piece in ranks else [piece[i:i + 1] for i in range(len(piece))]
    while True:
        ranked = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not ranked:
            return [ranks[part] for part in parts]
        i = min(ranked)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("sizes", [(5, 20, 7), (50, 1, 1), (10_000, 10_000, 10_000)])
def test_bpe_of_vocabularies_in_any_order(monkeypatch, sizes):
    """Merges that make pairs of lower ranks, repeated letters, and caches that start anew."""
    for name, size in zip(("PRETOKENS", "HELD", "MERGED"), sizes):
        monkeypatch.setattr(bytebpe, name, size)
    rng = random.Random(9)
    for _ in range(60):
        tokens = {bytes(rng.choices(b"abc\xff", (5, 4, 2, 1), k=rng.randint(2, 6))) for _ in range(40)}
        listed = [*(bytes([b]) for b in range(256)), *rng.sample(sorted(tokens), len(tokens))]
        ranks = {token: rank for rank, token in enumerate(listed)}
        own = bytebpe.ByteBpe(ranks, r"\S+|\s+")
        texts = [" ".join("".join(rng.choices("abcé", (6, 4, 2, 1), k=rng.randint(0, 25))) for _ in range(rng.randint(0, 6))) for _ in range(12)]
        want = [[i for piece in re.findall(r"\S+|\s+", text) for i in brute_merge(ranks, piece.encode())] for text in texts]
        assert list(own.encode_all(texts)) == want
        assert [own.decode(ids).decode() for ids in want] == texts


# Chat

def test_layouts_become_canonical_turns(spark):
    records = [
        '{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        '{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"id": 3, "prompt": "q", "response": "a"}',
        '{"id": 4, "system": "s", "instruction": "q", "input": "more", "output": "a"}',
        '{"conv_id": 5, "turn": 0, "role": "user", "text": "q"}', '{"strange": [1, {"x": 2}]}', None]
    df = spark.createDataFrame([(r,) for r in records], "record string")
    got = {}
    for r in chat.canonical_turns(df).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text) if r.unmapped is None else r.unmapped)
    pair = [(0, "user", "q"), (1, "assistant", "a")]
    assert got[1] == got[2] == pair and [t[1:] for t in got[3]] == [t[1:] for t in pair] and got[5] == pair[:1]
    assert [t[1:] for t in got[4]] == [("system", "s"), ("user", "q\nmore"), ("assistant", "a")]
    assert len(got[None]) == 2


def test_conversations_are_written_in_the_layouts_of_their_shapes(spark):
    def talk(conv_id, *said, first=0):
        return [(conv_id, first + k, role, text) for k, (role, text) in enumerate(said)]

    q, a = ("user", "q é"), ("assistant", "a\n")
    rows = [*talk(1, q, a), *talk(2, ("system", "s"), ("user", "q\nmore\nlines"), a), *talk(3, q, a, q), *talk(4, ("system", ""), q, a),
            *talk(5, q, a, first=1), *talk(6, ("human", "h"), a), *talk(7, *[q, a] * 50), *talk(8, (None, None), q), *talk(None, q, a),
            *talk(9, q, ("assistant", None)), (10, None, "user", "x"), (10, 0, "user", "x"), *talk(11, ("user", "\nx"), a)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.write_records(df)
    turns = chat.canonical_turns(records).collect()
    used = {}
    for t in turns:
        used.setdefault(t.layout, set()).add(t.conv_id)
    assert used == {"prompt": {1, 9, 11, None}, "instruction": {2}, "shared": {3}, "messages": {4, 8}, "turn rows": {5, 6, 7, 10}}
    plain = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    want = chat.format_conversations(df.select(plain.alias("record"))).collect()
    assert len(want) == 12
    for grouped in (False, True):
        assert Counter(chat.format_conversations(records, grouped).collect()) == Counter(want)


def test_records_without_a_mapping_are_counted(spark):
    records = ['{"id": 1, "prompt": "q", "response": "a"}', '{"id": 2, "prompt": "q", "response": "a", "source": "x"}',
               '{"id": 3, "prompt": "q", "response": "b", "source": "y"}', '{"id": 4, "messages": []}']
    got = chat.format_conversations(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert sorted((r.conv_id or 0, r.n_records or 0) for r in got) == [(0, 1), (0, 2), (1, 0)]
    assert all((r.unmapped is None) == (r.n_turns is not None) for r in got)


def test_formatting_is_reversible():
    rng = random.Random(6)
    bits = [*chat.CONTROLS, "\\", "\n", "n", "s", "<", "[", "]", "é", "/"]
    for _ in range(5000):
        role = rng.choice(["user", "assistant", "system", "", "".join(rng.choices(bits, k=4))])
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        shown, start, end = chat.format_turn(role, text)
        assert chat.read_turn(shown) == (role, text)
        assert not any(control in chat.escape(text) for control in chat.CONTROLS)
        assert role != "assistant" or chat.unescape(shown[start:end]) == text


def test_digests_of_odd_turns(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, None, "", ""), (None, 3, "user", "x")],
                                  "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(turns)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nassistant\na\nassistant\nb\n").hexdigest() and got[None].n_turns == 1
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0


# Fingerprints by chunks

def test_chunk_fingerprints_equal_brute_force(spark, docs):
    for df, ranges in ((docs, None), (docs, 1), (odd_docs(spark), 5)):
        rows = sorted(pairs(df), key=lambda p: (p[0] is not None, p), reverse=True)
        want = Counter()
        for k, (doc_id, text) in enumerate(rows):
            after, third = rows[(k + 1) % len(rows)][1], len(text) // 3
            changed = text[:len(text) - third] + after[:third]
            own = chunks.fingerprint(text)
            want[doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), chunks.listed(own),
                 chunks.listed(chunks.fingerprint(changed)), chunks.containment(own, chunks.fingerprint(changed)),
                 chunks.containment(own, chunks.fingerprint(after))] += 1
        assert Counter(map(tuple, chunks.document_fingerprints(df, ranges).collect())) == want
    assert chunks.document_fingerprints(docs.limit(0)).count() == 0


def test_boundaries_follow_the_content():
    rng = random.Random(8)
    data = bytes(rng.randrange(256) for _ in range(3000))

    def rolled(i):
        value = 0
        for b in data[max(0, i - 31):i + 1]:
            value = (value << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        return value

    assert chunks.gear_hashes(data).tolist() == [rolled(i) for i in range(len(data))]
    ends = chunks.boundaries(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunks.MOST and sizes[:-1].min() >= chunks.LEAST
    shifted = chunks.boundaries(b"some more" + data)
    assert len({e - 9 for e in shifted} & set(ends)) > 0.9 * len(ends)


# Mixing

def test_mixing_of_odd_rows(spark, docs):
    df = odd_docs(spark)
    taken = mixing.mix(df, WEIGHTS, SHARE)
    assert taken.columns == df.columns
    assert mixing.mix(docs.limit(0), WEIGHTS, SHARE).count() == 0
    assert mixing.selection(docs, {"d0": 0, "d1": 0, "d2": 0, "d3": 0, "other": 0}, SHARE).count() == 0
    counted = mixing.selection(docs, WEIGHTS, (4, 5))
    want = {r.doc_id: r.copies for r in counted.collect()}
    assert Counter(r.doc_id for r in mixing.mix(docs, WEIGHTS, (4, 5)).collect()) == want


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 500), ("d0", "fr", "c", 500), ("d1", "en", "d", 500)],
                                   "domain string, language string, origin string, tokens long")
    got = {r.origin: r.given for r in mixing.budgets(leaves, 400, {}, 1).collect()}
    # d0 and d1 get 200 each, en and fr of d0 100 each; a has only 10, so b gives the other 90.
    assert got == {"a": 10, "b": 90, "c": 100, "d": 200}
    got = {r.origin: r.given for r in mixing.budgets(leaves, 1400, {}, 1).collect()}
    assert got == {"a": 10, "b": 440, "c": 450, "d": 500}


# The pipeline

def test_pipeline_equals_brute_force(spark, data_dir, library, tmp_path):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    (_, toxic), (_, copies), (_, personal), (_, mixed), (_, encode) = corpus_pipeline.STAGES
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    kept = toxic(spark, docs, data_dir)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
    prints = {i: brute_print(t) for i, t in pairs(kept)}
    roots, least = brute_roots(prints.values()), {}
    for i, p in prints.items():
        least[roots[p]] = min(least.get(roots[p], i), i)
    single = copies(spark, kept, data_dir)
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values()) and single.columns == docs.columns
    clean = personal(spark, single, data_dir)
    assert clean.columns == docs.columns and all(not brute_spans(t) for _, t in pairs(clean))
    blend = mixed(spark, clean, data_dir)
    assert blend.columns == docs.columns
    want = Counter((i, tuple(library.encode_ordinary(t))) for i, t in pairs(blend))
    assert Counter((r.doc_id, tuple(r.ids)) for r in encode(spark, blend, data_dir).collect()) == want
    assert corpus_pipeline.run(spark, data_dir).count() == blend.count()
