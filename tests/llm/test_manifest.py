"""The Merkle manifest against trees built node by node."""

import hashlib
import zlib

from plumbline.llm import manifest
from tests.llm.test_llm import odd_docs


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def leaf(row):
    shown = [b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in row]
    return digest(b"".join(shown))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, place):
    for level in tree[:-1]:
        first = place - place % 8
        yield "".join(level[first:place]), "".join(level[place + 1:first + 8])
        place //= 8


def brute(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    names = sorted({r[2] for r in rows}, key=lambda n: (n is not None, (n or "").encode()))
    groups = {n: sorted(((r, leaf(r)) for r in rows if r[2] == n), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for n in names}
    trees = {n: levels([x[1] for x in groups[n]]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for place, (row, hashed) in enumerate(groups[name]):
            path = [*siblings(trees[name], place), *siblings(top, k)]
            node = hashed
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for left, right in path:
                node = digest(left + node + right)
            root = top[-1][0]
            out.append((row[0], hashed, trees[name][-1][0], root, digest("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def check(docs):
    got = sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=repr)
    assert got == brute(docs)
    return got


def test_documents(spark, data_dir):
    got = check(spark.read.parquet(f"{data_dir}/documents.parquet"))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


def test_odd_rows(spark):
    docs = odd_docs(spark)
    check(docs)
    lone = check(docs.limit(1))
    assert lone[0][1] == lone[0][2] == lone[0][3] and lone[0][4] == digest("")
    assert check(docs.limit(0)) == []


def test_groups_of_several_rounds(spark):
    """5,000 rows of one group are 10 blocks of 512; 513 rows are a full block and a lone node."""
    docs = spark.range(5600).selectExpr(
        "id AS doc_id", "concat('Text ', id % 700) AS text", "CASE WHEN id < 5000 THEN 'en' WHEN id < 5513 THEN 'de' WHEN id % 2 = 0 THEN '' END AS lang",
        "'s' AS source", "id AS n_chars", "id AS grp", "'x' AS path")
    check(docs)
    names = docs.selectExpr("doc_id", "text", "concat('l', doc_id % 600) AS lang", "source", "n_chars")  # more groups than a block holds
    check(names)
