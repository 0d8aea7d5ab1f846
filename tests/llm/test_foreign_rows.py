"""Records and columns from elsewhere: malformed and typed records, and columns named like the operators' own."""

import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, golay, pii
from tests.llm.test_llm import odd_docs

LINES = {
    "cut off": '{"id": 1, "prompt": "q", ',
    "no object": "[1, 2]",
    "a text": '"prompt"',
    "empty": "",
    "half a surrogate pair": '{"id": 2, "prompt": "\\ud800", "response": "a"}',
    "deep": "[" * 100_000,
    "a number as prompt": '{"id": 3, "prompt": 5, "response": "a"}',
    "a text as turn": '{"conv_id": 4, "turn": "x", "role": "user", "text": "q"}',
    "a list as text": '{"id": 5, "messages": [{"role": "user", "content": ["q"]}]}',
    "a list as id": '{"id": [6], "prompt": "q", "response": "a"}',
    "a boolean as id": '{"id": true, "prompt": "q", "response": "a"}',
    "a huge turn": '{"conv_id": 7, "turn": %d, "role": "user", "text": "q"}' % 10 ** 30,
    "a huge id": '{"id": %d, "prompt": "q", "response": "a"}' % 10 ** 30,
}
GOOD = ['{"id": 10, "prompt": "q", "response": null}', '{"id": null, "messages": [{"role": null, "content": "q"}, {"role": "user", "content": null}]}',
        '{"id": "abc", "prompt": "q", "response": "a"}', '{"conv_id": "x-1", "turn": null, "role": "user", "text": "q"}', "{}"]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(line,) for line in (*LINES.values(), *GOOD)], "record string").repartition(3)


def test_foreign_records_are_counted_and_kept_apart(records):
    for grouped in (False, True):
        found = chat.format_conversations(records, grouped).collect()
        assert {r.conv_id for r in found if r.n_turns} == {10, None}
        lost = {r.unmapped: r.n_records for r in found if r.unmapped}
        malformed = [name for name in LINES if name in ("cut off", "empty", "half a surrogate pair", "deep")]
        assert lost[chat.MALFORMED] == len(malformed)
        assert sum(lost.values()) == len(LINES) + len(GOOD) - 2


def test_text_ids(records):
    found = chat.format_conversations(records, ids="string").collect()
    assert {r.conv_id for r in found if r.n_turns} == {"10", "abc", "x-1", None}


def test_types_tell_layouts_apart():
    assert chat.parsed('{"a": 1}')[1] != chat.parsed('{"a": "1"}')[1] != chat.parsed('{"a": null}')[1]
    assert chat.parsed('{"a": [1, 2]}')[1] == chat.parsed('{"a": [3]}')[1] != chat.parsed('{"a": []}')[1]
    assert chat.parsed(None)[1] == chat.parsed("{}")[1]
    assert json.loads(LINES["half a surrogate pair"])["prompt"] == "\ud800"


CLASHING = ("spans_", "hash_", "id_", "hash__", "id__", "same__", "kept_", "packed", "id", "hash", "clean", "row_", "none")


def clashing(spark):
    docs = odd_docs(spark)
    return docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHING})


@pytest.mark.parametrize("operator", [pii.redact, golay.keep_first])
def test_columns_of_any_name_stay_as_they_are(spark, operator):
    docs = clashing(spark)
    got, plain = operator(docs), operator(odd_docs(spark))
    assert got.columns == docs.columns
    shown = [c for c in docs.columns if c not in CLASHING]
    assert sorted(map(repr, got.select(*shown).collect())) == sorted(map(repr, plain.collect()))
    for row in got.collect():
        assert all(row[c] == f"{c}-{'?' if row.doc_id is None else row.doc_id}" for c in CLASHING)


def test_clashing_columns_pass_the_pipeline(spark, data_dir):
    docs = clashing(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data_dir)
        assert set(CLASHING) < set(docs.columns), name
        assert docs.where(" OR ".join(f"NOT startswith(`{c}`, '{c}-')" for c in CLASHING)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data_dir).count() == docs.count()
