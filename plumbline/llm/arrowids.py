"""Token ids of a corpus as Arrow stream files of equal-length sequences and masks.

Documents are put in ascending doc_id order, encoded, each ended with an end id, and laid end to
end. Every file holds the stream of one range of doc_ids, cut into sequences of `length` ids:

* `<part>.ids.arrows`: record batches of `rows` sequences, two fixed-size-list columns, `ids`
  (the narrowest unsigned type that holds the vocabulary) and `mask` (true for an id, false for the
  padding behind the last document of the file). All batches but the last have the same number of
  bytes, so sequence k lies at a place that is computed, and a memory-mapped file gives it without
  a copy (`sequence`).
* `<part>.docs.arrows`: doc_id, place of the first id and number of ids of each document.

The folder must be reachable by pyarrow from every executor (a shared mount, or a store that
`pyarrow.fs` opens by its address). Files carry the task attempt in their names; only those that
the written manifest lists count, so a task that is run again does no harm.

Defined results: a null text is empty and gives the end id alone; rows with equal doc_id follow each
other in the order of their texts; rows without doc_id come first; an empty table gives no file. The
strings of special tokens in a text are ordinary text, or with `special` those tokens' ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.common import settle, shared_folder, texts

LENGTH = 1024  # ids of a sequence
ROWS = 256     # sequences of a record batch
# Words and characters a worker keeps and encodes at a time.
CACHED = 1_000_000
CHARACTERS = 4_000_000


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen."""
    seen = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(hidden)}


# A word of Latin-1 letters, and the marks behind it.
WORD = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch


class WordEncoder(dict):
    """Ids of texts by the tokenizers library, as bytes of `dtype`; a dictionary of the words met so far.

    The vocabulary drops white space and no token crosses it, so a text's ids are those of its
    words. A word of Latin-1 letters alone needs no normalising but lower case and no cutting, so
    it goes to the library's model as it is, and marks behind it are cut from it by the vocabulary's own
    patterns; all other words go through the whole tokenizer.

    A worker keeps two generations of words: when the younger is full it becomes the elder, and of the
    elder only words that are met again stay.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special  # true: their strings are ordinary text
        self.model = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.elder: dict[str, bytes] = {}
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        found = self.elder.get(word)
        if found is None:
            found = self._ids(word)
        self[word] = found
        return found

    def _ids(self, word: str) -> bytes:
        parts = WORD(word)
        if parts is None:
            return array(self.dtype.char, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        core, marks = parts.groups()
        if marks:
            return self[core] + self[marks]
        shown = core.lower()
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(self.letters)
        return array(self.dtype.char, [token.id for token in self.model(shown)]).tobytes()

    def encode(self, batch: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for text in batch:
            yield b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
            if len(self) > CACHED // 2:
                self.elder = dict(self)
                self.clear()
                self[""] = b""


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = False) -> WordEncoder:
    return WordEncoder(path, special)


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    ids = pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), False), length)
    mask = pa.list_(pa.field("item", pa.bool_(), False), length)
    return pa.schema([pa.field("ids", ids, False), pa.field("mask", mask, False)])


DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.schema = _schema(dtype, length)
        self.sink, self.dtype, self.length, self.rows = sink, dtype, length, rows
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.held, self.n_held, self.n_tokens = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        if self.n_held >= self.length * self.rows:
            self._flush(self.length * self.rows)

    def _flush(self, unit: int) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        whole = len(ids) // unit * unit
        for at in range(0, whole, unit):
            self._write(ids[at:at + unit], unit)
        self.held, self.n_held = [ids[whole:].tobytes()], len(ids) - whole
        self.n_tokens += whole

    def _write(self, ids: np.ndarray, n: int) -> None:
        size = -(-n // self.length) * self.length
        padded = np.zeros(size, self.dtype)
        padded[:n] = ids
        mask = pa.array(np.arange(size) < n)
        columns = [pa.FixedSizeListArray.from_arrays(values, type=field.type) for values, field in
                   zip((pa.array(padded), mask), self.schema, strict=True)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            ids = np.frombuffer(b"".join(self.held), self.dtype)
            self._write(ids, len(ids))
            self.n_tokens += len(ids)
        self.writer.close()
        self.sink.close()


def _open(address: str):
    """A file for reading: memory-mapped where it is local to the machine or mounted there."""
    store, path = fs.FileSystem.from_uri(address)
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def sequence(address: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence k of a file, by its place alone; ids of a mapped file are not copied."""
    source = _open(address)
    schema = pa.ipc.read_schema(source)
    head = source.tell()
    first = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    size = source.tell() - head
    batch, row = divmod(k, first.num_rows)
    source.seek(head + batch * size)
    found = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema).slice(row, 1)
    return (found["ids"].flatten().to_numpy(), found["mask"].flatten().to_numpy(zero_copy_only=False))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int,
              length: int = LENGTH, rows: int = ROWS, special: bool = False) -> DataFrame:
    """Writes the files and returns their manifest: part, n_tokens, n_docs and the base of each.

    The manifest has a row per file; `base` is the number of ids in all files before it.
    """
    schema = "ids_file string, docs_file string, first_id long, n_tokens long, n_docs long"

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = (b for b in batches if len(b))
        head = next(batches, None)
        if head is None:
            return
        words = encoder(tokenizer, special)
        end = np.array([end_id], words.dtype).tobytes()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out = SequenceWriter(store.open_output_stream(f"{path}/{name}.ids.arrows"), words.dtype, length, rows)
        first_id, first, n_docs = None, 0, 0
        with store.open_output_stream(f"{path}/{name}.docs.arrows") as sink, pa.ipc.new_stream(sink, DOCS) as listing:
            batch = head
            while batch is not None:
                if n_docs == 0:
                    first_id = batch["doc_id"].iloc[0]
                texts_, counts = batch["text"].tolist(), []
                sizes = np.cumsum([len(t) for t in texts_]) // CHARACTERS
                cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts_)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    for ids in words.encode(texts_[lo:hi]):
                        out.add(ids + end)
                        counts.append(len(ids) // words.dtype.itemsize + 1)
                ends = first + np.cumsum(counts)
                ids_ = pa.Array.from_pandas(batch["doc_id"], type=pa.int64())
                listing.write_batch(pa.record_batch(
                    [ids_, pa.array(ends - counts), pa.array(np.array(counts, np.int64))], schema=DOCS))
                first, n_docs = int(ends[-1]), n_docs + len(texts_)
                batch = next(batches, None)
        out.close()
        base = folder.rstrip("/")
        yield pd.DataFrame({
            "ids_file": [f"{base}/{name}.ids.arrows"], "docs_file": [f"{base}/{name}.docs.arrows"],
            "first_id": pd.array([None if pd.isna(first_id) else int(first_id)], "Int64"),
            "n_tokens": [out.n_tokens], "n_docs": [n_docs],
        })

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    listed = settle(ordered.mapInPandas(written, schema), "arrow-manifest")
    # One row per file: the files are as many as partitions, so one task orders them.
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids.

    The crc is over the ids as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for file in files.itertuples():
                yield from _read_file(file.ids_file, file.docs_file, int(file.base))

    manifest = settle(manifest, "arrow-files")
    spread = manifest.repartition(max(1, manifest.count()), "ids_file")
    return spread.mapInPandas(read, schema)


def _read_file(ids_file: str, docs_file: str, base: int) -> Iterator[pd.DataFrame]:
    batches = iter(pa.ipc.open_stream(_open(ids_file)))
    held, at = np.empty(0, np.uint16), 0  # ids not yet given out, and the place of the first
    for listing in pa.ipc.open_stream(_open(docs_file)):
        crcs, n_tokens = [], listing["n_tokens"].to_numpy()
        for first, n in zip(listing["first"].to_numpy(), n_tokens, strict=True):
            pieces, have = [held], at + len(held) - first
            while have < n:
                batch = next(batches)
                ids = batch["ids"].flatten().to_numpy()
                mask = batch["mask"].flatten().to_numpy(zero_copy_only=False)
                pieces.append(ids if mask[-1] else ids[mask])
                have += len(pieces[-1])
            if len(pieces) > 1:
                held = np.concatenate(pieces) if len(pieces[0]) else np.concatenate(pieces[1:])
            skip = int(first - at)
            crcs.append(zlib.crc32(held[skip:skip + n].astype("<u4").tobytes()))
            held, at = held[skip + n:], int(first + n)
        yield pd.DataFrame({
            "doc_id": listing["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
            "start": base + listing["first"].to_numpy(), "n_tokens": n_tokens, "ids_crc32": crcs})


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None,
              length: int = LENGTH, rows: int = ROWS, special: bool = False) -> DataFrame:
    """Writes a corpus' ids and reads every document back from the files."""
    folder = folder or shared_folder(docs.sparkSession, "arrow-ids")
    return read_documents(write_ids(docs, folder, tokenizer, end_id, length, rows, special))
