"""Token-id files: texts become Parquet rows of token ids in ascending id order, for reads of a few columns or rows.

A file row holds doc_id, part (the number of its file), start_in_part (ids of the rows before it in the part),
n_tokens and ids. Row groups and pages have set sizes, so page indexes let a reader fetch the tokens of few documents, or the counts
without the tokens; ids are dictionary-coded, and with writer version 2 what a dictionary doesn't pay for is delta-coded.

Null texts are empty; each document ends with end_id. Rows with a null doc_id come first; equal ids are ordered by text, and repeated
rows are all kept. Empty tables give an empty folder of files with the schema. Extra columns are ignored.

Scale: texts are shuffled once, by range of doc_id, before they are encoded, so tokens are never shuffled. The driver gets two
numbers for each part. Each distinct piece of a block of texts is encoded once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import chunks
from quillflow.llm.shared import only

SCHEMA = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids array<int>"
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 64 << 10
WORDS_PER_TEXT, TEXTS_PER_CALL, CACHED = 200, 50, 300_000
BLOCK_BYTES = 6 << 20
#: Marks that end words, and the letters (ASCII, Latin-1, Latin Extended) after which they are tokens of their own.
_MARKS, _AFTER_LETTER, _BEFORE_MARKS = ".,;:!?", r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]$", r"(?s)^.*?([.,;:!?]*)$"
_ENCODERS: dict = {}  # a worker process serves many tasks


class PieceEncoder:
    """Ids of distinct pieces, by the tokenizers library. Pieces that follow a space are encoded many to a text: each begins with the
    only token that starts with a space. Marks at a word's end are tokens of their own after a letter, so "word" and "word," are
    one piece to encode. Up to CACHED pieces are remembered from block to block, which changes no result."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token.startswith("Ġ")
        self.known = pa.array([], pa.large_string())
        self.values, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that follow a space, joined; and how many each has."""
        values, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), TEXTS_PER_CALL * WORDS_PER_TEXT):
            part = words[at : at + TEXTS_PER_CALL * WORDS_PER_TEXT]
            got = self.ids([" " + " ".join(part[k : k + WORDS_PER_TEXT]) for k in range(0, len(part), WORDS_PER_TEXT)])
            ids = np.concatenate([np.array(x, np.int32) for x in got])
            starts = np.flatnonzero(self.opens[ids])
            if "" in part or len(starts) != len(part):  # an empty or odd piece: one by one
                each = self.ids([" " + w for w in part])
                ids, n = np.concatenate([np.array(x, np.int32) for x in each]), np.array([len(x) for x in each], np.int64)
            else:
                n = np.diff(np.append(starts, len(ids)))
            values.append(ids)
            lengths.append(n)
        return np.concatenate(values), np.concatenate(lengths)

    def encode(self, pieces: chunks.Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where those of each code start and how many they are."""
        bare = pc.utf8_rtrim(pieces.inner, _MARKS)
        split = pc.match_substring_regex(bare, _AFTER_LETTER)
        cores = pc.if_else(split, bare, pieces.inner).dictionary_encode()
        tails = pc.if_else(split, pc.replace_substring_regex(pieces.inner, _BEFORE_MARKS, r"\1"), "").dictionary_encode()
        row = pc.fill_null(pc.index_in(cores.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = cores.dictionary.filter(pa.array(row < 0))
        values, lengths = self.encode_words(new.to_pylist())
        row[row < 0] = np.arange(len(new)) + len(self.known)
        all_values, all_lengths = np.concatenate([self.values, values]), np.concatenate([self.lengths, lengths])
        if (room := min(CACHED - len(self.known), len(new))) > 0:
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            self.lengths = all_lengths[: len(self.known)]
            self.values = all_values[: int(self.lengths.sum())]
        marks = [np.array(x, np.int32) for x in self.ids(tails.dictionary.to_pylist())]
        heads = [np.array(x, np.int32) for x in self.ids(pieces.outer.to_pylist())]
        n_marks, n_heads = np.array([len(x) for x in marks], np.int64), np.array([len(x) for x in heads], np.int64)
        values = np.concatenate([all_values, *marks, *heads])
        n = np.concatenate([all_lengths, n_marks, n_heads])
        starts = np.cumsum(n) - n
        # A word's ids are those of its core and of its marks; then come the pieces that begin a text.
        core, mark = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (cores, tails))
        n_words, both = len(core), np.stack([row[core], len(all_lengths) + mark], axis=1).reshape(-1)
        order = np.concatenate([both, len(all_lengths) + len(marks) + np.arange(len(heads))])
        flat, each = chunks.ragged(values, starts, n, order)
        counts = np.concatenate([each[: 2 * n_words].reshape(-1, 2).sum(axis=1), each[2 * n_words :]])
        return flat, np.cumsum(counts) - counts, counts


def shared_encoder(vocabulary: str) -> PieceEncoder:
    """One for each worker process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = PieceEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def encode_texts(texts: pa.Array, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, joined, and the number of each text."""
    pieces = chunks.cut(texts)
    values, starts, lengths = encoder.encode(pieces)
    ids, n = chunks.ragged(values, starts, lengths, pieces.codes)
    return ids, chunks.sums(n, pieces.counts)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = shared_encoder(vocabulary)
        at, part = 0, TaskContext.get().partitionId()
        for block in chunks.blocks(batches, "text", BLOCK_BYTES):
            ids, counts = encode_texts(block.column("text").combine_chunks() if block.num_rows else block.column("text"), encoder)
            ends = np.cumsum(counts)
            ids, counts = np.insert(ids, ends, end_id), counts + 1
            ends = np.cumsum(counts)
            for k in range(0, len(counts), 500):
                c, e = counts[k : k + 500], ends[k : k + 500]
                first = int(e[0] - c[0])
                lists = pa.ListArray.from_arrays(np.append(first, e).astype(np.int32) - first, pa.array(ids[first : int(e[-1])].astype(np.int32)))
                columns = [block.column("doc_id").slice(k, len(c)).combine_chunks(), pa.array(np.full(len(c), part, np.int32)), pa.array(at + e - c), pa.array(c), lists]
                columns[0] = columns[0].chunk(0) if isinstance(columns[0], pa.ChunkedArray) else columns[0]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            at += int(ends[-1]) if len(ends) else 0

    rows = only(docs, "doc_id", "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.enable.dictionary": "true",
        "parquet.writer.version": "PARQUET_2_0",
    }
    ordered.mapInArrow(encode, SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before), n_tokens and ids. The counts alone can be read without the ids."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each file
    before, bases = 0, []
    for r in sizes:
        bases.append((r["part"], before))
        before += r["n"]
    base = spark.createDataFrame(bases, "part int, base bigint")
    return files.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """ids replaced by the CRC-32 of the ids as little-endian unsigned 32-bit integers. Counts that differ from the ids stop the read."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            raw = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False).view(np.uint8))
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            if not np.array_equal(n, batch.column("n_tokens").to_numpy()):
                raise ValueError("a token file's counts differ from its ids")
            ends = np.cumsum(n) * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
