"""Byte-level BPE: ranked merges over the bytes of distinct words, folded by Spark's higher-order functions.

One narrow pass, without a shuffle:

1. texts are split by the tokenizer's pattern, block by block, into distinct words and a list of word numbers for each
   text; a partition's rows are each block's words that it had not before, then its texts;
2. a Spark expression folds merges over each word's bytes. The merge table is a literal of the plan;
3. the lists are replaced by the words' ids.

Merges go by rank: the adjacent pair of lowest rank is joined until no pair has a rank. Where each token's two parts come before it (merge_order), a join
never makes a pair of lower rank, and a token is always joined from the same two parts. So a fold over the ranks of a word's tokens, in their order, each of
which joins its pair wherever it stands, does the same. Which tokens of the vocabulary a word has is looked up when it is split. With other vocabularies, each
step of the fold looks for the pair of lowest rank.

A word that is a token itself needs no merges.

Decoding is a Spark expression as well: the ids' byte pieces, from a literal array, are concatenated.

Words of over fold_bytes bytes are merged by a heap instead of the fold, whose work grows with the square of a word's length; the ids are the same. Null and
empty texts have no ids. Repeated rows each give a row; a null doc_id is kept. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.llm import chunks
from quillflow.llm.quality_rules import let
from quillflow.llm.shared import only, short_plans, shrink_heap

FOLD_BYTES, HASH_BITS = 512, 17
#: Bytes of a block of texts. A partition's words are forgotten after so many of them.
BLOCK_BYTES, PARTITION_WORDS = 2 << 20, 400_000
_STAGE = "is_word boolean, doc_id bigint, word string, found array<int>, merged string, codes binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


# --- the fold -----------------------------------------------------------------------------------------------------------
#
# In the fold a token is one character, and characters are in the order of ranks. A word is a string of such characters, at first
# one for each byte. For merges in order, literals give each rank its pair and the joined token. For others, the literal maps a pair of characters to the character of the joined token: cell crc32(pair) modulo their number
# holds "pair:joined" for each of its pairs, behind LAST. What follows "pair:" is the joined token, and if a cell lacks the pair, all of the
# cell is taken to follow, which begins with LAST.

LAST = chr(0x10FFFF)


def mark(token: int) -> str:
    """The character of a token id."""
    return chr(0x100 + token if token < 0xD700 else 0x10000 + token)


def marks_to_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(points < 0x10000, points - 0x100, points - 0x10000)


def pair_cells(ranks: dict[bytes, int]) -> list[str]:
    cells = [[LAST] for _ in range(1 << HASH_BITS)]
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                pair = mark(left) + mark(right)
                cells[zlib.crc32(pair.encode()) & ((1 << HASH_BITS) - 1)].append(f"{pair}:{mark(rank)}")
    return ["".join(c) for c in cells]


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The cells; Spark folds this to a literal when it plans."""
    return F.split(F.lit(",".join(pair_cells(ranks))), ",")


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that merges by rank come to before they join them to this one; None if they don't."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            return None
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 and all(p in ranks for p in parts) else None


def merge_order(ranks: dict[bytes, int]) -> dict[int, str] | None:
    """The marks of the pair that is joined to each token, by its rank; None if a token doesn't come after its parts."""
    pairs = {}
    for token, rank in ranks.items():
        if pair := last_pair(token, ranks):
            left, right = ranks[pair[0]], ranks[pair[1]]
            if max(left, right) >= rank:
                return None
            pairs[rank] = mark(left) + mark(right)
    return pairs


class Beginnings:
    """What joined tokens begin with, as a tree: numbers 0 to 255 are the bytes, then come longer beginnings by length and bytes. So keys, the number of
    what is shorter by a byte times 256 plus that byte, ascend."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, str]):
        known = {token[:k] for token, rank in ranks.items() if rank in pairs for k in range(2, len(token) + 1)}
        order = sorted(known, key=lambda x: (len(x), x))
        number = {bytes([i]): i for i in range(256)} | {x: 256 + k for k, x in enumerate(order)}
        self.keys = np.array([number[x[:-1]] * 256 + x[-1] for x in order], np.int64)
        self.ranks = np.array([r if (r := ranks.get(x, -1)) in pairs else -1 for x in order], np.int64)

    def tokens_in(self, words: list[bytes]) -> pa.ListArray:
        """The ranks of the joined tokens that each word has anywhere, in order."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        own = np.repeat(np.arange(len(words)), sizes)
        end = np.cumsum(sizes)[own]
        at, node, found = np.arange(len(data)), data, [np.zeros(0, np.int64)]
        while len(self.keys):
            at = at + 1
            inside = np.flatnonzero(at < end)
            at, node, own, end = at[inside], node[inside], own[inside], end[inside]
            if not len(at):
                break
            key = node * 256 + data[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[place] == key)
            place, at, own, end = place[hit], at[hit], own[hit], end[hit]
            rank, node = self.ranks[place], place + 256
            is_token = rank >= 0
            found.append(own[is_token] << 32 | rank[is_token])
        each = np.unique(np.concatenate(found))
        ends = np.cumsum(np.bincount(each >> 32, minlength=len(words)))
        return pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array((each & 0xFFFFFFFF).astype(np.int32)))


def fold_in_order(word: Column, found: Column, pairs: dict[int, str]) -> Column:
    """The marks of a word's tokens, from the marks of its bytes and the ranks of the tokens in it."""
    n = max(pairs, default=-1) + 1
    table, joined = (F.split(F.lit(",".join(x)), ",") for x in ([pairs.get(r, "") for r in range(n)], [mark(r) for r in range(n)]))
    return F.aggregate(found, word, lambda s, r: F.replace(s, F.get(table, r), F.get(joined, r)))


def fold_merges(word: Column, table: Column) -> Column:
    """The same for any vocabulary, from the marks of the bytes alone."""

    def joined(pair: Column) -> Column:
        cell = F.get(table, F.crc32(pair.cast("binary")).bitwiseAND((1 << HASH_BITS) - 1).cast("int"))
        after = F.call_function("substring_index", cell, F.concat(pair, F.lit(":")), F.lit(-1))
        return F.substring(after, F.lit(1), F.lit(1))

    def step(state: Column, _: Column) -> Column:
        s = state["s"]
        ranks = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: joined(F.substring(s, i, F.lit(2))))

        def merged(r: Column, m: Column) -> Column:
            p = F.array_position(r, m).cast("int")
            rest = let(p, lambda at: F.concat(F.substring(s, F.lit(1), at - 1), m, F.substring(s, at + 2, F.lit(1 << 20))))
            return F.struct(F.when(m == LAST, s).otherwise(rest).alias("s"), (m == LAST).alias("done"))

        return F.when(state["done"], state).otherwise(let(ranks, lambda r: let(F.array_min(r), lambda m: merged(r, m))))

    start = F.struct(word.alias("s"), F.lit(False).alias("done"))
    return F.when(F.length(word) < 2, word).otherwise(F.aggregate(F.sequence(F.lit(2), F.length(word)), start, step, lambda state: state["s"]))


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids in n log n steps."""
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        r = ranks.get(word[i : ends[j]]) if j < n else None
        return None if r is None else (r, i, ends[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or ends[j] != end:
            continue
        alive[j], ends[i], after[i] = False, end, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


# --- splitting and putting together -------------------------------------------------------------------------------------


def _split(ranks: dict[bytes, int], pattern: str, fold_bytes: int, begins: Beginnings):
    byte_marks = {i: mark(ranks[bytes([i])]) for i in range(256)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matches = regex.compile(pattern).findall
        schema = pa.schema([("is_word", pa.bool_()), ("doc_id", pa.int64()), ("word", pa.string()), ("found", pa.list_(pa.int32())), ("merged", pa.string()), ("codes", pa.binary())])
        number: dict[str, int] = {}
        for block in chunks.blocks(batches, "text", BLOCK_BYTES):
            pieces = chunks.cut(block.column("text").combine_chunks())
            if len(number) > PARTITION_WORDS:
                number = {}
                yield pa.RecordBatch.from_pydict({"is_word": [True], "doc_id": [None], "word": [None], "found": [None], "merged": [""], "codes": [None]}, schema)
            known = len(number)
            flat, lengths = [], []
            for texts, lead in ((pieces.inner, " "), (pieces.outer, "")):
                for text in texts.to_pylist():
                    words = matches(lead + text)
                    lengths.append(len(words))
                    flat += [number.setdefault(w, len(number)) for w in words]
            values, n = np.array(flat, np.int32), np.array(lengths, np.int64)
            codes, each = chunks.ragged(values, np.cumsum(n) - n, n, pieces.codes)
            counts = chunks.sums(each, pieces.counts)
            words = [w.encode() for w in itertools.islice(number, known, None)]
            for k in range(0, len(words), 5_000):
                part = words[k : k + 5_000]
                done = ["".join(map(mark, merge_by_heap(w, ranks))) if len(w) > fold_bytes else None for w in part]
                done = [mark(ranks[w]) if w in ranks else x for w, x in zip(part, done, strict=True)]
                todo = [w.decode("latin-1").translate(byte_marks) if x is None else None for w, x in zip(part, done, strict=True)]
                found = begins.tokens_in([w if x is None else b"" for w, x in zip(part, done, strict=True)])
                rows = {"is_word": [True] * len(part), "doc_id": [None] * len(part), "word": todo, "found": found, "merged": done, "codes": [None] * len(part)}
                yield pa.RecordBatch.from_pydict(rows, schema)
            del pieces, words, flat
            pa.default_memory_pool().release_unused()
            ends = np.cumsum(counts)
            raw, ids = codes.tobytes(), block.column("doc_id").combine_chunks()
            for k in range(0, block.num_rows, 500):
                own = [raw[4 * (e - c) : 4 * e] for c, e in zip(counts[k : k + 500].tolist(), ends[k : k + 500].tolist(), strict=True)]
                m = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([False] * m), _one(ids.slice(k, m)), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.string()), pa.array(own, pa.binary())],
                    schema=schema,
                )

    return run


def _one(x):
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order in which _split made them."""
    values, lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
    fresh: list[pa.Array] = []
    table = (values, lengths, lengths)
    for batch in batches:
        flags = batch.column("is_word").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(flags[1:] != flags[:-1]) + 1).tolist(), len(flags)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if flags[a]:
                fresh.append(part.column("merged"))
                continue
            if fresh:
                words = pa.chunked_array(fresh, pa.string())
                n = pc.utf8_length(words).to_numpy().astype(np.int64)
                if len(begins := np.flatnonzero(n == 0)):  # the partition's words begin anew
                    words, n = words.slice(int(begins[-1]) + 1), n[begins[-1] + 1 :]
                    values, lengths = values[:0], lengths[:0]
                lengths = np.concatenate([lengths, n])
                values = np.concatenate([values, *(marks_to_ids("".join(c.to_pylist())).astype(np.int32) for c in words.chunks)])
                table, fresh = (values, np.cumsum(lengths) - lengths, lengths), []
                del words
            for k in range(0, len(part), 250):
                own = part.slice(k, 250)
                raw = own.column("codes").to_pylist()
                ids, n = chunks.ragged(*table, np.frombuffer(b"".join(raw), np.int32))
                each = chunks.sums(n, np.array([len(x) // 4 for x in raw], np.int64))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(each)]).astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """(doc_id, ids) of each row of docs (doc_id, text)."""
    short_plans(docs.sparkSession)
    shrink_heap(docs.sparkSession)
    pairs = merge_order(ranks)
    staged = only(docs, "doc_id", "text").mapInArrow(_split(ranks, pattern, fold_bytes, Beginnings(ranks, pairs or {})), _STAGE)
    fold = fold_merges(F.col("word"), rank_literal(ranks)) if pairs is None else fold_in_order(F.col("word"), F.col("found"), pairs)
    folded = F.when(F.col("word").isNotNull(), fold).otherwise(F.col("merged"))
    return staged.select("is_word", "doc_id", folded.alias("merged"), "codes").mapInArrow(_assemble, "doc_id bigint, ids array<int>")


def _pieces_literal(hex_pieces: list[str]) -> Column:
    return F.split(F.lit(",".join(hex_pieces)), ",")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of the ids."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        pieces[i] = token.hex()
    table = _pieces_literal(pieces)
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def little_endian(ids: Column, n_vocabulary: int) -> Column:
    """The ids as unsigned 32-bit little-endian integers."""
    table = _pieces_literal([i.to_bytes(4, "little").hex() for i in range(n_vocabulary)])
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def digests(encoded: DataFrame, ranks: dict[bytes, int]) -> list[Column]:
    ids = encoded["ids"]
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(little_endian(ids, max(ranks.values(), default=-1) + 1), 256).alias("ids_sha256"),
        F.sha2(decode(ids, ranks), 256).alias("decoded_sha256"),
    ]
