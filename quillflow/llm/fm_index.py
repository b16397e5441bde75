"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded block of whole documents. Its index is over words: the suffix array of the shard's word sequence, the Burrows-
Wheeler transform in a wavelet matrix, counts of smaller words, and sampled suffix positions. Test phrases are searched backward, all at once; the
ranges that are left are located by walking to a sampled position, and the occurrences of a document are merged to removal spans.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A to Z are lower-cased. A phrase is a window of `window` consecutive words of
an item, or the whole item if it has fewer words, but not none. A word that no phrase has can't be inside an occurrence, and neither can a run of
phrase words that is shorter than the shortest phrase; the index holds a separator in their place, and all else.

Phrases are sent to the executors in blocks of at most block_words words; with more blocks, documents pass through the search once for each.
Null and empty texts have no words and no hits. Repeated documents are searched each for itself; repeated items are one item. Null item ids are ignored.
Empty tables give empty results, or no hits. Other columns of the documents are returned as they are; columns with the names of results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.llm import chunks, words
from quillflow.llm.shared import only

WINDOW, BLOCK_WORDS, SAMPLE = 10, 2_000_000, 8
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEPT else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPANS = "array<struct<start:int,end:int>>"


def split_texts(texts: pa.Array) -> words.Words:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])  # without an offset
    _, offsets, data = texts.buffers()
    raw = (data.to_pybytes() if data else b"").translate(_TABLE)
    return words.split_words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(raw)]), lower=False)


# --- the index ----------------------------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of numbers whose last one is unique, by prefix doubling over what isn't in order yet."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.ones(n, bool)
    new[1:] = s[order[1:]] != s[order[:-1]]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    todo = order[np.repeat(sizes > 1, sizes)]
    h = 1
    while len(todo):
        old = rank[todo]
        key = old * (n + 1) + rank[todo + h]
        by = np.argsort(key, kind="stable")
        todo, key, old = todo[by], key[by], old[by]
        m = len(todo)
        sub, group = np.ones(m, bool), np.ones(m, bool)
        sub[1:], group[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        at = np.arange(m)
        first_sub, first_group = np.maximum.accumulate(np.where(sub, at, 0)), np.maximum.accumulate(np.where(group, at, 0))
        rank[todo] = old + first_sub - first_group
        sizes = np.diff(np.append(np.flatnonzero(sub), m))
        todo = todo[np.repeat(sizes > 1, sizes)]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


class WaveletMatrix:
    """Ranks of symbols in a sequence: a level for each bit, with the number of ones before each place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.ones, self.zeros, self.bits = [], [], bits
        s = symbols
        for level in range(bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, bit = self.ones[i], ((symbol >> level) & 1).astype(bool)
            start = np.where(bit, self.zeros[i] + ones[start], start - ones[start])
            end = np.where(bit, self.zeros[i] + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Of sequence (numbers from 1; 0 separates, also at its end)."""

    def __init__(self, sequence: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        n, gaps = len(sequence), sequence == 0
        distinct = np.where(gaps, np.cumsum(gaps) - 1, sequence + gaps.sum())  # no order goes on over a separator
        self.sa = suffix_array(distinct)
        before = self.sa - 1
        self.bwt = np.where(before >= 0, sequence[before], 0)
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(n_symbols).bit_length()))
        counts = np.bincount(sequence, minlength=n_symbols + 2)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])[: n_symbols + 2]
        sampled = (self.sa % sample == 0) | (self.bwt == 0)  # also at each run's start, so walks stay in a run
        self.sampled, self.n = sampled, n
        self.slot = np.cumsum(sampled) - 1
        self.positions = self.sa[sampled]
        del self.sa

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, a phrase a row."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.smaller[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.smaller[c] + self.wavelet.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, walking = rows.copy(), np.zeros(len(rows), np.int64), np.flatnonzero(~self.sampled[rows])
        while len(walking):
            c = self.bwt[rows[walking]]
            rows[walking] = self.smaller[c] + self.wavelet.rank(c, rows[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.positions[self.slot[rows]] + steps


# --- phrases and documents ----------------------------------------------------------------------------------------------


@dataclass
class Phrases:
    vocabulary: pa.Array
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # phrases; their items, flat: first and number
    items: list[str]
    shortest: int


def build_phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases | None:
    """Of (item id, text)."""
    if not items:
        return None
    w = split_texts(pa.array([text for _, text in items], pa.string()))
    found: dict[int, dict[tuple[int, ...], list[int]]] = {}
    end = 0
    for i, n in enumerate(w.counts.tolist()):
        code = (w.codes[end : end + n] + 1).tolist()
        end += n
        size = min(n, window)
        for k in range(n - size + 1 if n else 0):
            owners = found.setdefault(size, {}).setdefault(tuple(code[k : k + size]), [])
            if not owners or owners[-1] != i:
                owners.append(i)
    if not found:
        return None
    by_length = []
    for _, table in sorted(found.items()):
        n = np.array([len(x) for x in table.values()], np.int64)
        by_length.append((np.array(list(table), np.int64), np.concatenate([np.array(x, np.int64) for x in table.values()]), np.cumsum(n) - n, n))
    return Phrases(w.names, by_length, [i for i, _ in items], min(found))


def search_block(texts: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """For each text: its words, merged spans of hit words [start, end), and items."""
    w = split_texts(texts)
    n_docs, spans, items = len(texts), [[] for _ in range(len(texts))], [set() for _ in range(len(texts))]
    known = pc.fill_null(pc.index_in(w.names, value_set=phrases.vocabulary.cast(w.names.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    code = known[w.codes] if len(w.codes) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n_docs), w.counts)
    starts = np.cumsum(w.counts) - w.counts
    # Runs of phrase words within a document that are long enough, with a separator behind each.
    inside = code > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    run = np.cumsum(first) - 1
    lengths = np.bincount(run[inside], minlength=int(first.sum()))
    keep = np.zeros(len(code), bool)
    keep[inside] = lengths[run[inside]] >= phrases.shortest
    if not keep.any():
        return w.counts, spans, items
    place = np.flatnonzero(keep)
    last = np.append(run[place][1:] != run[place][:-1], True)
    at = np.arange(len(place)) + np.cumsum(last) - last
    sequence, origin = np.zeros(len(place) + int(last.sum()), np.int64), np.zeros(len(place) + int(last.sum()), np.int64)
    sequence[at], origin[at] = code[place], place
    index = FMIndex(sequence, len(phrases.vocabulary))
    got: list[tuple[np.ndarray, int]] = []
    pairs: list[np.ndarray] = []
    for table, owners, item_first, item_n in phrases.by_length:
        lo, hi = index.search(table)
        n = hi - lo
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        rows = np.arange(n[hit].sum()) + np.repeat(lo[hit] - (np.cumsum(n[hit]) - n[hit]), n[hit])
        word = origin[index.locate(rows)]
        phrase = np.repeat(hit, n[hit])
        got.append((word, table.shape[1]))
        doc_phrase = np.unique(owner[word] * len(table) + phrase)
        which, count = chunks.ragged(owners, item_first, item_n, doc_phrase % len(table))
        pairs.append(np.repeat(doc_phrase // len(table), count) * len(phrases.items) + which)
    if not got:
        return w.counts, spans, items
    change = np.zeros(len(code) + 1, np.int64)
    for word, size in got:
        np.add.at(change, word, 1)
        np.add.at(change, word + size, -1)
    covered = np.cumsum(change)[:-1] > 0
    opens = covered.copy()
    opens[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
    closes = covered.copy()
    closes[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
    for a, b in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(closes).tolist(), strict=True):
        d = int(owner[a])
        spans[d].append((a - int(starts[d]), b + 1 - int(starts[d])))
    for p in np.unique(np.concatenate(pairs)).tolist():
        items[p // len(phrases.items)].add(phrases.items[p % len(phrases.items)])
    return w.counts, spans, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from the first to the last word of each span."""
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    place = [m.span() for m in _WORD.finditer(lower)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : place[a][0]])
        at = place[b - 1][1]
    return "".join([*out, text[at:]])


def phrase_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[Phrases]:
    """The items in blocks of bounded size; one block is on the driver at a time."""
    rows = only(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("id"), "text")
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r["id"], r["text"]))
        size += len(r["text"]) // 2 + 1  # no text has more words
        if size >= block_words:
            if p := build_phrases(held, window):
                yield p
            held, size = [], 0
    if held and (p := build_phrases(held, window)):
        yield p


def _search(phrases: Phrases, schema: pa.Schema, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks.blocks(batches, "text"):
            n_words, spans, items = search_block(block.column("text").combine_chunks(), phrases)
            old_spans, old_items = block.column("spans").to_pylist(), block.column("items").to_pylist()
            spans = [merge_spans([*((s["start"], s["end"]) for s in o or ()), *new]) for o, new in zip(old_spans, spans, strict=True)]
            items = [sorted({*(o or ()), *new}) for o, new in zip(old_items, items, strict=True)]
            columns = {c: block.column(c) for c in block.column_names}
            if cut and any(spans):
                texts = [cut_text(t, s) if s else t for t, s in zip(block.column("text").to_pylist(), spans, strict=True)]
                columns["text"] = pa.array(texts, schema.field("text").type)
                if "n_chars" in columns:
                    n_chars = [len(t) if s else n for t, s, n in zip(texts, spans, block.column("n_chars").to_pylist(), strict=True)]
                    columns["n_chars"] = pa.array(n_chars, schema.field("n_chars").type)
                spans = [[] for _ in spans]
            columns["n_words"] = pa.array(n_words)
            columns["spans"] = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], schema.field("spans").type)
            columns["items"] = pa.array(items, pa.list_(pa.string()))
            table = pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)
            for k in range(0, table.num_rows, 1000):
                yield from table.slice(k, 1000).combine_chunks().to_batches()

    return run


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """docs with n_words, spans (of hit words) and items (ids as strings, sorted). With cut, the last pass cuts the spans."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    found = docs.select(*(docs[c] for c in own), F.lit(0).cast("bigint").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = to_arrow_schema(found.schema)
    blocks = phrase_blocks(items, window, block_words)
    phrases = next(blocks, Phrases(pa.array([], pa.string()), [], [], 1))
    while phrases is not None:
        following = next(blocks, None)
        found = found.mapInArrow(_search(phrases, schema, cut and following is None), found.schema)
        phrases = following
    return found


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the hit spans cut from their texts; n_chars, where there is such a column, is counted anew for texts that were cut."""
    return find_leaks(docs, items, window, block_words, cut=True).select(*docs.columns)
