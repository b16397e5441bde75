"""Texts cut into pieces that a byte-level tokenizer treats independently, so that each distinct piece is encoded once.

The splitting patterns of these tokenizers let a token begin with one space and never go on over one. So a text may be cut before each
single space that has no white space beside it. A text with other white space next to a space stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: All code points of the Unicode property White_Space, and the separators 0x1C to 0x1F that some libraries add.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = rf"( {_WHITE})|({_WHITE} )|(^ )|( $)"
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 16


@dataclass
class Pieces:
    codes: np.ndarray  # of all texts, one after the other
    counts: np.ndarray  # pieces of each text
    inner: pa.Array  # distinct pieces that follow a space, without it: codes 0 ..
    outer: pa.Array  # distinct pieces that begin a text: codes len(inner) ..


def cut(texts: pa.Array) -> Pieces:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = pc.match_substring_regex(texts, _UNSAFE)
    marked = pc.if_else(whole, "", texts)  # a text that stays whole gets its piece below
    parts = pc.split_pattern(marked, " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    firsts = np.zeros(len(texts), np.int64)
    np.cumsum(counts[:-1], out=firsts[1:])
    heads = pc.if_else(whole, texts, flat.take(pa.array(firsts)))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    head_codes = heads.dictionary_encode()
    codes[firsts] = head_codes.indices.to_numpy(zero_copy_only=False) + len(coded.dictionary)
    return Pieces(codes, counts, coded.dictionary, head_codes.dictionary)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[starts[c] : starts[c] + lengths[c]] for each code, joined; and how many each code gives."""
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.repeat(starts[codes] - (ends - n), n)
    at += np.arange(len(at))
    return values[at], n


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of the given lengths (which may be 0), in the values' type."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


@cache
def _libc():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


def give_back() -> None:
    """Free memory goes back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    _libc()(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Batches joined until a block holds about limit bytes of the text column or BLOCK_ROWS rows, and large batches cut."""
    held, size, rows = [], 0, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(batch):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), max(limit - size, 1), side="right")))
            n = min(n, BLOCK_ROWS - rows)
            held.append(batch.slice(at, n))
            rows += n
            size += int(sizes[at : at + n].sum())
            at += n
            if size >= limit * 0.9 or rows >= BLOCK_ROWS:
                block, held, size, rows = pa.Table.from_batches(held).combine_chunks(), [], 0, 0
                yield block
                del block
                give_back()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    give_back()
