"""Words of many texts at once: each distinct word is handled once, the rest are numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    codes: np.ndarray  # a number for each word of all texts, one after the other
    counts: np.ndarray  # words of each text
    names: pa.Array  # the distinct words by number


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words between ASCII white space (0x20, 0x09 to 0x0D); A to Z become a to z. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # beside white space at a text's ends
        real = codes != empty
        owner = np.repeat(np.arange(len(n)), n)
        n = np.bincount(owner[real], minlength=len(n)).astype(np.int64)
        codes = codes[real]
    return Words(codes, n, coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(s) for s in strings.cast(pa.large_binary()).to_pylist()), np.uint64, len(strings))
