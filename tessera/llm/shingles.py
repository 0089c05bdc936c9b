"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words begin (and all end), and a hash of each word; A-Z are lower-cased. Null is an empty text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    begins = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values[begins[0] : begins[-1]].dictionary_encode()
    begins = begins - begins[0]
    index, words = np.asarray(coded.indices), coded.dictionary.cast(pa.binary()).to_pylist()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if b"" in words:  # before the first and after the last word of a text
        full = index != words.index(b"")
        begins, index = np.concatenate([[0], np.cumsum(full)])[begins], index[full]
    return begins, each[index]


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's shingles begin (and all end), and the shingles' hashes in order, repeats included.

    A text with fewer words than width is one shingle of all its words; one without words has none.
    """
    begins, word = word_hashes(texts)
    n_words = np.diff(begins)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(starts[-1]) + np.repeat(begins[:-1] - starts[:-1], counts)
    size = np.repeat(np.minimum(n_words, width), counts)
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    out = size.astype(np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(k < size, padded[first + k], np.uint64(0)))
    return starts, out


def distinct_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles, each text's set in ascending order."""
    starts, values = shingles(texts, width)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((values, owner))
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return np.concatenate([[0], np.cumsum(new)])[starts], values[new]
