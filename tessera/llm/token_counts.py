"""Token counts by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch lie in one flat array of symbols. In each round every sequence finds the
lowest rank among its adjacent pairs and merges all its occurrences at once; sequences without a known pair are
done, and the number of their symbols is the number of their tokens. No rank below the one just merged can
appear in a round, since a merged symbol only stands in pairs of higher rank, so rounds give what one-by-one
merging gives. Normaliser and pre-tokeniser are the library's own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import schema_of, table
from tessera.llm.token_ids import TEXT_BYTES, distinct_words, drops_white_space, load_tokenizer, slices, vocabulary_path

_NONE = np.int64(1 << 40)
_REMEMBERED = 700_000


class RankMerger:
    """Merge ranks of a vocabulary file, and the merging of many sequences at once."""

    def __init__(self, config: dict):
        model = config["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.width = len(self.vocab) + len(config["added_tokens"]) + 1
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        left, right = (np.array([self.vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of the pieces, one for each character, the last with the end-of-word suffix; and lengths."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = "".join(pieces)
        chars = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        known, place = np.unique(chars, return_inverse=True)
        inner = np.array([self.vocab[chr(c)] for c in known], np.int64)
        last = np.array([self.vocab[chr(c) + self.suffix] for c in known], np.int64)
        out = inner[place]
        ends = np.cumsum(lengths) - 1
        out[ends] = last[place[ends]]
        return out, lengths

    def surviving(self, symbol: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols each sequence is left with. No sequence may be empty."""
        counts, sequence = lengths.copy(), np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbol), _NONE)
        inside = np.flatnonzero(sequence[1:] == sequence[:-1])
        rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
        while len(symbol):
            begins = np.flatnonzero(np.diff(sequence, prepend=-1))
            sizes = np.diff(np.append(begins, len(symbol)))
            lowest = np.minimum.reduceat(rank, begins)
            going = np.repeat(lowest < _NONE, sizes)
            counts[sequence[begins]] = sizes
            symbol, sequence, rank = symbol[going], sequence[going], rank[going]
            if not len(symbol):
                break
            hit = rank == np.repeat(lowest[lowest < _NONE], sizes[lowest < _NONE])
            run = np.flatnonzero(hit & np.append(False, hit[:-1]))
            if len(run):  # a symbol repeated: pairs overlap, and the leftmost goes first
                where = np.arange(len(hit))
                starts = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), where, 0))
                hit &= (where - starts) % 2 == 0
            at = np.flatnonzero(hit)
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, sequence, rank = symbol[keep], sequence[keep], rank[keep]
            at = np.cumsum(keep)[at] - 1
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[changed] = _NONE
            changed = changed[changed + 1 < len(symbol)]
            changed = changed[sequence[changed] == sequence[changed + 1]]
            rank[changed] = self.rank(symbol[changed], symbol[changed + 1])
        return counts


class TokenCounter:
    def __init__(self, path: str):
        with open(path) as f:
            config = json.load(f)
        if not drops_white_space(config):
            raise ValueError("counts need a vocabulary whose pre-tokens hold no white space")
        self.tokenizer, self.merger = load_tokenizer(path), RankMerger(config)
        special = sorted((x["content"] for x in config["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.place: dict[str, int] = {}
        self.counts = np.empty(0, np.int64)

    def _pieces(self, word: str) -> tuple[list[str], int]:
        """Pre-tokens of a word as the merges see them, and special strings in it."""
        parts = self.special.split(word) if "<|" in word else [word]
        split, lower = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.normalizer.normalize_str
        return [p for x in parts[::2] if x for p, _ in split(lower(x))], len(parts) // 2

    def _count_words(self, words: list[str]) -> np.ndarray:
        places: dict[str, int] = {}
        flat, sizes, out = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k, word in enumerate(words):
            pieces, out[k] = self._pieces(word)
            sizes[k] = len(pieces)
            flat += [places.setdefault(p, len(places)) for p in pieces]
        if places:
            each = self.merger.surviving(*self.merger.symbols(list(places)))[flat]
            ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
            out += np.diff(ends)
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Null is an empty text."""
        begins, word, words = distinct_words(texts)
        fresh = [x for x in words if x not in self.place]
        if len(self.place) + len(fresh) > _REMEMBERED:
            self.place, self.counts, fresh = {}, np.empty(0, np.int64), words
        if fresh:
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
            self.counts = np.concatenate([self.counts, self._count_words(fresh)])
        each = self.counts[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))][word]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[begins])


@lru_cache(maxsize=1)
def token_counter(path: str) -> TokenCounter:
    """One for each Python worker, so that words are remembered from task to task."""
    return TokenCounter(path)


def count_tokens(df: DataFrame, text: str, vocabulary: str, name: str = "n_tokens") -> DataFrame:
    """df's text column replaced by its token count (long); other columns stay. No shuffle: each batch is counted where it is read.

    A null text is empty and has no tokens. Repeated rows are counted alike, and an empty table gives no rows. Other
    columns may have any name but the result's, which is an error.
    """
    if name in df.columns and name != text:
        raise ValueError(f"df has a column {name} already")
    at = df.columns.index(text)
    schema = schema_of(df, [c for c in df.columns if c != text], f"`{name}` long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocabulary)
        for batch in batches:
            for first, texts in slices(batch.column(at), TEXT_BYTES):
                rest = batch.slice(first, len(texts)).remove_column(at)
                counts = pa.array(counter.count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*rest.columns, counts], [*rest.schema.names, name])

    return df.mapInArrow(count, schema)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """UTF-8 bytes and tokens of every document, and whether it is longer than 2048 tokens. A null text has none."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(sized, "text", vocabulary_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
