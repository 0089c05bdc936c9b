"""Token ids of whole texts, as the tokenizers library gives them.

The word vocabularies drop white space before anything else: no normaliser step and no pre-token reaches over a
space, tab or line end. Texts of these are split at ASCII white space, each distinct word is encoded once by
the library, and texts are put together from the words' ids. Other tokenizer files encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-token pattern and the normaliser steps of the word vocabularies.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_STEPS = ["NFC", "Replace", "Lowercase"]

#: Letters that are each one character to the normaliser and the pre-token pattern.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿŒœ]+").fullmatch

#: Words that a worker remembers before it starts anew.
_REMEMBERED = 700_000

#: Words that the library encodes as one text, and how many such texts at a time.
_RUN, _RUNS = 50, 200

#: Bytes of text whose words are told apart at once.
TEXT_BYTES = 8 << 20


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def drops_white_space(config: dict) -> bool:
    steps = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])]
    split = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return steps == _WORD_STEPS and (split.get("pattern") or {}).get("Regex") == _WORD_PATTERN and split.get("behavior") == "Removed"


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each s, n, one after another."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return values[at]


class Growing:
    """An int array that is appended to."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1024, dtype), 0

    def extend(self, values) -> None:
        values = np.asarray(values, self.data.dtype)
        if self.n + len(values) > len(self.data):
            self.data = np.resize(self.data, 2 * (self.n + len(values)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class TokenIds:
    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        with open(path) as f:
            config = json.load(f)
        self.by_word = drops_white_space(config)
        self.suffix = config["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if self.suffix and x.endswith(self.suffix)]] = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.lengths = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode, for words without white space: runs of words are encoded as one text, which costs less.

        A word of plain letters is one pre-token, and its last token alone bears the end-of-word mark; other words
        are told apart by the library's offsets, which take longer to make.
        """
        plain = np.fromiter((self.suffix and _PLAIN(x) is not None for x in words), bool, len(words))
        ids, counts = [np.empty(0, np.uint32)], np.zeros(len(words), np.int64)
        letters = [words[k] for k in np.flatnonzero(plain)]
        for run in self._runs(letters):
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
        flat = [np.concatenate(ids)]
        counts[plain] = np.diff(np.flatnonzero(self.ends[flat[0]]), prepend=-1)
        sizes = []
        others = [words[k] for k in np.flatnonzero(~plain)]
        for run in self._runs(others):
            for text, e in zip(run, self.tokenizer.encode_batch(run, add_special_tokens=False)):
                begins = np.cumsum([0, *(len(x) + 1 for x in text.split(" "))])
                word = np.searchsorted(begins, np.fromiter((b for b, _ in e.offsets), np.int64, len(e.offsets)), "right") - 1
                flat.append(np.array(e.ids, np.uint32))
                sizes.append(np.bincount(word, minlength=len(begins) - 1))
        if sizes:
            counts[~plain] = np.concatenate(sizes)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return gather(np.concatenate(flat), starts, counts), counts

    @staticmethod
    def _runs(words: list[str]) -> list[list[str]]:
        texts = [" ".join(words[k : k + _RUN]) for k in range(0, len(words), _RUN)]
        return [texts[k : k + _RUNS] for k in range(0, len(texts), _RUNS)]

    def _learn(self, words: list[str]) -> None:
        fresh = [x for x in words if x not in self.place]
        if len(self.place) + len(fresh) > _REMEMBERED:
            self._forget()
            fresh = words
        if not fresh:
            return
        ids, lengths = self._encode_words(fresh)
        self.starts.extend(self.ids.n + np.cumsum(lengths) - lengths)
        self.lengths.extend(lengths)
        self.ids.extend(ids)
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow string array) one after another, and how many each has. Null is an empty text."""
        if not self.by_word:
            return self._encode([x or "" for x in texts.to_pylist()])
        owner, word, words = distinct_words(texts)
        self._learn(words)
        place = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[word]
        lengths = self.lengths.data[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return gather(self.ids.data, self.starts.data[place], lengths), np.diff(ends[owner])


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts for a tokenizer that drops white space, as words: where each text's words begin (and all end), each word's number, the distinct words.

    Two steps keep ids and save words: ASCII texts are lowered, as the normaliser does, and a full stop or comma
    between an ASCII letter and white space stands alone, as the pre-token pattern has it. A text that may hold
    a special string is left as it is.
    """
    texts = pc.fill_null(texts, "")
    plain = pc.invert(pc.match_substring(texts, "<|"))
    texts = pc.if_else(pc.and_(plain, pc.string_is_ascii(texts)), pc.ascii_lower(texts), texts)
    texts = pc.if_else(plain, pc.replace_substring_regex(texts, r"([A-Za-z])([.,])([ \n])", r"\1 \2\3"), texts)
    lists = pc.ascii_split_whitespace(texts)
    begins = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values[begins[0] : begins[-1]].dictionary_encode()
    word, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
    begins = begins - begins[0]
    if "" in words:  # before the first and after the last word of a text
        full = word != words.index("")
        begins = np.concatenate([[0], np.cumsum(full)])[begins]
        word = word[full]
    return begins, word, words


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    """One for each Python worker, so that words are remembered from task to task."""
    return TokenIds(path)


def slices(column: pa.Array, most_bytes: int = 4 << 20) -> list[tuple[int, pa.Array]]:
    """(first row, rows) of a string array in runs of about most_bytes, so that long texts don't meet in memory."""
    pa.default_memory_pool().release_unused()  # of the batch before, as a worker lives on with what its pool holds
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    run = (np.cumsum(sizes + 8) - sizes - 8) // most_bytes
    cuts = np.flatnonzero(np.diff(run, prepend=-1)).tolist() + [len(column)]
    return [(a, column[a:b]) for a, b in zip(cuts, cuts[1:])]
