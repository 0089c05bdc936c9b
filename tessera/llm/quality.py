"""Quality rules: counts over words and lines, and how far a document's histograms lie from its language's.

The distribution rule compares two histograms of a document, of character classes and of common words, with
the same histograms of all documents of its language, by Jensen-Shannon distance. All other words share one bin, so
a text without common words lies no farther off than that bin allows; the share of common words has a bound of its
own. Documents with few words are exempt, since their histograms say little, and so are those without a language or
of one with too few words in all for a reference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import removed, schema_of, stored, table
from tessera.llm.token_ids import slices

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"

#: Character classes, by bytes of UTF-8: a character beyond ASCII counts by its first byte.
_CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "other", "control", "latin", "wide", "rest")
_NOT_COUNTED = len(_CLASSES) - 1


def _class_table() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other"), np.int64)
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("control", [*range(32), 127]), ("space", _SPACE), ("stop", b".,;:!?"), ("mark", b"'\"()-"), ("symbol", _SYMBOLS), ("rest", range(0x80, 0xC2)), ("latin", range(0xC2, 0xCC)), ("wide", range(0xCC, 0x100))):
        out[list(members)] = _CLASSES.index(name)
    return out


_CLASS_OF = _class_table()

#: What makes the references: so many of the most frequent words for each language, languages with at least so many words.
_COMMON, _LEAST_REFERENCE = 150, 5000
_LANES = 16

#: Bytes of text that are counted at once; each byte takes a few 64-bit numbers meanwhile.
_TEXT_BYTES = 1 << 20

#: Languages whose references are in memory at once; more are judged in more passes.
_BLOCK_LANGS = 500

#: The distribution rule: documents of fewer words are exempt; distances above these fail.
LEAST_WORDS, MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 50, 0.32, 0.55

#: It also fails documents whose share of common words is less than this part of the reference's, where the reference lets so many be expected.
LEAST_COMMON, _LEAST_EXPECTED = 0.5, 16

#: Words of more bytes are counted under a hash of theirs, so that they weigh little in a shuffle.
_LONG_WORD = 32

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins (and the last ends)."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's words begin (and all end), and the words, coded."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    begins = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values[begins[0] : begins[-1]].dictionary_encode()
    full = np.asarray(pc.not_equal(coded.dictionary, ""))[np.asarray(coded.indices)] if len(coded) else np.empty(0, bool)
    return np.concatenate([[0], np.cumsum(full)])[begins - begins[0]], coded.filter(pa.array(full))


def _class_counts(texts: pa.Array) -> np.ndarray:
    data, begins = _flat(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    n = len(_CLASSES)
    return np.bincount(owner * n + _CLASS_OF[data], minlength=len(texts) * n).reshape(-1, n)


def _repeats(begins: np.ndarray, word: np.ndarray, window: int = 8) -> np.ndarray:
    """For each text: words in windows of 8 words that occur twice or more in it. Windows get equal numbers only if equal: by pairs of words, then pairs of pairs."""
    n, texts = len(word), len(begins) - 1
    owner = np.repeat(np.arange(texts), np.diff(begins))
    name, span = word.astype(np.int64), 1
    while span < window:
        name = np.unique(name[:-span] * (n + 1) + name[span:], return_inverse=True)[1] if len(name) > span else name[:0]
        span *= 2
    if not len(name):
        return np.zeros(texts, np.int64)
    inside = owner[: len(name)] == owner[window - 1 :]
    at = np.flatnonzero(inside)
    _, which, counts = np.unique(owner[at] * (n + 1) + name[at], return_inverse=True, return_counts=True)
    again = at[counts[which] > 1]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + window, -1)
    return np.bincount(owner, np.cumsum(marks[:-1]) > 0, minlength=texts).astype(np.int64)


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    begins, coded = _words(texts)
    classes = _class_counts(texts)
    data, ends = _flat(texts)
    space = np.isin(np.arange(256), list(_SPACE))[data]
    starts_char = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts_char & ~space)])[ends]
    return {
        "n_words": np.diff(begins),
        "word_chars": np.diff(chars),
        "n_symbols": classes[:, _CLASSES.index("symbol")],
        "n_dup_lines": np.array([_dup_lines(x) if x else 0 for x in texts.to_pylist()], np.int64),
        "n_repeat_words": _repeats(begins, np.asarray(coded.indices)),
    }


def _lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's words begin (and all end), each word's number, and the distinct lower-case words by number, long ones as hashes."""
    begins, coded = _words(pc.ascii_lower(texts))
    names = coded.dictionary
    long = pc.greater(pc.binary_length(names), _LONG_WORD)
    hashes = [xxhash.xxh3_128_hexdigest(x) for x in names.filter(long).cast(pa.binary()).to_pylist()]
    return begins, np.asarray(coded.indices), pc.replace_with_mask(names, long, pa.array(hashes, names.type)) if hashes else names


def _gathered(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, item, n): class counts, words in all, and counts of lower-case words, summed up in each batch."""

    columns, types = ["lang", "kind", "item", "n"], (pa.string(), pa.string(), pa.string(), pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(0), _TEXT_BYTES):
                langs = batch.column(1).slice(first, len(texts)).dictionary_encode()
                number, names = np.asarray(langs.indices), langs.dictionary.to_pylist()
                classes = _class_counts(texts)
                begins, index, words = _lower_words(texts)
                owner = np.repeat(number, np.diff(begins))
                key, n = np.unique(owner.astype(np.int64) * len(words) + index, return_counts=True)
                rows = [(names[k], "class", c, int(v)) for k in range(len(names)) for c, v in zip(_CLASSES[:_NOT_COUNTED], classes[number == k].sum(axis=0).tolist())]
                rows += [(names[k], "all", "", int(v)) for k, v in enumerate(np.bincount(owner, minlength=len(names)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], columns)
                of, word = np.divmod(key, max(1, len(words)))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of)).cast(pa.string()), pa.array(["word"] * len(key)).cast(pa.string()), words.take(pa.array(word)).cast(pa.string()), pa.array(n, pa.int64())], columns)

    rows = docs.where(F.col(lang).isNotNull()).select(text, F.col(lang).alias("lang")).mapInArrow(count, "lang string, kind string, item string, n long")
    return rows.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


class References:
    """Histograms of languages, by name."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.classes: dict[str, np.ndarray] = {}
        self.words: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for lang in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == lang]
            counts = np.zeros(_NOT_COUNTED)
            for _, kind, item, n in own:
                if kind == "class":
                    counts[_CLASSES.index(item)] = n
            common = sorted((r[2], r[3]) for r in own if r[1] == "word")
            rest = sum(r[3] for r in own if r[1] == "all") - sum(n for _, n in common)
            self.classes[lang] = counts
            self.words[lang] = (pa.array([w for w, _ in common], pa.string()), np.array([*(n for _, n in common), rest], float))


def _block(lang: F.Column, blocks: int) -> F.Column:
    return F.pmod(F.xxhash64(lang), F.lit(blocks))


@dataclass
class LanguageReferences:
    """The references' histograms as a table (lang, kind, item, n), dealt out to blocks by language."""

    rows: DataFrame
    blocks: int

    def block(self, k: int) -> References:
        """At most 150 words and 11 classes for each of about 500 languages; that bounds what comes to the driver at once."""
        return References([tuple(r) for r in self.rows.where(_block(F.col("lang"), self.blocks) == k).collect()])


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageReferences:
    """References from all rows of docs, of every language with 5000 words or more, however small its share."""
    gathered = stored(_gathered(docs, text, lang), "references")
    large = gathered.where((F.col("kind") == "all") & (F.col("n") >= _LEAST_REFERENCE)).select("lang")
    # The most frequent of each lane first, so that no task ranks a language's words from all tasks.
    top = gathered.withColumn("_lane", F.pmod(F.xxhash64("item"), F.lit(_LANES)))
    for by in (("lang", "kind", "_lane"), ("lang", "kind")):
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "item")
        top = top.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= _COMMON)
    # Only ranked rows are joined, so that no task takes all words of a language.
    top = stored(top.join(large, "lang", "left_semi").select("lang", "kind", "item", "n"), "common")
    removed(gathered)
    return LanguageReferences(top, max(1, ceil(top.where("kind = 'all'").count() / _BLOCK_LANGS)))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2; 0 to 1) of two histograms; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, kl / 2)))


def distances(texts: pa.Array, langs: list[str | None], refs: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text to its language: by character classes, by common words; and whether it has too few common words. Without a reference, nothing is far."""
    classes = _class_counts(texts)[:, :_NOT_COUNTED]
    begins, index, words = _lower_words(texts)
    out, poor = np.zeros((2, len(texts))), np.zeros(len(texts), bool)
    slots = {}
    for lang in set(langs) & set(refs.words):
        common, ref = refs.words[lang]
        slots[lang] = np.asarray(pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=common), len(common)), np.int64)
    for k, lang in enumerate(langs):
        if lang in slots:
            ref = refs.words[lang][1]
            own = np.bincount(slots[lang][index[begins[k] : begins[k + 1]]], minlength=len(ref)).astype(float)
            out[0, k] = distance(classes[k].astype(float), refs.classes[lang])
            out[1, k] = distance(own, ref)
            expected = own.sum() * ref[:-1].sum() / max(1, ref.sum())
            poor[k] = expected >= _LEAST_EXPECTED and own[:-1].sum() < LEAST_COMMON * expected
    return out[0], out[1], poor


def judge(docs: DataFrame, refs: LanguageReferences, keep: tuple[str, ...], text: str = "text", lang: str = "lang") -> DataFrame:
    """keep, COUNTS, class_distance, word_distance, base_failed and kept for each row of docs.

    base_failed: under 20 words, or over 30 % of them in repeated windows. kept: neither that, nor, with LEAST_WORDS
    words or more, a distance above its bound or less than LEAST_COMMON of the common words that its language has. A null text has no words and fails. Documents without
    a language, or of one without a reference, have distances 0. No shuffle: rows are judged where they are read, in one
    pass for each block of references, which takes its languages' documents only. Repeated rows are judged alike, and an
    empty table gives no rows.
    Kept columns must not be named like the results; other columns of docs may have any name.
    """
    counts = "".join(f"{n} long, " for n in COUNTS)

    def run(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(0), _TEXT_BYTES):
                own = batch.slice(first, len(texts))
                n = base_counts(texts)
                classes, words, poor = distances(texts, own.column(1).to_pylist(), shared.value)
                failed = (n["n_words"] < 20) | (100 * n["n_repeat_words"] > 30 * n["n_words"])
                far = (n["n_words"] >= LEAST_WORDS) & ((classes > MOST_CLASS_DISTANCE) | (words > MOST_WORD_DISTANCE) | poor)
                out = {c: n[c].astype(np.int64) for c in COUNTS} | {"class_distance": classes, "word_distance": words, "base_failed": failed, "kept": ~failed & ~far}
                yield pa.RecordBatch.from_arrays([*own.columns[2:], *map(pa.array, out.values())], [*keep, *out])

    schema = schema_of(docs, keep, f"{counts}class_distance double, word_distance double, base_failed boolean, kept boolean")
    columns, parts = docs.select(F.col(text).alias("_text"), F.col(lang).alias("_lang"), *keep), []
    for k in range(refs.blocks):
        shared = docs.sparkSession.sparkContext.broadcast(refs.block(k))
        own = columns.where(_block(F.col("_lang"), refs.blocks) == k) if refs.blocks > 1 else columns
        parts.append(own.mapInArrow(partial(run, shared=shared), schema))
    return reduce(DataFrame.unionAll, parts)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, language_references(docs), ("doc_id",))
