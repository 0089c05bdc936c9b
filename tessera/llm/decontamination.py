"""Benchmark decontamination by template canonicalisation.

A text becomes a row of template tokens: numbers, units after numbers, and names are replaced by typed
placeholders, all other words are lower-cased and stand for themselves. Names are capitalised words within a
sentence, up to four in a row as one; longer rows and neighbours in capitals throughout are headings and shouts.

Windows of eight template tokens are looked up in a hash table of the benchmark's windows. Hits of one document
and item that keep their distance, or whose distances differ by a few tokens while both go forward, are one
alignment, so that a word put in or left out doesn't split a copy; its slots are checked: one item value must stand for one
value of the document throughout and the other way round. Windows over a slot that breaks this don't count. A
copy maps every value to itself, a re-parameterised question to others, and both are caught.

All items are looked up word by word too, in lower case and with their values as they are. That finds copies in which
case or line breaks make other words names, and items none of whose windows has enough literal words. Items of fewer
than five words are too short for either and are looked up whole, with their values and signs: those of three words or
signs and more anywhere in a text, shorter ones as a whole text only, since a word or two occur by chance.

Equal items are looked up once, and of equal windows of an item the first stands for all. Hits are arrays; those whose
alignment has too few others to count are dropped before any is looked at one by one, and once an alignment holds
all of an item's windows no other is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.shingles import mixed
from tessera.llm.token_ids import gather, slices

#: Window, the fewest literal words in one, and the fewest tokens of an item that is looked up by windows.
WINDOW, LITERALS, LEAST_TOKENS = 8, 4, 5

#: An item is in a document if this share of its windows match in one alignment, or windows over so many tokens do.
COVERAGE, LONG_RUN = 0.5, 20

#: Tokens put in or left out within one alignment.
SLIP = 4

#: Words and signs of an item that is found within longer texts, if it is looked up whole.
_LEAST_WHOLE = 3

#: Hits that are in memory at once, about: a worker takes the items in as many parts as that needs.
_HITS = 4_000_000

#: Words of the benchmark that one pass over the documents takes, in two tables; a larger benchmark takes more passes.
_BLOCK_WORDS = 1_000_000

#: Words that are units after a number.
UNITS = frozenset(
    "% $ € £ mm cm m km in ft mi mg g kg t lb oz ml l s sec ms min h hr hrs kb mb gb tb hz v w kw mph kmh c f percent dollar dollars euro euros cent cents pound pounds "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms ton tons liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years degree degrees".split()
)

_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$") + "«»“”‘’„…–—¿¡"
_LITERAL, _NUMBER, _UNIT, _NAME = range(4)
_NAME_WORDS = 4


@dataclass
class Template:
    """Template tokens of many texts: where each text's begin (and all end), their hashes, their values' hashes, their kinds."""

    begins: np.ndarray
    token: np.ndarray
    value: np.ndarray
    kind: np.ndarray


def canonical(texts: pa.Array) -> tuple[Template, Template, Template]:
    """The template tokens of texts; all their words, lower-cased, as literal ones; and these with signs that stand alone."""
    texts = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([0-9])([A-Za-z%$€£])", r"\1 \2")
    texts = pc.replace_substring_regex(texts, r"([$€£])([0-9]([0-9.,:/]*[0-9])?)", r"\2 \1")  # as "3 dollars", a number and a unit
    lists = pc.ascii_split_whitespace(pc.replace_substring(texts, "\n", " \x02 "))
    begins = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values[begins[0] : begins[-1]].dictionary_encode()
    index, begins, words = np.asarray(coded.indices), begins - begins[0], coded.dictionary
    core = pc.utf8_trim(words, _TRIM)
    lower = pc.utf8_lower(core)
    keys = lower.cast(pa.binary()).to_pylist()
    value = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def each(x) -> np.ndarray:
        return np.asarray(x, bool)[index] if len(index) else np.empty(0, bool)

    upper = each(pc.utf8_is_upper(pc.utf8_slice_codeunits(core, 0, 1)))
    capitals = each(pc.utf8_is_upper(core))
    number = each(pc.match_substring_regex(core, r"^[+-]?[0-9]([0-9.,:/]*[0-9])?$"))
    unit = each(pc.is_in(lower, pa.array(sorted(UNITS))))
    line = each(pc.equal(words, "\x02"))
    stop = each(pc.match_substring_regex(words, r"[.?!:]\W*$")) | line
    word = ~line & each(pc.not_equal(core, ""))
    signs = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    alone = each(pc.and_(pc.equal(core, ""), pc.and_(pc.not_equal(words, ""), pc.not_equal(words, "\x02"))))
    value, signs = value[index], signs[index]

    first = np.zeros(len(index) + 1, bool)
    first[begins[:-1]] = True
    opens = first[:-1] | np.append(True, stop[:-1])[: len(index)]
    follows = np.append(False, number[:-1])[: len(index)] & ~first[:-1]
    kind = np.where(number, _NUMBER, np.where(unit & follows, _UNIT, np.where(upper & ~opens, _NAME, _LITERAL)))
    name = kind == _NAME
    new = name & ~(np.append(False, name[:-1])[: len(index)] & ~first[:-1])
    run = np.cumsum(new)
    heading = np.bincount(run[name], minlength=len(index) + 1)[run] > _NAME_WORDS
    after = np.append(False, capitals[:-1])[: len(index)] & ~first[:-1]
    before = np.append(capitals[1:], False)[: len(index)] & ~first[1:]
    kind = np.where(name & (heading | capitals & (after | before)), _LITERAL, kind)
    name = kind == _NAME
    keep = word & ~(name & np.append(name[1:], False)[: len(index)] & ~first[1:])  # of a run of names, the last
    slot = np.array([0, 1, 2, 3], np.uint64)[kind]
    token = np.where(kind == _LITERAL, value, mixed(slot))
    plain = np.concatenate([[0], np.cumsum(word)])[begins], value[word], value[word], np.full(int(word.sum()), _LITERAL)
    every = word | alone
    whole = np.where(alone, signs, value)[every]
    whole = np.concatenate([[0], np.cumsum(every)])[begins], whole, whole, np.full(len(whole), _LITERAL)
    return Template(np.concatenate([[0], np.cumsum(keep)])[begins], token[keep], value[keep], kind[keep]), Template(*plain), Template(*whole)


def window_hashes(t: Template, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, hash) of every window of width template tokens that has enough literal words and lies in one text."""
    n = len(t.token) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(t.begins) - 1), np.diff(t.begins))
    literal = np.concatenate([[0], np.cumsum(t.kind == _LITERAL)])
    good = (owner[:n] == owner[width - 1 :]) & (literal[width:] - literal[:-width] >= min(LITERALS, width))
    at = np.flatnonzero(good)
    out = np.full(len(at), width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + t.token[at + k])
    return owner[at], at, out


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (document token, item token) in which both go forward."""
    pairs = sorted(pairs, key=lambda x: (x[1], -x[0]))
    tails, ends, before = [], [], []
    for n, (p, _) in enumerate(pairs):
        k = bisect_left(tails, p)
        before.append(ends[k - 1] if k else -1)
        tails[k:], ends[k:] = [p, *tails[k + 1 :]], [n, *ends[k + 1 :]]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class WindowTable:
    """A hash table of the distinct windows of items."""

    def __init__(self, template: Template):
        self.template, sizes = template, np.diff(template.begins)
        self.widths = np.where(sizes >= LEAST_TOKENS, np.minimum(sizes, WINDOW), 0)
        self.tables, self.counts = {}, np.zeros(len(sizes), np.int64)
        for width in sorted(set(self.widths.tolist()) - {0}):
            item, at, key = window_hashes(self.template, width)
            own = self.widths[item] == width
            item, at, key = item[own], at[own], key[own]
            order = np.lexsort((at, item, key))
            item, at, key = item[order], at[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
            item, at, key = item[new], at[new], key[new]
            np.add.at(self.counts, item, 1)
            sieve = np.zeros(1 << 22, bool)
            sieve[key & np.uint64((1 << 22) - 1)] = True
            self.tables[width] = (key, item, at, sieve)
        # An alignment counts with half of the windows, or with as many as cover a long run.
        self.needed = np.minimum(np.ceil(COVERAGE * self.counts), np.ceil(LONG_RUN / np.maximum(1, self.widths))).astype(np.int64)

    def hits(self, t: Template) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, item, document tokens, item tokens) of equal windows, by shift: those that lie with as many others as are needed within 2 * SLIP shifts."""
        for width, (keys, items, places, sieve) in self.tables.items():
            text, at, key = window_hashes(t, width)
            may = sieve[key & np.uint64((1 << 22) - 1)]
            text, at, key = text[may], at[may], key[may]
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            parts = -(-int((high - low).sum()) // _HITS)
            for part in range(parts):
                if parts > 1:
                    own = items % parts == part
                    keys_, items_, places_ = keys[own], items[own], places[own]
                    low, high = np.searchsorted(keys_, key, "left"), np.searchsorted(keys_, key, "right")
                else:
                    keys_, items_, places_ = keys, items, places
                n = high - low
                entry = gather(np.arange(len(keys_)), low, n)
                of, item, j, p = np.repeat(text, n), items_[entry], places_[entry], np.repeat(at, n)
                order = np.lexsort((j, p - j, item, of))
                of, item, j, p = of[order], item[order], j[order], p[order]
                if not len(p):
                    continue
                shift = p - j
                pair = np.cumsum(np.append(True, (of[1:] != of[:-1]) | (item[1:] != item[:-1])))
                span = int(shift.max() - shift.min()) + 2 * SLIP + 1
                line = pair * span + shift - shift.min()
                end = np.searchsorted(line, line + np.minimum(2 * SLIP, span * (pair + 1) - 1 - line), "right")
                starts = np.flatnonzero(end - np.arange(len(p)) >= self.needed[item])
                marks = np.zeros(len(p) + 1, np.int64)
                np.add.at(marks, starts, 1)
                np.add.at(marks, end[starts], -1)
                keep = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                cuts = np.flatnonzero(np.diff(pair[keep], prepend=0)).tolist() + [len(keep)]
                for a, b in zip(cuts, cuts[1:]):
                    own = keep[a:b]
                    yield int(of[own[0]]), int(item[own[0]]), p[own], j[own]

    def match(self, t: Template, item: int, p: np.ndarray, j: np.ndarray) -> tuple[int, int, int, int] | None:
        """(matching windows, slots, slots with another value, all windows) of the best alignment if the item is in the text. Hits are in the order of their shifts."""
        shift, best = p - j, None
        shifts, begins = np.unique(shift, return_index=True)
        low, high = np.searchsorted(shift, shifts - SLIP, "left"), np.searchsorted(shift, shifts + SLIP, "right")
        ends = np.append(begins[1:], len(shift))
        for k in np.argsort(low - high, kind="stable"):
            if best and min(high[k] - low[k], self.counts[item]) <= best[0]:
                break
            for a, b in {(begins[k], ends[k]), (low[k], high[k])}:
                pairs = list(zip(p[a:b].tolist(), j[a:b].tolist()))
                found = self._aligned(t, item, pairs if a == begins[k] and b == ends[k] else _chain(pairs))
                best = max(best or found, found or best) if best or found else None
        return best

    def _aligned(self, t: Template, item: int, chain: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        """match of one alignment."""
        width, kind, value = int(self.widths[item]), self.template.kind, self.template.value
        places = sorted({(j + k, p + k) for p, j in chain for k in range(width)})
        slots = [(j, p) for j, p in places if kind[j] != _LITERAL]
        pairs = Counter((int(kind[j]), int(value[j]), int(t.value[p])) for j, p in slots)
        forth, back = {}, {}
        for (of, a, b), _ in pairs.most_common():
            forth.setdefault((of, a), b)
            back.setdefault((of, b), a)
        broken = {(j, p) for j, p in slots if forth[int(kind[j]), int(value[j])] != int(t.value[p]) or back[int(kind[j]), int(t.value[p])] != int(value[j])}
        sound = [(p, j) for p, j in chain if not any((j + k, p + k) in broken for k in range(width))]
        covered = len({j + k for _, j in sound for k in range(width)})
        if sound and (len(sound) >= COVERAGE * self.counts[item] or covered >= LONG_RUN):
            changed = sum(int(value[j]) != int(t.value[p]) for j, p in slots if (j, p) not in broken)
            return len(sound), len(slots), changed, int(self.counts[item])
        return None


class WholeTable:
    """Items of few words, to be found as they are."""

    def __init__(self, template: Template, few: np.ndarray):
        sizes = np.diff(template.begins)
        self.keys: dict[int, dict[int, list[int]]] = {}
        for width in sorted(set(sizes[few].tolist()) - {0}):
            item, _, key = window_hashes(template, width)
            own = self.keys.setdefault(width, {})
            for i, x in zip(item.tolist(), key.tolist()):
                if few[i] and sizes[i] == width:
                    own.setdefault(x, []).append(i)

    def found(self, t: Template) -> Iterator[tuple[int, int]]:
        """(text, item), perhaps more than once."""
        sizes = np.diff(t.begins)
        for width, known in self.keys.items():
            text, _, key = window_hashes(t, width)
            may = np.isin(key, np.fromiter(known, np.uint64, len(known)))
            if width < _LEAST_WHOLE:
                may &= sizes[text] == width
            for k, x in set(zip(text[may].tolist(), key[may].tolist())):
                yield from ((k, i) for i in known[x])


class BenchmarkTable:
    """Tables of a block of items: by template, by words, and of items of few words."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        template, words, whole = canonical(pa.array(texts, pa.string()))
        self.tables = WindowTable(template), WindowTable(words)
        self.whole = WholeTable(whole, np.diff(words.begins) < LEAST_TOKENS)

    def found(self, texts: pa.Array) -> list[tuple[int, int, tuple[int, int, int, int]]]:
        """(text, item, match) for every item in every text; a match by template comes before one by words."""
        out, (template, words, whole) = {}, canonical(texts)
        for known, t in zip(self.tables, (template, words)):
            for k, item, p, j in known.hits(t):
                if (k, item) not in out and (m := known.match(t, item, p, j)):
                    out[k, item] = m
        for at in self.whole.found(whole):
            out.setdefault(at, (1, 0, 0, 1))
        return [(*at, m) for at, m in sorted(out.items())]


def benchmark_tables(benchmark: DataFrame, text: str = "text") -> Iterator[BenchmarkTable]:
    """Tables of bounded size that hold all distinct texts: their words are counted first, and they are split by their hash accordingly."""
    items = benchmark.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = ceil(words / _BLOCK_WORDS)
    for k in range(blocks):
        yield BenchmarkTable([r[0] for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()])


_LEAKS = "n_windows long, item_windows long, n_slots long, n_changed long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and benchmark item in it: doc_id, item_id, matching windows of the item and all its windows, slots of the alignment and those whose value differs.

    Whole documents are scanned where they are read, once for each block of the benchmark; nothing of them is shuffled.
    Distinct item texts are looked up, and the rows of the benchmark that have a found text are joined to it. Null and
    empty texts match nothing. An item found whole counts as one window. Repeated rows and repeated items match each
    for itself. An empty benchmark gives no rows. Other columns may have any name.
    """
    columns = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"))
    schema = f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, _item string, {_LEAKS}"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in benchmark_tables(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for first, texts in slices(batch.column(0)):
                    found = known.found(texts)
                    ids = batch.column(1).take(pa.array([first + k for k, _, _ in found], pa.int64()))
                    items = pa.array([known.texts[i] for _, i, _ in found], pa.string())
                    values = list(zip(*((m[0], m[3], m[1], m[2]) for _, _, m in found))) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([ids, items, *(pa.array(x, pa.int64()) for x in values)], ["doc_id", "_item", *(x.split()[0] for x in _LEAKS.split(", "))])

        out = out.unionByName(columns.mapInArrow(find, schema))
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("_item"))
    return out.join(named, "_item").select("doc_id", "item_id", *(x.split()[0] for x in _LEAKS.split(", ")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, whose text holds no benchmark item.

    Null and empty texts hold none. Equal rows stay or go together; an empty table stays empty, and an empty benchmark
    leaves all rows. Columns may have any name.
    """
    out = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    for block in benchmark_tables(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, texts in slices(batch.column(0)):
                    keep[[first + k for k, _, _ in shared.value.found(texts)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, out.schema)
    return out.select("_row.*")


def op3_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    """The benchmark items in all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
