"""Near-duplicates by b-bit MinHash.

Every document's set of word shingles is reduced to 160 minima. Runs of five minima make 32 band keys, and
documents that share a key are candidates. Of each minimum two bits are kept and packed into five 64-bit
words; two documents' similarity is estimated by counting equal two-bit fields and taking off what chance adds.
Pairs whose estimate is not far below the threshold are confirmed on their full sets.

Documents with equal sets are one class from the start, so exact copies never meet in a bucket. Buckets are then
worked off in two steps, so that one of many near-copies costs in proportion to its documents:

* Stars. Each bucket has a pivot, its first document. Each document is estimated against the pivots of its buckets and
  compared with the likeliest one, so that its text is sent once. Confirmed pairs are joined to components.
* Rest. In a bucket whose documents are all of one component nothing is left to find, and it is dropped. In the
  others, pairs of one component are skipped. While such buckets hold many documents beside their largest component,
  further rounds of stars go first. Then the documents beside the largest component are compared with it and with
  each other, in groups of two blocks each, so that none is capped. A pair is looked at in the first band that its
  documents share and nowhere else. A group gives its links as a forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import filesystem, removed, schema_of, stored, table
from tessera.llm.components import components
from tessera.llm.shingles import distinct_shingles, mixed
from tessera.llm.token_ids import slices

BANDS, ROWS, BITS = 32, 5, 2
_MINIMA = BANDS * ROWS
_WORDS = _MINIMA * BITS // 64

#: Documents and shingles that one side of a group may have.
_BLOCK_DOCS, _BLOCK_SHINGLES = 512, 2_000_000

#: Documents of a bucket that a copy of its pivot serves, as a power of two.
_STAR_BITS = 8

#: The rest goes to further rounds of stars while it has more than so many pairs a document and a round halves them.
_STAR_PAIRS = 4096

#: Parts that a component's members are dealt out to for a join.
_SALTS = 16

_PACKED = [f"b{k}" for k in range(_WORDS)]


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, _MINIMA, dtype=np.uint32), rng.integers(0, 1 << 32, _MINIMA, dtype=np.uint32) | np.uint32(1)


_XOR, _TIMES = _seeds()


def minima(starts: np.ndarray, values: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """The 160 minima (32-bit) of each set; a set without values has all ones."""
    out = np.full((len(starts) - 1, _MINIMA), 0xFFFFFFFF, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(starts))
    cuts = np.flatnonzero(np.diff(starts[full] // chunk, prepend=-1)).tolist() + [len(full)]
    for a, b in zip(cuts, cuts[1:]):
        rows = full[a:b]
        first, last = starts[rows[0]], starts[rows[-1] + 1]
        part, at = short[first:last], starts[rows] - first
        for k in range(_MINIMA):
            out[rows, k] = np.minimum.reduceat((part ^ _XOR[k]) * _TIMES[k], at)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    out = np.zeros((len(least), BANDS), np.uint64)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k::ROWS].astype(np.uint64) + np.uint64(1))
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """Two bits of each (spread) minimum, 32 of them in a 64-bit word."""
    x = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    low = ((x ^ (x >> np.uint32(13))) & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    fields = low.reshape(len(least), _WORDS, -1) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(fields, axis=2)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of a packed signature to each of many: equal fields, less those that are equal by chance."""
    differ = one ^ many
    differ = (differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)
    equal = 1 - np.bitwise_count(differ).sum(axis=1) / _MINIMA
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def estimated(a: str, b: str) -> Column:
    """estimates, as a column over two structs of packed words."""

    def equal(word: str) -> Column:
        differ = F.col(f"{a}.{word}").bitwiseXOR(F.col(f"{b}.{word}"))
        return F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    chance = 2.0**-BITS
    differing = reduce(add, map(equal, _PACKED))
    return (1 - differing / F.lit(float(_MINIMA)) - chance) / (1 - chance)


def _least_estimate(percent: int) -> float:
    """Six standard deviations of the estimate below the threshold."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - 6 * float(np.sqrt(p * (1 - p) / _MINIMA)) / (1 - chance)


def _shared(own: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many values of own each of the sets that make up flat holds; no set is empty."""
    found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)


@dataclass
class _Members:
    """Documents of a group, as arrays."""

    group: np.ndarray
    band: np.ndarray
    side: np.ndarray
    row: np.ndarray
    label: np.ndarray
    size: np.ndarray
    bits: np.ndarray
    keys: np.ndarray
    sets: np.ndarray | None = None

    def take(self, rows) -> _Members:
        return _Members(*(None if x is None else x[rows] for x in vars(self).values()))

    def join(self, other: _Members) -> _Members:
        return _Members(*(None if x is None else np.concatenate([x, y]) for x, y in zip(vars(self).values(), vars(other).values())))

    def firsts(self) -> range:
        """The members whose partners make up all pairs of the group."""
        return range(len(self.row) if self.side[0] == self.side[-1] else int(np.searchsorted(self.side, self.side[-1])))

    def partners(self, x: int, percent: int, least: float) -> np.ndarray:
        """Later members (of the other side, where there are two) of other components that x may be linked with and that it meets here first."""
        later = np.arange(x + 1 if self.side[0] == self.side[-1] else len(self.firsts()), len(self.row))
        later = later[self.label[later] != self.label[x]]
        low, high = np.minimum(self.size[later], self.size[x]), np.maximum(self.size[later], self.size[x])
        later = later[100 * low >= percent * high]
        later = later[estimates(self.bits[x], self.bits[later]) >= least]
        t = int(self.band[x])
        return later[~(self.keys[later, :t] == self.keys[x, :t]).any(axis=1)] if t else later


_GROUP = f"group long, band int, side int, row long, label long, size long, {', '.join(f'{w} long' for w in _PACKED)}, keys binary"
_GROUP_NAMES = [x.split()[0] for x in _GROUP.split(", ")]


def _members(batch: pa.RecordBatch, sets: bool, width: int) -> _Members:
    """From columns of _GROUP and, for sets, a text."""
    ints = [np.asarray(c) for c in batch.columns[:6]]
    bits = np.column_stack([np.asarray(c) for c in batch.columns[6 : 6 + _WORDS]]).view(np.uint64)
    keys = np.frombuffer(b"".join(batch.column(6 + _WORDS).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
    found = None
    if sets:
        found, at = np.empty(batch.num_rows, object), 0
        for _, texts in slices(batch.column(7 + _WORDS)):
            starts, values = distinct_shingles(texts, width)
            for k in range(len(texts)):
                found[at + k] = values[starts[k] : starts[k + 1]].copy()
            at += len(texts)
    return _Members(*ints, bits, keys, found)


def _groups(batches: Iterator[pa.RecordBatch], sets: bool = False, width: int = 0) -> Iterator[_Members]:
    """Whole groups, from rows sorted by group and side."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _members(batch, sets, width)
        rows = rows if held is None else held.join(rows)
        cuts = [0, *(np.flatnonzero(np.diff(rows.group)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield rows.take(slice(a, b))
        held = rows.take(slice(cuts[-1], None))
    if held is not None:
        yield held


def _links(m: _Members, percent: int, least: float) -> list[tuple[int, int]]:
    """A forest of the group's confirmed links, as pairs of the components that they join."""
    label, out = m.label.copy(), []
    for x in m.firsts():
        may = m.partners(x, percent, least)
        may = may[label[may] != label[x]]
        if not len(may):
            continue
        own, sizes = m.sets[x], m.size[may]
        both = _shared(own, np.concatenate([m.sets[y] for y in may]), sizes)
        for y in may[100 * both >= percent * (len(own) + sizes - both)]:
            if label[y] != label[x]:
                out.append((int(m.label[x]), int(m.label[y])))
                label[label == label[y]] = label[x]
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: row, a number of its own; doc; text and keep; size of its set; set_a and set_b, checksums over the set; the packed words and the band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(0)):
                starts, values = distinct_shingles(texts, width)
                least = minima(starts, values)
                bits, keys = packed(least).view(np.int64), band_keys(least)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(v)])[starts] for v in (values, mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                own = batch.slice(first, len(texts))
                more = [pa.array(np.diff(starts)), *(pa.array(np.diff(s).view(np.int64)) for s in sums), *(pa.array(w.copy()) for w in bits.T), pa.array([x.tobytes() for x in keys], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], [*own.schema.names, "size", "set_a", "set_b", *_PACKED, "keys"])

    columns = docs.select(F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc"), *keep)
    return columns.mapInArrow(sign, schema_of(columns, columns.columns, f"size long, set_a long, set_b long, {', '.join(f'{w} long' for w in _PACKED)}, keys binary"))


class Texts:
    """The texts of signatures, by row. The table's files hold rows in ascending order, and a row's upper bits tell the task that wrote its file.

    Rows that need their texts are sent to the files that hold these, one task a file, so that no other text leaves its file.
    """

    def __init__(self, signed: DataFrame):
        held = signed.select("row", F.input_file_name().alias("_file")).groupBy("_file").agg(F.min("row").alias("_low"), F.max("row").alias("_high"))
        self.files = stored(held.withColumn("_task", F.shiftright("_low", 33)), "files")

    def of(self, wanted: DataFrame) -> DataFrame:
        """wanted, of which row is a column, with text."""
        names = wanted.columns
        found = wanted.withColumn("_task", F.shiftright("row", 33)).join(self.files, "_task").where(F.col("row").between(F.col("_low"), F.col("_high"))).select("row", "_file", *(c for c in names if c != "row"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path, reader = None, None
            for batch in batches:
                files = batch.column(1).dictionary_encode()
                cuts = np.flatnonzero(np.diff(np.asarray(files.indices), prepend=-1)).tolist() + [batch.num_rows]
                for a, b in zip(cuts, cuts[1:]):
                    if path != files[a].as_py():
                        path = files[a].as_py()
                        reader = _RowReader(path)
                    at = a
                    for texts in reader.texts(np.asarray(batch.column(0).slice(a, b - a))):
                        own = batch.slice(at, len(texts))
                        yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), texts], [*names, "text"])
                        at += len(texts)

        dealt = found.repartition("_file").sortWithinPartitions("_file", "row")
        return dealt.mapInArrow(fetch, schema_of(found, names, "text string"))


class _RowReader:
    """Reads a file of rows forward, a small batch at a time."""

    def __init__(self, path: str):
        from pyarrow import parquet

        fs, at = filesystem(path)
        self.batches = parquet.ParquetFile(fs.open_input_file(at)).iter_batches(512, columns=["row", "text"])
        self.rows, self.held = np.empty(0, np.int64), None

    def texts(self, wanted: np.ndarray) -> Iterator[pa.Array]:
        """The texts of ascending rows, which must not lie before those asked for earlier, in parts."""
        done = 0
        while done < len(wanted):
            while not len(self.rows) or self.rows[-1] < wanted[done]:
                self.held = next(self.batches)
                self.rows = np.asarray(self.held.column(0))
            end = int(np.searchsorted(wanted, self.rows[-1], "right"))
            yield self.held.column(1).take(pa.array(np.searchsorted(self.rows, wanted[done:end])))
            done = end


def star_links(pairs: DataFrame, heads: DataFrame, texts: Texts, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of documents with the likeliest of their pivots, among pairs (row, pivot, docs): docs is how many documents share that pivot in a bucket.

    A pivot is dealt out in so many copies that each serves about 2**_STAR_BITS documents of a bucket. A document that
    meets a pivot in several buckets goes to one copy: copies are the low bits of a hash, and the largest number counts.
    """
    copies = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs"))) - _STAR_BITS)).cast("long")
    met = pairs.groupBy("row", "pivot").agg(F.max(F.pmod(F.xxhash64("row"), copies)).alias("copy"))
    signed = heads.select("row", F.struct("size", *_PACKED).alias("own"))
    pivots = met.select(F.col("pivot").alias("row"), "copy").distinct().join(signed, "row").select(F.col("row").alias("pivot"), "copy", F.col("own").alias("other"))
    both = met.join(signed, "row").join(pivots, ["pivot", "copy"])
    low, high = F.least("own.size", "other.size"), F.greatest("own.size", "other.size")
    both = both.where(100 * low >= percent * high).withColumn("like", estimated("own", "other")).where(F.col("like") >= _least_estimate(percent))
    near = both.groupBy("row").agg(F.max_by(F.struct("pivot", "copy"), F.struct("like", "pivot")).alias("best"))
    near = stored(near.select("best.pivot", "best.copy", "row"), "stars")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            for first, found in slices(batch.column(3)):
                pivot, copy, row = (np.asarray(batch.column(k).slice(first, len(found))) for k in range(3))
                starts, values = distinct_shingles(found, width)
                sizes = np.diff(starts)
                cuts = [0, *(np.flatnonzero((np.diff(pivot) != 0) | (np.diff(copy) != 0)) + 1).tolist(), len(row)]
                for a, b in zip(cuts, cuts[1:]):
                    if a < b and row[a] == pivot[a]:  # a pivot comes before its documents
                        at, own = (pivot[a], copy[a]), values[starts[a] : starts[a + 1]].copy()
                        a += 1
                    if a == b:
                        continue
                    if at != (pivot[a], copy[a]):
                        raise ValueError("a document came before its pivot")
                    both = _shared(own, values[starts[a] : starts[b]], sizes[a:b])
                    good = np.flatnonzero(100 * both >= percent * (len(own) + sizes[a:b] - both)) + a
                    if len(good):
                        yield pa.RecordBatch.from_arrays([pa.array(pivot[good]), pa.array(row[good])], ["a", "b"])

    wanted = near.unionByName(near.select("pivot", "copy", F.col("pivot").alias("row")).distinct())
    full = texts.of(wanted.select("pivot", "copy", "row")).withColumn("_later", F.col("row") != F.col("pivot"))
    dealt = full.repartition("pivot", "copy").sortWithinPartitions("pivot", "copy", "_later").select("pivot", "copy", "row", "text")
    links = stored(dealt.mapInArrow(confirm, "a long, b long"), "links")
    removed(near)
    return links


def _labelled(met: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of met (row, band, key) in buckets of more than one component: with their component as label, whether they lie beside the bucket's largest one, and counts of both parts."""
    named = joined.select(F.col("node").alias("row"), "component")
    rows = met.select("row", "band", "key", "size").join(named, "row", "left").select("row", "band", "key", "size", F.coalesce("component", "row").alias("label"))
    held = rows.groupBy("band", "key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    most = F.max_by("label", F.struct("n", "label")).alias("most")
    cells = held.groupBy("band", "key").agg(most, F.max("n").alias("n_most"), F.sum("n").alias("n_all"), F.sum("shingles").alias("s_all"), F.count("*").alias("labels"))
    cells = cells.where("labels > 1").drop("labels")
    return stored(rows.join(cells, ["band", "key"]).withColumn("beside", F.col("label") != F.col("most")).drop("most"), "mixed")


def _more_stars(mixed_rows: DataFrame, turn: int) -> DataFrame:
    """(row, pivot, docs): the documents beside the largest component with a pivot of it and one of their own, each drawn anew in each turn."""
    draw = F.xxhash64("row", F.lit(turn))
    drawn = [F.min_by("row", F.when(side, draw)).alias(name) for name, side in (("inner", ~F.col("beside")), ("outer", F.col("beside")))]
    labels = [F.min_by("label", F.when(F.col("beside"), draw)).alias("outer_label")]
    pivots = mixed_rows.groupBy("band", "key").agg(*drawn, *labels)
    both = mixed_rows.where("beside").join(pivots, ["band", "key"]).withColumn("docs", F.col("n_all") - F.col("n_most"))
    return both.select("row", F.col("inner").alias("pivot"), "docs").unionByName(both.where("label <> outer_label").select("row", F.col("outer").alias("pivot"), "docs"))


def rest_links(mixed_rows: DataFrame, heads: DataFrame, texts: Texts, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of components with a confirmed link, of those that share a bucket, from all pairs of which one lies beside the bucket's largest component."""
    least = _least_estimate(percent)

    def blocks(docs: Column) -> Column:
        return F.ceil(F.greatest(docs / _BLOCK_DOCS, docs * F.col("s_all") / F.col("n_all") / _BLOCK_SHINGLES)).cast("int")

    rows = mixed_rows.withColumns({"_inner": blocks(F.col("n_most")), "_outer": blocks(F.col("n_all") - F.col("n_most"))})
    own = F.pmod(F.xxhash64("row"), F.when(F.col("beside"), F.col("_outer")).otherwise(F.col("_inner"))).cast("int")
    rows = rows.withColumn("_own", own)

    def numbers(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    # (0, outer block, inner block) and (1, one outer block, the same or a later one)
    across = F.transform(numbers("_inner"), lambda k: F.struct(F.lit(0).alias("kind"), F.col("_own").alias("lo"), k.alias("hi")))
    among = F.transform(numbers("_outer"), lambda k: F.struct(F.lit(1).alias("kind"), F.least(F.col("_own"), k).alias("lo"), F.greatest(F.col("_own"), k).alias("hi")))
    inner = F.transform(numbers("_outer"), lambda k: F.struct(F.lit(0).alias("kind"), k.alias("lo"), F.col("_own").alias("hi")))
    met = rows.withColumn("_group", F.explode(F.when(F.col("beside"), F.concat(across, among)).otherwise(inner)))
    side = F.when(F.col("_group.kind") == 1, F.col("_own")).otherwise(F.when(F.col("beside"), F.lit(0)).otherwise(F.lit(1)))
    met = met.select(F.xxhash64("band", "key", "_group").alias("group"), "band", side.cast("int").alias("side"), "row", "label")
    met = met.join(heads, "row").select(*_GROUP_NAMES)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of at least one pair of their group that must be confirmed there."""

        def out(parts: list[_Members]) -> pa.RecordBatch:
            m = reduce(_Members.join, parts)
            ints = [pa.array(x) for x in (m.group, m.band, m.side, m.row, m.label, m.size, *m.bits.view(np.int64).T.copy())]
            return pa.RecordBatch.from_arrays([*ints, pa.array([x.tobytes() for x in m.keys], pa.binary())], _GROUP_NAMES)

        parts, held = [], 0
        for m in _groups(batches):
            use = np.zeros(len(m.row), bool)
            for x in m.firsts():
                may = m.partners(x, percent, least)
                use[may] = True
                use[x] |= len(may) > 0
            if use.any():
                parts.append(m.take(use))
                held += int(use.sum())
            if held >= 5000:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    chosen = stored(met.repartition("group").sortWithinPartitions("group", "side", "row").mapInArrow(needed, _GROUP), "candidates")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _groups(batches, sets=True, width=width):
            if found := _links(m, percent, least):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    full = texts.of(chosen)
    links = stored(full.repartition("group").sortWithinPartitions("group", "side", "row").mapInArrow(confirm, "a long, b long"), "links")
    removed(chosen)
    return links


def _roots(parents: DataFrame) -> DataFrame:
    """(node, component) of links (a, b) with one a, a smaller one, for each b: every node with the end of its path, by doubling its steps."""
    ends = parents_ = parents.select(F.col("b").alias("node"), F.col("a").alias("component"))
    while True:
        following = ends.select(F.col("node").alias("component"), F.col("component").alias("_end"))
        moved, seen = ends.join(following, "component", "left"), Observation()
        moved = moved.observe(seen, F.count("_end").alias("n")).select("node", F.coalesce("_end", "component").alias("component"))
        before, ends = ends, stored(moved, "ends")
        if before is not parents_:
            removed(before)
        if not seen.get["n"]:
            break
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


def near_components(signed: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of every representative of a class that is linked with another's."""
    heads = signed.where("size > 0").join(classes.select("set_a", "set_b", "size", F.col("head").alias("row")), ["set_a", "set_b", "size", "row"])
    heads, texts = stored(heads.select("row", "size", *_PACKED, "keys"), "heads"), Texts(signed)
    at = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    rows = heads.select("row", "size", "keys", at.alias("band")).select("row", "size", "band", F.expr("substring(keys, band * 8 + 1, 8)").alias("key"))
    cells = rows.groupBy("band", "key").agg(F.count("*").alias("docs"), F.min("row").alias("pivot")).where("docs > 1")
    met = stored(rows.join(cells, ["band", "key"]), "met")
    links = star_links(met.where("row <> pivot").select("row", "pivot", "docs"), heads, texts, width, percent)
    joined, turn, before = _roots(links), 0, None
    while True:
        whole, met = met, _labelled(met, joined)
        removed(whole)
        n, pairs = met.agg(F.count("*"), F.sum(F.when(F.col("beside"), F.col("n_all")))).first()
        if not n:
            removed(heads, texts.files, met)
            return joined
        if pairs <= _STAR_PAIRS * n or before and 2 * pairs > before:
            break
        links = links.unionByName(star_links(_more_stars(met, turn), heads, texts, width, percent))
        joined, turn, before = components(links), turn + 1, pairs
    more = rest_links(met, heads, texts, width, percent)
    removed(heads, texts.files, met)
    if more.isEmpty():
        return joined
    wider = components(more)
    named = joined.unionByName(wider.select("node", F.col("node").alias("component"))).distinct()
    of = wider.select(F.col("node").alias("component"), F.col("component").alias("_of"))
    return named.join(of, "component", "left").select("node", F.coalesce("_of", "component").alias("component"))


def _resolved(signed: DataFrame, width: int, percent: int) -> DataFrame:
    """(row, doc, size, _component, component_id) of every row of signatures; _component is a row of the component, whatever the ids are."""
    classes = stored(signed.where("size > 0").groupBy("set_a", "set_b", "size").agg(F.min("row").alias("head"), F.min("doc").alias("doc")), "classes")
    joined = near_components(signed, classes, width, percent)
    linked = classes.select("head", "doc").join(joined, F.col("head") == F.col("node")).select("head", "doc", "component", F.pmod(F.xxhash64("head"), F.lit(_SALTS)).alias("_salt"))
    least = linked.groupBy("component").agg(F.min("doc").alias("_least")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    linked = linked.join(least, ["component", "_salt"]).select("head", "component", "_least")  # in salts, as one component may hold most
    named = classes.join(linked, "head", "left").select("set_a", "set_b", "size", F.coalesce("component", "head").alias("_component"), F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("_least")).alias("_least"))
    out = signed.select("row", "doc", "size", "set_a", "set_b").join(named, ["set_a", "set_b", "size"], "left")
    blank = F.col("size") == 0
    return out.select("row", "doc", "size", F.when(blank, F.col("row")).otherwise(F.col("_component")).alias("_component"), F.when(blank, F.col("doc")).otherwise(F.col("_least")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of width-word shingles; a text
    with fewer words is one shingle. component_id is the smallest doc_id reachable; kept is doc_id = component_id. Null
    and blank texts have an empty set and are linked with nothing. Rows are told apart by numbers of their own, so
    rows of one doc_id are linked by their texts alone, and repeated rows are all kept or all not. A row with a null
    doc_id is linked as any other; its component has the smallest id that isn't null, or null if there is none, and
    then its rows are all kept. An empty table gives no rows. Other columns of docs may have any name. A pair at the
    threshold shares no band with a chance of 3 in a million.
    """
    out = _resolved(stored(signatures(docs, doc_id, text, width), "signatures"), width, percent)
    return out.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, less all but one of each component: that with the smallest doc_id, or any one of those that share it or have none.

    Links are those of near_duplicates; texts decide, so different texts under one doc_id all stay, and so does every
    row with a null or blank text. Columns may have any name.
    """
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text]
    whole = docs.select(F.col(f"`{doc_id}`").alias("_doc_id"), F.col(f"`{text}`").alias("_text"), F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    signed = stored(signatures(whole, "_doc_id", "_text", width, ("_rest",)), "signatures")
    heads = _resolved(signed, width, percent).where(F.col("doc").eqNullSafe(F.col("component_id"))).groupBy("_component").agg(F.min("row").alias("row"))
    kept = signed.select("row", "text", "_rest").join(heads.select("row"), "row", "left_semi")
    return kept.select(*(F.col("text").alias(c) if c == text else F.col(f"_rest.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of near-copies among all documents, at four words and 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS shingles FROM words
), each AS (SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))
), reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT doc_id, y FROM reached JOIN links ON other = x)
SELECT doc_id, any_value(len(shingles)) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM sets JOIN reached USING (doc_id) GROUP BY doc_id
"""
