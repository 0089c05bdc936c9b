"""Token ids, counts, record files and packing against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import crc32c, packing, records
from tessera.llm.common import shared_path
from tessera.llm.records import op10_record_files
from tessera.llm.token_counts import TokenCounter, count_tokens, op7_token_counts
from tessera.llm.token_ids import TokenIds, load_tokenizer, slices, vocabulary_path

ALPHABET = list("abcAB'sSt12 \t\n\r\x0b\x0c\x1c\x85\xa0 éÉİςΣσǅ²Ⅷ#$%<|>.,-") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "e\u0301", "\U0001f600", "aaaa", "the ", "a. ", "B,\n"]


@pytest.fixture(scope="module")
def library():
    return load_tokenizer(vocabulary_path())


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def _random_texts(n):
    rng = random.Random(7)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_counts_of_odd_texts(library):
    texts = [*_random_texts(3000), None, "", "a" * 3000]
    want = [_ids(library, x) for x in texts]
    encoder, counter = TokenIds(vocabulary_path()), TokenCounter(vocabulary_path())
    for part in range(0, len(texts), 1000):
        array = pa.array(texts[part : part + 1000], pa.string())
        ids, counts = encoder.encode(array)
        assert counts.tolist() == [len(x) for x in want[part : part + 1000]]
        assert ids.tolist() == [i for x in want[part : part + 1000] for i in x]
        assert counter.count(array).tolist() == counts.tolist()


def test_remembered_words_are_bounded(library, monkeypatch):
    monkeypatch.setattr("tessera.llm.token_ids._REMEMBERED", 50)
    encoder = TokenIds(vocabulary_path())
    for text in _random_texts(200):
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == _ids(library, text)


def test_other_vocabularies_encode_whole_texts():
    path = vocabulary_path("byte_bpe_50k.json")
    texts = ["two  spaces\nand a line", None, "x"]
    ids, counts = TokenIds(path).encode(pa.array(texts))
    want = [load_tokenizer(path).encode(x or "", add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
    with pytest.raises(ValueError):
        TokenCounter(path)


def test_slices_hold_all_rows():
    column = pa.array(["x" * n for n in (5, 0, 100, 3, 3, 3)] + [None])
    parts = slices(column, 20)
    assert [x for _, p in parts for x in p.to_pylist()] == column.to_pylist() and len(parts) > 2
    assert [first for first, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
    assert slices(column[:0]) == []


def test_token_counts(spark, folder, odd_docs, library):
    got = Counter(tuple(r) for r in op7_token_counts(spark, folder).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(_ids(library, r.text)), n > 2048) for r in odd_docs.collect())
    assert got == want


def test_a_clashing_name_is_refused(odd_docs):
    with pytest.raises(ValueError, match="n_tokens"):
        count_tokens(odd_docs, "text", vocabulary_path())


def test_checksums():
    assert [hex(x) for x in crc32c.crc32c([b"123456789", b"", bytes(32)])] == ["0xe3069283", "0x0", "0x8a9136aa"]
    rng = np.random.default_rng(0)
    whole = rng.bytes(5000)
    for n in (0, 1, 3, 251, 252, 253, 508, 4999):
        table, register = crc32c._tables()[0], 0xFFFFFFFF
        for b in whole[:n]:
            register = int(table[(register ^ b) & 0xFF]) ^ (register >> 8)
        assert int(crc32c.crc32c([b"x", whole[:n]])[1]) == register ^ 0xFFFFFFFF


def test_record_files(spark, folder, odd_docs, library):
    rows = op10_record_files(spark, folder).collect()
    want = Counter((r.doc_id, len(ids := [*_ids(library, r.text), 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_records_read_in_any_order_and_damage_is_found(spark, odd_docs, tmp_path):
    manifest = records.write_records(odd_docs, shared_path(spark, "test"), vocabulary_path(), 2, file_bytes=1000).collect()
    assert sum(r.records for r in manifest) == odd_docs.count()
    path = max(manifest, key=lambda r: r.records).path
    straight = [x for part in records.read_file(path) for x in part]
    order = list(range(len(straight)))[::-1]
    shuffled = list(records.read_shuffled(path, order))
    assert [(d, i.tolist()) for d, i in shuffled] == [(straight[k][0], straight[k][1].tolist()) for k in order]
    fs, at = records.filesystem(path)
    with fs.open_input_stream(at) as f:
        data = bytearray(f.read())
    data[20] ^= 1
    broken = str(tmp_path / "broken.rec")
    with open(broken, "wb") as f:
        f.write(data)
    with pytest.raises(ValueError):
        list(records.read_file(broken))


def _check_pieces(rows, want, window=2048):
    by, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc, pieces in by.items():
        pieces.sort(key=lambda r: r.start)
        joined = b"".join(bytes(r.ids) for r in pieces)
        assert joined == np.array(want[doc], "<u4").tobytes() and {r.doc_tokens for r in pieces} == {len(want[doc])}
        assert all(len(r.ids) == 4 * r.length for r in pieces)
    assert set(by) == set(want) and sorted(windows) == list(range(len(windows)))
    for k, pieces in windows.items():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at == window or k == len(windows) - 1


def test_packing(spark, odd_docs, library):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = {r.doc_id: [*_ids(library, r.text), 1] for r in docs.collect()}
    _check_pieces(packing.pack(docs).collect(), want)
    _check_pieces(packing.pack(docs, window=64, piece=16).collect(), want, 64)
    repeated = packing.pack(odd_docs)
    assert repeated.agg({"length": "sum"}).first()[0] == sum(len(_ids(library, r.text)) + 1 for r in odd_docs.collect())


def test_windows_keep_the_mixture(spark):
    docs = spark.createDataFrame([(k, "the river " * (30 + k % 40), "abc"[k % 10 // 4]) for k in range(600)], "doc_id long, text string, source string")
    for mixture in (None, {"a": 0.2, "b": 0.2, "c": 0.6}):
        rows = packing.pack(docs, keep=("doc_id", "source"), window=512, piece=16, mixture=mixture).collect()
        total, share, sent = Counter(), Counter(), Counter()
        for r in rows:
            total[r.source] += r.length
        weights = mixture or {s: n / sum(total.values()) for s, n in total.items()}
        first_dry = min(total[s] / weights[s] for s in total)
        for k in range(int(first_dry * sum(weights.values()) / 512) - 2):
            for r in rows:
                if r.sequence_id == k:
                    sent[r.source] += r.length
            for s, w in weights.items():  # what is sent up to a window follows the quanta, but for a piece and a round
                share[s] = (k + 1) * 512 * w
                assert abs(sent[s] - share[s]) <= 2 * max(16, 512 * w) + 16


def _round_robin(queues, quanta, piece):
    """The stream's pieces (doc_id, start, length), by rounds in which each queue sends while its deficit covers the piece at its head."""
    heads = {q: [(d, at, min(size, n - at)) for d, n in docs for size in [max(piece, int(quanta[q]))] for at in range(0, n, size)] for q, docs in queues.items()}
    deficit, out = dict.fromkeys(queues, 0.0), []
    while any(heads.values()):
        for q in sorted(queues):
            deficit[q] += quanta[q]
            while heads[q] and heads[q][0][2] <= deficit[q]:
                deficit[q] -= heads[q][0][2]
                out.append(heads[q].pop(0))
    return out


@pytest.mark.parametrize("mixture", [{"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 0.125, "b": 0.125, "c": 0.75}])
def test_order_is_that_of_a_simulated_round_robin(spark, library, monkeypatch, mixture):
    monkeypatch.setattr(packing, "_BLOCK_ROUNDS", 3)
    rng = random.Random(3)
    docs = [(k, "the river " * rng.randint(0, 90), "abc"[k * k % 7 % 3]) for k in range(60)]
    queues = {"abc"[j]: [(d, len(_ids(library, x)) + 1) for d, x, s in docs if s == "abc"[j]] for j in range(3)}
    want = _round_robin(queues, {s: 256 * w for s, w in mixture.items()}, 16)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    rows = sorted(packing.pack(frame, window=256, piece=16, mixture=mixture).collect(), key=lambda r: (r.sequence_id, r.offset))
    joined = []
    for r in rows:  # what a window's end cut is one piece again
        if joined and r.offset == 0 and joined[-1][0] == r.doc_id and joined[-1][1] + joined[-1][2] == r.start:
            joined[-1][2] += r.length
        else:
            joined.append([r.doc_id, r.start, r.length])
    flat = []
    for d, at, n in want:  # neighbours of one document that meet at a window's end look joined above
        if flat and flat[-1][0] == d and flat[-1][1] + flat[-1][2] == at and sum(x[2] for x in flat) % 256 == 0:
            flat[-1][2] += n
        else:
            flat.append([d, at, n])
    assert joined == flat


def test_shares_must_be_positive_and_powers_flatten_the_mixture(spark):
    docs = spark.createDataFrame([(k, "the river " * 40, "a" if k % 16 else "b") for k in range(400)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        packing.pack(docs, mixture={"a": 0.0})
    for power, share in ((1.0, 1 / 16), (0.5, 1 / (1 + 15**0.5))):
        rows = packing.pack(docs, keep=("source",), window=512, piece=16, power=power).where("sequence_id < 8").collect()
        got = sum(r.length for r in rows if r.source == "b") / (8 * 512)
        assert abs(got - share) < 0.03


def test_no_documents(spark, nothing):
    assert packing.op1_packed_pieces(spark, nothing).count() == 0
    assert op7_token_counts(spark, nothing).count() == 0
    assert op10_record_files(spark, nothing).count() == 0
