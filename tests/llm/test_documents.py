"""Near-duplicates, decontamination and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination, near_dup, packing, secrets
from tessera.llm.components import components
from tessera.llm.shingles import distinct_shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def _find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _components(texts: dict, width=4, percent=80) -> dict:
    sets = {k: _set(x, width) for k, x in texts.items()}
    parent, ids = {k: k for k in sets}, sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * (both := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = _find(parent, a), _find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {k: _find(parent, k) for k in sets}


def _families(seed=3, n=60):
    """Texts with copies that differ in a few words, chains of such copies, and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage, out = rng.choices(vocabulary, k=60), []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120, 300]))
        if k % 4 == 0:
            words += passage
        out.append(words)
        for _ in range(rng.choice([0, 0, 1, 4])):
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice([30, 60, 100]))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(words)
    rng.shuffle(out)
    return {k: " ".join(x) for k, x in enumerate(out)}


def _got(spark, texts, **more):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r for r in near_dup.near_duplicates(docs, **more).collect()}


def _sections(seed=8, n=40):
    """Texts that share most of a form, some of them linked and some not, in buckets with many components."""
    rng = random.Random(seed)
    form = [f"f{k}" for k in range(60)]
    return {k: " ".join(form + [f"own{k}x{j}" for j in range(rng.choice([4, 8, 12, 16, 20, 30]))]) for k in range(n)}


@pytest.mark.parametrize("small", [False, True])
def test_components_of_near_copies(spark, monkeypatch, small):
    if small:  # many blocks and copies of pivots, and no further stars, or many
        monkeypatch.setattr(near_dup, "_BLOCK_DOCS", 4)
        monkeypatch.setattr(near_dup, "_STAR_BITS", 1)
    for texts, pairs in ((_families(), 64), (_sections(), 1 << 40), (_sections(), 0)) if small else ((_families(), 64),):
        monkeypatch.setattr(near_dup, "_STAR_PAIRS", pairs)
        want, got = _components(texts), _got(spark, texts)
        assert {k: r.component_id for k, r in got.items()} == want
        assert all(r.n_shingles == len(_set(texts[k], 4)) and r.kept == (k == r.component_id) for k, r in got.items())


def test_work_on_near_copies_of_one_text_grows_in_proportion(spark, monkeypatch):
    """What is written on the way, by table and number of copies; a few documents beside them share their buckets."""
    written, whole = {}, near_dup.stored

    def counted(df, name):
        out = whole(df, name)
        written[n][name] = written[n].get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dup, "stored", counted)
    monkeypatch.setattr(near_dup, "_BLOCK_DOCS", 32)
    monkeypatch.setattr(near_dup, "_STAR_BITS", 4)
    base, rng = [f"w{k}" for k in range(200)], random.Random(6)
    for n in (300, 600):
        written[n], texts = {}, {}
        for k in range(n):
            words = list(base)
            words[rng.randrange(200)] = f"changed{k}"
            texts[k] = " ".join(words if k % 60 or k >= 300 else words[:150] + [f"else{k}x{j}" for j in range(60)])
        assert all(r.component_id == (1 if k % 60 or k >= 300 else k) for k, r in _got(spark, texts).items())
    for name in ("stars", "links", "candidates", "mixed"):
        assert written[600].get(name, 0) < 2.6 * (written[300].get(name, 0) + 32), (name, written)
    assert written[600]["links"] < 2 * 600


def test_texts_come_from_the_files_that_hold_them(spark):
    rows = [(k, f"text {k} " * (k % 7) or None) for k in range(3000)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 400)
    try:
        signed = near_dup.stored(near_dup.signatures(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", "text", 4), "signatures")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    wanted = signed.where("doc % 11 = 3").select(F.lit(7).alias("x"), "row", "doc")
    got = near_dup.Texts(signed).of(wanted.unionByName(wanted.where("doc < 500")))
    assert got.columns == ["x", "row", "doc", "text"]
    assert Counter((r.doc, r.text) for r in got.collect()) == Counter(r for r in rows for _ in range(1 + (r[0] < 500)) if r[0] % 11 == 3)


def test_sql_gives_the_components(spark, tmp_path):
    import duckdb

    texts = _families(n=30) | {1000: None, 1001: "", 1002: " one ", 1003: "ONE", 1004: "a b\x0bc"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(near_dup.OP4_SQL).fetchall()) == sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.op4_near_duplicates(spark, str(tmp_path)).collect())


def test_near_duplicates_of_odd_documents(spark, odd_docs):
    rows, all_docs = near_dup.near_duplicates(odd_docs).collect(), odd_docs.collect()
    want = _components({k: r.text for k, r in enumerate(all_docs)})
    ids = {}
    for k, head in want.items():
        ids.setdefault(head, []).append(all_docs[k].doc_id)
    least = {head: min((x for x in v if x is not None), default=None) for head, v in ids.items()}
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter((all_docs[k].doc_id, least[h], all_docs[k].doc_id == least[h]) for k, h in want.items())


def test_one_row_of_each_component_stays(spark, odd_docs):
    near = "the small boat sailed past nine quiet islands on its long way home that day".split()
    rows = [(1, " ".join(near)), (2, " ".join([*near, "again"])), (2, "a text of its own that nobody else has"), (3, "two rows of one id"), (3, "but with other texts altogether"), (3, "two rows of one id"), (None, " ".join(near)), (None, "alone without an id"), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, c0 int, `a.b` string")
    kept = near_dup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = sorted(r.c0 for r in kept.collect())
    assert got[0] == 0 and [x for x in got if x not in (3, 5)] == [0, 2, 4, 7, 8, 9, 10] and len(got) == 8
    assert near_dup.without_near_duplicates(odd_docs.limit(0)).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(5)
    starts, values = np.array([0, 4000, 8000]), rng.integers(0, 1 << 63, 8000, dtype=np.uint64)
    for shared in (0, 1000, 2000, 3000, 4000):
        values[4000 : 4000 + shared] = values[:shared]
        bits = near_dup.packed(near_dup.minima(starts, values))
        assert abs(near_dup.estimates(bits[0], bits[1:])[0] - shared / (8000 - shared)) < 0.15
    assert near_dup.minima(starts, values, chunk=100).tolist() == near_dup.minima(starts, values).tolist()


def test_shingles_are_sets_of_lowered_words():
    texts = [None, "", "A b C", "a b c", "a b c d a b c d a", "a\x0bb\x0cc\td", "a b c d", "  a b c d ", "a\xa0b c d e"]
    starts, values = distinct_shingles(pa.array(texts), 4)
    got = [frozenset(values[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    want = [frozenset(_set(x, 4)) for x in texts]
    assert [[x == y for y in got] for x in got] == [[x == y for y in want] for x in want] and list(map(len, got)) == list(map(len, want))


def test_connected_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 150), (300, 150), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150, 300: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


QUESTION = "If Alice buys 12 apples for 3 dollars each and sells 5 of them to Bob, how many apples does Alice have left in the basket"
ITEMS = [(1, QUESTION), (2, "the longest river of the old country runs quietly past seven small villages before it meets the sea"), (3, "too short"), (4, None), (None, "which of these gentle animals sleeps through every cold winter under the frozen northern ground")]
CASES = {
    1: ("x " * 500 + QUESTION + " y" * 500, {1: 0}),
    2: ("once again if Maria buys 15 apples for 4 euros each and sells 9 of them to Pedro, how many apples does Maria have left in the basket today", {1: 7}),
    3: ("the longest river of the old country runs quietly past seven small villages before it meets the sea", {2: 0}),
    4: ("the longest river runs past seven villages and it meets the sea before long", {}),
    5: ("too short", {3: 0}),
    10: ("this text is not too short, but holds these two words", {}),
    6: ("", {}),
    7: (None, {}),
    8: (ITEMS[4][1].upper() + "\n" + ITEMS[1][1], {2: 0, None: 0}),
    9: (ITEMS[4][1], {None: 0}),
}


def test_leaks(spark, nothing):
    docs = spark.createDataFrame([(k, x, 1) for k, (x, _) in CASES.items()], "doc_id int, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontamination.find_leaks(docs, items).collect()
    got = {k: {r.item_id: r.n_changed for r in rows if r.doc_id == k} for k in CASES}
    assert got == {k: x for k, (_, x) in CASES.items()}
    assert all(r.n_windows <= r.item_windows for r in rows)
    kept = decontamination.without_leaks(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, (_, x) in CASES.items() if not x}
    assert decontamination.op3_benchmark_leaks(spark, nothing).count() == 0


def test_benchmark_is_taken_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, x) for k, (x, _) in CASES.items()], "doc_id int, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = Counter(decontamination.find_leaks(docs, items).collect())
    monkeypatch.setattr(decontamination, "_BLOCK_WORDS", 20)
    assert len(list(decontamination.benchmark_tables(items))) > 2
    assert Counter(decontamination.find_leaks(docs, items).collect()) == whole
    assert decontamination.without_leaks(docs, items).count() == sum(not x for _, x in CASES.values())


def test_inconsistent_slots_break_windows():
    known = decontamination.BenchmarkTable([QUESTION])
    same = known.found(pa.array([QUESTION.replace("Alice", "Maria")]))[0][2]
    broken = known.found(pa.array([QUESTION.replace("Alice", "Maria", 1)]))[0][2]
    assert broken[0] < same[0] and same[2] == 2


def _found(item, text):
    return [x[2] for x in decontamination.BenchmarkTable([item]).found(pa.array(["some words before it " + text + " and some after"]))]


def test_a_word_put_in_or_left_out_does_not_hide_a_copy():
    item = "which of these gentle animals sleeps through every cold winter under the frozen northern ground while its small young wait quietly for spring"
    words = item.split()
    for k in range(4, len(words) - 4):
        assert _found(item, " ".join([*words[:k], "surely", *words[k:]])) and _found(item, " ".join([*words[:k], *words[k + 1 :]]))
    priced = "the old trader sells apples at 3 dollars for each small basket near the harbour"
    assert _found(priced, priced.replace("3 dollars", "$3")) and _found(priced.replace("3 dollars", "$3"), priced.replace("3", "5"))
    assert not _found(item, " ".join(words[12:] + words[:8]))


def test_items_of_numbers_and_names_are_found_as_they_are():
    for item in ("What is 37 + 48 - 19 * 6 / 2", "convert 12 km 5 m to miles"):
        assert _found(item, item) and not _found(item, item.replace("2", "9"))


def test_short_items_are_found_as_they_are():
    for item in ("12 + 7 = 19", "Compute 3 + 5 * 9 - 2 now", "a = b", "x -> y"):
        assert _found(item, item) and not _found(item, item.replace("7", "8").replace("5", "6").replace("b", "c").replace("y", "z"))
    assert _found("12 + 7 = 19", "12 + 7 = 19.") and not _found("12 + 7 = 19", "12 - 7 = 19")
    assert not _found("two words", "two words") and decontamination.BenchmarkTable(["two words"]).found(pa.array(["Two words."]))


def _slow_match(item, text):
    """Whether the item is in the text, by brute force over pairs of windows and shifts, without slips: its template, or its words."""
    for one, all_of in zip(decontamination.canonical(pa.array([item]))[:2], decontamination.canonical(pa.array([text]))[:2]):
        width = min(len(one.token), decontamination.WINDOW)
        if width < decontamination.LEAST_TOKENS:
            continue
        windows, seen = {}, set()
        for j in range(len(one.token) - width + 1):
            key = tuple(one.token[j : j + width].tolist())
            if key not in seen and sum(one.kind[j : j + width] == 0) >= min(decontamination.LITERALS, width):
                seen.add(key)
                windows[j] = key
        for shift in range(-len(one.token), len(all_of.token)):
            chain = [j for j, key in windows.items() if 0 <= j + shift and tuple(all_of.token[j + shift : j + shift + width].tolist()) == key]
            slots = sorted({j + k for j in chain for k in range(width) if one.kind[j + k] != 0})
            pairs = Counter((int(one.kind[j]), int(one.value[j]), int(all_of.value[j + shift])) for j in slots)
            forth, back = {}, {}
            for (of, a, b), _ in pairs.most_common():
                forth.setdefault((of, a), b)
                back.setdefault((of, b), a)
            bad = {j for j in slots if forth[int(one.kind[j]), int(one.value[j])] != int(all_of.value[j + shift]) or back[int(one.kind[j]), int(all_of.value[j + shift])] != int(one.value[j])}
            sound = [j for j in chain if not bad & set(range(j, j + width))]
            if sound and (2 * len(sound) >= len(windows) or len({j + k for j in sound for k in range(width)}) >= decontamination.LONG_RUN):
                return True
    return False


def test_matches_equal_brute_force():
    rng = random.Random(12)
    words = "tin can Alice Bob 3 7 12 apples km dollars sold to the red house and then".split()
    items = [" ".join(rng.choices(words, k=rng.randint(5, 30))) for _ in range(40)]
    texts = []
    for k in range(60):
        item = rng.choice(items).split()
        a, b = sorted(rng.sample(range(len(item) + 1), 2)) if k % 2 else (k % 3, len(item) - k % 2)
        texts.append(" ".join([*rng.choices(words, k=10), *item[a:b], *rng.choices(words, k=10)]))
    found = {(k, i) for k, i, _ in decontamination.BenchmarkTable(items).found(pa.array(texts))}
    slow = {(k, i) for k, x in enumerate(texts) for i, item in enumerate(items) if _slow_match(item, x)}
    assert slow <= found and len(slow) > 20
    straight = {at for at in found - slow}  # what slips add
    assert len(straight) < len(found) / 2


def test_repetitive_texts_and_repeated_items_cost_little(spark):
    import time

    phrase = "on and on and on it goes again and "
    table = decontamination.BenchmarkTable([phrase * k for k in range(2, 22)])
    began = time.perf_counter()
    assert len(table.found(pa.array([phrase * 30000]))) == 20
    assert time.perf_counter() - began < 30
    items = spark.createDataFrame([(k, QUESTION) for k in range(500)], "item_id long, text string")
    assert [len(x.texts) for x in decontamination.benchmark_tables(items)] == [1]
    assert decontamination.find_leaks(spark.createDataFrame([(1, QUESTION)], "doc_id int, text string"), items).count() == 500


def test_copies_in_another_case_or_with_other_lines_are_found():
    item = "the capital of France lies on the Seine and was home to Victor Hugo"
    for text in (item, item.lower(), item.upper(), item.title(), item.replace(" France", "\nFrance").replace(" Victor", "\nVictor")):
        assert _found(item, text)
    assert not _found(item, "the capital of a land lies on a river and was home to many poets")


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    common = "the of and to in a is that it was for on are with as his they at be this from have or by one had not but what all were when we there can".split()
    rows = []
    for k in range(120):
        words = [rng.choice(common) if rng.random() < 0.6 else "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(rng.randint(60, 200))]
        rows.append([k, " ".join(words) + ".", "en", f"s{k % 3}", 7])
    rows[50][1] = rows[10][1]
    rows[51][1] = rows[11][1] + " extra"
    rows[60][1] = rows[60][1] + " " + ITEMS[1][1] + "."
    rows[61][1] = 'token = "q8Zr2LxW0vTn5KcJ7yHd1GsE" ' + rows[61][1]
    rows[70][1] = "few words only"
    rows[71][1], rows[72][1] = None, "again and again it goes on " * 40
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = [{70, 71, 72}, {50, 51}, {60}, set(), set()]
    state, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), set(range(120))
    for (name, stage), lost in zip(corpus_pipeline.STAGES, gone):
        state = stage(spark, state, str(tmp_path))
        left -= lost
        assert {r.doc_id for r in state.select("doc_id").distinct().collect()} == left, name
        if name != "packing":
            assert state.columns == docs.columns
        if name == "secret_redaction":
            redacted = {r.doc_id: r for r in state.collect()}
            assert redacted[61].text.startswith('[secret]" ') and redacted[61].n_chars == len(redacted[61].text)
            assert redacted[5].text == rows[5][1] and not any(secrets.base_spans(r.text) for r in redacted.values())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left
    assert out.agg({"length": "sum"}).first()[0] == state.agg({"length": "sum"}).first()[0]


def test_pipeline_takes_odd_and_empty_tables(spark, odd_docs, nothing):
    wide = odd_docs.drop("spans", "n_tokens", "kept", "shard")
    clashing = odd_docs.withColumns({x: F.lit(1) for x in ("_doc", "_n", "_text", "_row", "a.b", "doc", "item_id")})
    for docs in (clashing, wide.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, nothing)
        docs.count()
    one = corpus_pipeline.near_duplicate_removal(spark, clashing, nothing)
    assert one.columns == clashing.columns and one.where("doc_id = 9").count() + one.where("doc_id = 8").count() == 1


def test_packing_is_the_last_stage():
    assert corpus_pipeline.STAGES[-1][1].__name__ == "packing" and packing.pack is corpus_pipeline.pack
