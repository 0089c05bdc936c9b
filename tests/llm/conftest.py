import pytest

#: Texts that every operator must take: null, empty, blank, one word, ties and repeats, very long, odd characters.
WORDS = "the of and to in river stone seven lamps bright morning walked quietly toward old house garden under"
ODD = [
    None, "", " \n\t ", "one", "One two", "one two three four five", "ONE two three four five", "a" * 5000, "é ñ 汉字 \U0001f600 <|endoftext|> x<|startoftext|>y",
    "tab\tand\x0bvertical\x0cfeed\r\n", "don't we'll THEY'RE 3.14 2024-01-01 !!! ???", " ".join(WORDS.split() * 3), " ".join(f"word{k % 977}" for k in range(30000)),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, each twice (the second time with another id), a row repeated whole, a null id, null lang and source, and columns with names that results have."""
    rows = [(2 * k + j, x, ["en", "fr", None][k % 3], ["a", None, "b"][(k + j) % 3]) for k, x in enumerate(ODD) for j in range(2)]
    rows += [rows[9], (None, "one two three four five", "en", "a"), (None, None, None, None)]
    rows = [(*r, len(r[1] or ""), "x", 1, True, 0.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, n_tokens long, kept boolean, shard double")


@pytest.fixture
def folder(tmp_path, odd_docs):
    """sf_dir with the odd documents as its table."""
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture
def nothing(tmp_path, odd_docs, spark):
    """sf_dir with empty tables."""
    odd_docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)
