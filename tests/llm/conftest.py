import pytest

#: Empty, null, blank and long texts, ties, repeated rows and a column with a clashing name.
TEXTS = [
    "The quick brown fox jumps over the lazy dog again and again",
    "The quick brown fox jumps over the lazy dog again and again",
    None, "", " \t\n ", "one", "Ünïcode straße 12 ‘quotes’ don't <|endoftext|> é  x\x00y \x00 z",
    "a b c d", "#### $$$ %%%\nsame line\nsame line\n\n", "lorem ipsum dolor sit amet " * 3000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(k, t, "en" if k % 2 else None, "src0", k, -k) for k, t in enumerate(TEXTS)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
