import public_tokenizers
import pytest

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(20_000))
TEXTS = [
    (1, "Hello  world's end.\nHello  world's end.\n\n A b c d e f g h i j k"), (2, None), (3, ""), (4, " \t\n "),
    (5, LONG), (6, "Hello world's end. Hello world's end. A b c d e f g h i j k"), (7, "a b c d e " * 30),
    (None, "No id here, but ten words are in this one sentence."), (8, "twice"), (8, "twice"), (8, "another text of id eight"),
    (9, "Σίσυφος 日本語 😀 İstanbul <|endoftext|> éè ½ x²"), (10, "x" * 5000), (11, "twice"), (-5, "minus five"),
    (12, "Released under the MIT License."), (None, None), (2**40, "far  id")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, _id int, key string"


def frame(spark, rows, columns=COLUMNS):
    names = [c.split()[0] for c in columns.split(", ")]
    full = [(*r, *[None] * (len(names) - len(r))) for r in rows]
    return spark.createDataFrame(full, columns)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long and repeated texts, ties, and columns whose names clash with inner ones."""
    return frame(spark, [(i, t, "en", f"src{n % 3}", 7, "r", 0.5, 1, "k") for n, (i, t) in enumerate(TEXTS)]).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
