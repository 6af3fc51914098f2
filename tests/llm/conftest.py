import pytest

WORDS = "the cat sat on a mat while rain fell over old grey hills and nobody knew why it had come so soon that year".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """n words of a fixed pseudo-random order, a sentence end every eight."""
    out, x = [], seed * 7919 + 1
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        word = WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 50)
        out.append(word + ("." if i % 8 == 7 else "") + ("\n" if i % 24 == 23 else ""))
    return " ".join(out)


def edge_texts() -> list:
    """Nulls, empties, white space, ties, a very long text, characters beyond Latin."""
    long = "word " * 60_000
    return [None, "", " \n\t ", "one", "one", prose(1, 80), prose(1, 80), prose(2, 300), "É à 中文 😀 é", "\x1c \x85   x", long, "a" * 50_000, "same line\n" * 40]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(edge_texts())]
    rows += [rows[5], (None, prose(3, 50), None, None, None), (None, None, None, None, None)]  # a repeated row, and nulls everywhere
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """Columns that share names with what operators make."""
    from pyspark.sql import functions as F

    names = ["fingerprint", "key", "side", "name", "line", "n", "score", "start", "dg_site", "dg_text", "digest", "kept_by", "low", "root", "row", "range", "dg_row", "dg_fp"]
    return edge_docs.select("*", *[F.lit("x").alias(c) for c in names])
