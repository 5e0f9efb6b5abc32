import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and blank texts, a very long one, copies, repeated rows, other scripts, clashing names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    base = " ".join(words)
    long_ = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    line = "The quick brown fox jumps over the lazy dog near the river bank"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.upper() + " more", "en", "b"), (4, None, "en", "b"), (5, "", None, None), (6, "  \n\t ", "fr", None),
        (7, long_, "de", "c"), (8, f"x\n{line}\ny", "en", "a"), (9, f"  {line.lower()}  ", "en", "a"), (10, line, "en", "b"), (11, f"{line}\n{line}", "en", "c"), (12, f"{line}\nz", "en", "a"),
        (13, "Ünïcödé ÉTÉ 東京 \U0001f600 words", None, "d"), (None, base, "en", "a"), (None, None, None, None), (14, "mit license and MIT  License!", "en", "a"), (15, "one", "en", "é"), (16, " ".join(words[3:]) + " " + base, "en", "a"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    for c in ("id", "h", "fp", "n", "key", "size_", "component", "items", "words", "kept"):
        df = df.selectExpr("*", f"cast(null as string) as {c}")
    return df


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
