import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with the awkward cases: nulls, empty and long texts, repeated rows, copies."""
    long_text = "\n".join(f"line number {i} of the long text holds some words that differ {i * 7919}" for i in range(3000))
    rows = [(i, f"alpha beta gamma delta {i} epsilon zeta eta theta iota kappa lambda mu {i * i}\n"
                f"a second line of document {i} with its own words {i * 31}", "en", f"s{i % 3}", 10) for i in range(20)]
    rows += [(20, None, "en", "s0", None), (21, "", None, "s1", 0), (None, "no id here but some words", "en", "s1", 1),
             (23, "no source here but words", "en", None, 1), (24, long_text, "en", "s2", 1),
             (25, rows[3][1], "en", "s0", 1), rows[4], rows[4], (26, "   \n\n  ", "en", "s1", 1),
             (27, "héllo wörld ça va 東京 🙂 " * 4, "fr", "s2", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with extra columns named like the operators' own."""
    names = ["size", "target", "shard", "kept", "ids", "key", "doc", "first", "kind", "h", "tokens", "sid", "line", "a",
             "repeat_id", "line_id", "line_th", "line_gone", "line_parts", "group_member", "unit"]
    return documents.selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(names)], "1 as `odd.name`")
