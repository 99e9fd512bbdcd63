import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, fp string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeats and clashing columns."""
    from couponflow.llm.tables import ship

    ship(spark)
    prose = " ".join(f"word{i % 97} thing{i % 31}" for i in range(120))
    texts = [
        None,
        "",
        " \n\t ",
        "one",
        "Two words",
        prose,
        prose,
        prose + " more",
        prose.upper() + "\n" + prose,
        "long " * 60_000 + "end",
        "été ÉTÉ straße 你好 мир 🙂\n" * 20,
        "same line\nsame line\nsame line\n" + prose,
        "password = hunter2222 " + prose,
        "x\x00y\x1cz " + prose,
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "a", "b", "c") for i, t in enumerate(texts)]
    rows += [(5, prose, None, None, None, None, None, None), (None, prose, "fr", None, 0, None, "b", None)]
    rows += [rows[6], rows[6]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    from couponflow.llm.tables import ship

    ship(spark)
    return spark.createDataFrame([], DOCS)
