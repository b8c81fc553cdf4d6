import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from newsweave.session import build_session

    return build_session("*", shuffle_partitions=4, app="newsweave-tests")


ODD_TEXTS = [None, "", " ", "\t\n", "a", "A a a", "x " * 5000, "word" * 3000, "l'été ÀÉ. it's <|endoftext|> 漢字 😀",
             "a\x1cb \x85c \x00 d", "same text here", "same text here"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra
    columns named like internal ones."""
    rows = [(i if i != 3 else None, t, None if i % 3 else "en", None if i % 4 else "src0", i, "z")
            for i, t in enumerate(ODD_TEXTS)] + [(4, "a", "en", "src0", 4, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids int, start string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
