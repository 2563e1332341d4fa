import glob
import re

import pyarrow.parquet as pq
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(folder, name):
    return [r for f in sorted(glob.glob(f"{folder}/{name}.parquet")) for r in pq.read_table(f).to_pylist()]


def plain_words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def documents(tiny):
    return rows(tiny, "documents")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with a clashing column and an extra one, from texts or (id, text) pairs."""

    def make(texts):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        data = [(i, t, "en", "s", None, "x", 1) for i, t in pairs]
        return spark.createDataFrame(
            data,
            "doc_id bigint, text string, lang string, source string, n_chars bigint,"
            " fp string, component int",
        )

    return make
