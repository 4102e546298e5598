import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def make(spark):
    """Rows (dicts) as a DataFrame of the documents' columns and any extra ones."""

    def run(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        names = [c.split()[0] for c in schema.split(",")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return run


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
