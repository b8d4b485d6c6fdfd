import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    """Documents with further columns whose names clash with those of results."""

    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(*r, *("en", "src1")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame(
            [(*r, None if r[1] is None else len(r[1]), 1.5, True, 7, "x") for r in full],
            "doc_id long, text string, lang string, source string, n_chars long, "
            "score double, kept boolean, tokens long, text_hash string",
        )

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as Parquet and returns the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write

