"""Helpers of the tests in this folder."""

import random


def prose(seed: int, n: int) -> list[str]:
    """Pseudo-random words, the same for the same seed."""
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def sql_rows(text: str, folder: str, tables: tuple[str, ...]) -> tuple[list[str], list[tuple]]:
    """Columns and rows of a DuckDB query over Parquet tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    result = con.execute(text)
    return [d[0] for d in result.description], result.fetchall()


def same_as_sql(df, text: str, folder: str, tables: tuple[str, ...]) -> list:
    """Asserts equal rows and returns those of Spark."""
    names, want = sql_rows(text, folder, tables)
    rows = df.select(*names).collect()
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    return rows
