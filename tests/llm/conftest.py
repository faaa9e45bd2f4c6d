import pytest


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def add(df):
        names = ("cls", "n", "h", "fp", "keys", "key", "part", "split_", "rest", "total", "full", "pid", "known", "p", "x", "rank", "local", "n_tokens", "hashes", "side", "kind", "score", "w", "a", "b", "e", "t", "count", "value")
        return df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})

    return add
