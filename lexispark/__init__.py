"""Full-text search and indexing on Spark DataFrames."""

__version__ = "0.1.0"


def version() -> str:
    return __version__
