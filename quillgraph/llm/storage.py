"""Names and tables that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize, new_path, remove, shared_dir

__all__ = ["free_name", "materialize", "new_path", "put_back", "remove", "set_aside", "shared_dir"]


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def set_aside(docs: DataFrame, working: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without columns called like an operator's ``working`` ones (in any case): these get other names; {new name: own name}."""
    names = {c: free_name(f"in_{c.lower()}", [*docs.columns, *working]) for c in docs.columns if c.lower() in working}
    return (docs.withColumnsRenamed(names) if names else docs), {new: c for c, new in names.items()}


def put_back(out: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns that were set aside, under their own names again."""
    return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns]) if names else out
