"""Row keys of the key-value tables, and surrogate identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "#"
FAMILY = "m"


def year_month(year: Column, month: Column) -> Column:
    """``YYYYMM``; NULL if either part is missing."""
    text = F.format_string("%04d%02d", year, month)
    return F.when(year.isNotNull() & month.isNotNull(), text)


def year_text(year: Column) -> Column:
    return F.when(year.isNotNull(), F.format_string("%04d", year))


def row_key(*parts: Column, required: Sequence[Column] = (), on_null: str = "collapse") -> Column:
    """Parts joined by ``#``.

    ``required`` parts make the key NULL when missing. For the others, ``collapse``
    leaves a missing part out (``Hail#202403``) and ``skip`` makes the key NULL.
    """
    if on_null not in ("collapse", "skip"):
        raise ValueError(f"on_null must be 'collapse' or 'skip', not {on_null!r}")
    needed = list(required) if on_null == "collapse" else list(parts)
    key = F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts])
    for part in needed:
        key = F.when(part.isNotNull(), key)
    return key


def key_parts(key: Column, limit: int = -1) -> Column:
    return F.split(key, SEPARATOR, limit)


def plain_cells(cells: Column) -> Column:
    """Cells of an exported row (``m:avg_dep_delay`` → bytes) as qualifier → text."""
    text = F.transform_values(cells, lambda _, v: v.cast("string"))
    return F.transform_keys(text, lambda k, _: F.regexp_replace(k.cast("string"), f"^{FAMILY}:", ""))


def load_id() -> Column:
    """Identifier unique within one load: no shuffle, and the same on a retried task. A month is
    written by one load only, so over several loads (year, month, identifier) is the key."""
    return F.monotonically_increasing_id()


def content_id(*cols: Column) -> Column:
    """Identifier that depends on the row's values only, whatever the file layout. Exact copies
    of a row share it, and with 64 bits a few of some billion different rows do as well; it
    marks content and is no key."""
    return F.xxhash64(*cols)
