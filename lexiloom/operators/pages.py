"""Page metadata: attributes, filters, sorting, paging, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import encode_cursor

MAX_PAGE, DEFAULT_PAGE = 500, 200
SYSTEM_COLUMNS = {"path": "path", "title": "title", "size": "size", "modified": "last_modified", "last_modified": "last_modified", "last_indexed": "last_indexed"}


def page_attrs(pages: DataFrame) -> DataFrame:
    """(path, key, value) of the JSON ``frontmatter``: scalars a row, arrays a row per element, objects and nulls none."""
    fields = pages.select("path", F.explode(F.from_json("frontmatter", "map<string,variant>")).alias("key", "v"))
    fields = fields.where(~F.col("key").isin("__proto__", "constructor", "prototype"))
    kind = F.schema_of_variant("v")
    each = F.when(kind.startswith("ARRAY"), F.from_json(F.to_json("v"), "array<string>")).when(~kind.startswith("OBJECT") & (kind != "VOID"), F.array(F.col("v").cast("string")))
    return fields.select("path", "key", F.explode(each).alias("value")).where("value is not null")


def with_attrs(pages: DataFrame, attrs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Pages that have every wanted (key, value): a semi join per key."""
    for key, value in wanted.items():
        pages = pages.join(attrs.where((F.col("key") == key) & (F.col("value") == value)), "path", "left_semi")
    return pages


def containing(pages: DataFrame, text: str) -> DataFrame:
    """Pages whose title or path contains ``text`` in any case; ``%`` and ``_`` in it are wildcards."""
    pattern = f"%{text.lower()}%"
    return pages.where(F.lower("title").like(pattern) | F.lower("path").like(pattern))


def sort_key(pages: DataFrame, attrs: DataFrame, sort: str) -> tuple[DataFrame, list[Column]]:
    """Pages and the order for a sort like ``-modified`` or ``owner``: a column of pages, else the smallest value of that attribute."""
    name, down = sort.removeprefix("-"), sort.startswith("-")
    if name in SYSTEM_COLUMNS:
        key = SYSTEM_COLUMNS[name]
    else:
        key = "_sort"
        pages = pages.join(attrs.where(F.col("key") == name).groupBy("path").agg(F.min("value").alias(key)), "path", "left")
    return pages, [F.desc_nulls_last(key) if down else F.asc_nulls_first(key), F.col("path")]


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def list_pages(pages: DataFrame, attrs: DataFrame, wanted: dict[str, str] | None = None, q: str | None = None, sort: str = "path", limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """One page of the filtered, sorted list."""
    rows = with_attrs(pages, attrs, wanted or {})
    rows = containing(rows, q) if q else rows
    rows, order = sort_key(rows, attrs, sort)
    return rows.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, 1, MAX_PAGE)).select(*pages.columns)


def next_cursor(total: Column, offset: int, limit: int) -> Column:
    """Cursor of the next page, null at the end."""
    return F.when(total > offset + limit, encode_cursor(F.lit(offset + limit)))


def parse_filters(params: dict[str, str]) -> dict[str, str]:
    """``filter[key]=value`` parameters."""
    return {k[7:-1]: v for k, v in params.items() if k.startswith("filter[") and k.endswith("]") and len(k) > 8}


def parse_int(raw: str | None, default: int, low: int, high: int) -> int:
    if raw is None or not raw.strip():
        return default
    try:
        return clamp(int(float(raw)), low, high)
    except (ValueError, OverflowError):
        raise ValueError(f"not a number: {raw}") from None


def status(manifest: DataFrame) -> DataFrame:
    """(pages, chunks, last_indexed)."""
    return manifest.agg(F.count("*").alias("pages"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.max("last_indexed").alias("last_indexed"))


def chunk_facts(chunks: DataFrame) -> DataFrame:
    """(path, chunks, with_headings)."""
    return chunks.groupBy("path").agg(F.count("*").alias("chunks"), F.count_if(F.size("heading_path") > 0).alias("with_headings"))
