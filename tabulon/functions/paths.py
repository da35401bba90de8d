"""Paths and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by extension.
MIMES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff"}


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative_key(path: Column, pattern: str = r"(\d+/\d+/\d+/[^/]+\.jpg)$") -> Column:
    """The key at a path's end; null if there is none."""
    return F.nullif(F.regexp_extract(slashes(path), pattern, 1), F.lit(""))


def remapped(path: Column, prefix: str, inner: str, target: str) -> Column:
    """(key, image_path) of a path below `prefix` and then `inner`; null if it lies elsewhere or climbs up."""
    text = slashes(path)
    tail = text.substr(F.lit(len(prefix) + 1), F.length(text))
    ok = text.startswith(prefix) & ~F.array_contains(F.split(tail, "/"), "..") & tail.startswith(inner)
    return F.when(ok, F.struct(tail.substr(F.lit(len(inner) + 1), F.length(tail)).alias("relative_key"), F.concat(F.lit(target), tail).alias("image_path")))


def without_parents(path: Column) -> Column:
    return F.regexp_replace(slashes(path), r"^(\.\./)+", "")


def folded(path: Column) -> Column:
    return F.lower(path)


def mime(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("image/jpeg"))


def label_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.jpg$", ".txt")


def level(path: Column, k: int) -> Column:
    """The k-th level of a path, from 0; null where there is none."""
    return F.get(F.split(slashes(path), "/"), F.lit(k))


def json_in(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
