"""Filters over the library, as Columns that reach the scan."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def added_at() -> Column:
    """When a file was added: found, else organised, else indexed, else changed."""
    return F.coalesce("discovered_at", "organized_at", "indexed_at", "mtime")


@dataclass(frozen=True)
class FileFilter:
    """Conditions that must all hold; those left out don't count."""

    name: str | None = None
    extensions: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    folder_terms: tuple[str, ...] = ()
    directory: bool | None = None
    modified: tuple[datetime | None, datetime | None] = (None, None)
    added: tuple[datetime | None, datetime | None] = (None, None)
    organized: tuple[datetime | None, datetime | None] = (None, None)
    size: tuple[int | None, int | None] = (None, None)
    has_note: bool | None = None
    indexed: bool | None = None

    def given(self) -> bool:
        return self != FileFilter()

    def column(self) -> Column:
        out: list[Column] = []
        if self.name is not None:
            out.append(F.lower("name") == self.name.lower())
        if self.extensions:
            out.append(F.lower("ext").isin(*(e.lower().lstrip(".") for e in self.extensions)))
        if self.categories:
            out.append(F.col("category").isin(*self.categories))
        place = F.lower(F.concat_ws("\n", "source_dir", "path", F.coalesce("organization_subfolder", F.lit(""))))
        out += [F.contains(place, F.lit(t.lower())) for t in self.folder_terms]
        if self.directory is not None:
            out.append(F.col("is_directory") == self.directory)
        for column, (start, end) in ((F.col("mtime"), self.modified), (added_at(), self.added), (F.col("organized_at"), self.organized)):
            out += [column >= F.lit(start)] * (start is not None) + [column < F.lit(end)] * (end is not None)
        low, high = size_bounds(*self.size)
        out += [F.col("size") >= low] * (low is not None) + [F.col("size") <= high] * (high is not None)
        if self.has_note is not None:
            noted = F.trim(F.coalesce("note", F.lit(""))) != ""
            out.append(noted if self.has_note else ~noted)
        if self.indexed is not None:
            out.append(F.col("indexed_at").isNotNull() if self.indexed else F.col("indexed_at").isNull())
        return functools.reduce(Column.__and__, out, F.lit(True))


def size_bounds(low: int | None, high: int | None) -> tuple[int | None, int | None]:
    """Neither below zero, the smaller first."""
    low, high = (max(0, x) if x is not None else None for x in (low, high))
    return (high, low) if low is not None and high is not None and low > high else (low, high)


def newest(files: DataFrame, limit: int, most: int = 2000) -> DataFrame:
    """At most limit files, clamped to 1..most, last added first."""
    return files.orderBy(added_at().desc(), F.lower("name"), "id").limit(max(1, min(most, limit)))


def under(path: Column, root: str) -> Column:
    """At the root or below it, letter case aside."""
    low = root.rstrip("/").lower()
    return (F.lower(path) == low) | F.startswith(F.lower(path), F.lit(low + "/"))


def any_contains(columns: tuple[str, ...], words: tuple[str, ...]) -> Column:
    """Whether any word occurs in any column, as it stands."""
    hits = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w.lower())) for c in columns for w in words]
    return functools.reduce(Column.__or__, hits, F.lit(False))


#: Names of files that are still being written or belong to the system.
TRANSIENT_SUFFIXES = ("tmp", "temp", "part", "partial", "crdownload", "download", "swp", "lock")
SYSTEM_NAMES = (".ds_store", "thumbs.db", "desktop.ini", ".localized")


def transient(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike(f"\\.({'|'.join(TRANSIENT_SUFFIXES)})$") | low.rlike("^(~\\$|\\.~|\\.#)") | low.isin(*SYSTEM_NAMES)


def exclusion_reason(name: Column, ext: Column, directory: Column, enabled: tuple[str, ...]) -> Column:
    """transient, hidden, unsupported, or null for what is watched."""
    return (
        F.when(transient(name), "transient")
        .when(F.startswith(name, F.lit(".")), "hidden")
        .when(~directory & ~F.coalesce(F.lower(ext), F.lit("")).isin(*enabled), "unsupported")
    )


def audit_candidates(files: DataFrame, after: int, extensions: tuple[str, ...], limit: int = 256) -> DataFrame:
    """Indexed and hashed directories or files of these kinds, those after the cursor first."""
    fit = files.where("indexed_at IS NOT NULL AND content_hash IS NOT NULL").where(F.col("is_directory") | F.col("ext").isin(*extensions))
    return fit.orderBy(F.when(F.col("id") > after, 0).otherwise(1), "id").limit(limit)


def within_budget(rows: DataFrame, order: list, size: str, most: int) -> DataFrame:
    """The first rows whose sizes together fit; the first always does. For lists already bounded by a limit."""
    from pyspark.sql.window import Window

    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"_sum": F.sum(size).over(running), "_n": F.count("*").over(running)}).where((F.col("_sum") <= most) | (F.col("_n") == 1)).drop("_sum", "_n")


def date_range(column: Column, start: str | None, end: str | None) -> Column:
    """Whole days from the earlier to the later of two dates, both inside; an open end is null."""
    if start and end and start > end:
        start, end = end, start
    out = F.lit(True)
    if start:
        out = out & (column >= F.lit(start).cast("date").cast("timestamp"))
    if end:
        out = out & (column < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return out


@dataclass(frozen=True)
class ReleaseFilter:
    platform: str
    channel: str
    architecture: str
    compatible: tuple[str, ...] = field(default=("universal",))

    def column(self) -> Column:
        return (F.col("platform") == self.platform) & (F.col("channel") == self.channel) & F.col("architecture").isin(self.architecture, *self.compatible)


def release_errors() -> Column:
    """What is wrong with a release record."""
    checks = {
        "version is missing": F.trim(F.coalesce("version", F.lit(""))) == "",
        "architecture is unknown": ~F.coalesce("architecture", F.lit("")).isin("arm64", "x86_64", "universal"),
        "address is not https": ~F.coalesce("url", F.lit("")).rlike("^https://[^/\\s]+"),
        "digest is not 64 hex digits": ~F.coalesce("sha256", F.lit("")).rlike("^[0-9a-fA-F]{64}$"),
    }
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for text, bad in checks.items())))
