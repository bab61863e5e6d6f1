"""Writing tables in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .readers import EXTENSIONS, extension_of


def output_path(source: str, requested: str | None = None) -> str:
    """The requested path, or ``<stem>_imputed<ext>`` next to the source; unknown extensions become csv."""
    path = requested or source
    ext = extension_of(path)
    if requested:
        return path if ext in EXTENSIONS else (path[: -len(ext)] if ext else path) + ".csv"
    stem = path[: -len(ext)] if ext else path
    return f"{stem}_imputed{ext if ext in EXTENSIONS else '.csv'}"


def write_output(df: DataFrame, source: str, requested: str | None = None) -> str:
    """Write csv, parquet or json by extension, as a folder of part files."""
    path = output_path(source, requested)
    writer = df.write.mode("overwrite")
    form = EXTENSIONS[extension_of(path)]
    if form == "csv":
        writer.option("header", "true").csv(path)
    elif form == "json":
        writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    else:
        writer.parquet(path)
    return path
