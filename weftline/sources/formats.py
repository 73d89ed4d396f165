"""What a file is, by name, scheme and first bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions by kind.
KINDS = {
    "jpeg": ("jpg", "jpeg"),
    "png": ("png",),
    "webp": ("webp",),
    "bmp": ("bmp",),
    "tiff": ("tif", "tiff"),
    "mp4": ("mp4",),
    "avi": ("avi",),
    "mkv": ("mkv",),
    "mov": ("mov",),
    "csv": ("csv",),
    "parquet": ("parquet",),
    "tar": ("tar",),
}
IMAGES = ("jpeg", "png", "webp", "bmp", "tiff")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)


def by_extension(path: Column) -> Column:
    out = F.lit("unknown")
    for kind, exts in reversed(KINDS.items()):
        out = F.when(extension(path).isin(*exts), kind).otherwise(out)
    return out


def by_scheme(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.startswith("http://") | low.startswith("https://"), "http").when(low.startswith("s3://"), "s3").when(low.startswith("gs://"), "gcs").otherwise("local")


def by_magic(content: Column) -> Column:
    """jpeg, png, webp or bmp; anything shorter than twelve bytes is unknown."""
    head = F.hex(F.substring(content, 1, 12))
    known = F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("424D"), "bmp").otherwise("unknown")
    return F.when(F.length(content) >= 12, known).otherwise("unknown")


def within(index: DataFrame, min_w: int = 0, min_h: int = 0, max_w: int = 0, max_h: int = 0, w: str = "w", h: str = "h") -> DataFrame:
    """Samples of known size within bounds; 0 is no bound, unknown sizes are out."""
    fits = (F.col(w) > 0) & (F.col(h) > 0) & (F.col(w) >= min_w) & (F.col(h) >= min_h)
    if max_w:
        fits &= F.col(w) <= max_w
    if max_h:
        fits &= F.col(h) <= max_h
    return index.filter(fits)


def kind_of(path: str) -> str:
    """As ``by_extension`` for one name; raises if it is not known."""
    ext = path.rpartition(".")[2].lower()
    for kind, exts in KINDS.items():
        if ext in exts:
            return kind
    raise ValueError(f"unknown format: {path}")
