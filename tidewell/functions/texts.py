"""Names, paths, identifiers, words and qualities of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = ("py", "js", "ts", "tsx", "css", "go", "java", "c", "cpp", "h", "cs", "rb", "rs", "sql")


def base_name(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: str) -> Column:
    """Lower-case extension without its dot, blank where a name has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def kind(path: str) -> Column:
    """What reads a file: code, pdf, docx, xlsx, pptx, zip, image or text."""
    ext = extension(path)
    return (
        F.when(ext.isin(*CODE), "code").when(ext.isin("pdf", "docx", "xlsx", "pptx", "zip"), ext)
        .when(ext.isin("png", "jpg", "jpeg", "gif", "tif", "tiff", "webp", "bmp"), "image").otherwise("text")
    )


def has_year(path: Column, year: int) -> Column:
    """Whether a path carries a year as digits of their own."""
    return F.regexp_like(path, F.lit(rf"(^|[^0-9]){year}([^0-9]|$)"))


def slug(name: Column, path: Column) -> Column:
    """A silo's slug: its name in lower case with dashes, and eight digits of a hash of name and path."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), r"(^-+|-+$)", "")
    return F.concat_ws("-", F.when(bare == "", "silo").otherwise(bare), F.substring(F.sha1(F.concat_ws("|", name, path)), 1, 8))


def chunk_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_id(source: Column, mtime: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, mtime.cast("string"), index.cast("string")), 256), 1, 20)


def file_hash(content: Column) -> Column:
    """A file's hash: its first eight kilobytes and its size."""
    return F.md5(F.concat(F.substring(content, 1, 8192), F.length(content).cast("string").cast("binary")))


def words(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case words and numbers of at least three characters, each once, in order."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]{3,})"), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop])) if stop else found


def overlap(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that ``b`` has too; 0 where ``a`` has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def alnum_ratio(text: Column) -> Column:
    """Share of letters and digits among the characters that are no blanks."""
    ink = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(ink > 0, F.length(F.regexp_replace(text, r"[^A-Za-z0-9]", "")) / ink).otherwise(0.0)


def money(text: Column) -> Column:
    """An amount as decimal(18,2), whatever separators and signs it is written with; null where it is none."""
    return F.expr("null").cast("decimal(18,2)") if text is None else F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("decimal(18,2)")
