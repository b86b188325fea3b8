"""Traits of questions and documents: ordered patterns over a column of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell the trait of a question, synonyms that widen it, kinds of documents by extension and by
# the words they begin with. They are data of the engine, the same in every query.
RECENT = r"\b(?:latest|current|now|today|most\s+recent|recently)\b|\bthis\s+(?:year|month|semester)\b|\blast\s+(?:year|semester|month)\b|\b20\d{2}\b"
SPEED = r"\b(?:fast|slow|quick|latency|performance|how\s+long|timing|duration)\b"
FILE_NOUN = r"\b(?:entry|entries|notes?|journals?|logs?|files?|docs?|documents?|pages?)\b"
SPOKEN = r"\b(?:about|regarding|concerning|thinking|thoughts?|wrote|writing|write|written|said|saying|mention(?:ed|s)?|feel|felt|feelings?)\b"
DATED = r"\b(?:today|yesterday|(?:this|last)\s+(?:week|month|year)|\d{4}-\d{2}-\d{2}|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,4})\b"
SLIDES = r"powerpoint|pptx|ppt|slides|slide deck"
SYNONYMS = {"income": "wages salary compensation earnings gross income", "address": "street mailing address residence", "phone": "telephone cell mobile contact number"}
BUCKETS = {"pdf": "pdf", "docx": "docx", "doc": "docx", "xlsx": "xlsx", "xls": "xlsx", "csv": "xlsx", "pptx": "pptx", "ppt": "pptx"}
CODE = ("py", "js", "ts", "tsx", "jsx", "mjs", "cjs", "go", "rs", "java", "c", "cpp", "h", "hpp", "cs", "rb", "sh", "bash", "zsh", "php", "kt", "sql", "swift", "scala", "r", "lua", "pl")
CONTENT_KINDS = (
    ("tax_return", r"(?i)\bform\s+1040\b|schedule\s+[a-c]\b|w-2|1099|irs|adjusted\s+gross\s+income\b"),
    ("transcript", r"(?i)\b(?:transcript|course\s+history|academic\s+standing|term\s+totals?|quality\s+points)\b"),
    ("syllabus", r"(?i)\bsyllabus\b|office\s+hours\b|course\s+objectives\b|prerequisite"),
    ("audit", r"(?i)\baudit\b|degree\s+plan\b|requirements\s+met\b"),
)
FACT_KINDS = (("risk", r"risk|uncertain"), ("segment", r"segment|business unit"), ("guidance", r"guidance|outlook|expects"), ("metric", r"revenue|income|cash|eps|margin|operating"))
#: Rows a question may take of one source and of one silo, by what it asks for.
CAPS = (("LOOKUP", 3, 3), ("EVIDENCE_PROFILE", 2, 3), ("AGGREGATE", 6, 6), ("REFLECT", 4, 3), ("FIELD_LOOKUP", 8, 3))
NEGATION = r"(?i)(?:^|[^\p{L}])(?:not|no|never|without|cannot|neither|nor|none)(?:[^\p{L}]|$)|n't(?:[^\p{L}]|$)"


def has(text: Column, pattern: str) -> Column:
    return F.regexp_like(F.lower(text), F.lit(pattern))


def expanded(question: Column) -> Column:
    """The question with the synonyms of its words appended, each word's once."""
    extra = F.array_compact(F.array(*[F.when(F.array_contains(F.split(F.lower(F.trim(question)), r"\s+"), w), F.lit(s)) for w, s in SYNONYMS.items()]))
    return F.concat_ws(" ", F.trim(question), F.nullif(F.array_join(extra, " "), F.lit("")))


def dated_file_question(question: Column) -> Column:
    """Whether a short question names files and a day, week or month, and no words about what somebody said or thought."""
    short = F.size(F.split(F.trim(question), r"\s+")) <= 12
    return short & has(question, FILE_NOUN) & has(question, DATED) & ~has(question, SPOKEN)


def bucket(ext: Column) -> Column:
    """Bucket of an extension (lower case, without dot): pdf, docx, xlsx, pptx, code or other."""
    return F.coalesce(*[F.when(ext == e, b) for e, b in BUCKETS.items()], F.when(ext.isin(*CODE), "code"), F.lit("other"))


def first_kind(text: Column, kinds: tuple[tuple[str, str], ...]) -> Column:
    """The first of ordered kinds whose pattern a text has; null where none has."""
    return F.coalesce(*[F.when(F.regexp_like(text, F.lit(p)), k) for k, p in kinds], F.lit(None).cast("string"))


def content_kind(text: Column) -> Column:
    """Kind of a document by the first 500 characters, which is where forms and titles say what they are."""
    return F.coalesce(first_kind(F.substring(text, 1, 500), CONTENT_KINDS), F.lit("other"))


def year_of(path: Column, text: Column) -> Column:
    """The year of a document: the first in its file name, else the last in its path, else the first in its text."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    years = lambda c: F.filter(F.split(c, "[^0-9]+"), lambda x: F.regexp_like(x, F.lit("^20[0-9][0-9]$")))
    return F.coalesce(F.get(years(base), F.lit(0)), F.try_element_at(years(path), F.lit(-1)), F.get(years(text), F.lit(0))).cast("int")


def bytes_label(size: Column) -> Column:
    """A number of bytes as text in steps of 1,024."""
    steps = [("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10)]
    return F.coalesce(*[F.when(size >= n, F.concat(F.format_number(size / n, 1), F.lit(f" {u}"))) for u, n in steps], F.concat(size.cast("string"), F.lit(" B")))


def stage_one_rows(n: int, *, reranked: bool = False) -> int:
    """Rows to fetch before ranking for a result of ``n``."""
    return 40 if reranked else min(100, max(5 * n, 60))


def fan_out_rows(stage_one: int) -> int:
    """Rows to fetch from each candidate silo."""
    return max(2, min(6, stage_one // 8))
