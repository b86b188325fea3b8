"""Quality of read-out texts and classes of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import questions
from tidewell.functions.texts import alnum_ratio


def readout_quality(text: Column) -> Column:
    """Struct (words, alnum, short_share, reasons, usable) of a read-out: too few words, too little of letters and
    digits, too many one-letter words each give a reason; without any it is usable."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+)"), F.lit(1))
    n = F.size(words)
    short = F.when(n > 0, F.size(F.filter(words, lambda w: F.length(w) == 1)) / n).otherwise(0.0)
    ratio = alnum_ratio(text)
    reasons = F.array_compact(F.array(F.when(n < 5, "few_words"), F.when(ratio < 0.6, "noise"), F.when(short > 0.4, "broken_words")))
    return F.struct(n.cast("bigint").alias("words"), F.round(ratio, 6).alias("alnum"), F.round(short, 6).alias("short_share"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("usable"))


#: Kinds of documents by their path, first match wins.
PATH_KINDS = (("tax", r"(^|[/_\- ])(tax|w-?2|1099|1040)"), ("code", r"\.(py|js|ts|tsx|css|go|java|c|cpp|h|cs|rb|rs|sql)$"), ("letter", r"letter|memo"), ("list", r"list|roster|inventory|ledger"), ("meeting", r"minutes|agenda|notes"))


def path_kind(path: Column) -> Column:
    return F.coalesce(*[F.when(F.regexp_like(F.lower(path), F.lit(p)), k) for k, p in PATH_KINDS], F.lit("other"))


# Words by which questions are told apart, and the order in which the kinds are tried. A rule names its kind,
# the patterns a question must have all of, and those it must have none of.
YEAR = r"\b20\d{2}\b"
DOCS = r"\b(?:files?|documents?|docs?)\b"
ASKS = r"\b(?:list|which|what|show|find|from)\b"
MANY = r"\bhow\s+(?:many|much)\b"
LINE = r"\bline\s+\d{1,3}[a-z]?\b"
FORM = r"\bform\s+\d{3,4}(?:-[a-z0-9]+)?\b|\b1040(?:-sr)?\b"
TAX = r"\b(?:tax|taxes|withheld|witheld|withholding|federal\s+income\s+tax|federal\s+wages?\s+withh?eld|w-?2|1099|1040|box\s*\d{1,2}|payroll|state\s+tax)\b"
PROJECTS = r"\bprojects?\b"
RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("CAPABILITIES", (r"\bsupported\s+(?:file\s+)?(?:types?|formats?)\b|\bwhat\s+(?:file\s+)?(?:types?|formats?)\b|\bwhat\s+can\s+you\s+index\b|\bcapabilities\b",), ()),
    ("FILENAME_DATE_LOOKUP", (r"^\S+(?:\s+\S+){0,11}$", questions.FILE_NOUN, questions.DATED), (questions.SPOKEN,)),
    ("FILE_LIST", (DOCS, YEAR, ASKS), (r"\b(?:summary|overview|analy[sz]e|analysis|architecture|design|why|how)\b",)),
    ("METADATA_ONLY", (r"\b(?:how\s+many|count|total|number\s+of)\b", DOCS, r"\bby\s+(?:year|month|quarter|type|extension|folder)\b"), ()),
    ("METADATA_ONLY", (r"\b(?:file\s+counts?|document\s+(?:types?|counts?)|extension\s+breakdown)\b",), ()),
    ("TIMELINE", (r"\b(?:timeline|chronolog|sequence|history|evolution|progression)\b", r"\b(?:20\d{2}|events?|milestones?|changes?|updates?)\b"), ()),
    ("STRUCTURE", (r"\b(?:(?:file|folder|directory)\s+structure|folder\s+outline|directory|layout|snapshot|recent\s+(?:changes?|files?)|what\s+changed\s+recently|file\s+types?|file\s+extensions?|inventory)\b", r"\b(?:files?|folders?|docs?|documents?|structure|changes?|types?|extensions?|inventory)\b"), ()),
    ("STRUCTURE", (r"\.[a-z0-9]{1,8}\b", r"\b(?:how\s+many|count|number\s+of)\b", DOCS), ()),
    ("CODE_LANGUAGE", (YEAR, r"\b(?:language|lang)\b"), (rf"{YEAR}.*{YEAR}", rf"{MANY}.*{PROJECTS}|{PROJECTS}.*{MANY}", rf"{DOCS}.*{ASKS}|{ASKS}.*{DOCS}")),
    ("CODE_LANGUAGE", (r"\b(?:most (?:common|used)|primary|dominant)\s+(?:coding\s+)?(?:programming\s+)?language\b|\bwhat (?:language|lang)\s+(?:do i\s+)?(?:code|program)\s+(?:in\s+)?(?:the\s+)?most\b",), ()),
    ("FIELD_LOOKUP", (YEAR, LINE, FORM), ()),
    ("MONEY_YEAR_TOTAL", (YEAR, r"\b(?:income|earnings|wages|agi|adjusted\s+gross)\b|\bhow\s+much\b.{0,80}\b(?:make|made|earn|earned)\b"), (LINE, FORM, TAX)),
    ("LOOKUP", (r"\bhow\s+many\b", r"\b(?:1099|w-?2|1040|1098|forms?)\b"), ()),
    ("LOOKUP", (r"\b(?:what|which)\b", r"\bstocks?\b"), (r"\bhow\s+much\b",)),
    ("TAX_QUERY", (r"\b(?:min(?:imum)?|threshold|required|at\s+least)\b", r"\b(?:file|issue|send|report)\b", r"\b1099\b"), ()),
    ("TAX_QUERY", (YEAR, TAX + r"|\b(?:federal|stocks?|sell|sold|proceeds|brokerage|capital\s*gain)\b"), ()),
    ("PROJECT_COUNT", (MANY, PROJECTS), ()),
    ("REFLECT", (r"^.{0,119}$", r"\breflect\s+(?:up)?on\b|\breflective\s+writer\b|\b(?:summarize|analyze)\s+this\b"), ()),
    ("EVIDENCE_PROFILE", (
        r"\bhow\s+(?:is|do|does|am)\s+(?:my|i)\b|\bwhat\s+(?:is|are)\s+my\s+(?:thought|mind|process|approach|style|pattern|habit|tendency|nature|way|default|sense)\b|"
        r"\bwhat\s+(?:kind|sort|type)\s+of\s+(?:person|thinker|learner|writer|mind)\s+am\s+i\b|\bwhat\s+(?:do|did)\s+i\s+(?:like|love|enjoy|say|think|decide)\b|"
        r"\bdo\s+i\s+(?:mention|say|like)\b|\b(?:preferences?|favorites?|opinions?)\b|\bwhat\s+(?:have\s+i|did\s+i)\s+(?:written|said)\b",
    ), ()),
    ("ACADEMIC_HISTORY", (r"\b(?:classes|class|courses?)\b", r"\b(?:course\s+history|transcript|completed|taken|did\s+i\s+take)\b"), (r"\b(?:should|recommend|suggest(?:ed)?)\b",)),
    ("AGGREGATE", (r"\ball\s+(?:my\s+)?(?:income|sources|documents|files)\b|\btotal\b|\bsum\s+of\b|\blist\s+(?:every|all)\b|\bhow\s+many\b|\bevery\s+(?:source|w2|1099)\b",), ()),
)


def intent(question: Column) -> Column:
    """The kind of a question, one of sixteen: the first rule that fits, else LOOKUP; null and blank questions too."""
    q = F.lower(F.trim(question))
    told = []
    for label, all_of, none_of in RULES:
        fits = F.lit(True)
        for p in all_of:
            fits = fits & F.regexp_like(q, F.lit(p))
        for p in none_of:
            fits = fits & ~F.regexp_like(q, F.lit(p))
        told.append(F.when(fits, label))
    return F.coalesce(*told, F.lit("LOOKUP"))
