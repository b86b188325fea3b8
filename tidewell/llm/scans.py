"""Problem 2: scanning noise in pages, image regions and images, and readable paragraphs out of them.

Four kinds of noise are found and repaired:

* ``hyphen``: a letter and a hyphen, soft hyphen or any other mark of that look at the end of a line; a true
  compound that the corpus writes with its hyphen inside lines is left alone;
* ``character``: words are grouped by the skeleton of their confusable glyphs (:mod:`glyphs`). A rare form is
  misread where a form of the same skeleton that is many times as frequent has been seen next to the same
  neighbours; forms with digits or bars among their letters need no neighbours;
* ``header``: edge lines of pages, digits masked and glyphs reduced, that recur on other pages of their file;
* ``page_number``: arabic or roman numbers alone on an edge line, or set apart at an end of one.

Statistics cover all records. Words are counted with map-side sums; the frequent forms, at most ``COMMON`` of
them, are sent to all tasks, so that only words that may be misread are shuffled for their context. Paragraphs are
rebuilt from lines with windows over each record.

Defined results: null and blank texts have no noise and come out null; a record without letters has no words; a
repeated row is one record; page order is page_num and ties of lines keep their place; very long texts are treated
whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.glyphs import PAIRS, SINGLE, skeleton, to_leaf
from tidewell.shared import Scratch

MARKS = "-\\u00AC\\u00AD\\u2010\\u2011"
#: Most frequent forms that every task knows, about 20 bytes each.
COMMON = 20_000
#: A form is suspect where another of its skeleton is so many times as frequent.
RATIO = 4
#: Glyph classes of scans: those of names, and round vowels and sixes besides.
SCAN_SINGLE = SINGLE | {"a": "o", "6": "h", "u": "h", "y": "v"}
SCAN_PAIRS = tuple((pair, "h" if pair == "ii" else glyph) for pair, glyph in PAIRS)
NUMBER = r"(?:\d{1,4}|(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
ALONE = rf"(?i)^[\[(\-–—\s]*(?:p\.|pp\.|page|seite|s\.|pág\.?|pagina|página)?\s*{NUMBER}(?:\s*(?:of|/|von|de|sur|di)\s*\d+)?[\])\-–—\s.]*$"
AT_END = rf"(?i)(?:\s+[|–—-]\s*|\s{{2,}})(?:p\.\s*|page\s+|s\.\s*)?{NUMBER}$"
AT_START = rf"(?i)^(?:p\.\s*|page\s+|s\.\s*)?{NUMBER}(?:\s+[|–—-]\s+|\s{{2,}})(?=\p{{L}})"
TAIL = rf"(?i)\n[\[(\-–—\h]*(?:p\.|page|seite|s\.)?\h*{NUMBER}(?:\h*(?:of|/|von|de|sur|di)\h*\d+)?[\])\-–—\h.]*\s*\z"
WORD = r"((?<![\p{L}\p{N}!|$])[!|$]?[\p{L}\p{N}]+(?:[!|$][\p{L}\p{N}]+)*\|?)"


def records(pages: DataFrame, regions: DataFrame, images: DataFrame) -> DataFrame:
    """All three tables as (record_kind, record_key, file_key, page_num, text), each record once."""
    none = F.lit(None)
    out = pages.select(F.lit("page").alias("record_kind"), F.col("page_key").alias("record_key"), "file_key", F.col("page_num").cast("int").alias("page_num"), "text")
    out = out.unionByName(regions.select(F.lit("region").alias("record_kind"), F.col("region_key").alias("record_key"), none.cast("bigint").alias("file_key"), none.cast("int").alias("page_num"), "text"))
    out = out.unionByName(images.select(F.lit("image").alias("record_kind"), F.col("image_key").alias("record_key"), none.cast("bigint").alias("file_key"), none.cast("int").alias("page_num"), F.col("visible_text").alias("text")))
    return out.where(F.col("record_key").isNotNull() & F.regexp_like("text", F.lit(r"\S"))).dropDuplicates(["record_kind", "record_key"])


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t ]", " "))), lambda x: x != "")


def _edges(lines: Column) -> Column:
    """The first and the last line and, where one of them is a bare number, its neighbour."""
    first, last = F.get(lines, F.lit(0)), F.try_element_at(lines, F.lit(-1))
    alone = lambda x: F.regexp_like(x, F.lit(ALONE))
    return F.array_compact(F.array(first, F.when(F.size(lines) > 1, last), F.when(alone(first), F.get(lines, F.lit(1))), F.when((F.size(lines) > 2) & alone(last), F.get(lines, F.size(lines) - 2))))


def header_key(line: Column) -> Column:
    """What running lines have in common: no page number, numbers masked, glyph skeletons; null where it can be none."""
    bare = F.regexp_replace(F.regexp_replace(line, AT_END, ""), AT_START, "")
    masked = F.regexp_replace(bare, r"(?<![\p{L}\p{N}])\p{N}+(?![\p{L}\p{N}])", "#")
    key = F.trim(F.regexp_replace(skeleton(F.regexp_replace(masked, r"[^\p{L}\p{N}#!|$]+", " "), single=SCAN_SINGLE, pairs=SCAN_PAIRS), r"\s+", " "))
    headed = ~F.regexp_like(bare, F.lit(r"[.?!,;:–—-]\s*$")) & ~F.regexp_like(bare, F.lit(r"^\d+(\.\d+)+\s")) & (F.length(bare) <= 120)
    return F.when(headed & F.regexp_like(bare, F.lit(r"^[^\p{Ll}]")) & ~F.regexp_like(bare, F.lit(ALONE)) & (F.length(key) >= 6), key)


def edge_lines(pages: DataFrame) -> DataFrame:
    """(record_kind, record_key, file_key, page_num, keys, numbered) of ``pages``, read once: the header keys of the edge lines,
    and whether an edge line is, begins with or ends with a printed page number."""
    lined = pages.select("record_kind", "record_key", "file_key", "page_num", _lines(F.col("text")).alias("lines"))
    lined = lined.select("record_kind", "record_key", "file_key", "page_num", _edges(F.col("lines")).alias("edges"))
    keys = F.array_compact(F.array_distinct(F.transform("edges", lambda x: header_key(x))))
    return lined.select("record_kind", "record_key", "file_key", "page_num", keys.alias("keys"), F.exists(F.slice("edges", 1, 2), numbered).alias("numbered"))


def running_lines(edges: DataFrame) -> DataFrame:
    """(file_key, key) of the edge lines that recur on at least two pages of their file."""
    edge = edges.where("file_key is not null").select("file_key", "page_num", F.explode("keys").alias("key"))
    seen = edge.groupBy("file_key", "key").agg(F.min("page_num").alias("low"), F.max("page_num").alias("high"))
    # a line cut off at its end counts for the longer one that begins with it
    whole = to_leaf(seen.withColumn("start", F.substring("key", 1, 8)), ["file_key", "start"], "key")
    cut = ~F.col("ambiguous") & (F.length("key") * 5 >= F.length("leaf") * 3)
    whole = whole.select("file_key", "key", F.when(cut, F.col("leaf")).otherwise(F.col("key")).alias("leaf"), "low", "high")
    again = whole.groupBy("file_key", "leaf").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("file_key", "leaf")
    return whole.join(again, ["file_key", "leaf"], "left_semi").select("file_key", "key")


def _inline(line: Column) -> Column:
    """Whether a page number is set apart at an end of a line that may be a running one."""
    titled = (F.length(line) <= 80) & F.regexp_like(line, F.lit(r"^[^\p{Ll}]|^p\.|^" + NUMBER + r"\s"))
    return titled & (F.regexp_like(line, F.lit(AT_END)) | F.regexp_like(line, F.lit(AT_START))) & ~F.regexp_like(line, F.lit(r"^\d+(\|\d+)+$"))


def numbered(line: Column) -> Column:
    """Whether an edge line is, begins with or ends with a printed page number."""
    return F.regexp_like(line, F.lit(ALONE)) | _inline(line)


def _flow(text: Column) -> Column:
    """The text as one line of words: bare number lines at the edges go, broken words are joined."""
    text = F.regexp_replace(text, r"\r\n", "\n")
    text = F.regexp_replace(text, TAIL, "")
    text = F.regexp_replace(text, rf"(\p{{L}})[{MARKS}]\h*\n\s*(?=\p{{Ll}})", "$1")
    # a word broken at the end of the record, and what is left of it before a footer
    return F.regexp_replace(text, rf"\p{{L}}+[{MARKS}]\h*(?=\n|\z)", " ")


def words(text: Column) -> Column:
    """Lower-case words that hold a letter, in order."""
    return F.filter(F.transform(F.regexp_extract_all(_flow(text), F.lit(WORD), F.lit(1)), lambda x: F.lower(x)), lambda x: F.regexp_like(x, F.lit(r"\p{L}.*\p{L}|\p{L}")) & (F.length(x) > 1))


MIXED = r"\p{L}.*[0-9!|$]|[0-9!|$].*\p{L}"
#: Numbers with letters that nobody misread: ordinals, units, codes.
CODE = r"^(?:[0-9]+(?:st|nd|rd|th|e|er|ème|º|ª|kg|km|cm|mm|kb|mb|h|m|s|x)|[a-z]{1,3}[0-9]+|[0-9a-f]{8,})$"


def misread_words(recs: DataFrame, scratch: Scratch) -> DataFrame:
    """(record_kind, record_key, word, meant): words of a record that are misread, and the form meant."""
    told = scratch.keep(recs.select("record_kind", "record_key", words(F.col("text")).alias("w")), "words")
    base = told.where("record_kind <> 'image'")
    counts = base.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.keep(counts.withColumn("skeleton", skeleton(F.col("word"), single=SCAN_SINGLE, pairs=SCAN_PAIRS)), "counts")
    clean = counts.where(~F.regexp_like("word", F.lit(MIXED)) & (F.col("n") > 1))
    tops = clean.groupBy("skeleton").agg(F.max("n").alias("top"))
    held = counts.join(tops, "skeleton", "left")
    mixed = F.regexp_like("word", F.lit(MIXED)) & ~F.regexp_like("word", F.lit(CODE))
    rare = (F.col("n") * RATIO <= F.col("top")) | mixed
    suspects = held.where(rare & F.col("top").isNotNull()).select("word", "skeleton", "n", mixed.alias("mixed"))
    better = clean.select("skeleton", F.col("word").alias("meant"), F.col("n").alias("support"))
    pairs = suspects.join(better, "skeleton").where((F.col("word") != F.col("meant")) & (F.col("mixed") | (F.col("support") >= F.col("n") * RATIO)))
    pairs = scratch.keep(pairs.select("word", "meant", "mixed", "support"), "pairs")
    # the most frequent sound forms: a bounded list that spares their occurrences a shuffle
    sound = F.broadcast(held.where(~rare | F.col("top").isNull()).orderBy(F.desc("n"), "word").limit(COMMON).select("word"))
    around = lambda x, i: F.struct(F.when(i > 0, F.get("w", i - 1)).alias("before"), x.alias("word"), F.get("w", i + 1).alias("after"))
    spots = told.select("record_kind", "record_key", F.explode(F.transform("w", around)).alias("s")).select("record_kind", "record_key", "s.before", "s.word", "s.after")
    spots = spots.join(sound, "word", "left_anti").distinct()
    spots = scratch.keep(spots.join(pairs, "word"), "spots")
    sure = spots.where("mixed").select("record_kind", "record_key", "word", "meant", "support")
    unsure = spots.where("not mixed")
    asked = unsure.select(F.col("before").alias("a"), F.col("meant").alias("b")).unionByName(unsure.select(F.col("meant").alias("a"), F.col("after").alias("b")))
    asked = asked.unionByName(unsure.select(F.col("before").alias("a"), F.col("word").alias("b"))).unionByName(unsure.select(F.col("word").alias("a"), F.col("after").alias("b"))).where("a is not null and b is not null").distinct()
    couples = base.select(F.explode(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("a"), F.get("w", i + 1).alias("b")))).alias("p")).select("p.a", "p.b")
    couples = couples.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).join(asked, ["a", "b"], "left_semi")
    couples = scratch.keep(couples, "couples")
    # a misread form stands where the form meant stands often; a word of its own keeps company of its own
    before = lambda form: couples.select(F.col("a").alias("before"), F.col("b").alias(form), F.col("k").alias(f"{form}_left"))
    after = lambda form: couples.select(F.col("a").alias(form), F.col("b").alias("after"), F.col("k").alias(f"{form}_right"))
    told_by = unsure
    for form in ("meant", "word"):
        told_by = told_by.join(before(form), ["before", form], "left").join(after(form), [form, "after"], "left")
    seen = {form: F.coalesce(f"{form}_left", F.lit(0)) + F.coalesce(f"{form}_right", F.lit(0)) for form in ("meant", "word")}
    told_by = told_by.where((seen["meant"] >= 2) & (seen["meant"] >= 4 * (seen["word"] - 2)))
    told_by = told_by.select("record_kind", "record_key", "word", "meant", seen["meant"].alias("support"))
    best = sure.unionByName(told_by).groupBy("record_kind", "record_key", "word").agg(F.max_by("meant", F.struct("support", "meant")).alias("meant"))
    return scratch.keep(best, "misread")


def _compounds(recs: DataFrame) -> DataFrame:
    """The compounds that the corpus writes with their hyphen inside lines, in lower case."""
    inside = recs.select(F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"(\p{L}+-\p{L}+)"), F.lit(1)), lambda x: F.lower(x))).alias("compound"))
    return inside.groupBy("compound").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("compound")


def broken_words(recs: DataFrame, scratch: Scratch) -> DataFrame:
    """(record_kind, record_key) of records with a word broken over a line end."""
    always = rf"\p{{L}}[{MARKS.replace('-', '')}]\h*(?:\r?\n|$)"
    plain = r"(\p{L}+)-\h*(?:\r?\n\s*(\p{Ll}*)|\z)"
    sure = recs.where(F.regexp_like("text", F.lit(always))).select("record_kind", "record_key")
    found = recs.where(F.regexp_like("text", F.lit(plain))).select(
        "record_kind", "record_key", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(plain), F.lit(1)).alias("l"), F.regexp_extract_all("text", F.lit(plain), F.lit(2)).alias("r"))).alias("p")
    ).select("record_kind", "record_key", F.lower(F.concat_ws("-", "p.l", "p.r")).alias("compound"))
    return sure.unionByName(found.join(_compounds(recs), "compound", "left_anti").select("record_kind", "record_key")).distinct()


def noise(pages: DataFrame, regions: DataFrame, images: DataFrame, scratch: Scratch) -> DataFrame:
    """(record_kind, record_key, noise_kind), one row per record and kind."""
    recs = scratch.keep(records(pages, regions, images), "records")
    edges = scratch.keep(edge_lines(recs.where("record_kind = 'page'")), "edges")
    lined = edges.select("record_kind", "record_key", "file_key", F.explode("keys").alias("key"))
    header = lined.join(running_lines(edges), ["file_key", "key"], "left_semi").select("record_kind", "record_key").distinct()
    number = edges.where("numbered").select("record_kind", "record_key")
    misread = misread_words(recs, scratch).select("record_kind", "record_key").distinct()
    kinds = {"hyphen": broken_words(recs, scratch), "character": misread, "header": header, "page_number": number}
    out = None
    for kind, rows in kinds.items():
        rows = rows.select("record_kind", "record_key", F.lit(kind).alias("noise_kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


def repaired(pages: DataFrame, regions: DataFrame, images: DataFrame, scratch: Scratch) -> DataFrame:
    """(record_kind, record_key, paragraph, text): the records as continuous paragraphs, from 1 on, without noise.

    The pages of a file are read on from one to the next: a word broken at the end of a page is joined, and a paragraph
    that goes on belongs to the page on which it begins. The same lines and words that :func:`noise` reports are
    removed and mended: running lines, printed numbers (within a line only the number goes), broken and
    misread words. A hyphen at a line end stays where the corpus writes the compound with it or a capital follows."""
    recs = scratch.keep(records(pages, regions, images), "records")
    misread = misread_words(recs, scratch).groupBy("record_kind", "record_key").agg(F.collect_list(F.struct("word", "meant")).alias("fixes"))
    running = running_lines(scratch.keep(edge_lines(recs.where("record_kind = 'page'")), "edges")).withColumn("runs", F.lit(True))
    page = F.col("record_kind") == "page"
    # pages of one file are one text; everything else stands alone
    unit = F.when(page & F.col("file_key").isNotNull(), F.concat(F.lit("file"), F.col("file_key").cast("string"))).otherwise(F.concat_ws("-", "record_kind", "record_key"))
    line = recs.select("record_kind", "record_key", "file_key", unit.alias("unit"), F.coalesce("page_num", F.lit(0)).alias("page_num"), F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    # as in edge_lines, so that both see the same keys
    line = line.withColumn("line", F.trim(F.regexp_replace("line", r"[\t ]", " ")))
    mine = W.partitionBy("unit", "page_num", "record_key")
    inked = F.col("line") != ""
    line = line.withColumn("n", F.sum(inked.cast("int")).over(mine.orderBy("at"))).withColumn("all", F.max("n").over(mine))
    first, last = inked & (F.col("n") == 1), inked & (F.col("n") == F.col("all"))
    alone = inked & F.regexp_like("line", F.lit(ALONE))
    ends = line.withColumns({"first": page & first, "last": page & last, "alone": page & (first | last) & alone})
    near = ends.withColumns({"head": F.max(F.col("first") & F.col("alone")).over(mine), "foot": F.max(F.col("last") & F.col("alone")).over(mine)})
    edge = F.col("first") | F.col("last") | (page & inked & ((F.col("head") & (F.col("n") == 2)) | (F.col("foot") & (F.col("n") == F.col("all") - 1))))
    told = near.withColumn("key", F.when(edge, header_key(F.col("line")))).join(running, ["file_key", "key"], "left")
    told = told.where(~(F.col("alone") | F.coalesce("runs", F.lit(False))))
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", AT_END, ""), AT_START, ""))
    kept = told.withColumn("line", F.trim(F.regexp_replace(F.when((F.col("first") | F.col("last")) & _inline(F.col("line")), bare).otherwise(F.col("line")), " +", " ")))
    # breaks between paragraphs: blank lines, and new records unless the text before them goes on
    flow = W.partitionBy("unit").orderBy("page_num", "record_key", "at")
    kept = kept.withColumn("blank", F.sum((F.col("line") == "").cast("int")).over(mine.orderBy("at"))).where("line <> ''")
    before = {c: F.lag(c).over(flow) for c in ("line", "record_key", "blank")}
    open_end = ~F.regexp_like(before["line"], F.lit(r"[.?!:;…][\"'»”)\]]*$"))
    goes_on = open_end & F.regexp_like("line", F.lit(r"^\p{Ll}"))
    new = before["line"].isNull() | F.when(before["record_key"] == F.col("record_key"), before["blank"] != F.col("blank")).otherwise(~goes_on)
    kept = kept.withColumn("paragraph", F.sum(new.cast("int")).over(flow))
    # broken words: the next line of the paragraph tells whether the mark goes
    after = F.lead("line").over(W.partitionBy("unit", "paragraph").orderBy("page_num", "record_key", "at"))
    kept = kept.withColumns({"mark": F.regexp_extract("line", rf"\p{{L}}([{MARKS}])$", 1), "next": after})
    halves = F.regexp_extract("line", r"(\p{L}+)-$", 1), F.regexp_extract("next", r"^(\p{Ll}+)", 1)
    # a line without a compound meets none: a key of its own spreads such lines over all tasks
    compound = F.when((halves[0] != "") & (halves[1] != ""), F.lower(F.concat_ws("-", *halves)))
    kept = kept.withColumn("compound", F.coalesce(compound, F.concat_ws(" ", F.lit(""), "record_key", "at")))
    kept = kept.join(_compounds(recs).withColumn("known", F.lit(True)), "compound", "left")
    hyphen, soft = F.col("mark") == "-", (F.col("mark") != "") & (F.col("mark") != "-")
    whole = F.regexp_replace("line", rf"[{MARKS}]$", "")
    glued = (
        F.when(F.col("next").isNull(), F.when(soft, whole).otherwise(F.col("line")))
        .when(soft | (hyphen & ~F.coalesce("known", F.lit(False)) & F.regexp_like("next", F.lit(r"^\p{Ll}"))), whole)
        .when(hyphen, F.col("line")).otherwise(F.concat("line", F.lit(" ")))
    )
    kept = kept.join(misread, ["record_kind", "record_key"], "left")
    piece = F.struct("page_num", "record_key", "at", glued.alias("piece"), "record_kind", "fixes")
    parts = kept.groupBy("unit", "paragraph").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    parts = parts.select(
        F.col("p")[0]["record_kind"].alias("record_kind"), F.col("p")[0]["record_key"].alias("record_key"), "paragraph",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"),
        F.array_distinct(F.flatten(F.filter(F.transform("p", lambda x: x["fixes"]), lambda x: x.isNotNull()))).alias("fixes"),
    )
    tokens = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}!|$]+|[^\p{L}\p{N}!|$]+)"), F.lit(1))

    def mend(part: Column) -> Column:
        meant = F.get(F.filter("fixes", lambda x: x["word"] == F.lower(part)), F.lit(0))["meant"]
        upper = (F.upper(part) == part) & (F.length(part) > 1)
        title = F.regexp_like(part, F.lit(r"^\p{Lu}"))
        return F.coalesce(F.when(upper, F.upper(meant)).when(title, F.initcap(meant)).otherwise(meant), part)

    text = F.when(F.size("fixes") == 0, F.col("text")).otherwise(F.array_join(F.transform(tokens, mend), ""))
    order = F.row_number().over(W.partitionBy("record_kind", "record_key").orderBy("paragraph"))
    return parts.select("record_kind", "record_key", order.alias("paragraph"), F.trim(text).alias("text"))
