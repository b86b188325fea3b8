"""Problem 3: source files nobody in the silo wrote, by belief propagation over directory trees.

Every file and every directory is a variable with the labels handwritten, generated, minified, vendored and
blob; for a directory the label says what it mainly holds. Evidence about a file (name, size, the text where there
is one) and about a directory (its name) enters as log likelihoods; a directory and its entries are bound by
compatibilities, so that siblings and parents speak for each other: a strange file in a folder of third-party
copies is one of them, generated neighbours raise the odds of an undecided file, and backups mean nothing. The
graph is a forest, so one pass from the deepest directories up and one back down give exact posteriors. Passes
run level by level over directories only, as grouped sums and equi-joins; files are summed into their
directory first, however many it has.

Size likelihoods are learned from all files whose text already decides their label (a table of labels by quarter
octaves of size, which is bounded). Names of libraries are those of folders directly inside third-party folders.

Defined results: files without a source extension or with a null path are not classified; null size and
null or blank text are no evidence; repeated rows are classified each; of several texts of a file the longest counts;
an empty table gives no rows; ties between labels go to handwritten.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.shared import Scratch

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
EXTENSIONS = ("py", "js", "ts", "tsx", "css", "go", "java", "c", "cpp", "h", "cs", "rb", "rs", "sql")
#: Conventional folder names, compared whole and in lower case.
VENDORED_DIRS = ("node_modules", "bower_components", "jspm_packages", "vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "extern", "pods", "carthage", "site-packages", ".venv", "venv")
GENERATED_DIRS = ("generated", "__generated__", "_generated", "autogen", "generated-sources", "generated_sources", "obj")
MINIFIED_DIRS = ("dist", "static", "bundles", ".next")
#: P(label of an entry | label of its directory): files, then sub-directories; rows are the directory's label.
FILE_GIVEN_DIR = {
    "handwritten": (0.86, 0.045, 0.045, 0.03, 0.02),
    "generated": (0.03, 0.93, 0.01, 0.01, 0.02),
    "minified": (0.05, 0.02, 0.90, 0.01, 0.02),
    "vendored": (0.02, 0.03, 0.04, 0.88, 0.03),
    "blob": (0.15, 0.02, 0.02, 0.01, 0.80),
}
DIR_GIVEN_DIR = {
    "handwritten": (0.998, 0.0005, 0.0005, 0.0005, 0.0005),
    "generated": (0.04, 0.93, 0.01, 0.01, 0.01),
    "minified": (0.10, 0.01, 0.87, 0.01, 0.01),
    "vendored": (0.01, 0.005, 0.005, 0.975, 0.005),
    "blob": (0.30, 0.02, 0.02, 0.02, 0.64),
}
ROOT = (0.96, 0.01, 0.01, 0.01, 0.01)


def _messages(df: DataFrame, belief: list[Column], given: list[tuple[float, ...]], out: list[str]) -> DataFrame:
    """``df`` with the columns ``out``: the log of the sum over k of exp(belief k) times given[d][k], for each d.

    In three steps, each column made once: as one expression their code would outgrow what the compiler takes."""
    parts = {f"_x{d}_{k}": b + F.lit(math.log(row[k])) for d, row in enumerate(given) for k, b in enumerate(belief)}
    tops = {f"_t{d}": F.greatest(*[F.col(f"_x{d}_{k}") for k in range(len(belief))]) for d in range(len(given))}
    sums = {c: F.col(f"_t{d}") + F.log(sum((F.exp(F.col(f"_x{d}_{k}") - F.col(f"_t{d}")) for k in range(len(belief))), F.lit(0.0))) for d, c in enumerate(out)}
    return df.withColumns(parts).withColumns(tops).withColumns(sums).drop(*parts, *tops)


def _up(table: dict[str, tuple[float, ...]]) -> list[tuple[float, ...]]:
    """From an entry to its directory: for each label of the directory, over those of the entry."""
    return [table[d] for d in LABELS]


def _down(table: dict[str, tuple[float, ...]]) -> list[tuple[float, ...]]:
    """From a directory to an entry: for each label of the entry, over those of the directory."""
    return [tuple(table[d][k] for d in LABELS) for k in range(len(LABELS))]


def _evidence(**points: list[tuple[Column, float]]) -> list[Column]:
    """Log likelihoods by label: each (condition, weight) adds its weight where the condition holds."""
    return [sum((F.when(c, w).otherwise(0.0) for c, w in points.get(label, [])), F.lit(0.0)) for label in LABELS]


def text_features(read: DataFrame) -> DataFrame:
    """``read`` (text, project) with what its texts show, each computed once: blanks, digits, longest line, marks, repetition."""
    text = F.col("text")
    mark = (
        r"(?im)^\W{0,6}(?:<auto-generated|@generated\b|code generated by\b|auto(?:matically)?[- ]?generated (?:file|code|by|from|on)\b"
        r"|(?:this )?file (?:was|is) (?:auto\w*|produced|machine)[- ]?(?:automatically |generated|made)|generated (?:by|from) )|do not edit\.?\s*$|manual edits are overwritten"
    )
    holder = F.lower(F.regexp_extract(text, r"(?i)copyright (?:\(c\) )?(?:[0-9, -]+ )?(?:the )?([\w.-]+) (?:contributors|authors|project|developers)", 1))
    size = F.length(text)
    out = read.withColumns({
        "_there": F.coalesce(F.length(F.trim(text)) > 0, F.lit(False)),
        "_lines": F.filter(F.split(text, r"\r?\n"), lambda x: F.length(F.trim(x)) > 0),
        "_digits": (size - F.length(F.translate(text, "0123456789", ""))) / size,
        "_blanks": (size - F.length(F.translate(text, " \t\n\r", ""))) / size,
        "_marked": F.regexp_like(text, F.lit(mark)),
        "_holder": holder,
        "_run": F.regexp_like(text, F.lit(r"[A-Za-z0-9+/=]{400}")),
    })
    out = out.withColumns({
        "_longest": F.array_max(F.transform("_lines", lambda x: F.length(x))),
        "_masks": F.transform("_lines", lambda x: F.regexp_replace(F.regexp_replace(x, r"[\p{L}]+", "w"), "[0-9]+", "9")),
    })
    # a pattern that more than half of the lines follow is the middle one when they are sorted
    out = out.withColumn("_middle", F.get(F.array_sort("_masks"), F.floor(F.size("_masks") / 2).cast("int")))
    followers = F.size(F.filter("_masks", lambda x: x == F.col("_middle")))
    out = out.withColumn("_alike", (F.size("_lines") >= 10) & (followers * 10 >= F.size("_lines") * 6))
    return out.drop("_lines", "_masks", "_middle")


def text_evidence() -> list[Column]:
    """What the features of a whole text say about its origin; a null or blank text says nothing."""
    there, marked = F.col("_there"), F.col("_marked")
    foreign = (F.col("_holder") != "") & ~F.coalesce(F.col("_holder") == F.lower("project"), F.lit(False))
    packed = (F.col("_longest") > 400) & (F.col("_blanks") < 0.1)
    data = (F.col("_digits") > 0.3) | F.col("_run")
    plain = there & ~packed & ~data & ~F.col("_alike") & (F.col("_longest") <= 250)
    spaced = there & (F.col("_blanks") > 0.18) & (F.col("_digits") < 0.08)
    return _evidence(
        handwritten=[(plain, 3.0), (spaced, 2.0)],
        generated=[(there & marked, 8.0), (there & F.col("_alike") & ~data, 6.0)],
        minified=[(there & packed & ~data, 8.0)],
        vendored=[(there & foreign, 9.0), (there & ~foreign, -1.3), (plain, 3.0), (spaced, 2.0)],
        blob=[(there & data, 9.0)],
    )


def name_evidence(base: Column, known_library: Column) -> list[Column]:
    """What a file's name says about its origin."""
    like = lambda pattern: F.regexp_like(base, F.lit(pattern))
    return _evidence(
        generated=[
            (like(r"(?:\.pb\.|_pb2(?:_grpc)?\.|\.g\.cs$|\.designer\.|[._](?:gen|generated|autogen)\.[a-z]+$|^zz_generated[._]|\.freezed\.)"), 7.0),
            (like(r"\.d\.ts$"), 1.0),
        ],
        minified=[(like(r"[.\-_]min\.(?:js|css|ts|tsx)$"), 7.0), (like(r"\.(?:bundle|packed|chunk)\.(?:js|css)$"), 7.0), (like(r"[.\-][0-9a-f]{8,}\.(?:js|css)$"), 7.0)],
        vendored=[(like(r"-[0-9]+\.[0-9]+\.[0-9]+\.[a-z]+$"), 7.0), (known_library, 6.0)],
    )


def directory_evidence(name: Column) -> list[Column]:
    """What a directory's own name says about what it holds."""
    return _evidence(
        vendored=[(name.isin(*VENDORED_DIRS), 13.0), (F.regexp_like(name, F.lit(r"^[\w.]+-[0-9]+\.[0-9]+\.[0-9]+$")), 6.0)],
        generated=[(name.isin(*GENERATED_DIRS), 13.0)],
        minified=[(name.isin(*MINIFIED_DIRS), 11.0)],
    )


def _conventional(column: str) -> Column:
    return F.lower(F.regexp_extract(column, r"([^/]*)$", 1)).isin(*VENDORED_DIRS, *GENERATED_DIRS, *MINIFIED_DIRS)


def _sizes(files: DataFrame) -> list[Column]:
    """Log likelihood of a file's size under each label, learned from the files whose text decides."""
    bins = files.where("size_bin is not null and text_label is not null").groupBy("text_label", "size_bin").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[int, int]] = {label: {} for label in LABELS}
    for label, size_bin, n in bins.collect():  # labels by quarter octaves: a few hundred rows at most
        counts[label][size_bin] = n
    every = sorted({b for c in counts.values() for b in c})
    out = []
    for label in LABELS:
        total = sum(counts[label].values())
        if total < 20 or label == "vendored":  # third-party copies are as long as anyone's
            own, total = counts["handwritten"], sum(counts["handwritten"].values())
        else:
            own = counts[label]
        near = {b: sum(own.get(b + k, 0) * (0.6 if k == 0 else 0.2) for k in (-1, 0, 1)) for b in every}
        rare = math.log(0.05 / (total + 2)) if total else 0.0
        table = [x for b in every for x in (F.lit(b), F.lit(math.log((near[b] + 0.05) / (total + 2))))]
        found = F.element_at(F.create_map(*table), F.col("size_bin")) if table else F.lit(None).cast("double")
        out.append(F.when(F.col("size_bin").isNull(), 0.0).otherwise(F.coalesce(found, F.lit(rare))))
    return out


def classify(files: DataFrame, texts: DataFrame, scratch: Scratch, silos: DataFrame | None = None) -> DataFrame:
    """(file_key, label, confidence, p_handwritten) of every source file.

    ``silos`` (slug, path) gives the folder of each silo; the folder right below it names the project, whose own
    copyright marks are not foreign. Without it, or for a path outside its silo's folder, every holder is foreign."""
    cols = [f"e{k}" for k in range(len(LABELS))]
    sums = lambda prefix: [F.sum(f"m{k}").alias(f"{prefix}{k}") for k in range(len(LABELS))]
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "/+", "/")
    base = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    source = files.select("file_key", F.coalesce("silo", F.lit("")).alias("silo"), path.alias("path"), "size").where(F.regexp_extract(base, r"\.([a-z]+)$", 1).isin(*EXTENSIONS))
    source = source.select("file_key", "size", base.alias("base"), F.concat_ws("\x1f", "silo", F.regexp_replace("path", r"/[^/]*$", "")).alias("dir"))
    best = texts.where(F.length(F.trim("text")) > 0).select("file_key", "text").groupBy("file_key").agg(F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"))
    source = source.join(best, "file_key", "left")
    if silos is None:
        source = source.withColumn("project", F.lit(None).cast("string"))
    else:
        root = F.rtrim(F.trim(F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "/+", "/")), F.lit("/"))
        roots = silos.where("path is not null and slug is not null").groupBy(F.col("slug").alias("silo")).agg(F.min(root).alias("root"))
        below = F.when(F.startswith("dir", F.concat_ws("\x1f", "silo", F.concat("root", F.lit("/")))), F.substring(F.col("dir"), F.length("silo") + F.length("root") + 3, F.length("dir")))
        source = source.withColumn("silo", F.split_part("dir", F.lit("\x1f"), F.lit(1))).join(roots, "silo", "left").withColumn("project", F.split_part(below, F.lit("/"), F.lit(1))).drop("silo", "root")
    read = text_features(source).drop("text")
    marks = text_evidence()
    seen = read.select("file_key", "dir", "base", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int")).alias("size_bin"), *[m.alias(c) for m, c in zip(marks, cols)])
    top = F.greatest(*cols)
    decided = F.when(top >= 2.0, F.coalesce(*[F.when(F.col(c) == top, label) for c, label in zip(cols, LABELS)]))
    seen = scratch.keep(seen.withColumn("text_label", decided), "files")

    # directories of every level, however deep
    parts = F.split("dir", "/")
    dirs = seen.select("dir").distinct().withColumn("parts", parts)
    dirs = dirs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("parts", 1, n), "/").alias("dir")))).alias("d"))
    dirs = dirs.select("d.dir", "d.depth").distinct()
    dirs = dirs.select("dir", "depth", F.when(F.col("depth") > 1, F.regexp_replace("dir", r"/[^/]*$", "")).alias("parent"), F.lower(F.regexp_extract("dir", r"([^/]*)$", 1)).alias("name"))
    dirs = scratch.keep(dirs.select("dir", "depth", "parent", "name", *[e.alias(c) for e, c in zip(directory_evidence(F.col("name")), cols)]), "dirs")

    holder = F.lower(F.regexp_extract("parent", r"([^/]*)$", 1))
    library = F.regexp_replace("name", r"-[0-9]+\.[0-9]+\.[0-9]+$", "")
    libraries = dirs.where(holder.isin(*VENDORED_DIRS) & ~F.col("name").isin("lib", "src", "python", "include") & ~F.col("name").startswith("@")).groupBy(library.alias("library")).agg(F.count(F.lit(1)).alias("places")).where("places >= 3")
    stem = F.regexp_replace(F.regexp_replace("base", r"\.[^.]*$", ""), r"-[0-9]+\.[0-9]+\.[0-9]+$", "")
    named = seen.withColumn("library", stem).join(libraries, "library", "left")
    known = F.col("places").isNotNull()
    belief = [F.col(c) + n + s for c, n, s in zip(cols, name_evidence(F.col("base"), known), _sizes(seen))]
    # beliefs are written before the messages are made of them: together their code would be too long to compile
    named = scratch.keep(named.select("file_key", "dir", *[b.alias(c) for b, c in zip(belief, cols)]), "beliefs")
    sent = [f"m{k}" for k in range(len(LABELS))]
    named = scratch.keep(_messages(named, [F.col(c) for c in cols], _up(FILE_GIVEN_DIR), sent), "evidence")

    levels = sorted((r[0] for r in dirs.select("depth").distinct().collect()), reverse=True)
    inbox = scratch.keep(named.groupBy("dir").agg(*sums("i")).withColumn("depth", F.size(F.split("dir", "/"))), "inbox")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    up: dict[int, DataFrame] = {}
    below: DataFrame | None = None
    for depth in levels:
        own = inbox.where(F.col("depth") == depth).drop("depth")
        got = own if below is None else own.unionByName(below).groupBy("dir").agg(*[F.sum(f"i{k}").alias(f"i{k}") for k in range(len(LABELS))])
        now = dirs.where(F.col("depth") == depth).join(got, "dir", "left")
        now = now.select("dir", "parent", *[(F.col(c) + zero(F.col(f"i{k}"))).alias(c) for k, c in enumerate(cols)])
        # a conventional name settles what a directory is whatever its parent: no message passes that edge
        now = now.withColumn("free", ~_conventional("dir"))
        now = _messages(now, [F.col(c) for c in cols], _up(DIR_GIVEN_DIR), sent).withColumns({m: F.when(F.col("free"), F.col(m)).otherwise(0.0) for m in sent})
        up[depth] = scratch.keep(now, f"up{depth}")
        below = up[depth].where("parent is not null").groupBy(F.col("parent").alias("dir")).agg(*sums("i"))
    above: DataFrame | None = None
    for depth in reversed(levels):
        if above is None:
            now = up[depth].select("dir", *[(F.col(c) + F.lit(math.log(p))).alias(c) for c, p in zip(cols, ROOT)])
        else:
            told = up[depth].alias("c").join(above.alias("p"), F.col("c.parent") == F.col("p.dir"))
            told = told.select("c.dir", "c.free", *[F.col(f"c.{c}").alias(c) for c in cols], *[(F.col(f"p.{c}") - F.col(f"c.{m}")).alias(f"r{k}") for k, (c, m) in enumerate(zip(cols, sent))])
            told = _messages(told, [F.col(f"r{k}") for k in range(len(cols))], _down(DIR_GIVEN_DIR), [f"d{k}" for k in range(len(cols))])
            now = told.select("dir", *[(F.col(c) + F.when(F.col("free"), F.col(f"d{k}")).otherwise(math.log(p))).alias(c) for k, (c, p) in enumerate(zip(cols, ROOT))])
        above = scratch.keep(now, f"down{depth}")
    if above is None:
        final = inbox.select("dir", *[F.col(f"i{k}").alias(c) for k, c in enumerate(cols)])
    else:  # one scan of all levels: a union would repeat the code of what follows for each of them
        final = files.sparkSession.read.schema(above.schema).parquet(*[f"{scratch.root}/down{d}" for d in levels])
    told = named.alias("f").join(final.alias("d"), "dir")
    told = told.select("f.file_key", *[F.col(f"f.{c}").alias(c) for c in cols], *[(F.col(f"d.{c}") - F.col(f"f.{m}")).alias(f"r{k}") for k, (c, m) in enumerate(zip(cols, sent))])
    told = _messages(told, [F.col(f"r{k}") for k in range(len(cols))], _down(FILE_GIVEN_DIR), [f"d{k}" for k in range(len(cols))])
    score = scratch.keep(told.select("file_key", *[(F.col(c) + F.col(f"d{k}")).alias(c) for k, c in enumerate(cols)]), "scores")
    score = _messages(score, [F.col(c) for c in cols], [(1.0,) * len(cols)], ["_whole"])
    whole, top = F.col("_whole"), F.greatest(*cols)
    label = F.coalesce(*[F.when(F.col(c) == top, name) for c, name in zip(cols, LABELS)])
    return score.select("file_key", label.alias("label"), F.exp(top - whole).alias("confidence"), F.exp(F.col("e0") - whole).alias("p_handwritten"))
