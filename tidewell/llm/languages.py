"""Problem 8: the languages of documents and of their sentences, with a confidence.

Word-first backoff: a word the model knows is scored by its log frequency in each language; any other word by the
longest character n-grams it is made of that the model knows, from five characters down to one. Scores are
relative to the best language and bounded per word, so that a name cannot outweigh a sentence. A text is cut
into sentences at closing punctuation and blank lines; each sentence takes the language of the highest sum, with
its posterior probability as confidence; the document's languages are those of its whole sentences.

The model is counted from a sample of labelled documents, about ``SAMPLE`` of each language, chosen by hash; a second
round counts the sentences of the sample again under the language the first round gives them, which undoes wrong
and mixed labels. At most ``KNOWN`` words of each language are kept, so that the model sent to the tasks is a few
megabytes. Every document is classified whole.

Defined results: null or blank text, or text without letters, has no language; ties take the first of ``LANGUAGES``;
a text without one whole sentence (logs, tables) has the language of all its words; code fences are not read;
repeated rows are classified each; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.shared import Scratch

LANGUAGES = ("en", "de", "fr", "es", "it", "pt")
#: Usual names of the languages: codes of two and three letters and the English name.
NAMES = {
    "en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german"), "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"), "it": ("it", "ita", "italian"), "pt": ("pt", "por", "portuguese"),
}
SAMPLE, KNOWN = 1500, 20_000
#: A word counts for at most so many nats between two languages.
BOUND = 4.0
#: Words that a whole sentence has at least, and its least lead over the second language in nats.
LEAST, LEAD = 4, 4.0
_WORD = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_END = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|\n\s*\n")
_WHOLE = re.compile(r"[.!?…][\"'»”)\]]*\s*$")


def named_language(label: Column) -> Column:
    """The language a label names in any usual way, else null."""
    bare = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:[-_ ].*)?$", 1))
    return F.coalesce(*[F.when(bare.isin(*names), code) for code, names in NAMES.items()])


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the sentences of a text; whole ones close with punctuation."""
    masked = _FENCE.sub(lambda m: "\n\n" + " " * max(0, len(m.group()) - 4) + "\n\n" if len(m.group()) >= 4 else m.group(), text)
    out, begin = [], 0
    for m in _END.finditer(masked):
        if masked[begin : m.start()].strip():
            out.append((begin, m.start(), bool(_WHOLE.search(masked[begin : m.start()].rstrip() + masked[m.start() : m.end()].rstrip()))))
        begin = m.end()
    if masked[begin:].strip():
        out.append((begin, len(masked), bool(_WHOLE.search(masked[begin:]))))
    return out


class Model:
    """Log frequencies of words and character n-grams by language."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        size = len(LANGUAGES)
        totals = np.array([sum(counts.get(g, {}).values()) + 1.0 for g in LANGUAGES])
        table: dict[str, np.ndarray] = {}
        for k, g in enumerate(LANGUAGES):
            for w, n in counts.get(g, {}).items():
                table.setdefault(w, np.zeros(size))[k] = n
        self.words = {w: self._relative(v, totals) for w, v in table.items() if v.sum() >= 2}
        grams: dict[str, np.ndarray] = {}
        for w, v in table.items():
            weight = np.sqrt(v)
            framed = f"^{w}$"
            for n in range(1, 6):
                for j in range(len(framed) - n + 1):
                    grams.setdefault(framed[j : j + n], np.zeros(size)).__iadd__(weight)
        sums = np.array([sum(math.sqrt(n) for n in counts.get(g, {}).values()) + 1.0 for g in LANGUAGES])
        self.grams = {g: self._relative(v, sums * 5) for g, v in grams.items() if v.sum() >= 2}
        self.seen: dict[str, np.ndarray] = {}

    @staticmethod
    def _relative(v: np.ndarray, totals: np.ndarray) -> np.ndarray:
        score = np.log((v + 0.3) / totals)
        return np.maximum(score - score.max(), -BOUND).astype(np.float32)

    def word(self, w: str) -> np.ndarray:
        got = self.words.get(w)
        if got is None:
            got = self.seen.get(w)
        if got is None:
            framed, at, total, parts = f"^{w}$", 0, np.zeros(len(LANGUAGES), dtype=np.float32), 0
            while at < len(framed):
                for n in range(min(5, len(framed) - at), 0, -1):
                    gram = self.grams.get(framed[at : at + n])
                    if gram is not None:
                        total += gram * (n / 5)
                        parts += 1
                        break
                at += max(1, n - 1)
            got = np.maximum(total / max(1, parts) * 1.0, -BOUND / 2)
            if len(self.seen) < 200_000:
                self.seen[w] = got
        return got

    def score(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(len(LANGUAGES), dtype=np.float32)
        return np.sum([self.word(w) for w in words], axis=0)


def posterior(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max())
    return p / p.sum()


def segments(model: Model, text: str) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, language, confidence, counts) of the sentences with words; ``counts`` marks whole, sure ones."""
    out = []
    for begin, end, whole in sentences(text):
        words = _WORD.findall(text[begin:end].lower())
        if not words:
            continue
        score = model.score(words)
        first, second = np.sort(score)[::-1][:2]
        k = int(score.argmax())
        out.append((begin, end, LANGUAGES[k], float(posterior(score)[k]), whole and len(words) >= LEAST and first - second >= LEAD))
    return out


def languages_of(model: Model, text: str | None) -> list[tuple[str, float, int]]:
    """(language, confidence, sentences) of a document, its most frequent language first."""
    if text is None or not _WORD.search(text):
        return []
    sure: dict[str, list[float]] = {}
    for begin, end, language, confidence, counts in segments(model, text):
        if counts:
            sure.setdefault(language, []).append(confidence)
    if sure:
        return sorted(((g, float(np.mean(c)), len(c)) for g, c in sure.items()), key=lambda x: (-x[2], LANGUAGES.index(x[0])))
    p = posterior(model.score(_WORD.findall(text.lower())))
    return [(LANGUAGES[int(p.argmax())], float(p.max()), 0)]


def _count_model(sample: DataFrame, model: Model | None, known: int) -> Model:
    """Words of the sample's sentences by language: the label's, or what ``model`` says of each sentence."""
    shared = None if model is None else sample.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                if shared is None:
                    parts = [(label, text)]
                else:
                    parts = [(g, text[b:e]) for b, e, g, sure, counts in segments(shared.value, text) if sure > 0.9]
                for language, part in parts:
                    seen.update((language, w) for w in _WORD.findall(part.lower()))
        rows = [(g, w, n) for (g, w), n in seen.items()]
        yield pd.DataFrame(rows, columns=["label", "word", "n"]).astype({"label": "object", "word": "object", "n": "int64"})

    counted = sample.mapInPandas(count, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n"))
    # bounded: `known` words of each language
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "word"))
    counts: dict[str, dict[str, int]] = {g: {} for g in LANGUAGES}
    for label, word, n in counted.withColumn("rank", rank).where(F.col("rank") <= known).select("label", "word", "n").collect():
        counts[label][word] = n
    return Model(counts)


def fit(documents: DataFrame, scratch: Scratch, *, sample: int = SAMPLE, known: int = KNOWN) -> Model:
    """The model of a corpus, counted from about ``sample`` labelled documents of each language, which are written once."""
    labelled = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text", named_language(F.col("lang")).alias("label")).where("label is not null")
    numbers = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("label") == g, min(1.0, sample / n)) for g, n in numbers.items()], F.lit(0.0)) if numbers else F.lit(0.0)
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000
    drawn = scratch.keep(labelled.where(chosen).select("text", "label"), "sample")
    return _count_model(drawn, _count_model(drawn, None, known), known)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document and language: doc_id, named (what its label names), language, confidence, sentences, languages."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, named, text in zip(batch["doc_id"], batch["named"], batch["text"]):
                found = languages_of(shared.value, text)
                rows += [(doc_id, named, *f, len(found)) for f in found]
            yield pd.DataFrame(rows, columns=["doc_id", "named", "language", "confidence", "sentences", "languages"])

    asked = documents.select("doc_id", named_language(F.col("lang")).alias("named"), "text").where("doc_id is not null")
    return asked.mapInPandas(classify, "doc_id bigint, named string, language string, confidence double, sentences int, languages int")


def segment_languages(documents: DataFrame, model: Model) -> DataFrame:
    """One row per sentence with words: doc_id, segment_no, segment_start, segment_end, language, confidence."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, b, e, g, c) for d, t in zip(batch["doc_id"], batch["text"]) if t is not None for k, (b, e, g, c, _) in enumerate(segments(shared.value, t))]
            yield pd.DataFrame(rows, columns=["doc_id", "segment_no", "segment_start", "segment_end", "language", "confidence"])

    asked = documents.select("doc_id", "text").where("doc_id is not null")
    return asked.mapInPandas(classify, "doc_id bigint, segment_no int, segment_start int, segment_end int, language string, confidence double")


def mislabelled(found: DataFrame) -> DataFrame:
    """(doc_id, language) of documents whose label is missing or wrong, or that mix languages."""
    right = F.max(F.coalesce(F.col("named") == F.col("language"), F.lit(False)).cast("int"))
    docs = found.groupBy("doc_id").agg(right.alias("right"), F.collect_set("language").alias("all"))
    return docs.where((F.col("right") == 0) | (F.size("all") > 1)).select("doc_id", F.explode("all").alias("language"))
