"""Problem 10: the reading level of each document.

From the graded documents each word gets the grade at which it is acquired: the share of its use in each grade, evened out
for how much text a grade has, gives the grade by which half of its use is reached. A document is described by quantiles
of the grades of its known words; a small ordinal calibration, fitted on the graded documents, turns them into a level.

Which language a text is in is told by the words it has: each word's share in the texts of each declared language, counted on a
bounded sample whose declarations may be missing or wrong here and there, compared among the languages of the text's script.

Results: null, empty and blank texts, and texts without a known word, have a null level. Documents in other languages get a
level as far as their words are known; `language` says which they are in by their text. Two grades of one document both
count. Words of equal grade are interchangeable; repeated texts get the same level; very long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import sampled
from weir.llm.recurrent import softmax
from weir.session import spread

#: Graded documents the word grades and the calibration are fitted on at most: those with the smallest hash of their id.
FIT_DOCUMENTS = 40_000
#: Times a word stands in them at least to be known; most of its use that one grade must have beyond an even share.
LEAST_USES, LEAST_SHARE = 3, 0.4
#: Shares of the known words at which a document's word grades are read off.
QUANTILES = (0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95)
#: Words a document has at least for a level that is worth comparing.
LEAST_WORDS = 40
GRADES = 4

EDGE = regex.compile(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$")
#: Documents the words of languages are counted on at most; how often a word stands in them at least.
LANGUAGE_DOCUMENTS, LANGUAGE_USES = 12_000, 3
#: What is declared and in which script, and what it is called here: Nepali in Latin letters is a language of its own.
SPOKEN = {("en", False): "en", ("de", False): "de", ("ne", False): "ne-latn", ("ne", True): "ne", ("hi", True): "hi"}


def words_of(text: str) -> list[str]:
    """The words with at least one letter, lower case, without marks at their ends."""
    return [w for w in (EDGE.sub("", p) if not p.isalpha() else p for p in text.lower().split()) if w and not w.isdigit()]


def in_devanagari(words: list[str]) -> bool:
    return 2 * sum("ऀ" <= w[0] <= "ॿ" for w in words) > len(words)


class Languages:
    """How likely each known word is in each language, apart for the two scripts."""

    def __init__(self, texts: list[tuple[list[str], str]]):
        self.names = {script: [name for (_, s), name in SPOKEN.items() if s == script] for script in (False, True)}
        counts: dict[bool, list[Counter]] = {script: [Counter() for _ in names] for script, names in self.names.items()}
        for words, declared in texts:
            script = in_devanagari(words)
            name = SPOKEN.get((declared, script))
            if name is not None:
                counts[script][self.names[script].index(name)].update(words)
        self.known: dict[bool, dict[str, int]] = {}
        self.logs: dict[bool, np.ndarray] = {}
        for script, each in counts.items():
            uses = sum(each, Counter())
            self.known[script] = {w: k for k, w in enumerate(sorted(w for w, n in uses.items() if n >= LANGUAGE_USES))}
            size = [sum(c.values()) for c in each]
            unseen = 0.5 * max(len(self.known[script]), 1)
            # a language nothing is declared in is never the likeliest
            table = np.array([[(c[w] + 0.5) / (n + unseen) if n else 1e-30 for c, n in zip(each, size, strict=True)] for w in self.known[script]]).reshape(-1, len(each))
            self.logs[script] = np.log(table)

    def of(self, words: list[str]) -> str | None:
        """The likeliest language of the script most words are in; null without a known word."""
        if not words:
            return None
        script = in_devanagari(words)
        get = self.known[script].get
        found = [k for w in words if (k := get(w)) is not None]
        return self.names[script][int(self.logs[script][found].sum(0).argmax())] if found else None


def spoken(documents: DataFrame) -> Languages:
    """Counted on documents that declare one of the languages, those with the smallest hash of their id."""
    declared = documents.select("doc_id", "text", F.lower("lang").alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isin("en", "de", "ne", "hi"))
    rows = sampled(declared, "doc_id", LANGUAGE_DOCUMENTS, declared.count()).collect()
    return Languages([(words_of(r["text"]), r["lang"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


class Grader:
    """Word grades and the calibration."""

    def __init__(self, grades: dict[str, float], weights: np.ndarray):
        self.grades, self.weights = grades, weights

    def describe(self, words: list[str]) -> np.ndarray | None:
        known = sorted(g for g in map(self.grades.get, words) if g is not None)
        if not known:
            return None
        return np.array([known[min(len(known) - 1, int(q * len(known)))] for q in QUANTILES])

    def levels(self, rows: np.ndarray) -> np.ndarray:
        return softmax(inputs(rows) @ self.weights)


def inputs(rows: np.ndarray) -> np.ndarray:
    """Quantiles around the middle grade, how near each is to each grade, and a constant."""
    near = [np.exp(-np.square((rows - g) / 0.5)) for g in range(1, GRADES + 1)]
    return np.concatenate([(rows - 2.5) / 2, *near, np.ones((len(rows), 1))], 1)


def word_grades(graded: list[tuple[list[str], int]]) -> dict[str, float]:
    """The acquisition grade of each known word."""
    uses: dict[str, np.ndarray] = {}
    size = np.zeros(GRADES)
    for words, grade in graded:
        size[grade - 1] += len(words)
        for w in words:
            found = uses.get(w)
            if found is None:
                found = uses[w] = np.zeros(GRADES)
            found[grade - 1] += 1
    grades = {}
    for w, n in uses.items():
        if n.sum() >= LEAST_USES:
            share = n / np.maximum(size, 1)
            share = share / share.sum()
            if share.max() >= LEAST_SHARE:
                reached = np.concatenate([[0], np.cumsum(share)])
                k = int(np.searchsorted(reached, 0.5)) - 1
                grades[w] = k + 0.5 + float((0.5 - reached[k]) / max(share[k], 1e-9))
    return grades


def calibrated(grades: dict[str, float], graded: list[tuple[list[str], int]], steps: int = 400) -> Grader:
    """Multinomial regression from quantiles to grades, by gradient steps."""
    grader = Grader(grades, np.zeros((len(QUANTILES) * (GRADES + 1) + 1, GRADES)))
    pairs = [(d, g) for words, g in graded if (d := grader.describe(words)) is not None]
    if not pairs:
        return grader
    x, y = inputs(np.array([d for d, _ in pairs])), np.eye(GRADES)[[g - 1 for _, g in pairs]]
    moment = np.zeros_like(grader.weights)
    for _ in range(steps):
        moment = 0.9 * moment + x.T @ (softmax(x @ grader.weights) - y) / len(x) + 1e-4 * grader.weights
        grader.weights -= 0.3 * moment
    return grader


def fitted(documents: DataFrame, labels: DataFrame) -> Grader:
    """Fitted on the graded documents, a bounded number of which comes to the driver."""
    kept = labels.filter(f"grade_level BETWEEN 1 AND {GRADES}").select("doc_id", "grade_level")
    few = sampled(kept, "doc_id", FIT_DOCUMENTS, kept.count())
    rows = documents.select("doc_id", "text").filter("text IS NOT NULL").join(few, "doc_id").collect()
    graded = [(words_of(r["text"]), r["grade_level"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["grade_level"]))]
    grades = word_grades(graded)
    return calibrated(grades, graded)


def graded(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, words, language, level, confidence) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast((fitted(documents, labels), spoken(documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grader, tongues = shared.value
        for batch in batches:
            counts, languages, rows, known = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text or "")
                counts.append(len((text or "").split()))
                languages.append(tongues.of(words))
                if (row := grader.describe(words)) is not None:
                    rows.append(row)
                    known.append(k)
            level, confidence = [None] * batch.num_rows, [None] * batch.num_rows
            if rows:
                for k, p in zip(known, grader.levels(np.array(rows)), strict=True):
                    level[k], confidence[k] = int(p.argmax()) + 1, float(p.max())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(languages, pa.string()), pa.array(level, pa.int32()), pa.array(confidence, pa.float64())], names=["doc_id", "words", "language", "level", "confidence"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, words int, language string, level int, confidence double")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, grade_level) of the ungraded documents in English or in Nepali in Devanagari that are long enough."""
    wanted = graded(documents, labels).filter((F.col("words") >= LEAST_WORDS) & F.col("language").isin("en", "ne") & F.col("level").isNotNull())
    return wanted.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("level").alias("grade_level"))
