"""Problem 4: the language of each text and of each stretch in another language.

A bidirectional gated recurrent network reads the bytes of each white-space piece and labels every position; it is trained
in numpy by backpropagation through time on a bounded sample of pages, first under the languages their records declare,
then again after pieces whose pages it doubts were weighed down; no language is too rare to be in the sample. A piece's
probabilities pool its positions and its neighbours in the line, a line's and a text's pool those of their pieces. As the
recurrence runs within a piece, equal pieces are read once a task; over whole lines each byte of the corpus would have to be
read, which is several times the work.

Results: null and blank texts have no language, pieces without a letter none either. A text's language is the one with
most probability over the words of its body lines (those that end as sentences and stand on the page beside others that do;
all lines if there are none); ties go to the language named first in `LANGUAGES`. A page with several records counts by the latest (then the lexically last language).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.blocks import SENTENCE
from weir.llm.common import sampled
from weir.llm.plain import plain
from weir.llm.recurrent import Adam, Gru, softmax, uniform
from weir.session import cut, spread

LANGUAGES = ("en", "ne", "hi", "de")
#: What the network tells apart: the languages, and Nepali in Latin letters, which counts as the second.
CLASSES, LATIN_NEPALI = len(LANGUAGES) + 1, len(LANGUAGES)
# Names of these languages as pages declare them, before any region or script.
NAMES = {"en": "en", "eng": "en", "english": "en", "ne": "ne", "nep": "ne", "npi": "ne", "nepali": "ne", "hi": "hi", "hin": "hi", "hindi": "hi", "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de"}
#: What pages declare when they name no language.
NAMELESS = {"", "und", "unknown", "none", "null", "mul", "mis", "zxx", "xx", "x"}

#: Pages the network is trained on; steps of each round; pieces in a step.
TRAIN_PAGES, STEPS, STEP = 2500, (600, 300, 500), 160
#: Pages of each class for itself that are trained on too: all if it has no more, about half as many of a larger one; bytes a character below which a text is mostly in Latin letters.
CLASS_PAGES, LATIN_BYTES = 100, 1.8
#: Mean nats a word by which another language must fit better for a training line to be given to it.
CLEAR = 0.4
#: Width of a byte's vector and of each direction's state; bytes of a piece that are read at once.
WIDTH, HIDDEN, BYTES = 16, 24, 48
#: Weight of a neighbour's label beside a piece's own, and how far neighbours count.
NEAR, REACH = 0.6, 6
#: Nats that speak for a text's main language in each word's label.
HOME = 2.5
#: Words a line has at least to be a stretch of its own.
LINE_WORDS = 8
MARKS = " .,;:!?…।|\"'“”‘’()[]{}<>«»–—-•*/\\"
DIGITS = re.compile(r"\d+")


def declared(lang: Column) -> Column:
    """The language a record declares, null if it names none; languages other than these stay as they are spelled."""
    name = F.lower(F.element_at(F.split(F.trim(lang), "[-_ ]"), 1))
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.when(name.isNull() | name.isin(*NAMELESS), None).otherwise(F.coalesce(known[name], name))


def records(pages: DataFrame) -> DataFrame:
    """(id, lang) of the fetches that have a record."""
    best = F.max_by("lang", F.struct(F.col("fetched_at"), F.col("lang")))
    return pages.groupBy(F.col("crawled_document_id").alias("id")).agg(declared(best).alias("lang"))


def piece(word: str) -> str:
    """What is read of a white-space piece: no marks at its ends, digits as 0, lower case; empty if it has no letter."""
    core = word.strip(MARKS)
    if not core.isalpha():
        if not any(c.isalpha() for c in core):
            return ""
        core = DIGITS.sub("0", core)
    return core.lower()


class Reader:
    """The network."""

    def __init__(self, seed: int = 2):
        rng = np.random.default_rng(seed)
        p = self.params = {"E": (rng.standard_normal((257, WIDTH)) * 0.3).astype(np.float32)}
        p["Wa"], p["Wr"] = uniform(rng, WIDTH, 3 * HIDDEN), uniform(rng, WIDTH, 3 * HIDDEN)
        p["ba"], p["br"] = np.zeros(3 * HIDDEN, np.float32), np.zeros(3 * HIDDEN, np.float32)
        self.ahead, self.back = Gru("a", HIDDEN, rng, p), Gru("r", HIDDEN, rng, p)
        p["V"], p["c"] = uniform(rng, 2 * HIDDEN, CLASSES), np.zeros(CLASSES, np.float32)

    def run(self, raw: list[bytes], keep: bool) -> tuple:
        p = self.params
        sizes = np.array([len(r) for r in raw])
        n = int(sizes.max())
        codes = np.full((n, len(raw)), 256, np.int32)
        for k, r in enumerate(raw):
            codes[: len(r), k] = np.frombuffer(r, np.uint8)
        mask = (codes < 256).astype(np.float32)
        ahead, tape_a = self.ahead.forward(p, (p["E"] @ p["Wa"] + p["ba"])[codes], mask, keep)
        back, tape_r = self.back.forward(p, (p["E"] @ p["Wr"] + p["br"])[codes[::-1]], mask[::-1], keep)
        joint = np.concatenate([ahead, back[::-1]], 2)
        return softmax(joint @ p["V"] + p["c"]), joint, codes, mask, tape_a, tape_r

    def train(self, words: list[str], truth: np.ndarray, weight: np.ndarray, most: int, rate: float, seed: int) -> None:
        rng, adam, p = np.random.default_rng(seed), Adam(rate), self.params
        raw = [w.encode("utf-8", "surrogatepass")[:BYTES] for w in words]
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        steps = [order[k : k + STEP] for k in range(0, len(order), STEP)]
        for done in range(most):
            chosen = steps[rng.integers(len(steps))]
            adam.rate = rate * (1 - done / most) + 0.0005
            prob, joint, codes, mask, tape_a, tape_r = self.run([raw[i] for i in chosen], True)
            scale = weight[chosen][None, :, None] * mask[:, :, None]
            d = (prob - truth[chosen][None]) * scale / scale.sum()
            grads = {"V": joint.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, CLASSES), "c": d.sum((0, 1))}
            djoint = d @ p["V"].T
            da = self.ahead.backward(p, tape_a, djoint[:, :, :HIDDEN], grads)
            dr = self.back.backward(p, tape_r, djoint[::-1, :, HIDDEN:], grads)[::-1]
            by_byte_a, by_byte_r = np.zeros((257, 3 * HIDDEN), np.float32), np.zeros((257, 3 * HIDDEN), np.float32)
            np.add.at(by_byte_a, codes.ravel(), da.reshape(-1, 3 * HIDDEN))
            np.add.at(by_byte_r, codes.ravel(), dr.reshape(-1, 3 * HIDDEN))
            grads["Wa"], grads["Wr"] = p["E"].T @ by_byte_a, p["E"].T @ by_byte_r
            grads["ba"], grads["br"] = by_byte_a.sum(0), by_byte_r.sum(0)
            grads["E"] = by_byte_a @ p["Wa"].T + by_byte_r @ p["Wr"].T
            adam.step(p, grads)

    def read(self, words: list[str], merged: bool = True) -> np.ndarray:
        """Log-probabilities of each piece, the mean over its positions; long pieces are read in parts."""
        parts = [(k, raw[j : j + BYTES]) for k, w in enumerate(words) for raw in (w.encode("utf-8", "surrogatepass"),) for j in range(0, len(raw), BYTES)]
        parts.sort(key=lambda x: len(x[1]))
        total, positions = np.zeros((len(words), len(LANGUAGES) if merged else CLASSES)), np.zeros(len(words))
        for k in range(0, len(parts), 2048):
            chosen = parts[k : k + 2048]
            prob, _, _, mask, *_ = self.run([r for _, r in chosen], False)
            if merged:
                prob[:, :, 1] += prob[:, :, LATIN_NEPALI]
                prob = prob[:, :, : len(LANGUAGES)]
            logs = (np.log(prob + 1e-4) * mask[:, :, None]).sum(0)
            at = [i for i, _ in chosen]
            np.add.at(total, at, logs)
            np.add.at(positions, at, mask.sum(0))
        return (total / np.maximum(positions, 1)[:, None]).astype(np.float32)


class Texts:
    """The words of many texts, flat: which line and text each is in."""

    def __init__(self, texts: list[str | None], codes: dict[str, int], seen: dict[str, int]):
        words: list[int] = []
        self.lines: list[tuple[int, int, bool]] = []  # text, number, body
        counts: list[int] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            for number, line in enumerate(plain(text).split("\n")):
                found = []
                for w in line.split():
                    code = seen.get(w)
                    if code is None:
                        core = piece(w)
                        code = seen[w] = codes.setdefault(core, len(codes)) if core else -1
                    if code >= 0:
                        found.append(code)
                if found:
                    body = len(found) >= 4 and SENTENCE.search(line[-8:].rstrip()) is not None
                    self.lines.append((k, number, body))
                    counts.append(len(found))
                    words += found
        self.words, self.counts = np.array(words, np.int64), np.array(counts, np.int64)
        self.owner = np.repeat(np.arange(len(counts)), self.counts)

    def beside(self, logs: np.ndarray) -> np.ndarray:
        """Log-probabilities of each word together with its neighbours in the line."""
        own = logs[self.words]
        near = own.copy()
        for step in range(1, REACH + 1):
            same = (self.owner[step:] == self.owner[:-step])[:, None]
            near[step:] += NEAR * own[:-step] * same
            near[:-step] += NEAR * own[step:] * same
        return near

    def labels(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How sure each word's label is, and how many words of each line have each label."""
        label = near.argmax(1)
        return softmax(near)[np.arange(len(label)), label], np.bincount(self.owner * len(LANGUAGES) + label, minlength=len(self.lines) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))


def sample_of(pages: DataFrame, langs: DataFrame) -> DataFrame:
    """(id, text, lang) of pages whose record declares one of the languages, those with the smallest hash of their id.

    Besides those among all such pages, those of each class alone are taken - of a language in its own script, and of Nepali
    in Latin letters -, so that however many pages the others have, none goes untrained.
    """
    latin = F.octet_length("text") < LATIN_BYTES * F.char_length("text")
    script = pages.filter(F.col("text").rlike(r"\S")).select("id", latin.alias("latin"))
    kind = F.when(F.col("latin") == F.col("lang").isin("en", "de"), F.col("lang")).when(F.col("latin") & (F.col("lang") == "ne"), "ne-Latn")
    known = cut(langs.filter(F.col("lang").isin(*LANGUAGES)).join(script, "id", "left").select("id", "lang", kind.alias("kind")))
    sizes = {r["kind"]: r["count"] for r in known.groupBy("kind").count().collect()}
    shares = [sampled(known.filter(F.col("kind") == k), "id", CLASS_PAGES, n) for k, n in sizes.items() if k]
    few = reduce(DataFrame.unionByName, shares, sampled(known, "id", TRAIN_PAGES, sum(sizes.values()))).select("id", "lang").distinct()
    return pages.select("id", "text").filter("text IS NOT NULL").join(F.broadcast(few), "id")


def trained(pages: DataFrame, langs: DataFrame) -> Reader:
    """A reader trained on the sample."""
    sample = sorted(sample_of(pages, langs).collect(), key=lambda r: r["id"])
    reader, codes = Reader(), {}
    if not sample:
        return reader
    texts = Texts([r["text"] for r in sample], codes, {})
    words = list(codes)
    if not words:
        return reader
    language = np.array([LANGUAGES.index(r["lang"]) for r in sample])
    latin = np.array([w[0] < "\u0250" for w in words])[texts.words]
    of_text = np.array([k for k, _, _ in texts.lines])
    latin_line = np.bincount(texts.owner, latin) > 0.5 * texts.counts
    latin_text = (np.bincount(of_text[texts.owner], latin, minlength=len(sample)) > 0.5 * np.bincount(of_text[texts.owner], minlength=len(sample)))[of_text]
    line_class = language[of_text]
    line_class = np.where((line_class == 1) & latin_text, LATIN_NEPALI, line_class)
    line_class = np.where(np.isin(line_class, [0, 3, LATIN_NEPALI]) == latin_line, line_class, -1)  # a line in another script than its page's language says nothing
    body = np.array([b for _, _, b in texts.lines])
    for turn, steps in enumerate(STEPS):
        of_word = line_class[texts.owner]
        counts = [np.zeros((len(words), CLASSES), np.float32) for _ in range(2)]
        for table, kept in zip(counts, ((of_word >= 0) & body[texts.owner], (of_word >= 0) & ~body[texts.owner]), strict=True):
            np.add.at(table, (texts.words[kept], of_word[kept]), 1)
        uses = counts[0].sum(0)
        truth = counts[0] * (uses.sum() / np.maximum(uses, 1)).clip(1, 50) / CLASSES  # a rare language's pieces count as much
        around = np.flatnonzero((counts[0].sum(1) == 0) & (counts[1].sum(1) > 0))  # menus and the like stand on pages of any language: the most of these decide
        truth[around, counts[1][around].argmax(1)] += np.minimum(counts[1][around].max(1), 50)
        truth += 0.02
        total = truth.sum(1, keepdims=True)
        reader.train(words, truth / total, np.log1p(total[:, 0]), steps, 0.012 if turn == 0 else 0.006, 5 + turn)
        logs = reader.read(words, merged=False)
        pooled = np.zeros((len(texts.lines), CLASSES))
        np.add.at(pooled, texts.owner, logs[texts.words])
        best = pooled.argmax(1)
        clear = (line_class >= 0) & ((pooled.max(1) - pooled[np.arange(len(best)), line_class]) / np.maximum(texts.counts, 1) > CLEAR)
        line_class = np.where(clear, best, line_class)  # the page's label doesn't hold for this line
    return reader


def recognised(pages: DataFrame, langs: DataFrame) -> DataFrame:
    """(id, line_no, words, lang, confidence, main, main_confidence) of every line with words, and of each text as line -1."""
    shared = pages.sparkSession.sparkContext.broadcast(trained(pages, langs))
    names = np.array(LANGUAGES, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, codes, seen = shared.value, {}, {}
        logs = np.zeros((0, len(LANGUAGES)), np.float32)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                if len(codes) > 300_000 or len(seen) > 600_000:
                    codes, seen, logs = {}, {}, logs[:0]
                texts = Texts(part.column(1).to_pylist(), codes, seen)
                if not texts.lines:
                    continue
                fresh = list(codes)[len(logs) :]
                if fresh:
                    logs = np.concatenate([logs, reader.read(fresh)])
                near = texts.beside(logs)
                share = np.zeros((len(texts.lines), len(LANGUAGES)))
                np.add.at(share, texts.owner, softmax(near))
                text, number, body = (np.array(x) for x in zip(*texts.lines, strict=True))
                pooled, every = np.zeros((part.num_rows, len(LANGUAGES))), np.zeros((part.num_rows, len(LANGUAGES)))
                np.add.at(pooled, text[body], share[body])
                np.add.at(every, text, share)
                pooled = np.where(pooled.sum(1, keepdims=True) > 0, pooled, every)
                main = pooled.argmax(1)
                main_sure = pooled.max(1) / np.maximum(pooled.sum(1), 1)
                near[np.arange(len(near)), main[text[texts.owner]]] += HOME  # a line is in its text's language unless it says otherwise
                sure, counts = texts.labels(near)
                mean = np.bincount(texts.owner, sure, minlength=len(counts)) / texts.counts
                own = counts.argmax(1)
                words = np.bincount(text, texts.counts, minlength=part.num_rows)
                whole = np.flatnonzero(words > 0)
                ids = part.column(0).to_numpy()
                columns = [
                    pa.array(np.concatenate([ids[text], ids[whole]])),
                    pa.array(np.concatenate([number, np.full(len(whole), -1)]).astype(np.int32)),
                    pa.array(np.concatenate([texts.counts, words[whole]]).astype(np.int32)),
                    pa.array(np.concatenate([counts.max(1), np.rint(every.max(1))[whole]]).astype(np.int32)),
                    pa.array(np.concatenate([names[own], names[main[whole]]])),
                    pa.array(np.concatenate([mean, main_sure[whole]])),
                    pa.array(np.concatenate([names[main[text]], names[main[whole]]])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "line_no", "words", "most", "lang", "confidence", "main"])

    return spread(pages.select("id", "text").filter("text IS NOT NULL")).mapInArrow(run, "id long, line_no int, words int, most int, lang string, confidence double, main string")


def stretches(pages: DataFrame, page_records: DataFrame) -> DataFrame:
    """(id, line_no, lang, confidence, declared, wrong): each text's language, with whether its record fails to say so, and each line of enough words mostly in another one."""
    langs = records(page_records)
    all_lines = recognised(pages, langs)
    kept = all_lines.filter(f"line_no = -1 OR words >= {LINE_WORDS} AND lang <> main AND 2 * most > words")
    joined = kept.join(langs.withColumnRenamed("lang", "declared"), "id", "left")
    return joined.select("id", "line_no", "lang", "confidence", "declared", ((F.col("line_no") >= 0) | ~F.col("declared").eqNullSafe(F.col("lang"))).alias("wrong"))
