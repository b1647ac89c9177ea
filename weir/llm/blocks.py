"""Problem 5: the main body of a page among menus, notices, side columns and page ends.

Every line of a page is a block. A block is read as the hashed words of the whole line and a path vector (the text has no
tags: heading levels, the page's title, list marks, separators, place). A bidirectional LSTM in numpy reads the blocks of
the whole page in order and labels each. It is trained, whenever the operator runs, on a bounded sample of pages, all lines
of them, labelled by structure alone (`labels`): how many pages of its host a line stands on, the levels at which pages
list it among their headings, the page's title and how lines follow each other. No wording is given. Lines that structure
doesn't tell carry no loss; the network reads them by their words and surroundings. Some sampled pages are damaged on
purpose so that lost letters don't mislead it.

Results: null and blank texts have no blocks; blank lines get no label; pages of any length are read whole. The sample is
about `TRAIN_HOSTS` hosts of at least `HOST_LEAST` pages, those with the smallest hash of their name, and about `HOST_PAGES`
pages of each; if no host has so many pages, about as many pages of any host.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import sampled
from weir.llm.plain import plain
from weir.llm.recurrent import Adam, Lstm, uniform
from weir.session import spread

#: Hosts the model is trained on, pages a host has at least and pages taken of it, about; most pages if no host has so many.
TRAIN_HOSTS, HOST_LEAST, HOST_PAGES, TRAIN_PAGES = 90, 12, 22, 2000
#: Passes over the pages; stretches in a step; share of damaged copies.
PASSES, STEP_PAGES, DAMAGED = 6, 32, 0.3
#: Lines of a stretch of a page that is trained on at once; longer pages are several stretches.
STRETCH = 120
#: Slots of hashed words, width of a word's vector, of the path vector, of each direction's state.
WORD_SLOTS, WORD_WIDTH, PATH_WIDTH, HIDDEN = 1 << 13, 24, 24, 20
#: Share of a host's pages from which a line is furniture of the host, and up to which it is a page's own.
OFTEN, SELDOM = 0.3, 0.15
#: Hosts from which on a line is no host's own.
SPREAD = 3
#: Probability from which a line counts as outside the body.
LEVEL = 0.5
#: Lines a task remembers the reading of.
REMEMBERED = 100_000

SEPARATED = re.compile(r" ?[|»›•·] ?| :: | / | – | > |  +")
SENTENCE = re.compile(r"[.।!…”\"’']\W*$")
LIST = re.compile(r"^\s*(?:[-•*–]|0+[).]) ")
SHAPE = re.compile(r"[\wऀ-ॿ‍?�]+|[^\w\s]")
DIGITS = re.compile(r"\d+")
#: Words, and marks as words of their own.
WORD = re.compile(r"[^\s.,;:!?|»›•·/–<>()\[\]\"“”‘’©।=+*#@%&…-]+|\S")


def hashed(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % (WORD_SLOTS - 1) + 1


class Memory(dict):
    """The slots of words, each hashed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = hashed(word)
        return found


SLOT = Memory()


def features(line: str, low: str) -> tuple[list[int], list[float], bool]:
    """Slots of all words of a line, of its first pair and last word; the part of the path vector it has by itself; whether it has separators.

    Where letters are lost, the lengths of the words stand in for them.
    """
    found = WORD.findall(low)
    words = [SLOT[w] for w in found]
    lost = "�" in line or "??" in line
    if found:
        words += [SLOT["^" + found[0]], SLOT["^" + " ".join(found[:2])], SLOT[found[-1] + "$"]]
    if lost:
        shape = [str(min(len(w), 12)) if w[0].isalnum() or w[0] in "?�" else w for w in SHAPE.findall(line)]
        words += [SLOT["#" + a + " " + b] for a, b in zip(["", *shape], shape, strict=False)]
    number = line.count(" ") + 1
    parts = len(SEPARATED.findall(line)) if number > 1 or "|" in line else 0
    end = line[-12:]
    shape = [min(number, 30) / 10, float(number <= 3), float(number >= 12), float(SENTENCE.search(end) is not None), float(end.endswith("?")), float(LIST.match(low) is not None), min(parts, 6) / 3, float(line.isupper()), float("0" in low), float(lost)]
    return words or [0], shape, parts > 0


class Page:
    """The non-blank lines of a page: their numbers, hashed words and path vectors."""

    def __init__(self, text: str, title: str | None, headings: list | None, memo: dict):
        raw = plain(text).split("\n")
        self.numbers = [k for k, line in enumerate(raw) if line and not line.isspace()]
        self.lines = [raw[k].strip() for k in self.numbers]
        self.lowered = [line.lower() for line in self.lines]
        self.low = [DIGITS.sub("0", line) for line in self.lowered]
        self.title = plain(title).strip().lower() if title else ""
        self.heads: dict[str, int] = {}
        self.first = ""
        for h in headings or []:
            if h and h["text"]:
                name = plain(h["text"]).strip().lower()
                self.heads.setdefault(name, int(h["level"] or 1))
                self.first = self.first or (name if (h["level"] or 1) == 1 else "")
        known = []
        for line, low in zip(self.lines, self.low, strict=True):
            found = memo.get(low)
            if found is None:
                if len(memo) > REMEMBERED:
                    memo.clear()
                found = memo[low] = features(line, low)
            known.append(found)
        self.words = [k[0] for k in known]
        crumbs = {SEPARATED.split(line)[-1].strip() for line, k in zip(self.lowered, known, strict=True) if k[2] and len(line) < 200}
        self.tails = tuple(c for c in crumbs if len(c) >= 8)
        self.is_title = [self.titled(line) for line in self.lowered]
        self.is_crumb = [k[2] and not title and self.crumb(line) for line, k, title in zip(self.lowered, known, self.is_title, strict=True)]
        paths, seen, count, before, heads = [], 0, len(self.lines), -1, self.heads
        named, size, last = bool(self.title or self.first), min(count, 60) / 30, max(1, count - 1)
        for k, number in enumerate(self.numbers):
            level, title = heads.get(self.lowered[k], 0), self.is_title[k]
            seen = seen or title
            paths.append((*known[k][1], level == 1, level == 2, level > 2, title, seen, k > 0 and number - before > 1, k / last, k == 0, k == count - 1, named, self.is_crumb[k], size, 1.0, bool(heads)))
            before = number
        self.paths = np.array(paths, np.float32).reshape(count, PATH_WIDTH)

    def titled(self, low: str) -> int:
        """Whether a line is the page's own title: as the title or first heading has it, or as a breadcrumb begins it."""
        if low == self.first or low == self.title:
            return 1
        if len(low) < 6:
            return 0
        if self.title and low in self.title and len(low) > 0.4 * len(self.title):
            return 1
        return int(low.startswith(self.tails) and low not in self.tails)

    def crumb(self, low: str) -> bool:
        """Whether a line ends, after a separator, with the page's title or its beginning."""
        tail = SEPARATED.split(low)[-1].strip()
        return len(tail) >= 8 and (self.first.startswith(tail) or tail in self.title)


class Host:
    """What the sampled pages of one host, and the headings of all, say about lines."""

    def __init__(self, pages: list[Page]):
        self.size = len(pages)
        self.on = Counter(low for p in pages for low in set(p.low))

    def share(self, low: str) -> float | None:
        """On what share of the host's pages a line stands; null if too few are known."""
        return self.on[low] / self.size if self.size >= HOST_LEAST // 2 else None


def heading_levels(pages: list[Page]) -> dict[str, int]:
    """Of each line that pages list among their headings, the level at which most do: 2 for parts of the body, 3 for what is below."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for p in pages:
        for name, level in p.heads.items():
            if level > 1:
                votes[DIGITS.sub("0", name)][min(level, 3)] += 1
    return {name: max(count, key=lambda x: (count[x], x)) for name, count in votes.items()}


def labels(page: Page, host: Host, levels: dict[str, int], common: dict[str, int]) -> np.ndarray:
    """1 outside the body, 0 body, -1 not known: what structure says of a page's lines.

    `levels` are the usual levels of headings, `common` on how many hosts a line stands.
    """
    count = len(page.lines)
    out = np.full(count, -1, np.int8)
    sentence = [SENTENCE.search(line[-12:]) is not None and line.count(" ") >= 3 for line in page.lines]
    share = [host.share(low) for low in page.low]
    own = [s is None or s <= SELDOM for s in share]
    last_own = max((k for k in range(count) if sentence[k] and own[k]), default=-1)
    mode, titled = "", False
    for k, low in enumerate(page.low):
        level = page.heads.get(page.lowered[k]) or levels.get(low, 0)
        if page.is_title[k]:
            out[k], mode, titled = 0, "title", True
        elif level == 2:
            out[k], mode = 0, "body"
        elif level > 2:
            out[k], mode = 1, "side"
        elif page.is_crumb[k]:
            out[k], mode = 1, ""
        elif share[k] is not None and share[k] >= OFTEN:
            opening = sentence[k] and mode == "title" and k < last_own  # the first sentence below the title, before the page's own
            out[k] = 0 if opening else 1
            mode = "body" if opening else mode if mode in ("title", "body") and titled else ""
        elif sentence[k] and own[k]:
            out[k] = 0 if mode == "title" or common.get(low, 0) < SPREAD else -1  # what many hosts say somewhere may be a notice
            mode = "body"
        elif LIST.match(low) and own[k]:
            out[k] = 0 if mode in ("body", "title") else -1
        elif mode == "side" and own[k]:
            out[k] = 1
        elif mode == "body" and own[k] and common.get(low, 0) >= SPREAD and k > 0 and out[k - 1] == 0:
            out[k] = 0
    return out


def damaged(text: str, rng: np.random.Generator) -> str:
    """The text with its letters beyond ASCII lost, all or most of them, in all or some of its lines."""
    mark, share, lines = "?�"[rng.integers(2)], rng.choice([1.0, 0.7]), rng.choice([1.0, 0.4])
    out = []
    for line in text.split("\n"):
        if rng.random() < lines:
            line = "".join(mark if ord(c) > 127 and rng.random() < share else c for c in line)
        out.append(line)
    return "\n".join(out)


class Labeller:
    """The network: word vectors, two directions, and one score a line."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        p = self.params = {"E": (rng.standard_normal((WORD_SLOTS, WORD_WIDTH)) * 0.1).astype(np.float32)}
        width = WORD_WIDTH + PATH_WIDTH
        self.ahead, self.back = Lstm("a", width, HIDDEN, rng, p), Lstm("r", width, HIDDEN, rng, p)
        p["V"], p["c"] = uniform(rng, 2 * HIDDEN + width, 1), np.zeros(1, np.float32)

    def inputs(self, rows: list[tuple[list[list[int]], np.ndarray]]) -> tuple:
        """Of sequences of lines (words, paths): the input, its mask, and what leads back from a line's vector to its words."""
        sizes = [len(words) for words, _ in rows]
        n = max(sizes)
        x, mask = np.zeros((n, len(rows), WORD_WIDTH + PATH_WIDTH), np.float32), np.zeros((n, len(rows)), np.float32)
        words = [w for part, _ in rows for w in part]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((s for w in words for s in w), np.int32, int(counts.sum()))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        weight = (1 / np.sqrt(counts)).astype(np.float32)
        vectors = np.add.reduceat(self.params["E"][flat], starts) * weight[:, None]
        at = 0
        for k, size in enumerate(sizes):
            x[:size, k, :WORD_WIDTH] = vectors[at : at + size]
            x[:size, k, WORD_WIDTH:] = rows[k][1]
            mask[:size, k] = 1
            at += size
        return x, mask, sizes, flat, counts, weight

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple:
        p = self.params
        ahead, tape_a = self.ahead.forward(p, x, mask, keep)
        back, tape_r = self.back.forward(p, x[::-1], mask[::-1], keep)
        joint = np.concatenate([ahead, back[::-1], x], 2)
        score = (joint @ p["V"])[:, :, 0] + p["c"][0]
        return 1 / (1 + np.exp(-score)), joint, tape_a, tape_r

    def train(self, pages: list[Page], truth: list[np.ndarray], seed: int = 11) -> None:
        rng, adam = np.random.default_rng(seed), Adam(0.01)
        p = self.params
        rows, known = [], []
        for page, y in zip(pages, truth, strict=True):
            for k in range(0, len(y), STRETCH):
                rows.append((page.words[k : k + STRETCH], page.paths[k : k + STRETCH]))
                known.append(y[k : k + STRETCH])
        by_length = sorted(range(len(rows)), key=lambda k: len(known[k]))
        steps = [by_length[k : k + STEP_PAGES] for k in range(0, len(rows), STEP_PAGES)]
        for turn in range(PASSES):
            adam.rate = 0.01 * (1 - turn / PASSES) + 0.001
            for k in rng.permutation(len(steps)):
                x, mask, sizes, flat, counts, weight = self.inputs([rows[i] for i in steps[k]])
                prob, joint, tape_a, tape_r = self.run(x, mask, True)
                d = np.zeros_like(prob)
                for j, i in enumerate(steps[k]):
                    y = known[i]
                    d[: sizes[j], j] = np.where(y < 0, 0, prob[: sizes[j], j] - y)
                d /= max(1.0, float((d != 0).sum()))
                grads = {"V": joint.reshape(-1, joint.shape[2]).T @ d.reshape(-1, 1), "c": np.array([d.sum()], np.float32)}
                djoint = d[:, :, None] * p["V"][:, 0]
                dx = djoint[:, :, 2 * HIDDEN :].copy()
                dx += self.ahead.backward(p, x, tape_a, djoint[:, :, :HIDDEN], grads)
                dx += self.back.backward(p, x[::-1], tape_r, djoint[::-1, :, HIDDEN : 2 * HIDDEN], grads)[::-1]
                dlines = np.concatenate([dx[:size, j, :WORD_WIDTH] for j, size in enumerate(sizes)]) * weight[:, None]
                table = np.zeros_like(p["E"])
                np.add.at(table, flat, np.repeat(dlines, counts, axis=0))
                grads["E"] = table
                adam.step(p, grads)

    def predict(self, pages: list[Page]) -> list[np.ndarray]:
        """The probability of each line of each page to be outside the body."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k].lines), key=lambda k: len(pages[k].lines))
        at = 0
        while at < len(order):
            size = max(1, min(256, 40_000 // len(pages[order[at]].lines)))
            chosen = order[at : at + size]
            x, mask, sizes, *_ = self.inputs([(pages[k].words, pages[k].paths) for k in chosen])
            prob = self.run(x, mask, False)[0]
            for j, k in enumerate(chosen):
                out[k] = prob[: sizes[j], j]
            at += size
        return out


def fitted(rows: list[dict], seed: int = 5) -> Labeller:
    """A labeller trained on these pages (host, title, text, headings), labelled by their structure."""
    rng = np.random.default_rng(seed)
    memo: dict = {}
    pages = [Page(r["text"], r["title"], r["headings"], memo) for r in rows]
    by_host: dict[str | None, list[Page]] = defaultdict(list)
    for r, page in zip(rows, pages, strict=True):
        by_host[r["host"]].append(page)
    hosts = {name: Host(own) for name, own in by_host.items()}
    levels, common = heading_levels(pages), Counter(low for host in hosts.values() for low in host.on)
    kept, truth = [], []
    for r, page in zip(rows, pages, strict=True):
        if not page.lines:
            continue
        known = labels(page, hosts[r["host"]], levels, common)
        if rng.random() < DAMAGED:
            page = Page(damaged(r["text"], rng), r["title"] if rng.random() < 0.5 else None, r["headings"] if rng.random() < 0.5 else None, memo)
            if len(page.lines) != len(known):
                continue
        kept.append(page)
        truth.append(known)
    labeller = Labeller()
    if kept:
        labeller.train(kept, truth)
    return labeller


def sample_of(pages: DataFrame) -> list[dict]:
    """The pages the labeller is trained on: a bounded number, whole, of a bounded number of hosts."""
    full = pages.filter("text IS NOT NULL AND trim(text) <> ''").select("id", "host", "title", "text", "headings")
    sizes = full.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= HOST_LEAST)
    number = sizes.count()
    if not number:
        found = sampled(full, "id", TRAIN_PAGES, full.count())
    else:
        few = sampled(sizes, "host", TRAIN_HOSTS, number)
        share = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 30)) < (F.lit(HOST_PAGES) / F.col("n") * (1 << 30))
        found = full.join(F.broadcast(few), "host").filter(share).drop("n")  # at most about TRAIN_HOSTS names
    return sorted((r.asDict(True) for r in found.collect()), key=lambda r: r["id"])


def labelled(pages: DataFrame) -> DataFrame:
    """(id, line_no, outside) of every non-blank line: the probability that it isn't part of the body."""
    wanted = pages.select("id", "title", "text", "headings")
    shared = pages.sparkSession.sparkContext.broadcast(fitted(sample_of(pages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, memo = shared.value, {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                rows = batch.slice(begin, 2000).to_pydict()
                read = [Page(t, title, heads, memo) for t, title, heads in zip(rows["text"], rows["title"], rows["headings"], strict=True)]
                prob = labeller.predict(read)
                sizes = [len(p.numbers) for p in read]
                if sum(sizes):
                    columns = [pa.array(np.repeat(np.array(rows["id"], np.int64), sizes)), pa.array([n for p in read for n in p.numbers], pa.int32()), pa.array(np.concatenate(prob), pa.float32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "line_no", "outside"])

    return spread(wanted.filter("text IS NOT NULL")).mapInArrow(run, "id long, line_no int, outside float")


def outside(pages: DataFrame) -> DataFrame:
    """(id, line_no) of the lines that aren't part of the body."""
    return labelled(pages).filter(F.col("outside") >= LEVEL).select("id", "line_no")


def bodies(pages: DataFrame) -> DataFrame:
    """(id, body): each page's text with only the lines of its body; null texts stay null."""
    gone = outside(pages).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, k: ~F.coalesce(F.array_contains("gone", k), F.lit(False))), "\n")
    return pages.select("id", "text").join(gone, "id", "left").select("id", kept.alias("body"))
