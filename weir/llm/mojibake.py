"""Problem 7: text that was decoded in the wrong encoding.

Adjacent pairs of characters are scored by their mutual information in the corpus (counted over all fields that hold no
byte sequence of another encoding), improbable runs are isolated as maximum-scoring segments, and only inside those
runs the inverse mappings of the usual single-byte encodings are tried, again and again for text that was decoded
wrongly more than once. A mapping is accepted only if it makes the run likelier: the mean mutual information of its pairs
must rise by `GAIN` (or another run of the field shows the same encoding, or the corpus knows none of the characters it yields), so that Cyrillic or Greek words whose letters happen to spell byte sequences stay as they are.

Results: null and empty fields are never affected. Where bytes are gone (replacement characters, runs of question
marks) the field is affected and `restored` is false; `repaired` then holds what could be had. Very long fields are
scored whole. Ties between encodings go to the one named first in `ENCODINGS`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weir.llm.common import code_points, mix64, pieces, total_of

#: Encodings in which UTF-8 is most often misread, the likelier first.
ENCODINGS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "cp850", "cp1250", "iso8859-15", "koi8-r", "cp866")
#: Slots of the hashed table of pairs, and of that of single characters (cut to 16 bits): fixed, whatever the corpus.
PAIR_SLOTS, CHAR_SLOTS = 1 << 18, 1 << 16
#: Shares of the corpus below which a pair, and a character, counts as if it had this share.
PAIR_FLOOR, CHAR_FLOOR = 1e-8, 1e-3
#: Mutual information (bits) below which a pair adds to a run; above it, it takes from it. And the most a pair takes.
LEVEL, MOST = -3.0, 4.0
#: Bits a pair by which an inverse mapping must raise the mean mutual information of a run.
GAIN = 1.0
#: How often a text is taken to have been misread at most.
ROUNDS = 4
#: Question marks a field has at least where its letters were replaced by them.
LOST_MARKS = 4


@lru_cache(1)
def inverses() -> list[tuple[str, dict[str, int], re.Pattern]]:
    """Of each encoding: its name, the byte of each character beyond ASCII, and a pattern of UTF-8 sequences as it shows them."""
    out = []
    for name in ENCODINGS:
        byte_of: dict[str, int] = {}
        for byte in range(128, 256):
            try:
                char = bytes([byte]).decode(name)
            except UnicodeDecodeError:
                char = chr(byte)  # browsers let undefined bytes pass
            byte_of.setdefault(char, byte)
        shown = lambda low, high, of=byte_of: "[" + "".join(re.escape(c) for c, b in of.items() if low <= b <= high) + "]"
        tail = shown(0x80, 0xBF)
        pattern = f"{shown(0xC2, 0xDF)}{tail}|{shown(0xE0, 0xEF)}{tail}{{2}}|{shown(0xF0, 0xF4)}{tail}{{3}}"
        out.append((name, byte_of, re.compile(f"(?:{pattern})(?: ?(?:{pattern}))*")))
    return out


@lru_cache(1)
def translations() -> list[dict[int, int]]:
    """Of each encoding: from its characters to those whose numbers are their bytes."""
    return [{ord(c): b for c, b in byte_of.items()} for _, byte_of, _ in inverses()]


LOST = re.compile(r"�|(?:^|(?<=\s))\?\?")


@lru_cache(1)
def adjacent() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each encoding and 16-bit code: whether it shows the code for the first byte of a sequence, and for a later one; the last pair holds for any."""
    tables = []
    for _, byte_of, _ in inverses():
        leads, tails = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for char, byte in byte_of.items():
            leads[ord(char)] = 0xC2 <= byte <= 0xF4
            tails[ord(char)] = byte <= 0xBF
        tables.append((leads, tails))
    return [*tables, (np.any([a for a, _ in tables], 0), np.any([b for _, b in tables], 0))]


def beside(codes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether a first and a later byte stand side by side."""
    return bool((table[0][codes[:-1]] & table[1][codes[1:]]).any())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def misread(text: str) -> bool:
    """Whether a text holds sequences of another encoding: two such characters side by side are looked for first."""
    if text.isascii():
        return False
    codes = codes_of(text)
    return beside(codes, adjacent()[-1]) and any(beside(codes, t) and p.search(text) for t, (_, _, p) in zip(adjacent(), inverses(), strict=False))


def suspicious(text: str) -> bool:
    """A quick test for texts that may hold misread or lost characters."""
    return ("�" in text or "??" in text) and LOST.search(text) is not None or misread(text)


def undo(run: str) -> tuple[str, str | None, int]:
    """The run with the sequences of the best encoding decoded; which encoding; how many characters it explains."""
    best: tuple[str, str | None, int] = (run, None, 0)
    codes = codes_of(run)
    if not beside(codes, adjacent()[-1]):
        return best
    beyond = int((codes > 127).sum())
    for table, to_bytes, (name, _, pattern) in zip(adjacent(), translations(), inverses(), strict=False):
        if not beside(codes, table):
            continue
        done = 0

        def decode(match: re.Match, to_bytes: dict[int, int] = to_bytes) -> str:
            nonlocal done
            raw = match[0].translate(to_bytes).encode("latin-1")
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                return " ".join(one_by_one(part, to_bytes) for part in match[0].split(" "))
            done += len(raw) - raw.count(b" ")
            return text

        def one_by_one(part: str, to_bytes: dict[int, int]) -> str:
            nonlocal done
            try:
                text = part.translate(to_bytes).encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                return part
            done += len(part)
            return text

        text = pattern.sub(decode, run)
        if done > best[2]:
            best = text, name, done
            if done >= beyond:
                break  # all is explained; later encodings are less likely
    return best


def score_table(pairs: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log2 shares of pairs and of characters, each with its floor."""
    total = max(pairs.sum(), 1.0)
    return np.log2(pairs / total + PAIR_FLOOR).astype(np.float32), np.log2(chars / total + CHAR_FLOOR).astype(np.float32)


@lru_cache(1)
def spelled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character, cut to 16 bits: its hash as the first and as the second of a pair, and its slot; digits of any one script count as one."""
    x = np.arange(1 << 16, dtype=np.uint64)
    x = np.where((x >= 48) & (x <= 57), 48, np.where((x >= 0x966) & (x <= 0x96F), 0x966, x)).astype(np.uint64)
    first, second = mix64(x), mix64(x + np.uint64(1 << 20))
    return (first & np.uint64(PAIR_SLOTS - 1)).astype(np.int32), (second & np.uint64(PAIR_SLOTS - 1)).astype(np.int32), x.astype(np.int32)


def slots(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the adjacent pairs and of the characters."""
    cut = (points ^ (points >> np.uint32(16)) * np.uint32(0x9E37)).astype(np.uint16)
    first, second, single = spelled()
    return first[cut[:-1]] ^ second[cut[1:]], single[cut]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's counts: pairs in the first slots, characters after them."""
    pairs, chars = np.zeros(PAIR_SLOTS, np.int64), np.zeros(CHAR_SLOTS, np.int64)
    for batch in batches:
        kept = [t for t in batch.column(0).to_pylist() if t and not suspicious(t)]
        for group in pieces(kept):
            points, _ = code_points(["\n", *(t + "\n" for t in group)])
            pair, char = slots(points)
            pairs += np.bincount(pair, minlength=PAIR_SLOTS)
            chars += np.bincount(char, minlength=CHAR_SLOTS)
    both = np.concatenate([pairs, chars])
    at = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(both[at], pa.int64())], names=["slot", "n"])


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-scoring segments: from each start the stretch up to its best sum, ended when the sum has dropped to nothing."""
    out, at, n = [], 0, len(scores)
    starts = np.flatnonzero(scores > 0)
    while True:
        k = np.searchsorted(starts, at)
        if k == len(starts):
            return out
        begin = int(starts[k])
        total = best = 0.0
        end = at = begin
        while at < n:
            total += scores[at]
            at += 1
            if total > best:
                best, end = total, at
            if total <= 0 or total < best - 3 * MOST:
                break
        out.append((begin, end))
        at = max(at, end)


class Repairer:
    """Finds and undoes wrong decodings by the scores of a corpus."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        self.pairs, self.chars = score_table(pairs, chars)

    def information(self, text: str) -> float:
        """The mean mutual information of the pairs of a stretch of text."""
        pair, char = slots(code_points([text])[0])
        return float((self.pairs[pair] - self.chars[char[:-1]] - self.chars[char[1:]]).mean()) if len(pair) else 0.0

    def tried(self, text: str, low: int, high: int) -> tuple[str, list[str], float, bool]:
        """A run with the best inverse mappings applied, which, by how many bits a pair its mean mutual information rises, and whether all beyond ASCII is explained."""
        run = own = text[low:high]
        found: list[str] = []
        whole = False
        for turn in range(ROUNDS):
            own, name, done = undo(own)
            if name is None:
                break
            found.append(name)
            if turn == 0:
                whole = done >= sum(not c.isascii() for c in run)
        if not found:
            return run, found, 0.0, whole
        before, after = text[max(low - 1, 0) : low] or "\n", text[high : high + 1] or "\n"
        return own, found, self.information(before + own + after) - self.information(before + run + after), whole

    def foreign(self, text: str) -> bool:
        """Whether the corpus lacks some of the characters beyond ASCII, so that it can't judge them, and all are punctuation or letters of one script, Latin beside ASCII letters."""
        beyond = [c for c in text if not c.isascii()]
        scripts = {unicodedata.name(c, "?").split(" ")[0] for c in beyond if unicodedata.category(c)[0] in "LM"} | {"LATIN" for c in text if c.isascii() and c.isalpha()}
        if not beyond or len(scripts) > 1 or any(unicodedata.category(c)[0] not in "LMP" for c in beyond):
            return False
        return bool((self.chars[slots(code_points(["".join(beyond)])[0])[1]] <= np.float32(np.log2(CHAR_FLOOR)) + 1e-3).any())

    def field(self, text: str, scores: np.ndarray) -> tuple[bool, bool, str, str | None]:
        """Of a field with its pairs' scores (the first is of the mark before it): affected, restored, repaired, encodings."""
        runs = []
        for begin, end in segments(scores):  # pair k joins characters k - 1 and k of the text
            low, high = max(begin - 1, 0), min(end, len(text))
            while low > 0 and not text[low - 1].isascii():
                low -= 1
            while high < len(text) and not text[high].isascii():
                high += 1
            if runs and low <= runs[-1][1]:
                runs[-1] = runs[-1][0], max(high, runs[-1][1])
            else:
                runs.append((low, high))
        affected, lost, names, parts, at = False, False, [], [], 0
        marks = text.count("?") >= LOST_MARKS
        undone = [self.tried(text, low, high) for low, high in runs]
        sure = {found[0] for _, found, gain, _ in undone if found and gain >= GAIN}
        for (low, high), (own, found, gain, whole) in zip(runs, undone, strict=True):
            run = text[low:high]
            if found and (gain >= GAIN or whole and (found[0] in sure or self.foreign(own))):  # what one run shows of a field's encoding holds for its others
                run, affected = own, True
                names += [name for name in found if name not in names]
            if "�" in run or marks and re.search(r"(?:^|\s)\?\?", text[max(low - 1, 0) : high]):
                affected = lost = True
            parts += [text[at:low], run]
            at = high
        repaired = "".join(parts) + text[at:]
        left = affected and suspicious(repaired)
        return affected, affected and not lost and not left, repaired if affected else text, "+".join(names) or None

    def batch(self, texts: list[str | None]) -> list[tuple[bool, bool, str | None, str | None]]:
        out: list[tuple] = [(False, False, t, None) for t in texts]
        full = [k for k, t in enumerate(texts) if t]
        at = 0
        for group in pieces([texts[k] for k in full]):
            points, offsets = code_points(["\n" + t for t in group] + ["\n"])
            pair, char = slots(points)
            info = self.pairs[pair] - self.chars[char[:-1]] - self.chars[char[1:]]
            scores = np.maximum(LEVEL - info, -MOST)
            high = np.flatnonzero(scores > 0)
            touched = np.unique(np.searchsorted(offsets, high, side="right") - 1)
            for k in touched:
                if k < len(group):
                    out[full[at + k]] = self.field(group[k], scores[offsets[k] : offsets[k + 1]])
            at += len(group)
        return out


def fitted(fields: DataFrame) -> Repairer:
    """Counts over all fields; two tables of fixed size come to the driver."""
    counted = fields.select("stored").mapInArrow(count_batches, "slot int, n long")
    both = total_of(counted, "n", PAIR_SLOTS + CHAR_SLOTS)
    return Repairer(both[:PAIR_SLOTS], both[PAIR_SLOTS:])


def repaired(fields: DataFrame) -> DataFrame:
    """Of rows (id, field, stored): (id, field, affected, restored, repaired, encodings)."""
    shared = fields.sparkSession.sparkContext.broadcast(fitted(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = shared.value
        for batch in batches:
            if batch.num_rows:
                done = repairer.batch(batch.column(2).to_pylist())
                columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.bool_(), pa.bool_(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "field", "affected", "restored", "repaired", "encodings"])

    return fields.select("id", "field", "stored").mapInArrow(run, "id long, field string, affected boolean, restored boolean, repaired string, encodings string")
