"""A quick reading form of a line, for models that look at damaged text: repaired, composed, without invisible characters."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from weir.llm.mojibake import ROUNDS, codes_of, misread, undo
from weir.llm.unify import LOOKALIKES

TABLE = str.maketrans(LOOKALIKES)
MIXED = re.compile("[A-Za-z][Ͱ-֏]|[Ͱ-֏][A-Za-z]")
GONE = re.compile("[­͏؜​-‏‪-‮⁠-⁯﻿]")
#: For each 16-bit code whether it may need a second look: all but ASCII, composed Devanagari and the usual typographic marks.
UNUSUAL = np.ones(1 << 16, bool)
for low, high in ((0x00, 0x7E), (0x900, 0x957), (0x960, 0x97F)):
    UNUSUAL[low : high + 1] = False
UNUSUAL[[ord(c) for c in "–—‘’“”…•©»›\u200d"]] = False


def repaired(line: str) -> str:
    for _ in range(ROUNDS):
        line, name, _ = undo(line)
        if name is None:
            break
    return line


def plain(text: str) -> str:
    """The text as a reader takes it; line breaks stay where they are."""
    if text.isascii():
        return text
    if not UNUSUAL[codes_of(text)].any():
        return text.replace("\u200d", "") if "\u200d" in text else text
    if misread(text):
        text = "\n".join(repaired(line) if misread(line) else line for line in text.split("\n"))
    text = unicodedata.normalize("NFKC", GONE.sub("", text))
    return text.translate(TABLE) if MIXED.search(text) else text
