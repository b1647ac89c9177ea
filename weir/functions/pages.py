"""Functions over HTML, words and addresses that SQL can't say; all run on Arrow batches, HTML is parsed once for everything.

Null input gives null output; broken markup is read as far as it goes.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags never read, tags around the content, tags that end a line, tags whose text may be main text.
SKIPPED = {"script", "style", "noscript", "template", "svg", "title"}
AROUND = {"nav", "header", "footer", "aside"}
BLOCKS = set("address article blockquote br caption dd div dl dt figcaption form h1 h2 h3 h4 h5 h6 hr li main ol option p pre section table td th tr ul".split())
MAIN = {"p", "li", "dd", "td", "th", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tokens the text without what is around it has at least to be taken; shares and lengths of main blocks; bounds of the record.
LEAST_TOKENS, LINK_SHARE, LEAST_CHARS, OUTLINE, LINKS, IMAGES = 40, 0.6, 20, 400, 5000, 1000
TOKEN = re.compile(r"[\wऀ-ॿ]+")

STRUCTURE = "text string, main_text string, title string, headings array<struct<level:int,text:string>>, links array<struct<href:string,anchor:string>>, images array<string>, metas map<string,string>, canonical string, tags map<string,int>, nodes int, depth int, forms int, tables int, lists int"


def vectorised(kind: str) -> Callable:
    """A Pandas UDF that is made where it is used, so that workers can import this module."""

    def wrap(function: Callable) -> Callable[..., Column]:
        return lambda *columns: F.pandas_udf(function, kind)(*columns)

    return wrap


class Reader(HTMLParser):
    """Collects all that is wanted of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = self.around = self.depth = self.deepest = 0
        self.every: list[str] = []
        self.kept: list[str] = []
        self.tags: Counter = Counter()
        self.stack: list[str] = []
        self.headings: list[tuple[int, str]] = []
        self.links: list[tuple[str, str]] = []
        self.images: list[str] = []
        self.metas: dict[str, str] = {}
        self.canonical: str | None = None
        self.title: str | None = None
        self.blocks: list[str] = []
        self.open_link: list[str] | None = None
        self.open_head: list[str] | None = None
        self.block: list[str] | None = None
        self.block_links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        self.tags[tag] += 1
        if tag not in VOID:
            self.stack.append(tag)
            self.deepest = max(self.deepest, len(self.stack))
            self.skip += tag in SKIPPED
            self.around += tag in AROUND
        if tag in BLOCKS:
            self.every.append("\n")
            self.kept.append("\n")
        if tag == "a" and "href" in given:
            self.open_link = [given["href"], ""]
        elif tag == "img" and given.get("src"):
            self.images.append(given["src"])
        elif tag == "meta" and (name := given.get("name") or given.get("property")):
            self.metas.setdefault(name.lower(), given.get("content", ""))
        elif tag == "link" and "canonical" in given.get("rel", "").lower().split():
            self.canonical = self.canonical or given.get("href")
        if re.fullmatch("h[1-6]", tag):
            self.open_head = [tag[1], ""]
        if tag in MAIN:
            self.block, self.block_links = [], 0

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack:
                gone = self.stack.pop()
                self.skip = max(0, self.skip - (gone in SKIPPED))
                self.around = max(0, self.around - (gone in AROUND))
                if gone == tag:
                    break
        if tag in BLOCKS:
            self.every.append("\n")
            self.kept.append("\n")
        if tag == "a" and self.open_link:
            self.links.append((self.open_link[0], " ".join(self.open_link[1].split())))
            self.open_link = None
        if self.open_head and tag == "h" + self.open_head[0]:
            self.headings.append((int(self.open_head[0]), " ".join(self.open_head[1].split())))
            self.open_head = None
        if tag in MAIN and self.block is not None:
            text = " ".join("".join(self.block).split())
            if len(text) >= LEAST_CHARS and self.block_links < LINK_SHARE * len(text):
                self.blocks.append(text)
            self.block = None

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1] == "title" and self.title is None:
            self.title = " ".join(data.split()) or None
        if self.skip or not data.strip():
            return
        self.every.append(data)
        if not self.around:
            self.kept.append(data)
        if self.open_link:
            self.open_link[1] += data
        if self.open_head:
            self.open_head[1] += data
        if self.block is not None and not self.around and "form" not in self.stack:
            self.block.append(data)
            self.block_links += len(data) if self.open_link else 0

    @property
    def text(self) -> str:
        kept, every = (normalized("\n".join(" ".join(line.split()) for line in "".join(x).split("\n"))) for x in (self.kept, self.every))
        return kept if len(TOKEN.findall(kept)) >= LEAST_TOKENS else every


def normalized(text: str) -> str:
    """Composed, control characters as blanks, white space collapsed."""
    return " ".join(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ", unicodedata.normalize("NFC", text)).split())


def read(html: str) -> Reader:
    page = Reader()
    page.feed(html)
    page.close()
    return page


def record(html: str | None) -> dict | None:
    if html is None:
        return None
    r = read(html)
    return {
        "text": r.text, "main_text": "\n".join(r.blocks), "title": r.title, "headings": [{"level": a, "text": b} for a, b in r.headings[:OUTLINE]], "links": [{"href": a, "anchor": b} for a, b in r.links[:LINKS]], "images": r.images[:IMAGES],
        "metas": r.metas, "canonical": r.canonical, "tags": dict(r.tags), "nodes": sum(r.tags.values()), "depth": r.deepest, "forms": r.tags["form"], "tables": r.tags["table"], "lists": r.tags["ul"] + r.tags["ol"] + r.tags["dl"],
    }


@vectorised(STRUCTURE)
def structure(html: pd.Series) -> pd.DataFrame:
    """Everything wanted of a page's markup, out of one parse."""
    empty = dict.fromkeys(("text", "main_text", "title", "headings", "links", "images", "metas", "canonical", "tags", "nodes", "depth", "forms", "tables", "lists"))
    return pd.DataFrame([record(x) or empty for x in html], columns=list(empty)).astype(object)


def canonical_url(url: str | None) -> str | None:
    """Without fragment, host in lower case without the usual ports, query sorted, no slash at the end."""
    if url is None:
        return None
    try:
        parts = urlsplit(url.strip())
        port = parts.port
    except ValueError:
        return None
    host = (parts.hostname or "").lower()
    if port and port not in (80, 443):
        host += f":{port}"
    path = quote(parts.path, safe="/%:@!$&'()*+,;=~-._") or "/"
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    return urlunsplit((parts.scheme.lower(), host, path, urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True))), ""))


@vectorised("string")
def canonical(url: pd.Series) -> pd.Series:
    return url.map(canonical_url)


def resolved(base: str | None, href: str | None) -> str | None:
    """The address a link leads to; null for what isn't one."""
    href = (href or "").strip()
    if not href or href.startswith("#") or re.match(r"(?i)(?:mailto|tel|javascript|data):", href):
        return None
    try:
        full = urljoin(base or "", href)
        return full if urlsplit(full).scheme in ("http", "https") else None
    except ValueError:
        return None


@vectorised("string")
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolved(a, b) for a, b in zip(base, href, strict=True)], dtype=object)


@vectorised("string")
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@vectorised("string")
def composed(text: pd.Series) -> pd.Series:
    """The canonical composition of a text; Spark has no built-in for it."""
    return text.map(normalized, na_action="ignore")


@vectorised("string")
def normalized_query(query: pd.Series) -> pd.Series:
    """White space collapsed, composed, lower case if at least half of its letters are Latin."""

    def one(q: str) -> str:
        q = unicodedata.normalize("NFC", " ".join(q.split()))
        latin = sum(unicodedata.name(c, "").startswith("LATIN") for c in q)
        letters = sum(unicodedata.category(c).startswith("L") for c in q)
        return q.lower() if latin >= letters - latin else q

    return query.map(one, na_action="ignore")


def decode_bytes(content: bytes, content_type: str | None) -> str:
    """By the charset of the header, else of a meta tag near the beginning, else as UTF-8; what doesn't fit is replaced."""
    found = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I) or re.search(r"charset=[\"']?([\w-]+)", content[:4096].decode("latin-1"), re.I)
    for name in ([found[1]] if found else []) + ["utf-8"]:
        try:
            return content.decode(name, "replace")
        except LookupError:
            continue
    return ""


@vectorised("string")
def decoded(content: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else decode_bytes(a, b) for a, b in zip(content, content_type, strict=True)], dtype=object)


def fnv1a(word: str) -> int:
    h = 0xCBF29CE484222325
    for byte in word.encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def word_fingerprint(text: str) -> int:
    """64 bits by the votes of the FNV-1a hashes of the white-space words, as a signed number."""
    weights = [0] * 64
    for word, n in Counter(text.split()).items():
        h = fnv1a(word)
        for k in range(64):
            weights[k] += n if h >> k & 1 else -n
    value = sum(1 << k for k in range(64) if weights[k] > 0)
    return value - (1 << 64) if value >> 63 else value


@vectorised("long")
def fnv_simhash(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else word_fingerprint(t) for t in text], dtype="Int64")


class Porter:
    """The suffix stripping algorithm of M. F. Porter (1980), step by step as published."""

    STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def shape(word: str) -> str:
        out = ""
        for k, c in enumerate(word):
            out += "v" if c in "aeiou" or c == "y" and k > 0 and out[k - 1] == "c" else "c"
        return out

    @classmethod
    def measure(cls, stem: str) -> int:
        return len(re.findall("v+c+", cls.shape(stem)))

    @classmethod
    def ends_cvc(cls, stem: str) -> bool:
        return cls.shape(stem).endswith("cvc") and stem[-1] not in "wxy"

    @classmethod
    def stem(cls, word: str) -> str:
        if len(word) <= 2 or not word.isascii() or not word.isalpha():
            return word
        w = word.lower()
        vowel = lambda s: "v" in cls.shape(s)
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            if cls.measure(w[:-3]) > 0:
                w = w[:-1]
        else:
            cut = next((n for end, n in (("ed", 2), ("ing", 3)) if w.endswith(end) and vowel(w[:-n])), 0)
            if cut:
                w = w[:-cut]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and cls.shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif cls.measure(w) == 1 and cls.ends_cvc(w):
                    w += "e"
        if w.endswith("y") and vowel(w[:-1]):
            w = w[:-1] + "i"
        for table in (cls.STEP2, cls.STEP3):
            end = next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)
            if end and cls.measure(w[: -len(end)]) > 0:
                w = w[: -len(end)] + table[end]
        end = next((e for e in sorted(cls.STEP4, key=len, reverse=True) if w.endswith(e)), None)
        if end:
            rest = w[: -len(end)]
            if cls.measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                w = rest
        if w.endswith("e") and (cls.measure(w[:-1]) > 1 or cls.measure(w[:-1]) == 1 and not cls.ends_cvc(w[:-1])):
            w = w[:-1]
        if w.endswith("ll") and cls.measure(w) > 1:
            w = w[:-1]
        return w


@vectorised("array<string>")
def stems(words: pd.Series) -> pd.Series:
    memo: dict[str, str] = {}
    return words.map(lambda ws: [memo.get(w) or memo.setdefault(w, Porter.stem(w)) for w in ws], na_action="ignore")


# Case and number endings of Nepali nouns, the longer first.
NEPALI_ENDINGS = ("हरूलाई", "हरूले", "हरूको", "हरूमा", "हरूबाट", "हरू", "लाई", "बाट", "सँग", "देखि", "सम्म", "ले", "को", "का", "की", "मा")


def nepali_lemma(word: str) -> str:
    """The word without its noun ending, if two letters at least are left."""
    for end in NEPALI_ENDINGS:
        if word.endswith(end) and len(word) - len(end) >= 2:
            return word[: -len(end)]
    return word


@vectorised("array<string>")
def lemmas(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [nepali_lemma(w) for w in ws], na_action="ignore")


def expanded(queries: DataFrame, places: DataFrame, most: int = 4) -> DataFrame:
    """Queries (id, q) with `variants`: the query, its stems, the other names of its places by a map in one row (places), in this order, each once."""
    words = F.split("q", " ")
    stemmed = queries.withColumn("lemma", F.array_join(lemmas(stems(words)), " "))
    asked = F.concat(F.array("q", "lemma"), words)
    others = F.transform(asked, lambda w: F.col("places")[w])
    terms = F.filter(F.concat(F.array("q", "lemma"), others), lambda t: t.isNotNull() & (t != ""))
    return stemmed.join(F.broadcast(places)).select("id", F.slice(F.array_distinct(terms), 1, most).alias("variants"))


def windows(words: Column, size: int = 256, most: int = 16) -> Column:
    """Consecutive windows of so many words, at most so many of them."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(size))
    return F.slice(F.transform(starts, lambda k: F.slice(words, k, size)), 1, most)


def sitemap_urls(body: str | None) -> Iterator[tuple[str, str]]:
    """(kind, address) of a sitemap: pages of a urlset, or further sitemaps of an index."""
    kind = "sitemap" if re.search(r"<sitemapindex\b", body or "") else "page"
    for match in re.finditer(r"<loc>\s*(.*?)\s*</loc>", body or "", re.S):
        yield kind, match[1].replace("&amp;", "&")
