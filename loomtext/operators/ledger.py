"""Guarded text edits as a ledger: found, checked, applied, replayed and reversed.

An edit is struct<start,end,rule,before,replacement> with code-point offsets into the
source. Spark has no expression for offset-exact scans, so finding edits is an Arrow
function; replay, inversion and audits are native folds.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

EDIT = StructType([
    StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("rule", StringType()),
    StructField("before", StringType()), StructField("replacement", StringType()),
])
# Entities that are decoded, and characters of protected spans.
ENTITIES = ("amp", "lt", "gt", "quot", "apos", "nbsp", "ndash", "mdash", "hellip")
ENTITY = re.compile(r"&(?:(" + "|".join(ENTITIES) + r")|#(\d{1,7})|#[xX]([0-9A-Fa-f]{1,6}));")
URL = re.compile(r"https?://[^\s<>\"']+")
CONTROL = re.compile("\r\n?|[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f﻿]")
OPEN, CLOSE = "([{", ")]}"


def url_spans(text: str) -> list[tuple[int, int]]:
    """Places of URLs, without closing brackets or stops that the URL did not open."""
    out = []
    for m in URL.finditer(text):
        end = m.end()
        while end > m.start():
            last = text[end - 1]
            body = text[m.start() : end]
            if last in ".,;:!?" or (last in CLOSE and body.count(last) > body.count(OPEN[CLOSE.index(last)])):
                end -= 1
            else:
                break
        out.append((m.start(), end))
    return out


def find_edits(text: str | None) -> list[tuple]:
    """Edits of line ends, control characters and entities outside URLs.

    An entity whose decoding would make a new reference (&amp;lt;) is left alone, so that
    a second pass finds nothing.
    """
    if not text:
        return []
    kept = url_spans(text)
    inside = lambda a: any(s <= a < e for s, e in kept)
    out = [(m.start(), m.end(), "control", m[0], "\n" if m[0][0] == "\r" else "") for m in CONTROL.finditer(text)]
    for m in ENTITY.finditer(text):
        decoded = html.unescape(m[0])
        nested = decoded == "&" and re.match(r"#?\w{1,8};", text[m.end() : m.end() + 10])
        if decoded == m[0] or nested or inside(m.start()):
            continue
        out.append((m.start(), m.end(), "entity", m[0], " " if decoded == " " else decoded))
    return sorted(out)


@F.pandas_udf(ArrayType(EDIT))
def edits(texts: pd.Series) -> pd.Series:
    """The ledger of each text."""
    names = EDIT.fieldNames()
    return texts.map(lambda t: [dict(zip(names, e, strict=True)) for e in find_edits(t)])


def needs_edits(text: Column) -> Column:
    """A necessary condition, so that other rows skip the Python worker."""
    return text.rlike("[\\x00-\\x08\\x0B-\\x1F\\x7F\\uFEFF]|&[A-Za-z#]")


def replay(text: Column, ledger: Column) -> Column:
    """The text with its edits made."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, e: F.struct(e["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["replacement"]).alias("out"))
    return F.aggregate(ledger, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def inverse(text: Column, ledger: Column) -> Column:
    """The source again, from the edited text and the ledger."""
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("src"), F.lit("").alias("out"))

    def step(acc, e):
        gap = e["start"] - acc["src"]
        return F.struct((acc["at"] + gap + F.length(e["replacement"])).cast("int").alias("at"), e["end"].cast("int").alias("src"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, gap), e["before"]).alias("out"))

    return F.aggregate(ledger, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def project(offset: Column, ledger: Column) -> Column:
    """Where an offset of the source lies in the edited text; inside an edit, at its start."""
    shift = lambda e: F.length(e["replacement"]) - (e["end"] - e["start"])
    before = F.aggregate(ledger, F.lit(0), lambda acc, e: acc + F.when(e["end"] <= offset, shift(e)).when(e["start"] < offset, e["start"] - offset).otherwise(0))
    return (offset + before).cast("int")


def pack_tokens(text: str, cap: int, spans: list[tuple[int, int]] | None = None) -> list[int]:
    """Ends of chunks of at most `cap` tokens: at a paragraph, a sentence, a blank, or any token.

    `spans` are the tokens' offsets in order; without them, words are the tokens. A
    boundary must fill a third of the cap; the strongest kind that does wins, the last of
    its kind. No token is cut.
    """
    tokens = [m.span() for m in re.finditer(r"\S+", text)] if spans is None else [s for s in spans if s[1] > s[0]]
    ends, at = [], 0
    while len(tokens) - at > cap:
        best = at + cap
        for kind in (r"\n\s*\n", r"[.!?][\"')\]]*\s", r"\s"):
            found = [k for k in range(at + max(1, cap // 3), at + cap + 1) if re.search(kind, text[tokens[k - 1][1] - 1 : tokens[k][0] + 1])]
            if found:
                best = found[-1]
                break
        # Tokens of one character share its offsets; a chunk ends where a character begins.
        while best > at + 1 and tokens[best][0] < tokens[best - 1][1]:
            best -= 1
        ends.append(tokens[best][0])
        at = best
    return [*ends, len(text)] if tokens else []


def tokenizer_ends(path: str, cap: int):
    """A column function: chunk ends under a cap of the tokens of a tokenizer file."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return texts.map(lambda t: pack_tokens(t or "", cap, tokenizer.encode(t or "", add_special_tokens=False).offsets))

    return run


def tokenizer_counts(path: str):
    """A column function: how many tokens of a tokenizer file begin in each chunk of a plan."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series, plans: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        out = []
        for text, ends in zip(texts, plans, strict=True):
            begins = [a for a, b in tokenizer.encode(text or "", add_special_tokens=False).offsets if b > a]
            out.append([sum(low <= a < high for a in begins) for low, high in zip([0, *ends], ends)])
        return pd.Series(out)

    return run


@F.pandas_udf(ArrayType(IntegerType()))
def token_ends(texts: pd.Series, caps: pd.Series) -> pd.Series:
    """Chunk ends of each text under its cap of words."""
    return pd.Series([pack_tokens(t or "", int(c)) for t, c in zip(texts, caps, strict=True)])


class _Segments(HTMLParser):
    KEEP = {"title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote"}
    DROP = {"nav", "footer", "script", "style", "header", "aside", "form"}

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.tag, self.parts, self.heading, self.out, self.seen = 0, "", [], "", [], {}

    def handle_starttag(self, tag, attrs):
        if tag in self.DROP:
            self.depth += 1
        elif tag in self.KEEP and not self.depth:
            self.end_piece()
            self.tag = tag
            self.seen[tag] = self.seen.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if tag in self.DROP:
            self.depth = max(0, self.depth - 1)
        elif tag == self.tag:
            self.end_piece()

    def handle_data(self, data):
        if self.tag and not self.depth:
            self.parts.append(data)

    def end_piece(self):
        text = " ".join("".join(self.parts).split())
        if text:
            if self.tag[0] == "h":
                self.heading = text
            self.out.append({"locator": f"{self.tag}[{self.seen[self.tag]}]", "heading": self.heading, "text": text})
        self.tag, self.parts = "", []


SEGMENT = StructType([StructField("locator", StringType()), StructField("heading", StringType()), StructField("text", StringType())])


@F.pandas_udf(ArrayType(SEGMENT))
def html_segments(pages: pd.Series) -> pd.Series:
    """Main-content pieces of each page with their locator and the heading above."""

    def one(page):
        parser = _Segments()
        parser.feed(page or "")
        # What the parser has buffered comes out when it is closed, before the last piece ends.
        parser.close()
        parser.end_piece()
        return parser.out

    return pages.map(one)
