"""Text functions as native column expressions.

Offsets are zero-based, half-open and count Unicode code points, as the caller's hashes
do. Every function maps null to null unless it says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Separator of the parts of a stable id.
UNIT = "\u001f"
# The cues of the rule classifier.
EMOTION = r"\b(fear|afraid|frighten(?:ed|ing)?|worr(?:y|ied|ies)|anxious|anxiety)\b"
FUTURE = r"\b(future|decade|century|children|grandchildren|inherit|will|could|coming|long[- ]term|next fifty years)\b"
HEAT = r"\b(today|tonight|this week|heatwave|heat emergency|extreme temperature|immediate)\b"
NEGATED = r"\b(?:not|never|no)\b.{0,24}\b(?:fear|afraid|panic|worr(?:y|ied)|anxious|anxiety)\b"
#: Markers that cleaning should have removed, by name.
MARKERS = {"entity": r"&[A-Za-z]+;|&#\d+;", "tag": r"<[A-Za-z/][^>]*>", "url": r"https?://\S+", "rule": r"[-=_*]{4,}", "pipe": r"\|"}


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it.

    A lambda that names a computed column would compute it again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no expression for."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """NFKC, then collapsed white space; the worker gets null for texts of ASCII alone."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return collapse_space(F.when(plain, text).otherwise(nfkc(F.when(~plain, text))))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and twenty hex digits of the parts' hash; a null part reads as None."""
    joined = F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 20))


def body_hash(text: Column) -> Column:
    """Hash of the lower-cased text with collapsed white space."""
    return F.sha2(F.lower(collapse_space(text)), 256)


def lexical_form(text: Column) -> Column:
    """A comparison form: lower case, one kind of dash, collapsed white space."""
    return collapse_space(F.lower(F.regexp_replace(text, "[‐-―−]", "-")))


def marker_counts(text: Column) -> Column:
    """Map from marker name to its count, without zero counts."""
    pairs = [x for name, rule in MARKERS.items() for x in (F.lit(name), F.size(F.regexp_extract_all(text, F.lit(rule), F.lit(0))))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def words(text: Column, rule: str = r"[\p{L}\p{N}]+") -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(text), F.lit(rule), F.lit(0))


def shingles(tokens: Column, width: int = 5) -> Column:
    """Distinct runs of `width` words; fewer words give none."""

    def runs(words: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))
        return F.when(F.size(words) >= width, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return bound(tokens, runs)


def _bottom(grams: Column, hashed, kind: str, k: int, least: int) -> Column:
    """The k smallest hashes of a set of at least `least` shingles, else none."""

    def smallest(runs: Column) -> Column:
        some = F.slice(F.array_sort(F.array_distinct(F.transform(runs, hashed))), 1, k)
        return F.when(F.size(runs) >= least, some).otherwise(F.array().cast(f"array<{kind}>"))

    return bound(grams, smallest)


def bottom_sketch(grams: Column, k: int = 12, least: int = 30) -> Column:
    """The k smallest CRC-32 values of a set of at least `least` shingles, else none."""
    return _bottom(grams, lambda g: F.crc32(g.cast("binary")), "bigint", k, least)


def bottom_sketch_md5(grams: Column, k: int = 12, least: int = 30) -> Column:
    """The same sketch over MD5 digits, for engines without CRC-32."""
    return _bottom(grams, lambda g: F.md5(g), "string", k, least)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united size of two sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared size over the smaller set's; null if that is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def pair_id(a: Column, b: Column) -> Column:
    """One id for a pair in either order."""
    return F.sha2(F.concat_ws(":", F.least(a, b), F.greatest(a, b)), 256)


def emotion_rules(text: Column) -> Column:
    """Struct of the rule classifier's cues and its candidate decision."""
    flag = lambda rule: text.rlike(f"(?i){rule}")
    cue = F.lower(F.regexp_extract(text, f"(?i){EMOTION}", 0))
    return F.struct(
        F.when(cue != "", cue).alias("emotion_cue"),
        flag(r"\b(fear|afraid|frighten(?:ed|ing)?)\b").alias("fear_cue"),
        flag(r"\bworr(?:y|ied|ies)\b").alias("worry_cue"),
        flag(r"\b(anxious|anxiety)\b").alias("anxiety_cue"),
        flag(NEGATED).alias("negated_emotion"),
        flag(FUTURE).alias("future_horizon_cue"),
        flag(HEAT).alias("immediate_heat_cue"),
        (flag(EMOTION) & flag(FUTURE) & ~flag(NEGATED)).alias("future_worry_rule_candidate"),
    )


def term_rule(term: str) -> str:
    """A pattern of a term with its plural, and with hyphens or blanks between its words."""
    parts = [re.escape(p) for p in re.split(r"[- ]+", term.lower())]
    return "(?<![a-z0-9])" + "[- ]".join(parts) + "(?:e?s)?(?![a-z0-9])"


def term_matches(docs: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """(key, term, position, hits) of the terms in each text, the position of the first one-based."""
    low = F.lower("text")
    found = F.array(*[F.struct(F.lit(t).alias("term"), F.regexp_instr(low, F.lit(term_rule(t))).alias("position"), F.regexp_count(low, F.lit(term_rule(t))).alias("hits")) for t in terms])
    return docs.select(key, F.explode(found).alias("m")).select(key, "m.*").where("position > 0")


def snippet(text: Column, position: Column, before: int = 180, size: int = 500) -> Column:
    """At most `size` characters about a one-based position, verbatim."""
    return F.substring(text, F.greatest(F.lit(1), position - before), F.lit(size))


def strip_tags(html: Column) -> Column:
    """Text of simple markup: tags become blanks, common entities are decoded."""
    text = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def url_key(url: Column) -> Column:
    """A comparison key: scheme and host in lower case, no default port, no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(host, r":(80|443)$", "")
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(rest == "", "/").otherwise(rest)))


def paragraph_starts(text: Column, gap: str = "\n") -> Column:
    """Start offsets of the non-blank pieces between line breaks `gap`."""
    pieces = F.split(text, F.lit(gap), F.lit(-1))
    step = len(gap)
    folded = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + step).cast("int").alias("at"),
            F.when(p.rlike(r"(?U)\S"), F.concat(acc["starts"], F.array(acc["at"].cast("int")))).otherwise(acc["starts"]).alias("starts"),
        ),
    )
    return folded["starts"]
