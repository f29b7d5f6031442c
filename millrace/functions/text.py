"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.stem import stems

# Words that carry no meaning for a search; a parameter of every function that uses them.
STOP_WORDS = tuple(
    "a an the of in on at for to is are was were be been being by with and or how what which who whom whose "
    "when where why does do did can could should shall must may might will would from that this these those it its as any all "
    "into between during after before over under than then there their they them he she his her we our you your i me my not no "
    "if but so such out also about tell give show list explain describe please mention state per via".split()
)


def raw_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def terms(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens of two characters or more that are not stop words."""
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def compound_tokens(text: Column) -> Column:
    """Tokens joined by dots or slashes stay whole, and their parts follow unless the whole is a decimal number."""
    whole = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[./][a-z0-9]+)*"), F.lit(0))
    return F.flatten(F.transform(whole, lambda t: F.when(t.rlike("[./]") & ~t.rlike(r"^[0-9]+\.[0-9]+$"), F.concat(F.array(t), F.split(t, "[./]"))).otherwise(F.array(t))))


def normalize(text: Column) -> Column:
    """One spelling for dashes, quotes, ratios (1 in 12, 1:12), weights (60 kg) and speeds."""
    t = F.translate(F.lower(text), "–—‘’“”", "--''\"\"")
    t = F.regexp_replace(t, r"\b([0-9]+)\s*(?:in|:)\s*([0-9]+)\b", "$1in$2")
    t = F.regexp_replace(t, r"\b([0-9]+)\s+(kg|mm|cm|km)\b", "$1$2")
    t = F.regexp_replace(t, r"km/h(r)?", "kmph")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


#: Units that are joined to the number before them.
SEARCH_UNITS = "kg|mm|cm|km|kmph|kn|mhz|hz|kv|amps?|volts?|litres?|liters?|tonnes?|gmt|hp|rpm|mpa|db"


def search_text(text: Column) -> Column:
    """The spelling in which texts are searched: lower case, plain dashes and quotes, ratios and quantities in one piece."""
    t = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2018\u2019", "-------''"), "\u00b0", " deg ")
    t = F.regexp_replace(t, r"\b1\s*(?:in|:)\s*([0-9]+(?:\.[0-9]+)?)", "1in$1")
    t = F.regexp_replace(t, rf"\b([0-9]+(?:\.[0-9]+)?)\s*({SEARCH_UNITS})\b", "$1$2")
    return F.regexp_replace(t, r"\b(?:kmph|km/h|kmh)\b", "kmph")


def search_terms(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Stemmed tokens in order, without stop words: a token with dots or slashes that is no number is followed by its parts."""
    whole = F.regexp_extract_all(search_text(text), F.lit(r"[a-z0-9]+(?:[./][a-z0-9]+)*"), F.lit(0))
    parted = lambda t: F.when(t.rlike("[./]") & ~t.rlike(r"^[0-9]+(?:\.[0-9]+)+$"), F.concat(F.array(t), F.split(t, "[./]"))).otherwise(F.array(t))
    return stems(F.filter(F.flatten(F.transform(whole, parted)), lambda t: ~t.isin(*stop)))


def squash(text: Column) -> Column:
    """Lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", "_")


def sentences(text: Column) -> Column:
    """Pieces that end with a full stop, question or exclamation mark before white space, trimmed, without empty ones."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "[\u0001\n]"), lambda s: F.trim(s)), lambda s: s != "")


def unhtml(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags gone, white space squeezed."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))


def in_order(spans: Column) -> Column:
    """Greedy allocation over sorted array<struct<s, e>>: a span is kept if it starts at or after the end of the last kept one."""
    kind = "array<struct<s:int,e:int>>"
    return F.aggregate(spans, F.array().cast(kind), lambda acc, x: F.when((F.size(acc) == 0) | (x.s >= F.element_at(acc, -1).e), F.concat(acc, F.array(x))).otherwise(acc))


def value_text(comparator: Column, lo: Column, hi: Column, unit: Column) -> Column:
    """A measurement in words."""
    s = lambda c: F.format_string("%.2f", c)
    return (
        F.when(comparator == "max", F.concat(F.lit("at most "), s(hi), F.lit(" "), unit))
        .when(comparator == "min", F.concat(F.lit("at least "), s(lo), F.lit(" "), unit))
        .when(comparator == "range", F.concat(s(lo), F.lit(" to "), s(hi), F.lit(" "), unit))
        .otherwise(F.concat(s(F.coalesce(lo, hi)), F.lit(" "), unit))
    )
