"""Personal data: fixed patterns, and more spans chosen by boosted trees over high-recall candidates.

Everything per document is DataFrame functions: patterns find spans, array functions place them in the text, and the
trees, which are trained on the driver from synthetic examples, become nested conditions. Four kinds are known, in this
order: email, ip, card, phone. The fixed patterns give the base spans; the generators propose further spellings
(spelt-out addresses, spaced or bracketed numbers, phone numbers without a plus sign), and a candidate is kept when its
score reaches its kind's threshold, which is calibrated for precision on held-out synthetic examples.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: No candidate is shorter.
SHORTEST = 5

# Patterns of Java's engine. Repeats are possessive and starts are anchored to the beginning of a run (or the end of
# the last match), which finds the same matches as the plain form in time linear in the text.
_NAME = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:@|[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[]dot[)\]]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\.|[(\[]\.[)\]]|[(\[]dot[)\]])\x20?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[\x20./_-]{1,2}+[0-9]{3,7}+){2,5}+(?![0-9])",
    "phone": r"(?<![0-9])(?:[(+]|00)?[0-9]{1,5}+[\x20()./-]{0,3}+[0-9]{2,5}+(?:[\x20()./-]{1,2}+[0-9]{2,5}+){1,4}+(?![0-9])",
}
#: Texts that cannot match are passed over; each test is implied by its pattern.
_MAY = {"email": r"@|\bat\b", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CONTEXT = 24
_BLOCK = 128


# --- features of a candidate: name -> (in Spark, in Python), over (match, left context, right context) ---
def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _count(pattern: str) -> tuple[Callable, Callable]:
    return (lambda m, a, b: F.length(m) - F.length(F.regexp_replace(m, pattern, ""))), (lambda m, a, b: len(m) - len(re.sub(pattern, "", m)))


def _before(pattern: str) -> tuple[Callable, Callable]:
    return (lambda m, a, b: F.lower(a).rlike(pattern).cast("int")), (lambda m, a, b: int(bool(re.search(pattern, a.lower()))))


def _after(pattern: str) -> tuple[Callable, Callable]:
    return (lambda m, a, b: b.rlike(pattern).cast("int")), (lambda m, a, b: int(bool(re.search(pattern, b))))


def _inside(pattern: str) -> tuple[Callable, Callable]:
    return (lambda m, a, b: m.rlike(pattern).cast("int")), (lambda m, a, b: int(bool(re.search(pattern, m))))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of its last one."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 1, F.lit(2) * F.ascii(F.substring(digits, i, F.lit(1))) - 96 - F.when(F.ascii(F.substring(digits, i, F.lit(1))) > 52, 9).otherwise(0)).otherwise(F.ascii(F.substring(digits, i, F.lit(1))) - 48),
    )
    return (n > 0) & (total % 10 == 0)


def _luhn_py(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return bool(digits) and total % 10 == 0


FEATURES: dict[str, tuple[Callable, Callable]] = {
    "length": (lambda m, a, b: F.length(m), lambda m, a, b: len(m)),
    "digits": _count("[0-9]"),
    "letters": _count("[A-Za-z]"),
    "spaces": _count(" "),
    "dots": _count(r"\."),
    "dashes": _count("[-/_]"),
    "brackets": _count(r"[()\[\]]"),
    "plus_or_00": _inside(r"^(\+|00)"),
    "starts_bracket": _inside(r"^\("),
    "spelt_at": _inside(r"[(\[]at[)\]]| at "),
    "spelt_dot": _inside(r"[(\[]dot[)\]]| dot |[(\[]\.[)\]]"),
    "fours": _inside(r"^[0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}[ .-][0-9]{1,7}$"),
    "dated": _inside(r"(19|20)[0-9]{2}[-/. ](0?[1-9]|1[0-2])[-/. ]|[-/.](0?[1-9]|1[0-2])[-/.](19|20)[0-9]{2}"),
    "same_separator": _inside(r"^[0-9]+([ .-])[0-9]+\1[0-9]+(\1[0-9]+)*$"),
    "groups_of_3": _inside(r"^[0-9]{1,3}([ .][0-9]{3})+$"),
    "luhn": (lambda m, a, b: _luhn(_digits(m)).cast("int"), lambda m, a, b: int(_luhn_py(re.sub("[^0-9]", "", m)))),
    "says_phone": _before(r"(tel|phone|call|mobile|cell|fax|whatsapp|number)[a-z]*[.:]? *(is|at|on|me|us)? *$"),
    "says_card": _before(r"(card|visa|amex|mastercard|credit|debit)[a-z]*[.:]? *(no|number|is)?[.:]? *$"),
    "says_mail": _before(r"(mail|contact|reach|write|address)[a-z]*[.:]? *(is|at|to|me|us)? *$"),
    "says_ip": _before(r"(ip|host|server|address|from)[.:]? *(is)? *$"),
    "says_other": _before(r"(version|release|isbn|issn|order|invoice|serial|section|page|id|sku|ref|v|no|part|build|total|price|license)[a-z]*[.:#]? *(is)? *$"),
    "glued_left": _before(r"[a-z0-9_=#$\"/.-]$"),
    "glued_right": _after(r"^([A-Za-z0-9_=%\"/]|[.:-][0-9])"),
}


# --- training on synthetic examples ---
def _examples(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """(kind, match, left, right, whether personal). Drawn from format rules, never from a corpus."""
    r = random.Random(seed)

    def number(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(low, high)))

    def card() -> str:
        body = r.choice("3456") + number(14)
        return next(body + c for c in "0123456789" if _luhn_py(body + c))

    def groups(digits: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for s in sizes:
            out.append(digits[at : at + s])
            at += s
        return sep.join(x for x in out if x)

    def text() -> str:
        return " ".join(word() for _ in range(3)) + r.choice([" ", ", ", ". "])

    hints = {
        "email": ["email: ", "contact ", "write to ", "mail me at ", "my address is "],
        "ip": ["ip ", "host ", "server: ", "from "],
        "card": ["card number ", "visa ", "credit card: ", "my card is "],
        "phone": ["tel. ", "call ", "phone: ", "mobile ", "fax "],
    }
    false_hints = ["version ", "isbn ", "order ", "invoice no. ", "serial ", "section ", "ref: ", "part no ", "build ", "total "]

    def good(kind: str) -> str:
        if kind == "email":
            at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), (" @ ", "."), ("[at]", "[dot]"), ("@", " dot ")])
            return f"{word()}{r.choice(['', '.' + word(), number(2)])}{at}{word(3, 9)}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'example' + dot + 'com'])}"
        if kind == "ip":
            sep = r.choice(["[.]", " . ", "(.)", "[dot]", ". "])
            return sep.join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            return groups(card(), r.choice([[4, 4, 4, 4], [4, 6, 6]]), r.choice([" ", "-", ".", "  ", " - "[:2]]))
        return r.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(3)}/{number(3)} {number(4)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"00{number(2)} {number(3)} {number(3)} {number(4)}", f"1-{number(3)}-{number(3)}-{number(4)}"])

    def bad(kind: str) -> str:
        if kind == "email":
            return r.choice([f"{word()} at {word()}.{word()}", f"{word()} at {word()}. {word()}", f"{word()} at {word()}.", f"{word()} @ {word()}. {word()}"])
        if kind == "ip":
            return r.choice([".".join(number(r.randint(1, 3)) for _ in range(4)), ". ".join(str(r.randint(1, 9)) for _ in range(4)), " . ".join(str(r.randint(256, 999)) for _ in range(4))])
        if kind == "card":
            return r.choice([groups(number(16), [4, 4, 4, 4], r.choice(" -./")), groups(number(13), [3, 4, 5, 1], "-"), f"{r.randint(1900, 2099)} {r.randint(1900, 2099)} {r.randint(1900, 2099)}", groups(number(12), [3, 3, 3, 3], " "), "978-" + groups(number(10), [3, 3, 4], "-")])
        day = r.choice([f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2099)}"])
        return r.choice([groups(number(16), r.choice([[4, 4, 4, 4], [4, 6, 6]]), r.choice(" .-")), day, f"{day} {r.randint(0, 23):02}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2099)}", f"{r.randint(1900, 2099)}/{r.randint(1, 12)}/{r.randint(1, 28)}", f"{r.randint(1, 99)}.{r.randint(10, 99)}.{r.randint(10, 99)}", f"{number(3)} {number(3)} {number(3)}", f"{number(2)}.{number(3)}.{number(3)}", f"{number(4)} {number(4)}", f"{r.randint(1900, 2099)}-{r.randint(1900, 2099)} {number(3)}", f"978-{number(3)}-{number(4)}"])

    out = []
    for _ in range(n):
        for kind in KINDS:
            y = r.random() < 0.5
            m = good(kind) if y else bad(kind)
            left, right = text(), r.choice([" ", ". ", ", ", ")", ""]) + word()
            style = r.random()
            if y:
                left += r.choice(hints[kind]) if style < 0.5 else ""
            elif style < 0.45:
                left += r.choice(false_hints)
            elif style < 0.6:
                left += r.choice(["x", "id=", "#", '"', "v", "/", "$", "a-"])
                right = r.choice(["a", "f3", "%", '"', "/", ".4", "_"]) + right
            if not y and r.random() < 0.15:  # a good form that is part of something longer
                m, left, right = good(kind), left.rstrip() + r.choice(["=", "#", "/", "x"]), r.choice(["e", "/", "_"]) + right
            out.append((kind, m, left[-CONTEXT:], right[:CONTEXT], int(y)))
    return out


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    value: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Node:
    """One regression tree on gradients, by exact search over all cuts."""
    node = Node(value=-rate * g.sum() / (h.sum() + 1.0))
    best = g.sum() ** 2 / (h.sum() + 1.0) + 1e-3
    if depth and len(x) >= 20:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + 1.0) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1.0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, node.feature, node.cut = gain[k], f, float(v[at[k]] + v[at[k] + 1]) / 2
    if node.feature >= 0:
        low = x[:, node.feature] < node.cut
        node.left, node.right = _grow(x[low], g[low], h[low], depth - 1, rate), _grow(x[~low], g[~low], h[~low], depth - 1, rate)
    return node


def _value(node: Node, row: np.ndarray) -> float:
    while node.left is not None:
        node = node.left if row[node.feature] < node.cut else node.right
    return node.value


@dataclass
class Forest:
    trees: list[Node]
    threshold: float

    def margin(self, row: np.ndarray) -> float:
        return sum(_value(t, row) for t in self.trees)


def _row(m: str, a: str, b: str) -> np.ndarray:
    return np.array([float(f[1](m, a, b)) for f in FEATURES.values()])


@lru_cache(maxsize=4)
def train(examples: int = 1500, trees: int = 20, depth: int = 3, rate: float = 0.3, precision: float = 0.98, seed: int = 11) -> dict[str, Forest]:
    """A forest for each kind, and as its threshold the lowest margin from which on the given share of held-out
    synthetic candidates is personal (never under even odds)."""
    drawn, held = _examples(examples, seed), _examples(examples // 3, seed + 1)
    out = {}
    for kind in KINDS:
        x, y = (np.array(z) for z in zip(*((_row(m, a, b), y) for k, m, a, b, y in drawn if k == kind), strict=True))
        score, forest = np.zeros(len(y)), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            forest.append(_grow(x, p - y, np.maximum(p * (1 - p), 1e-6), depth, rate))
            score += [_value(forest[-1], row) for row in x]
        z, t = (np.array(v) for v in zip(*((sum(_value(f, r) for f in forest), y) for k, m, a, b, y in held if k == kind for r in [_row(m, a, b)]), strict=True))
        order = np.argsort(-z, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(right >= precision)
        out[kind] = Forest(forest, max(0.0, float(z[order[ok[-1]]])) if len(ok) else float("inf"))
    return out


def _margin(forest: Forest, features: Column) -> Column:
    """The forest as nested conditions over a struct of features."""

    def walk(node: Node) -> Column:
        if node.left is None:
            return F.lit(node.value)
        return F.when(features[f"f{node.feature}"] < F.lit(node.cut), walk(node.left)).otherwise(walk(node.right))

    total = F.lit(0.0)
    for t in forest.trees:
        total = total + walk(t)
    return total


# --- spans ---
def _found(gaps: Column, matches: Column) -> Column:
    """array<struct<s, e, m>> of a pattern's matches, from the texts between them. Starts are sums over all before:
    whole blocks first, so that the work stays near linear in the number of matches."""
    sizes = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)

    def placed(sizes: Column) -> Column:
        blocks = F.aggregate(
            F.sequence(F.lit(0), (F.size(matches) / _BLOCK).cast("int")),
            F.array(F.lit(0)),
            lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(sizes, k * _BLOCK + 1, _BLOCK)))),
        )
        return F.transform(F.array(blocks), lambda b: F.transform(matches, lambda m, i: _span(m, i, b, sizes)))[0]

    def _span(m: Column, i: Column, b: Column, sizes: Column) -> Column:
        k = (i / _BLOCK).cast("int")
        s = b[k] + total(F.slice(sizes, k * _BLOCK + 1, i - k * _BLOCK)) + F.length(gaps[i])
        return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"))

    return F.transform(F.array(sizes), placed)[0]


def _spans(df: DataFrame, text: str, patterns: dict[str, str], prefix: str) -> DataFrame:
    """Adds, for each kind, prefix_kind: the spans of its pattern."""
    empty = F.array().cast("array<string>")
    may = {k: F.col(text).rlike(p) for k, p in _MAY.items()}
    raw = {}
    for kind, p in patterns.items():
        raw[f"{prefix}m_{kind}"] = F.when(may[kind], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(empty)
    df = df.withColumns(raw)
    gaps = {f"{prefix}g_{k}": F.when(F.size(f"{prefix}m_{k}") > 0, F.split(F.col(text), p, -1)).otherwise(empty) for k, p in patterns.items()}
    df = df.withColumns(gaps)
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return df.withColumns({f"{prefix}_{k}": F.when(F.size(f"{prefix}m_{k}") > 0, _found(F.col(f"{prefix}g_{k}"), F.col(f"{prefix}m_{k}"))).otherwise(none) for k in patterns}).drop(*raw, *gaps)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _plain(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e")))


def find(docs: DataFrame, forests: dict[str, Forest] | None = None) -> DataFrame:
    """docs with two more columns: base_spans and all_spans, sorted array<struct<s, k, e>> of start, number of the kind
    in KINDS, and end (code points, end exclusive).

    docs has text and any other columns but those two. Base spans are the fixed patterns' matches, leftmost and
    non-overlapping in each kind, without those that fail their kind's test; spans of different kinds may overlap. All
    spans are the base spans and the chosen candidates; a candidate that overlaps a base span, or another candidate of
    a higher score (earlier start or kind on ties), is left out. A null or empty text has no spans; repeated rows get
    equal results.
    """
    forests = forests or train()
    df = docs.select(F.struct(*docs.columns).alias("__own"), F.coalesce("text", F.lit("")).alias("__t"))
    df = _spans(df, "__t", BASE, "__b")
    df = _spans(df, "__t", GENERATORS, "__c")

    def tested(kind: str) -> Column:
        return F.filter(F.col(f"__b_{kind}"), lambda x: _valid(kind, x.m))

    valid = [_plain(tested(kind), k) for k, kind in enumerate(KINDS)]
    df = df.withColumn("base_spans", F.array_sort(F.concat(*valid)))

    def scored(kind: str, k: int) -> Column:
        def one(x: Column) -> Column:
            left = F.substring(F.col("__t"), F.greatest(x.s - CONTEXT, F.lit(0)) + 1, F.least(x.s, F.lit(CONTEXT)))
            right = F.substring(F.col("__t"), x.e + 1, F.lit(CONTEXT))
            feats = F.struct(*(f[0](x.m, left, right).cast("double").alias(f"f{i}") for i, f in enumerate(FEATURES.values())))
            return F.transform(F.array(feats), lambda f: F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e"), _margin(forests[kind], f).alias("z")))[0]

        free = F.filter(F.col(f"__c_{kind}"), lambda x: ~F.exists(F.col("base_spans"), lambda b: (b.s < x.e) & (x.s < b.e)))
        return F.filter(F.transform(free, one), lambda x: x.z >= float(forests[kind].threshold))

    df = df.withColumn("__new", F.array_sort(F.concat(*(scored(kind, k) for k, kind in enumerate(KINDS)))))

    def losers(x: Column, i: Column) -> Column:
        """Of each pair of x and a later candidate that begins inside it, the one to leave out. Candidates of one kind never
        overlap, so of each kind at most one in SHORTEST places begins there."""
        inside = len(KINDS) * (F.floor((x.e - x.s) / SHORTEST).cast("int") + 1)
        later = F.filter(F.slice(F.col("__new"), i + 2, inside), lambda y: y.s < x.e)
        return F.transform(later, lambda y: F.when(y.z > x.z, F.struct(x.s, x.k)).otherwise(F.struct(y.s, y.k)))

    df = df.withColumn("__out", F.flatten(F.transform(F.col("__new"), losers)))
    chosen = F.transform(F.filter(F.col("__new"), lambda x: ~F.array_contains(F.col("__out"), F.struct(x.s, x.k))), lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e")))
    return df.withColumn("all_spans", F.array_sort(F.concat("base_spans", chosen))).select("__own.*", "base_spans", "all_spans")


def _written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(names[x.k], F.lit(":"), x.s.cast("string"), F.lit(":"), x.e.cast("string"))), ",")


def redact(docs: DataFrame, forests: dict[str, Forest] | None = None) -> DataFrame:
    """docs with each of its spans replaced by its kind in brackets in text (overlapping ones by that of the first),
    and n_chars, where there is one, counted anew. A null text stays null."""
    df = find(docs.select(F.struct(*docs.columns).alias("own"), "text"), forests)
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.s.alias("s"), last.k.alias("k"), F.greatest(last.e, x.e).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x.s < last.e, wider).otherwise(F.concat(acc, F.array(x)))

    df = df.withColumn("joined", F.aggregate("all_spans", empty, join))
    names, u, t = F.array(*(F.lit(f"[{k}]") for k in KINDS)), F.col("joined"), F.col("text")
    parts = F.transform(u, lambda x, i: F.concat(F.substring(t, F.when(i == 0, 0).otherwise(u[i - 1].e) + 1, x.s - F.when(i == 0, 0).otherwise(u[i - 1].e)), names[x.k]))
    rest = F.substring(t, F.element_at(u, -1).e + 1, F.length(t))
    changed = F.size(u) > 0
    text = F.when(changed, F.concat(F.array_join(parts, ""), rest)).otherwise(t)
    out = {c: F.col("own")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("own")["n_chars"])
    return df.select(*(v.alias(c) for c, v in out.items()))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")

    def count(k: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x.k == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"))
