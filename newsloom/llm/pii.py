"""Personal data in whole texts: fixed patterns, and boosted trees over wider candidates.

The base patterns always hold. Beside them, high-recall generators propose overlapping spans (spelled
and bracketed addresses, defanged and longer IP addresses, other separators of cards, numbers without a
plus). Boosted trees judge each by its format and its context; their scores are calibrated on a fold of
their own, each kind has the lowest threshold that keeps the wanted precision there, and of overlapping
spans the likeliest stays. No table tells where personal data lies, so the trees are trained on texts
that a small generator writes with known answers, look-alikes included. Texts are read where they lie, without a shuffle.
"""

from __future__ import annotations

import ipaddress
import random
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.trees import Trees, boosted, kept
from newsloom.llm.util import arrow_map, materialize, slices, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, number of the kind, end (code points, end exclusive)

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) < 4 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans by start, then kind. Every scan is linear: a local part is read back from its `@`, no digit run is tried twice."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- candidates

_AT = r"(?:[ ]?[\[({<][ ]?(?:at|AT|@|arroba|arobase)[ ]?[\])}>][ ]?|[ ](?:at|AT|arroba|arobase)[ ]|[ ]@[ ]|[ ]?＠[ ]?|%40)"
_DOT = r"(?:[ ]?[\[({<][ ]?(?:dot|DOT|\.|punto|point|punkt)[ ]?[\])}>][ ]?|[ ](?:dot|DOT|punto|point|punkt)[ ]|[ ]\.[ ]|\.)"
#: Where an address may have been disguised: what follows the sign in its place, then a name and an end after a dot.
_SIGN = re.compile(_AT + r"(?=[A-Za-z0-9-]{1,63}" + _DOT + r"[A-Za-z])")
_REST = re.compile(r"[A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63}){0,3}" + _DOT + r"[A-Za-z]{2,24}(?![A-Za-z0-9])")
_SEP = "[ .\\-/_–  ]"
#: (kind, pattern): each start is tried once, a match is short, and starts may overlap.
NUMBERS = [(k, re.compile(f"(?=({p}))")) for k, p in (
    (1, r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:[ ]?[\[({](?:\.|dot)[\])}][ ]?[0-9]{1,3}|[ ]dot[ ][0-9]{1,3}|\.[0-9]{1,3}){3}(?![0-9])"),
    (1, r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{1,4}:|:(?=:)|(?<=:):(?!:)){2,7}(?:[0-9A-Fa-f]{1,4})?(?![0-9A-Za-z:])"),
    (2, rf"(?<![0-9])[0-9](?:{_SEP}{{0,2}}[0-9]){{12,18}}(?![0-9])"),
    *((3, rf"(?<![0-9A-Za-z])\(?(?:\+|00)?[0-9]{{1,5}}\)?{_SEP}{{0,2}}\(?[0-9]{{2,5}}\)?(?:{_SEP}{{1,2}}[0-9]{{2,{last}}}){{{more}}}(?![0-9])") for more, last in ((1, 8), (2, 4), (3, 4), (4, 4))),
    (3, r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{4}(?![0-9-])"),
    (3, r"(?<![0-9A-Za-z.,-])[0-9]{7,15}(?![0-9A-Za-z-])"),
    (3, rf"(?<![0-9A-Za-z])\(?0[0-9]{{1,4}}\)?{_SEP}{{1,2}}[0-9]{{4,9}}(?![0-9])"),
)]


def candidates(text: str) -> Iterator[Span]:
    """Proposed spans, overlaps and repeats among them included."""
    for m in _SIGN.finditer(text):
        end = _REST.match(text, m.end())
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        if end and start < m.start():
            yield start, 0, end.end()
            short = re.match(r"[A-Za-z0-9-]{1,63}" + _DOT + r"[A-Za-z]{2,24}(?![A-Za-z0-9])", text[m.end() : end.end()])
            if short and m.end() + short.end() < end.end():
                yield start, 0, m.end() + short.end()
    if _DIGIT.search(text) or "::" in text:
        for kind, pattern in NUMBERS:
            for m in pattern.finditer(text):
                yield m.start(1), kind, m.end(1)
                if kind == 2:  # what follows a card may look like more of it
                    for end in [g.end() for g in _GROUP.finditer(m.group(1))][:-1]:
                        if sum(map(str.isdigit, m.group(1)[:end])) > 12:
                            yield m.start(1), kind, m.start(1) + end


# ---------------------------------------------------------------- features

#: Words that tell what a number or name is. Fixed values.
CUES = {
    "email": "mail email write contact correo courriel mailto reach send escriba schreiben adresse",
    "ip": "ip ipv server host ping router gateway node dns network login serveur servidor client",
    "card": "card visa mastercard amex credit debit carte tarjeta karte payment pay cvv expires",
    "phone": "tel phone call mobile cell fax whatsapp telephone téléphone telefon teléfono llame appelez anruf handy móvil ring sms",
    "not": "version order isbn issn invoice serial token key id ref page pages section chapter figure table price total sum year date part sku ticket step score build port rev "
    "seite bestellung rechnung pedido factura página commande facture usd eur",
}
_CUE = {w: k for k, ws in enumerate(CUES.values()) for w in ws.split()}
#: Ends of host names that are common. Fixed values.
ENDS = frozenset("com org net edu gov io de fr es uk eu info co us ch at it nl biz dev app".split())
_WORD = re.compile(r"[^\W\d_]+")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{1,4}:$")
_BEFORE, _AFTER = 48, 20


def _kind_of(c: str) -> float:
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0 if c in "\"'=#$€£%&@/:" else 5.0


def _ip6(text: str) -> float:
    try:
        return float(ipaddress.ip_address(text).version == 6)
    except ValueError:
        return 0.0


def _date(groups: list[str]) -> float:
    if len(groups) < 3:
        return 0.0
    a, b, c = (int(g) if len(g) < 5 else 0 for g in groups[:3])
    return float((1900 <= a <= 2100 and 1 <= b <= 12 and 1 <= c <= 31) or (1900 <= c <= 2100 and 1 <= min(a, b) <= 12 and max(a, b) <= 31))


def features(text: str, span: Span) -> list[float]:
    """Format and context of one candidate."""
    start, kind, end = span
    s = text[start:end]
    groups = _GROUP.findall(s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    other = [c for c in s if not c.isalnum()]
    before, after = text[max(0, start - _BEFORE) : start], text[end : end + _AFTER]
    x = [float(kind == k) for k in range(4)]
    x += [len(s), len(digits), sum(c.isalpha() for c in s), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), len(other), len(set(other))]
    x += [float(luhn(digits)) if digits else 0.0, float(digits[:1] in ("3", "4", "5", "6")), float("(" in s and ")" in s), float("+" in s), float(digits[:1] == "0"), float(s.count("(") != s.count(")"))]
    x += [_kind_of(before[-1:]), _kind_of(after[:1]), float(all(map(octet, groups))) if len(groups) == 4 else -1.0, _ip6(s) if kind == 1 and ":" in s else -1.0, _date(groups), float("." in other), float(":" in other)]
    x += [float(max(map(digits.count, set(digits))) / len(digits)) if digits else 0.0]
    if kind == 0:
        words = _WORD.findall(s)
        last = words[-1] if words else ""
        x += [float(last.lower() in ENDS), len(last), float(last != last.lower()), float(any(c in s for c in "[({<")), float(bool(re.search(r"(?i) (?:dot|punto|point|punkt) ", s))), float("@" in s or "＠" in s), s.count(" "), len(words[0]) if words else 0]
    else:
        x += [-1.0] * 8
    for part, near in ((before, lambda w: w[::-1]), (after, lambda w: w)):
        found = [_CUE.get(w.lower(), -1) for w in near(_WORD.findall(part))]
        x += [float(found.index(k)) if k in found else 9.0 for k in range(5)]
    x += [float(bool(_HEX.search(before))), sum(c.isdigit() for c in after), float("+" in before[-5:]), float(before.rstrip()[-1:].isdigit()), float(after.lstrip()[:1].isdigit())]
    return [float(v) for v in x]


# ---------------------------------------------------------------- training texts


class Writer:
    """Writes one training text with known answers."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = [self.r.choice("bcdfglmnprstvw") + self.r.choice("aeiouéöü") for _ in range(40)]

    def word(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return r.choice("the and at of to in dot point is on was look see der die und am le la les à el los en que punto a this from".split())
        return "".join(r.choices(self.syllables, k=r.randint(1, 4)))

    def filler(self, low: int, high: int) -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(w + self.r.choice((".", ",", "")) if self.r.random() < 0.15 else w for w in out)

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def card(self, good: bool) -> str:
        n = self.r.choice((13, 15, 16, 16, 16, 19))
        head = self.r.choice("3456") + self.digits(n - 2) if good or self.r.random() < 0.5 else self.digits(n - 1)
        own = next(d for d in "0123456789" if luhn(head + d))
        return head + (own if good else self.r.choice([d for d in "0123456789" if d != own]))

    def grouped(self, digits: str, sep: str) -> str:
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def host(self) -> tuple[str, str]:
        r = self.r
        return r.choice(("mail", "example", self.word() + r.choice(("", "-it", "5")), self.word())), r.choice(sorted(ENDS)[:] + ["com"] * 12 + ["org"] * 5)

    def email(self) -> str:
        r = self.r
        user = r.choice((self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{r.randint(1, 99)}", "info")).encode("ascii", "ignore").decode() or "office"
        host, end = self.host()
        host = host.encode("ascii", "ignore").decode().strip("-") or "mail"
        o, c = r.choice(("[]", "()", "{}"))
        at, dot = r.choice(((f"{o}at{c}", f"{o}dot{c}"), (f" {o}at{c} ", f" {o}dot{c} "), (" at ", " dot "), (" AT ", " DOT "), (f"{o}at{c}", "."), (" @ ", "."), (" @ ", " . "), ("＠", "."), ("%40", "."), (" arroba ", " punto ")))
        return user + at + host + (dot + self.host()[0].encode("ascii", "ignore").decode().strip("-") if r.random() < 0.1 else "") + dot + end

    def ip(self) -> str:
        r = self.r
        part = [str(r.randint(0, 255)) for _ in range(4)]
        if r.random() < 0.5:
            return r.choice(("[.]", "(.)", "[dot]", " dot ")).join(part)
        words = [f"{r.randint(0, 65535):x}" for _ in range(8)]
        return ":".join(words) if r.random() < 0.5 else ":".join(words[: r.randint(1, 4)]) + "::" + ":".join(words[5 : r.randint(6, 8)])

    def ip_v4(self) -> str:
        return ".".join(str(self.r.randint(0, 255)) for _ in range(4))

    def phone(self) -> tuple[str, bool]:
        """A number, and whether it is one only if a word beside it says so."""
        r, d = self.r, self.digits
        a = str(r.randint(201, 989))
        return r.choice((
            (f"({a}) {d(3)}-{d(4)}", False), (f"{a}-{d(3)}-{d(4)}", False), (f"({a}) {d(3)} {d(4)}", False), (f"1-{a}-{d(3)}-{d(4)}", False), (f"{a}.{d(3)}.{d(4)}", True), (f"{a} {d(3)} {d(4)}", True),
            (f"00{r.randint(30, 49)} {d(2)} {d(3)} {d(4)}", False), (f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", False), (f"0{d(3)}/{d(r.randint(5, 7))}", False), (f"0{d(4)} {d(6)}", True), (f"{a}{d(7)}", True), (f"{d(3)}-{d(4)}", True), (f"+1 ({a}) {d(3)}-{d(4)}", False), (f"+{r.randint(30, 49)} {d(2)} {d(3)} {d(4)}", False),
        ))

    def lookalike(self) -> str:
        r, d = self.r, self.digits
        y = r.randint(1950, 2030)
        return r.choice((
            lambda: f"{y}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{y}", lambda: f"{r.randint(0, 23):02}:{d(2)}:{d(2)}", lambda: f"{y}-{y + 3}", lambda: f"{y} {y + 1} {y + 2}",
            lambda: f"{r.randint(1, 9)}.{d(1)}.{r.randint(1, 20)}", lambda: f"{r.randint(1, 30)}.{d(3)}.{d(4)}.{d(1)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"978{d(10)}", lambda: self.card(False), lambda: self.grouped(self.card(False), r.choice(" -./")),
            lambda: d(r.randint(7, 15)), lambda: "".join(r.choices("0123456789abcdef", k=r.choice((8, 32, 40)))), lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(2)}.{d(3)},{d(2)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)}",
            lambda: f"{self.word()} at {self.word()}. {self.word().capitalize()}", lambda: f"{self.word()} at the dot {self.word()}", lambda: f"{self.word()} at {self.word()}.{self.word()}", lambda: f"look at {self.host()[0]}.{r.choice(('com', 'org'))}", lambda: f"{d(3)}-{d(2)}-{d(4)}",
            lambda: f"{r.randint(256, 999)}[.]{d(3)}[.]{d(2)}[.]1", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(5)}-{d(4)}", lambda: f"({d(3)}) {d(2)}", lambda: f"{d(5)} {d(5)} {d(5)}",
        ))()

    def text(self) -> tuple[str, set[Span]]:
        out, gold, r, d = "", set(), self.r, self.digits
        for _ in range(r.randint(2, 9)):
            out += self.filler(0, 14) + r.choice((" ", " ", " ", "\n", ": ", " ("))
            kind, cue = r.choice((0, 1, 2, 3, 3, -1, -1, -1, -1)), ""
            if kind < 0:
                item = self.lookalike()
                cue = r.choice(CUES["not"].split()) if r.random() < 0.4 else r.choice(CUES[r.choice(KINDS[:3])].split()) if r.random() < 0.1 else ""
            elif kind == 3:
                item, needs = self.phone()
                cue = r.choice(CUES["phone"].split()) if needs or r.random() < 0.5 else ""
            else:
                item = (self.email, self.ip, lambda: self.grouped(self.card(True), r.choice((".", "_", "/", "–", " ", "  "))))[kind]()
                cue = r.choice(CUES[KINDS[kind]].split()) if r.random() < 0.5 else ""
            if cue:
                out += (cue if r.random() < 0.6 else cue.capitalize()) + r.choice((" ", ": ", ":", " = ", f" {self.word()} "))
            if kind >= 0:
                gold.add((len(out), kind, len(out) + len(item)))
            # Numbers that follow each other are one run to the base patterns, which then drop it.
            tail = f" {self.ip_v4() if r.random() < 0.3 else self.card(r.random() < 0.2) if r.random() < 0.5 else d(r.randint(2, 16))}" if kind > 1 and r.random() < 0.25 else ""
            if kind > 1 and r.random() < 0.1:
                lead = self.card(False) + " "
                if kind >= 0:
                    gold = {g for g in gold if g != (len(out), kind, len(out) + len(item))} | {(len(out) + len(lead), kind, len(out) + len(lead) + len(item))}
                item = lead + item
            out += item + (tail or r.choice((" ", " ", ", ", ". ", "\n", ") ", "! ")))
        return out + self.filler(0, 6), gold


def free(base: list[Span], found: set[Span]) -> list[Span]:
    """The spans that touch none of the base ones: both in order of start, so it is one walk."""
    ends, top = [], 0
    for _, _, e in base:
        top = max(top, e)
        ends.append(top)
    starts = [s for s, _, _ in base]
    return [c for c in sorted(found) if not (k := bisect_right(starts, c[2] - 1)) or ends[k - 1] <= c[0]]


def examples(seed: int) -> tuple[list[list[float]], list[float], list[list[int]]]:
    """(features, label, span) of the candidates of one training text that no base span touches; a label is 1 if both ends are right."""
    text, gold = Writer(seed).text()
    found = free(base_spans(text), set(candidates(text)))
    return [features(text, c) for c in found], [float(c in gold) for c in found], [list(c) for c in found]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(s, *row) for s in b.column("id").to_pylist() for row in zip(*examples(s), strict=True)]
        if rows:
            seed, x, y, span = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64()), pa.array(span, pa.list_(pa.int32()))], ["seed", "x", "label", "span"])


def disjoint(spans: list[Span], score: np.ndarray) -> list[tuple[Span, int]]:
    """The likeliest of overlapping spans with their places in the list, by start; of equally likely ones the longer, then the earlier. Scores below a half never win."""
    starts: list[int] = []
    out: list[tuple[Span, int]] = []
    for i in sorted(np.flatnonzero(score >= 0.5).tolist(), key=lambda i: (-score[i], spans[i][0] - spans[i][2], spans[i])):
        s, _, e = spans[i]
        k = bisect_right(starts, s)
        if (k == 0 or out[k - 1][0][2] <= s) and (k == len(starts) or starts[k] >= e):
            starts.insert(k, s)
            out.insert(k, (spans[i], i))
    return out


@dataclass
class Model:
    """Trees, and of each kind the calibrated curve (scores rising, probabilities) and the least probability that redacts."""

    trees: Trees
    curves: list[tuple[np.ndarray, np.ndarray]]
    least: list[float]

    def probability(self, kind: int, score: float) -> float:
        """The calibrated probability of a score of the trees."""
        start, p = self.curves[kind]
        return float(p[max(int(np.searchsorted(start, score, "right")) - 1, 0)]) if len(start) else 0.0

    def added(self, text: str, base: list[Span]) -> list[tuple[Span, float]]:
        """The accepted spans of a text and their probabilities, by start."""
        spans = free(base, set(candidates(text)))
        score = [self.trees.probability(np.array([features(text, c) for c in spans[lo : lo + 4096]])) for lo in range(0, len(spans), 4096)]
        score = np.concatenate([np.zeros(0), *score])
        won = [(s, self.probability(s[1], score[i])) for s, i in disjoint(spans, score)]
        return [(s, p) for s, p in won if p >= self.least[s[1]]]


def calibrated(score: np.ndarray, label: np.ndarray, precision: float) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """Isotonic regression (pool adjacent violators) of labels on scores, and the least probability whose spans and all likelier ones keep `precision`."""
    if not len(score):
        return (np.zeros(0), np.zeros(0)), 2.0
    blocks: list[list[float]] = []
    each, place, count = np.unique(score, return_inverse=True, return_counts=True)
    for block in zip(each.tolist(), np.bincount(place, weights=label).tolist(), count.tolist(), strict=True):
        blocks.append(list(block))
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, y1, n1 = blocks.pop()
            blocks[-1][1:] = [blocks[-1][1] + y1, blocks[-1][2] + n1]
    start, good, n = np.array(blocks).T
    p = good / n
    right = np.cumsum(good[::-1])[::-1] / np.cumsum(n[::-1])[::-1]
    ok = np.flatnonzero((right >= precision) & (p >= 0.5))
    return (start, p), float(p[ok[0]]) if len(ok) else 2.0


def train(spark: SparkSession, texts: int = 3000, rounds: int = 30, depth: int = 5, seed: int = 11, precision: float = 0.95) -> Model:
    """A model from `texts` generated texts; a third of them is the fold that calibrates, on the spans that overlaps leave."""
    rows = materialize(arrow_map(spark.range(seed * 10**6, seed * 10**6 + texts, 1, 8), _examples, "seed long, x array<double>, label double, span array<int>"), "examples")
    trees = kept(spark, f"pii-{texts}-{rounds}-{depth}-{seed}", lambda: boosted(rows.where("seed % 3 <> 0").select("x", "label"), rounds, depth, seed), sys.modules[__name__])
    own = rows.where("seed % 3 = 0").toPandas()  # some twenty rows per text
    own["score"] = trees.probability(np.array(own["x"].tolist()))
    won = {(seed, span) for seed, one in own.groupby("seed") for span, _ in disjoint([tuple(x) for x in one["span"]], one["score"].to_numpy())}
    own = own[[(seed, tuple(span)) in won for seed, span in zip(own["seed"], own["span"], strict=True)]]
    kind = np.array([span[1] for span in own["span"]])
    found = [calibrated(own["score"].to_numpy()[kind == k], own["label"].to_numpy()[kind == k], precision) for k in range(len(KINDS))]
    return Model(trees, [c for c, _ in found], [t for _, t in found])


# ---------------------------------------------------------------- the operator


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])


def _find(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for b in slices(batch):
            base, found = [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                base.append(base_spans(text))
                found.append(model.added(text, base[-1]))
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "p": 1.0} for s, k, e in x] for x in base], [[{"kind": KINDS[k], "start": s, "end": e, "p": q} for (s, k, e), q in x] for x in found]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *[pa.array(r, pa.list_(_SPAN)) for r in rows]], [*names, "base", "added"])


SPANS = "array<struct<kind:string,start:int,end:int,p:double>>"


def find(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, base, added: spans by start, then kind, in code points; p is the calibrated probability (1 for base ones).

    Null texts are empty. Added spans overlap no base span and none of their own. One row per input row; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # rounds * 2^depth nodes
    few = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema if f.name != "text")
    return arrow_map(few, partial(_find, shared=shared), f"{kind}, base {SPANS}, added {SPANS}")


def _cover(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for found in _find(batches, shared):
        text = [_covered(t or "", x + y) for t, x, y in zip(*(found.column(c).to_pylist() for c in ("_text", "base", "added")), strict=True)]
        names = [n for n in found.schema.names if n not in ("_text", "base", "added")]
        yield pa.RecordBatch.from_arrays([*[found.column(n) for n in names], pa.array(text, pa.string())], [*names, "text"])


def _covered(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] > at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"] if s["start"] >= at else []
            at = s["end"]
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, text: each text with its spans replaced by their kind in brackets; overlapping spans become one. Null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # rounds * 2^depth nodes
    few = docs.select(*keep, F.col("text").cast("string").alias("_text"), F.col("text").cast("string").alias("text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema if f.name not in ("_text", "text"))
    return arrow_map(few, partial(_cover, shared=shared), f"{kind}, text string")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op11_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), train(spark))
    count = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    order = F.array(*[F.lit(k) for k in KINDS])
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))
    all_ = F.array_sort(F.transform(F.concat("base", "added"), place))
    return found.select("doc_id", *count, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(all_).alias("spans"))
