"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans follow fixed patterns and always count. On top of them, generators of
high recall propose spans that may overlap (masked e-mail addresses, IPv6,
national phone numbers, card numbers in other groupings). Boosted trees score
each proposal from its format and its context; a calibrated probability over its
kind's threshold selects it, the likelier of overlapping proposals winning.

No table labels personal data, so the trees learn from two sources (``EXAMPLES``
in all). Half come from the corpus (:func:`contexts`): base spans in their real
surroundings, rewritten in forms that the fixed patterns don't know, are data;
proposals that surely are none (cards failing the check digit, runs inside longer
words, numbers called orders or dates) and look-alikes put in a base span's place
are none. The rest is written by a seeded generator, and all of it where a corpus
has no base spans. The trees are fitted on the driver in a second or two and
travel with the tasks.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.llm import boosting
from storylake.llm.common import written

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A match can only begin where a run of digits does, and no run is given back, so digits are read a few times at most.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# High-recall generators: (kind, pattern). Proposals may overlap one another.
_DOT, _HOST, _END = r" ?(?:[\[({]dot[\])}]|\bdot\b) ?", r"[A-Za-z0-9-]{2,}+", r"[A-Za-z]{2,}"
#: What may follow the name of a masked address: an ``at`` in brackets and any dots, or a bare ``at`` and masked dots.
MASKED_REST = re.compile(rf" ?(?:[\[({{]at[\])}}] ?{_HOST}(?:(?:{_DOT}|\.){_HOST})*?(?:(?:{_DOT}|\.){_END})+|\bat\b ?{_HOST}(?:{_DOT}{_END})+)", re.I)
MASKED_AT = re.compile(r"[\[({]at[\])}]|\bat\b", re.I)
MASK = re.compile(r"dot|[\[({]at[\])}]", re.I)
IPV6 = re.compile(r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?|(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4})(?![\w:])")
CLUSTER = re.compile(r"[0-9A-Fa-f ().:/\-]{7,}+")
CLUSTER_START = re.compile(r"[(0-9]")
NO_END = " ().:/-"
IN_CLUSTER = (
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])00[1-9][0-9 ]{7,14}[0-9](?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\(?0[1-9][0-9]{0,3}\)?[ ./-][0-9]{5,8}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])")),
)
CUES = {
    "email": re.compile(r"e-?mail|mail|contact|write|reach|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|client|login", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|payment|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|ring|reach|dial|whatsapp|anruf|llam|appel", re.I),
}
AGAINST = re.compile(r"order|isbn|version|serial|invoice|ticket|ref|part|build|date|score|page|hash|token|key|time|no\.|#", re.I)
#: Common last parts of a host name.
DOMAIN_END = re.compile(r"\b(?:com|org|net|edu|gov|info|io|co|uk|eu|de|fr|es|it|nl|ch|at|us|ca|au|jp|br|in|ru|pl)$", re.I)
# English function words, which rarely are the name or the host of an address.
FUNCTION_WORDS = frozenset("a an and are as at be but by can do for from had has have he her him his how i if in is it its me my no not of on or our out she so that the their them then there they this to up us was we were what when where who will with you your".split())
#: Code points before and after a proposal that its features look at.
CONTEXT = 32
#: Examples written for fitting; a quarter of them calibrates.
EXAMPLES = 6_000
#: Different spans of the corpus that examples are made of, about so many a kind and side (base or not); each at most ``LONGEST`` code points long.
CONTEXTS, LONGEST = 400, 64
#: Least precision on the calibration examples that sets a kind's threshold.
PRECISION = 0.98
#: Standard deviations by which the precision seen must lie over it: nine times in ten.
SURE = 1.28


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches; only the run of local characters before each ``@`` is looked at."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield found.start(), found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start; leftmost, non-overlapping within a kind."""
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = _digits(m[0]) if len(m[0]) >= 16 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(_digits(m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def _masked(text: str):
    """Masked e-mail addresses from the left, with names of any length; a stretch of name characters is gone through once."""
    last, seen = 0, (-1, -1)  # the end of the last match; where the name before an earlier "at" ended and began
    for at in MASKED_AT.finditer(text):
        if at.start() < last:
            continue
        end = start = at.start() - (text[at.start() - 1 : at.start()] == " ")
        while start > last and text[start - 1] in LOCAL:
            start = seen[1] if start == seen[0] else start - 1
        start, seen = max(start, last), (end, start)
        rest = MASKED_REST.match(text, end) if end - start >= 2 else None
        if rest:
            yield start, rest.end()
            last = rest.end()


def _clusters(text: str):
    """Stretches of digits and what groups them, from a digit or bracket to a digit."""
    for run in CLUSTER.finditer(text):
        start = CLUSTER_START.search(text, *run.span())
        end = run.start() + len(run[0].rstrip(NO_END))
        if start and end - start.start() >= 7:
            yield start.start(), end


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans that might be personal data beyond the base; they may overlap."""
    found = []
    if MASK.search(text):
        found += [("email", *span) for span in _masked(text)]
    if ":" in text:
        found += [("ip", *m.span()) for m in IPV6.finditer(text) if len(m[0]) > 2]
    if DIGIT.search(text):
        for cluster in _clusters(text):
            for kind, pattern in IN_CLUSTER:
                found += [(kind, *m.span()) for m in pattern.finditer(text, *cluster) if kind != "phone" or len(_digits(m[0])) <= 15]
    return found


def _name_and_host(span: str, kind: str) -> tuple[float, float, float]:
    """Of a masked address: whether the name and the host are function words, and whether the name holds more than letters."""
    at = MASKED_AT.search(span) if kind == "email" else None
    if not at:
        return 0.0, 0.0, 0.0
    name, host = span[: at.start()].strip(" "), re.match(r"[A-Za-z0-9-]*", span[at.end() :].lstrip(" "))[0]
    return float(name.lower() in FUNCTION_WORDS), float(host.lower() in FUNCTION_WORDS), float(not name.isalpha())


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one span."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _digits(span)
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", span) if g]
    return [
        *(float(kind == k) for k in KINDS),
        len(span), len(digits), len(digits) / len(span), len(groups), max(groups, default=0), min(groups, default=0),
        len(set(re.sub(r"[0-9A-Za-z]", "", span))), float(len(digits) > 1 and luhn(digits)), float("(" in span), float(span.startswith("00")),
        float(":" in span), float("/" in span), float(groups[-2:] == [3, 4]), float(bool(CUES[kind].search(before))), float(bool(CUES[kind].search(after))),
        float(bool(AGAINST.search(before))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float("[" in span or "(" in span),
        float(bool(DOMAIN_END.search(span))), float(bool(MASK.search(span))),
        float(digits.startswith("0")), float(re.match(r"(?:19|20)[0-9]{2}(?![0-9])", span) is not None), float(span.count(".")), float(span.count("-")),
        *_name_and_host(span, kind),
    ]


#: Leading words of written examples that no feature knows.
NEITHER = ("see", "under", "use", "this", "is", "with", "via", "then", "our", "new", "it was", "for", "")


def _body(rnd: random.Random, kind: str, label: int, span: str = "") -> str:
    """Data of a kind in a form that the fixed patterns don't know, made of the base span ``span`` if there is one; or what merely looks like it."""
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rnd.choice("abcdefghilmnoprstuv") for _ in range(rnd.randint(3, 8)))
    common = lambda: rnd.choice(sorted(FUNCTION_WORDS))
    if kind == "email":
        end = rnd.choice(["com", "org", "net", "de"])
        if not label:  # words around "at" and "dot"
            who, host = rnd.choice([(common(), name()), (name(), common()), (common(), common())])
            return f"{who} at {host} dot {rnd.choice([end, name(), *NEITHER[:7], 'of', 'the'])}"
        who, host = (span.split("@")[0], span.split("@")[1]) if span else (rnd.choice([name(), f"{name()}.{name()}", f"{name()}{n(2)}"]), f"{name()}.{end}")
        at, dot = rnd.choice([("(at)", "."), (" (at) ", "."), ("[at]", "."), (" [at] ", "."), (" (at) ", " [dot] "), (" [at] ", " dot "), (" at ", " dot "), (" at ", " [dot] ")])
        return f"{who}{at}{host.replace('.', dot)}"
    if kind == "ip":
        if not label:
            return rnd.choice([f"{rnd.randint(0, 23):02d}:{n(2)}:{n(2)}", f"{n(2)}:{n(1)}:{n(2)}", f"::{n(1)}", f"{n(1)}:{n(2)}:{n(3)}:{n(1)}"])
        parts = [int(p) % 256 for p in span.split(".")] if span else []
        groups = [f"{rnd.randrange(65536):x}" for _ in range(8)]
        if parts and rnd.random() < 0.5:  # the address as a prefix of its own network
            groups[:3] = ["2002", f"{parts[0] * 256 + parts[1]:x}", f"{parts[2] * 256 + parts[3]:x}"]
        if rnd.random() < 0.5:
            low = rnd.randint(3, 4)
            groups[low : rnd.randint(low + 1, 7)] = [""]
        return ":".join(groups)
    if kind == "card":
        while True:
            digits = _digits(span) if span and label else n(rnd.choice([13, 15, 16, 16, 16]))
            if luhn(digits) == bool(label):
                break
        sizes, mark = ((4, 6, 5), rnd.choice(" -.")) if len(digits) == 15 else ((4, 4, 4, 8), rnd.choice([".", "/"] if label else " -./"))
        return mark.join(g for g in (digits[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes))) if g)
    digits = (_digits(span)[-10:] if span and len(_digits(span)) >= 10 else "") or str(rnd.randint(2, 9)) + n(9)
    area, mid, last = digits[:3], digits[3:6], digits[6:]
    if label:
        return rnd.choice([
            f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{area} {mid} {last}", f"00{rnd.choice(['49', '33', '34', '44', '1'])} {area} {mid}{last}",
            f"0{digits[:2]} {digits[2:6]} {digits[6:9]}", f"0{digits[:2]} {digits[2:9]}", f"0{area}/{mid}{last}", f"0{digits[0] if digits[0] != '0' else 1} " + " ".join(digits[i : i + 2] for i in range(1, 9, 2)),
        ])
    year = str(rnd.randint(1900, 2099))
    return rnd.choice([f"{n(4)}-{n(4)}-{n(2)}", f"{n(3)}/{n(3)}/{n(2)}", f"{n(3)} {n(3)} {n(3)} {n(3)}", f"{area}-{mid}-{last}", f"{year}-{n(4)}-{n(2)}", f"{year} {year} {n(2)}", f"{n(2)}.{n(3)}.{n(3)}"])


CUE_WORDS = {"email": ("email", "contact", "write to"), "ip": ("from host", "ip", "client address"), "card": ("card", "visa", "credit card"), "phone": ("call", "tel", "phone", "fax")}
AGAINST_WORDS = ("order", "isbn", "version", "serial", "invoice", "date", "page", "score", "ref", "build")


def _example_in(rnd: random.Random, before: str, kind: str, label: int, after: str, lead: str, span: str = "") -> tuple[str, str, int, int, int]:
    """The example with its kind's data, or what looks like it, between ``before`` and ``after``: text, kind, start, end, label."""
    body = _body(rnd, kind, label, span)
    text = f"{before}{lead}{body}{after}"
    start = len(before) + len(lead)
    # Learn from what the generators propose of it, the longest first; what they don't propose counts as written.
    own = [(e - s, s, e) for k, s, e in proposals(text) if k == kind and s < start + len(body) and start < e]
    _, start, end = max(own, default=(0, start, start + len(body)))
    return text, kind, start, end, label


def _written_example(rnd: random.Random) -> tuple[str, str, int, int, int]:
    """One labelled example of the generator alone."""
    name = lambda: "".join(rnd.choice("abcdefghilmnoprstuv") for _ in range(rnd.randint(3, 8)))
    kind, label = rnd.choice(KINDS), int(rnd.random() < 0.5)
    # Hard cases: clear data without a cue, other things beside one, and words that no feature knows beside either.
    place = rnd.random()
    lead = rnd.choice(NEITHER) if place < 0.2 else rnd.choice(CUE_WORDS[kind]) if (place < 0.9) == bool(label) else rnd.choice(AGAINST_WORDS)
    return _example_in(rnd, " ".join(name() for _ in range(rnd.randint(1, 5))) + " ", kind, label, f" {name()}", lead + rnd.choice([" ", " ", " ", ": "]))


def surely_none(kind: str, before: str, span: str, after: str) -> bool:
    """Whether a proposal of the corpus is no personal data beyond doubt; other proposals are not learned from."""
    if before[-1:].isalnum() or after[:1].isalnum():
        return True
    if kind == "card":
        return not luhn(_digits(span))
    return bool(AGAINST.search(before)) and not CUES[kind].search(before)


#: ``kind, base, before, span, after`` of a span in the corpus.
Context = tuple[str, bool, str, str, str]


def _corpus_example(rnd: random.Random, bases: dict[str, list[Context]], others: dict[str, list[Context]]) -> tuple[str, str, int, int, int]:
    """One labelled example in words of the corpus, its kind dealt evenly; see the module's text."""
    of = rnd.choice([k for k in KINDS if k in bases or k in others])
    if of in others and (of not in bases or rnd.random() < 0.25):
        kind, _, before, span, after = rnd.choice(others[of])
        return f"{before}{span}{after}", kind, len(before), len(before) + len(span), 0
    kind, _, before, span, after = rnd.choice(bases[of])
    label, place = int(rnd.random() < 0.6), rnd.random()
    lead = "" if place < 0.5 else rnd.choice(CUE_WORDS[kind] if (place < 0.95) == bool(label) else AGAINST_WORDS) + " "
    return _example_in(rnd, before, kind, label, after, lead, span)


@dataclass(frozen=True)
class Selector:
    """Boosted trees with a calibration and a threshold for each kind."""

    trees: boosting.BoostedTrees
    slope: float
    shift: float
    thresholds: dict[str, float]

    def probabilities(self, rows: list[list[float]]) -> np.ndarray:
        return boosting._sigmoid(self.slope * self.trees.margin(np.array(rows, float)) + self.shift)


@lru_cache(maxsize=2)
def fitted_selector(seed: int = 7, known: tuple[Context, ...] = ()) -> Selector:
    """Fit, calibrate and set thresholds on ``EXAMPLES`` examples, every second of them from ``known`` if there are any; the same for the same seed and contexts."""
    rnd = random.Random(seed)
    bases, others = {}, {}
    for c in known:
        if c[1] or surely_none(c[0], *c[2:]):
            (bases if c[1] else others).setdefault(c[0], []).append(c)
    examples = [_corpus_example(rnd, bases, others) if (bases or others) and i % 2 else _written_example(rnd) for i in range(EXAMPLES)]
    x = np.array([features(t, k, s, e) for t, k, s, e, _ in examples], float)
    y = np.array([e[-1] for e in examples], float)
    cut = EXAMPLES * 3 // 4
    trees = boosting.fit(x[:cut], y[:cut])
    slope, shift = boosting.platt(trees.margin(x[cut:]), y[cut:])
    p = boosting._sigmoid(slope * trees.margin(x[cut:]) + shift)
    thresholds = {}
    for i, kind in enumerate(KINDS):
        own = x[cut:, i] == 1
        order = np.argsort(-p[own])
        n = np.arange(1, own.sum() + 1)
        share = np.cumsum(y[cut:][own][order]) / n
        # Wilson's lower bound: few examples must not pass for a good share.
        sure = (share + SURE**2 / (2 * n) - SURE * np.sqrt(share * (1 - share) / n + (SURE / (2 * n)) ** 2)) / (1 + SURE**2 / n)
        good = np.flatnonzero(sure >= PRECISION)
        thresholds[kind] = float(max(0.5, p[own][order][good[-1]])) if len(good) else 1.0
    return Selector(trees, slope, shift, thresholds)


class _Taken:
    """Stretches of a text that spans take up; asks and additions look at the neighbours only."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for start, end in sorted((s, e) for _, s, e in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def selected(text: str, base: list[tuple[str, int, int]], selector: Selector) -> list[tuple[str, int, int]]:
    """Proposals chosen beside the base: likely enough, touching no base span and no likelier proposal."""
    taken = _Taken(base)
    found = list(dict.fromkeys(p for p in proposals(text) if not taken.meets(p[1], p[2])))
    if not found:
        return []
    chance = selector.probabilities([features(text, *p) for p in found])
    kept: list[tuple[str, int, int]] = []
    for p, span in sorted(zip(chance, found), key=lambda c: (-c[0], c[1][1], -c[1][2], c[1][0])):
        if p >= selector.thresholds[span[0]] and not taken.meets(span[1], span[2]):
            kept.append(span)
            taken.add(span[1], span[2])
    return kept


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join(out) + text[last:]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
SPAN_DDL = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_spans(docs: DataFrame, carried: dict[str, Column], text_col: str = "text", selector: Selector | None = None, with_redacted: bool = False) -> DataFrame:
    """The ``carried`` columns with all spans of every whole text, and the redacted text if asked for.

    Spans are ordered by kind (``KINDS``), then start; ``base`` tells whether a
    fixed pattern gave them. Null texts have no spans and stay null.
    """
    selector = selector or fitted_selector()
    kept = docs.select(*(c.alias(n) for n, c in carried.items()), F.col(text_col).alias("__text"))
    names = list(carried)

    def run(batches):
        for batch in batches:
            lists, texts = [], []
            for value in batch.column(len(names)):
                text = value.as_py()
                base = base_spans(text or "")
                more = selected(text or "", base, selector)
                fixed = set(base)
                lists.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in fixed} for k, s, e in in_order(base + more)])
                texts.append(redacted(text, base + more) if with_redacted and text is not None else None)
            columns = [*batch.columns[: len(names)], pa.array(lists, pa.list_(SPAN))]
            columns += [pa.array(texts, pa.string())] if with_redacted else []
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "spans", *["redacted"] * with_redacted])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, spans {SPAN_DDL}" + ", redacted string" * with_redacted)


CONTEXT_DDL = "kind string, base boolean, before string, span string, after string"


def contexts(docs: DataFrame, text_col: str = "text", about: int = CONTEXTS) -> DataFrame:
    """``kind, base, before, span, after``: about ``about`` different spans for each kind and side.

    All spans and proposals of all whole texts are told apart from their copies,
    counted, and chosen by hash, so that the choice depends neither on order nor
    on partitions. Spans of over ``LONGEST`` code points are not learned from.
    """
    names = [c.split()[0] for c in CONTEXT_DDL.split(", ")]

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                base = base_spans(text)
                taken = _Taken(base)
                rest = [p for p in dict.fromkeys(proposals(text)) if not taken.meets(p[1], p[2])]
                rows = {(k, own, text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT]) for spans, own in ((base, True), (rest, False)) for k, s, e in spans if e - s <= LONGEST}
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "base" else pa.string()) for n, c in zip(names, zip(*rows))], names=names)

    found = written(docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(run, CONTEXT_DDL).distinct(), "contexts")
    counts = found.groupBy("kind", "base").agg(F.count("*").alias("n"))
    place = F.xxhash64(*names) / F.lit(2.0**64) + 0.5
    return found.join(F.broadcast(counts), ["kind", "base"]).where(place < about / F.col("n")).select(*names)


def learned_selector(docs: DataFrame, text_col: str = "text") -> Selector:
    """The selector fitted on about ``CONTEXTS`` spans a kind and side of ``docs``, which are all that reaches the driver."""
    return fitted_selector(known=tuple(sorted(tuple(r) for r in contexts(docs, text_col).collect())))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, redacted`` for every row; see :func:`find_spans`."""
    return find_spans(docs, {"doc_id": F.col(id_col)}, text_col, learned_selector(docs, text_col), with_redacted=True)


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of every row.

    Returns one row per input row: ``doc_id, n_email, n_ip, n_card, n_phone``
    (base spans), ``base_sha256`` (of the base spans as ``kind:start:end``,
    comma-joined), ``spans`` (all spans likewise), ``n_added``. Offsets count
    code points, ends are exclusive. Null counts as empty. Repeated rows are
    reported one by one; an empty table gives an empty result; other columns are
    ignored.
    """
    found = find_spans(docs, {"doc_id": F.col(id_col)}, text_col, learned_selector(docs, text_col))
    as_text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
