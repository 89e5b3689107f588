"""Personal data in whole texts: exact base patterns, and spans that boosted trees accept among wide candidates."""

from __future__ import annotations

import hashlib
import random
import re
import warnings
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkstone.llm.boosting import Trees, boost, calibrate, sigmoid
from inkstone.llm.common import free_name, map_arrow, short_batches, slices, whole_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the look-behinds change no match, they keep a failing run of digits from being tried at every digit
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of a local part, an at sign and a dotted domain, found from the signs outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns that pass their check, by kind and start."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


#: The ways to write the at sign of an address; no spelled-out address is without one.
AT_SIGN = re.compile(r"\[at\]|\(at\)|\{at\}|<at>|＠|[\x20]at(?=[\x20])", re.I)
SPELLED = re.compile(r"[\w.%+-]{1,64}[\x20]?(?:\[at\]|\(at\)|\{at\}|<at>|＠|[\x20]at[\x20])[\x20]?[\w-]{1,63}(?:[\x20]?(?:\.|\[dot\]|\(dot\)|\{dot\}|[\x20]dot[\x20])[\x20]?[\w-]{2,63}){1,4}", re.I)
#: Generators of high recall, each of spans of one kind, which may overlap; one runs on every text that meets its necessary condition.
WIDE = (
    ("ip", "digit", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[\x20]?(?:\[\.\]|\(\.\)|\[dot\]|[,·])[\x20]?[0-9]{1,3}){3}(?![0-9])")),
    ("ip", "colons", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ip", "double", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:])")),
    ("card", "digit", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[\x20._/–-]{1,3}[0-9]{2,6}){2,5}(?![0-9])")),
    ("card", "digit", re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")),
    ("phone", "digit", re.compile(r"(?<![0-9A-Za-z])(?:(?:\+|00)?[0-9]{1,4}[\x20./-]{1,2})?\(?[0-9]{2,4}\)?(?:[\x20./–-]{1,2}[0-9]{2,4}){2,4}(?![0-9A-Za-z])")),
    ("phone", "digit", re.compile(r"(?<![0-9A-Za-z.,])\(?[0-9]{3}\)?[\x20.-]{0,2}[0-9]{3}[\x20.-]{0,1}[0-9]{4}(?![0-9A-Za-z])")),
)
LOCAL_WORD = re.compile(r"[\w.%+-]")
CONTEXT = 32
#: Words near personal data or near other numbers, by what they speak for.
HINTS = (
    re.compile(r"tel|phone|call|mobil|fax|ruf|llam|appel|whatsapp|sms", re.I),
    re.compile(r"card|visa|master|amex|credit|karte|tarjeta|carte|pay", re.I),
    re.compile(r"\bip\b|host|server|addr|login|from|proxy", re.I),
    re.compile(r"mail|contact|write|reach|kontakt|correo", re.I),
    re.compile(r"version|\bv\b|isbn|page|order|invoice|\bid\b|no\.|date|nr|total|price|serial|sku|ref", re.I),
)
DATE = re.compile(r"(?:19|20)[0-9]{2}[./\x20-][01]?[0-9][./\x20-][0-3]?[0-9]|[0-3]?[0-9][./\x20-][01]?[0-9][./\x20-](?:19|20)[0-9]{2}")


def spelled_emails(text: str) -> list[Span]:
    """Addresses with a spelled-out at sign, found from the signs outwards."""
    out, end = [], 0
    for sign in AT_SIGN.finditer(text):
        if sign.start() < end:
            continue
        start = sign.start()
        if start > end and text[start - 1] == " ":
            start -= 1
        last = start
        while start > end and last - start < 64 and LOCAL_WORD.match(text, start - 1):
            start -= 1
        m = SPELLED.match(text, start)
        if m:
            out.append(("email", *m.span()))
            end = m.end()
    return out


def wide_spans(text: str) -> list[Span]:
    holds = {"digit": DIGIT.search(text) is not None, "colons": text.count(":") >= 3, "double": "::" in text}
    found = set(spelled_emails(text))
    for kind, needed, pattern in WIDE:
        if holds[needed]:
            found.update((kind, *m.span()) for m in pattern.finditer(text))
    return sorted(found)


def describe(text: str, span: Span) -> list[float]:
    """Features of a candidate: its format, and the characters and words around it."""
    kind, a, b = span
    own = text[a:b]
    groups = [g for g in NOT_DIGIT.split(own) if g]
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + 8]
    left, right = before[-1:], after[:1]
    return [
        KINDS.index(kind), b - a, len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        own.count(" "), own.count("-"), own.count("."), own.count("/"), own.count(":"), own.count(","), own.count("("), own.count("["), "+" in own, "::" in own,
        luhn(digits) if len(digits) >= 12 else -1, sum(int(g) > 255 for g in groups if len(g) < 9) if groups else -1,
        int(digits[:1] or -1), digits[:2] == "00", len(set(digits)), DATE.search(own) is not None,
        sum(c.isalpha() for c in own), " at " in own.lower(), " dot " in own.lower(), len(own.rsplit(".", 1)[-1]) if "." in own else -1,
        left.isalpha(), left.isdigit(), left in "=:#\"'" and left != "", left.isspace() or left == "", right.isalpha(), right.isdigit(), right in ".,;:!?" and right != "", right in "%=\"'" and right != "",
        *(len(h.findall(before)) for h in HINTS),
    ]


class Detector:
    """Trees over candidates with a calibrated probability and a threshold for each kind."""

    def __init__(self, trees: Trees, slope: float, intercept: float, thresholds: dict[str, float]):
        self.trees, self.slope, self.intercept, self.thresholds = trees, slope, intercept, thresholds

    def probabilities(self, rows: list[list[float]]) -> np.ndarray:
        return sigmoid(self.slope * self.trees.raw(np.array(rows, dtype=np.float64)) + self.intercept)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Accepted candidates that touch no base span, the likeliest first where they overlap."""
        taken = merged(base)
        free = [s for s in wide_spans(text) if not touches(taken, s)]
        if not free:
            return []
        p = self.probabilities([describe(text, s) for s in free])
        out: list[Span] = []
        for k in sorted(range(len(free)), key=lambda k: (-p[k], free[k][1] - free[k][2], free[k])):
            if p[k] >= self.thresholds[free[k][0]] and not touches(taken, free[k]):
                out.append(free[k])
                insort(taken, free[k][1:])
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by kind and start."""
        base = base_spans(text)
        return base, sorted(base + self.added(text, base), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that spans cover, as sorted intervals that don't overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def touches(taken: list[tuple[int, int]], span: Span) -> bool:
    """Whether a span overlaps one of the intervals of ``merged``."""
    at = bisect_left(taken, (span[2], -1))
    return at > 0 and taken[at - 1][1] > span[1]


def example(rng: random.Random) -> tuple[str, str, int]:
    """(kind, value, 1 for personal data): a made-up value in one of the forms people write, or one that only looks like it."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    site = "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    kind = rng.choice(KINDS)
    if kind == "email":
        if rng.random() < 0.6:
            at = rng.choice(["[at]", "(at)", " [at] ", " at ", "＠", " (at) ", "{at}", "<at>"])
            dot = " dot " if at == " at " else rng.choice(["[dot]", "(dot)", ".", " dot ", " (dot) ", " [dot] ", "{dot}"])
            user = rng.choice([name, f"{name}.{digits(2)}", f"{name}.{site}", f"{name}_{digits(1)}"])
            return kind, f"{user}{at}{site}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'info'])}", 1
        return kind, rng.choice([f"{name} at {site} dot {name} {site}", f"{name} at {site}.{name}", f"met at {site}. {name}", f"look at {site}.{site}{name}"]), 0
    if kind == "ip":
        if rng.random() < 0.5:
            parts = [str(rng.randint(1, 254)) for _ in range(4)]
            if rng.random() < 0.3:
                if rng.random() < 0.6:
                    groups = [f"{rng.randint(0, 65535):x}" for _ in range(rng.randint(1, 6))]
                    cut = rng.randint(0, len(groups))
                    return kind, ":".join(groups[:cut]) + "::" + ":".join(groups[cut:]), 1
                return kind, ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8)), 1
            return kind, rng.choice(["[.]", "(.)", "[dot]"]).join(parts), 1
        return kind, rng.choice([", ".join(str(rng.randint(0, 999)) for _ in range(4)), ",".join(digits(3) for _ in range(4)), ":".join(digits(2) for _ in range(4)), "::".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(2)), f"{rng.randint(1, 99)}::{rng.randint(1, 99)}"]), 0
    if kind == "card":
        body = rng.choice("3456") + digits(14)
        check = next(c for c in "0123456789" if luhn(body + c))
        if rng.random() < 0.5:
            number = body + check
            return kind, rng.choice([".", "  ", "_", " - ", "/", "–"]).join(number[k : k + 4] for k in range(0, 16, 4)), 1
        number = body + rng.choice([c for c in "0123456789" if c != check])
        return kind, rng.choice(["", ".", " ", "-", "/"]).join(number[k : k + 4] for k in range(0, 16, 4)) if rng.random() < 0.6 else digits(rng.randint(12, 19)), 0
    area, mid, last = digits(3), digits(3), digits(4)
    if rng.random() < 0.5:
        return kind, rng.choice([f"({area}) {mid}-{last}", f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"1 ({area}) {mid}-{last}", f"00{digits(2)} {area} {mid} {last}", f"0{digits(2)}/{mid} {last}", f"({area}) {mid} {last}"]), 1
    year, month, day = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)
    return kind, rng.choice([f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"{year} {rng.randint(1900, 2030)} {year + 1}", digits(10), f"{digits(3)}-{digits(2)}-{digits(5)}-{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(3)}", f"{digits(4)} {digits(4)} {digits(4)}", f"{digits(2)} {digits(2)} {digits(2)}"]), 0


def train(snippets: list[str], examples: int = 8000, precision: float = 0.98, seed: int = 5) -> Detector:
    """Fit on made-up values set into snippets of the corpus, calibrate and choose thresholds on a held-out third.

    A candidate counts as personal data if it covers the value set in and no more than a little around it. A kind's
    threshold is the least from 0.5 on at which so large a share of its accepted held-out candidates is right.
    """
    rng = random.Random(seed)
    snippets = sorted(set(snippets)) or ["and so on"]
    rows, truth, kinds = [], [], []
    hint = {"email": ["mail ", "contact ", ""], "ip": ["host ", "from ", ""], "card": ["card ", "pay with ", ""], "phone": ["call ", "tel ", "phone: ", ""]}
    wrong = ["version ", "order ", "id ", "page ", "ref ", "", "", ""]
    for _ in range(examples):
        kind, value, good = example(rng)
        left, right = rng.choice(snippets), rng.choice(snippets)
        before = f"{left} {rng.choice(hint[kind] + ['', '', '']) if good else rng.choice(wrong)}"
        text = f"{before}{value}{rng.choice([' ', '. ', ', '])}{right}"
        taken = sorted((a, b) for _, a, b in base_spans(text))
        for span in wide_spans(text):
            if touches(taken, span) or span[2] <= len(before) or span[1] >= len(before) + len(value):
                continue
            rows.append(describe(text, span))
            near = abs(span[1] - len(before)) <= 3 and abs(span[2] - len(before) - len(value)) <= 1
            truth.append(int(good and near and span[0] == kind))
            kinds.append(span[0])
    x, y, k = np.array(rows, dtype=np.float64), np.array(truth, dtype=np.float64), np.array(kinds)
    held = np.arange(len(y)) % 3 == 0
    trees = boost(x[~held], y[~held])
    raw = trees.raw(x[held])
    slope, intercept = calibrate(raw, y[held])
    p, thresholds = sigmoid(slope * raw + intercept), {}
    for kind in KINDS:
        own = k[held] == kind
        thresholds[kind] = threshold_of(kind, p[own], y[held][own], precision)
    return Detector(trees, slope, intercept, thresholds)


def threshold_of(kind: str, p: np.ndarray, right: np.ndarray, precision: float) -> float:
    """The least threshold from 0.5 on whose accepted candidates are right in that share; else, with a warning, the most precise one."""
    reached = [(right[p >= t].mean(), t) for t in np.arange(0.5, 0.996, 0.005) if (p >= t).any()]
    fits = [t for share, t in reached if share >= precision]
    if fits:
        return float(fits[0])
    best = max(reached, key=lambda r: (r[0], -r[1]), default=(0.0, 0.5))
    warnings.warn(f"added spans of kind {kind} are right in {best[0]:.3f} of the held-out cases, under {precision}", stacklevel=2)
    return float(best[1])


def snippets_of(docs: DataFrame, rows: int, text_col: str) -> list[str]:
    """A few words from a place in each of ``rows`` texts, those of the least hashes; the bound is on the driver's work."""
    text = whole_text(text_col)
    place = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - 40, F.lit(1))) + 1
    picked = docs.filter(F.length(text) > 0).select(F.xxhash64(F.lit(3), text).alias("h"), F.substring(text, place, F.lit(40)).alias("s"))
    found = picked.orderBy("h", "s").limit(rows).collect()
    return [re.sub(r"[0-9@]", "", r["s"]) for r in found]


def detector_for(docs: DataFrame, sample: int = 500, text_col: str = "text") -> Detector:
    """Train with contexts from at most ``sample`` texts. Empty tables train on a fixed context."""
    return train(snippets_of(docs, sample, text_col))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text.

    Counts and the digest are of the base spans, ``spans`` also has what the detector adds; offsets are code
    points with an exclusive end. A null text is empty and has none; repeated rows stay; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)  # some 100 kB at any size of the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            found = [own.spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], type=pa.int64()) for kind in KINDS]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], type=pa.string())
            every = pa.array([written(spans) for _, spans in found], type=pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, every], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_arrow(rows, run, f"id {kind}, {counts}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the kind of its first."""
    out, end, last = [], 0, None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if last is not None and a < end:
            end = max(end, b)
            continue
        out.append(text[end:a])
        out.append(f"<{kind.upper()}>")
        last, end = kind, b
    return "".join(out) + text[end:]


def redact(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of the text masked. Null stays null; all other columns, names and repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    short_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def masks(texts: pa.Array) -> pa.Array:
        own = shared.value
        return pa.array([None if t is None else masked(t, own.spans(t)[1]) for t in texts.to_pylist()], type=pa.string())

    held = free_name(docs, "masked")
    done = docs.withColumn(held, masks(F.col(text_col)))
    return done.select(*(F.col(held).alias(c) if c == text_col else F.col(c) for c in docs.columns))
