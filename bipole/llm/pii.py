"""Personal data: overlapping candidate spans from high-recall generators, boosted trees over format and context, calibrated thresholds.

The trees are trained on the driver from seeded examples made here (EXAMPLES of them, a fixed number); the pattern of every kind and look-alikes such as
order numbers, versions, prices, dates and hashes occur among common words, with and without words that name them. Platt scaling and a threshold for each
kind come from a held-out part.
"""

from __future__ import annotations

import ipaddress
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bipole.llm.boosting import Boosted, platt
from bipole.llm.common import arrow_map

EXAMPLES = 5000
KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "BIRTHDATE", "ACCOUNT")
_W = r"(?<![^\W_])"
_E = r"(?![^\W_])"
_D, _N = r"(?<!\d)", r"(?!\d)"
_H = "[0-9A-Fa-f]{1,4}"
GENERATORS: list[tuple[str, re.Pattern]] = [
    ("EMAIL", re.compile(r"(?<![\w.+%'-])[\w.+%'-]++@[\w-]+(?:\.[\w-]+)+")),
    ("PHONE", re.compile(rf"(?:\+|{_D})(?:\d{{1,3}}[ ./-]?)?(?:\(\d{{1,5}}\)[ ./-]?\d{{2,10}}(?:[ ./-]\d{{2,10}}){{0,4}}|\d{{2,10}}(?:[ ./-]\d{{2,10}}){{1,4}}){_N}")),
    ("PHONE", re.compile(rf"(?:\+|{_D}00|{_D})\d{{7,15}}{_N}")),
    ("IP", re.compile(rf"{_D}\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_N}")),
    ("IP", re.compile(rf"{_W}(?:(?:{_H}:){{1,7}}(?:(?::{_H}){{1,6}}|:)|::(?:{_H}:){{0,6}}{_H}|(?:{_H}:){{2,7}}{_H})(?:(?<=[:.\dA-Fa-f])(?:\.\d{{1,3}}){{3}})?{_E}")),
    ("CARD", re.compile(rf"{_D}\d(?:[ -]?\d){{12,18}}{_N}")),
    ("CARD", re.compile(rf"{_D}\d{{13,19}}{_N}")),
    ("SSN", re.compile(rf"{_W}\d{{3}}[- ]\d{{2}}[- ]\d{{4}}{_E}")),
    ("IBAN", re.compile(rf"{_W}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}")),
    ("BIRTHDATE", re.compile(rf"{_W}(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}){_E}")),
    ("ACCOUNT", re.compile(rf"{_W}\d{{6,17}}{_E}")),
]
_ANCHOR = re.compile(r"[0-9]+|:[0-9A-Fa-f]{0,4}:")
#: No proposal of a generator reaches further from the digits or colons in it; addresses of mail, which may be of any length, are found from their sign.
_REACH = 120
_LOCAL = re.compile(r"[\w.+%'-]")
_DOMAIN = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
IBAN = next(g for g, (kind, _) in enumerate(GENERATORS) if kind == "IBAN")
#: Generators of grouped numbers and the characters that the shortest has.
_GROUPED = {1: 5, next(g for g, (kind, _) in enumerate(GENERATORS) if kind == "CARD"): 13, IBAN: 15}
_CONTEXT = [
    re.compile(p if p[0] == "[" else rf"(?<![^\W_])(?:{p})(?![^\W_])", re.I)
    for p in (
        r"e-?mail|mail to|mailto|contact|correo|courriel",
        r"phone|tel|call|mobile|fax|cell|telefon|tél|teléfono|whatsapp|sms",
        r"ip|ip addr\w*|host|client|login|from address|adresse ip",
        r"card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte",
        r"ssn|social sec|tax id|national id",
        r"iban|bank|konto|compte|cuenta",
        r"born|birth|dob|geboren|né|née|nacid",
        r"account|acct|customer no|passport|licen[cs]e no|patient|member",
        r"orders?|invoices?|tickets?|tracking|ref|reference|sku|items?|part no|serial|cases?|batch|shipment|commande|pedido|bestell\w*|rechnung",
        r"versions?|releases?|builds?|v|firmware|sections?|chapters?|§|rfc",
        r"isbn|issn|doi|page|pp\.|vol",
        r"[$€£%]|\b(?:usd|eur|price|total|population|approx|kg|km|bytes)\b",
        r"date|updated|published|posted|deadline|meeting|copyright",
        r"timestamp|epoch|hash|sha\d*|md5|commit|checksum|uuid",
    )
]

#: The same as one pattern, to tell which of them stands nearest before a candidate.
_NEAREST = re.compile("|".join(f"({p.pattern})" for p in _CONTEXT), re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ipv6(span: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(span))
    except ValueError:
        return False


def _mails(text: str) -> Iterator[tuple[int, int, int]]:
    """Addresses of any length, in one pass: from every sign to both sides."""
    at = text.find("@")
    while at >= 0:
        start = at
        while start and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end(), 0
        at = text.find("@", at + 1)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of every proposal; generators look only near digits, at signs and the colons of addresses, of which every kind has one."""
    found, lo, hi = list(_mails(text)), -1, -1
    spans = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - _REACH), m.end() + _REACH
        if a <= hi:
            hi = b
        else:
            if hi >= 0:
                spans.append((lo, hi))
            lo, hi = a, b
    if hi >= 0:
        spans.append((lo, hi))
    for lo, hi in spans:
        for g, (kind, pattern) in enumerate(GENERATORS):
            if kind == "EMAIL":
                continue
            at, end = lo, min(hi, len(text))
            while m := pattern.search(text, at, end):
                found.append((m.start(), m.end(), g))
                at = m.end()
                if g in _GROUPED:  # other numbers may stand beside a grouped one: every shorter run of its groups is proposed as well, and what begins at its second group
                    parts, least = list(re.finditer(r"[+(]*\w+", m[0])), _GROUPED[g]
                    found += [(m.start() + a.start(), m.start() + b.end(), g) for i, a in enumerate(parts) for b in parts[i + (g != IBAN) :] if (a, b) != (parts[0], parts[-1]) and least <= sum(map(str.isalnum, m[0][a.start() : b.end()])) and (g != IBAN or i == 0)]
                    if len(parts) > 1 and g != IBAN:
                        at = m.start() + parts[1].start()
    found = list(dict.fromkeys(found))
    return found


def _overlaps(found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For every candidate, how many others of another place overlap it, and whether one holds it; by sorting, since a text may have any number."""
    start, end = np.array([f[:2] for f in found], np.int64).reshape(-1, 2).T
    _, same, twins = np.unique(np.stack([start, end], 1), axis=0, return_inverse=True, return_counts=True)
    over = len(found) - np.searchsorted(np.sort(end), start, "right") - (len(found) - np.searchsorted(np.sort(start), end, "left")) - twins[same.ravel()]
    order = np.lexsort((-end, start))
    reach = np.maximum.accumulate(end[order])  # the furthest end of those that begin no later; of equal begins the longest comes first
    begin = np.searchsorted(start[order], start, "left")
    before = np.where(begin > 0, reach[np.maximum(begin - 1, 0)], -1)
    return over, (before >= end) | (end[order][begin] > end)


def _char(c: str) -> list[float]:
    return [c == "", c.isspace(), c.isalpha(), c in "#$€£", c in ".,;:!?", c in "=\"'", c in "-/_"]


def describe(text: str, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Format and context features of every candidate."""
    rows = []
    over, held = _overlaps(found) if found else ((), ())
    for (s, e, g), n_over, inside in zip(found, over, held, strict=True):
        span = text[s:e]
        digits = "".join(c for c in span if "0" <= c <= "9")
        groups = re.findall(r"\d+", span)
        before, after = text[max(0, s - 48) : s], text[e : e + 24]
        octets = span.split(".")
        parts = span.rpartition("@")
        near = 0
        for m in _NEAREST.finditer(before):
            near = m.lastindex
        kind = GENERATORS[g][0]
        rows.append(
            [
                *(kind == k for k in KINDS), g, len(span), len(digits), sum(c.isalpha() for c in span), sum(c in " .-/" for c in span), span.startswith("+"), "(" in span, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
                13 <= len(digits) <= 19 and _luhn(digits), len(digits) == 16, len(octets) == 4 and all(o.isdigit() and int(o) < 256 for o in octets), len(octets) == 4 and octets[0] not in ("0", "1", "2", "3", "v"),
                span.count(":"), ":" in span and _ipv6(span), "::" in span, len(parts[2].rpartition(".")[2]) if parts[1] else 0, len(parts[0]), kind == "IBAN" and _iban(span), len(set(digits)), digits[:1] == "0", "-" in span, "/" in span, bool(re.search(r"(?:19|20)\d\d", span)), len(groups) > 1 and len(groups[-1]) == 4,
                n_over, inside, *(near == j for j in range(1, len(_CONTEXT) + 1)), *_char(text[s - 1 : s]), *_char(text[e : e + 1]), *(bool(p.search(before)) for p in _CONTEXT), *(bool(p.search(after)) for p in _CONTEXT[8:12]),
            ]
        )
    return np.array(rows, np.float64).reshape(len(rows), -1)


_WORDS = """the of and to in is was for on with as by at from this that which have not are but they were all can when there use each how their will other about many then them would these some
der die das und ist nicht mit sich auf für eine auch werden nach über haben wurde zwischen Straße Haus Zeit Jahr le la les des est dans pour que qui sur pas plus avec sont été même année maison el los las
una por con para como más pero sus este entre cuando muy sin sobre también hasta hay donde quien river mountain engine paper market school winter doctor window music system report garden bridge letter
history language energy number science water people village machine""".split()
_GIVEN = "anna ben carla david elena felix greta hugo ines jonas kate lukas maria nora oscar paula quentin rosa simon tara ursula victor wendy yusuf zoe o'neil".split()
_FAMILY = "smith meyer dubois garcia rossi novak jensen kowalski brown fischer lefebvre lopez silva berg young khan lindqvist murphy weber martin".split()


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text of common words with spans of personal data, of look-alikes, or of both."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: ":".join(f"{rng.randrange(rng.choice([16, 65536, 65536])):x}" for _ in range(n))
    quad = lambda: ".".join(str(rng.randint(i == 0, rng.choice([255, 255, 40]))) for i in range(4))
    prose = lambda n: "".join(rng.choice(_WORDS) + rng.choice([" "] * 9 + [", ", ". ", "; ", " - ", "\n", ": ", " / ", " ... ", "! ", " ## ", " > ", " | "]) for _ in range(n))

    def luhn(base: str) -> str:
        return next(base + c for c in "0123456789" if _luhn(base + c))

    def mail() -> str:
        a, b = rng.choice(_GIVEN), rng.choice(_FAMILY)
        name = rng.choice([f"{a}.{b}", f"{a[0]}.{b}", f"{a}_{b}", f"{a}{b}", f"{b}-{a}", a, f"{a}+{rng.choice(_WORDS)}", f"{a}{d(rng.randint(1, 4))}", f"{a}.{d(rng.randint(1, 4))}", f"{a[0]}{b}{d(2)}", rng.choice(["info", "sales", "press", "no-reply", "office"]), (a + b) * rng.randint(1, 9)])
        host = rng.choice([*_FAMILY, *_WORDS[:12], "mail", "web", "post"]) + rng.choice(["", "", "-online", d(1), d(2)])
        return f"{name}@{rng.choice(['', '', '', 'mail.', 'smtp2.', 'lists.', 'cs.'])}{host}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'edu', 'info', 'example', 'example.org'])}"

    def phone() -> str:
        cc = rng.randint(1, 99)
        return rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{cc} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"+{cc} {d(3)} {d(3)} {d(4)}", f"+{cc}{d(10)}", f"00{cc} {d(3)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{cc} {d(2)} {d(8)}", f"+{cc} ({d(2)}) {d(8)}", f"0{d(3)} {d(7)}", f"0{d(3)}-{d(7)}", f"0{d(rng.randint(2, 3))}/{d(rng.randint(6, 8))}"])

    def address() -> str:
        n = rng.randint(1, 5)
        return rng.choice([quad] * 4 + [lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), lambda: "fe80::" + hexes(rng.randint(1, 4)), lambda: f"{hexes(n)}::{hexes(rng.randint(0, 6 - n))}", lambda: "2001:db8::" + hexes(rng.randint(0, 5)), lambda: rng.choice(["::1", "::" + hexes(rng.randint(1, 3))]), lambda: "::ffff:" + quad()])()

    def card() -> str:
        base = rng.choice([luhn(rng.choice("456") + d(14)), luhn("4" + d(14)), luhn("37" + d(12)), d(16)])
        cut = [base[i : i + 4] for i in range(0, len(base), 4)]
        return rng.choice([base, base, " ".join(cut), "-".join(cut)])

    def iban() -> str:
        head, body = rng.choice(["DE", "FR", "ES", "GB", "IT", "NL", "AT", "CH"]), d(rng.choice([12, 14, 16, 18, 20]))
        span = f"{head}{98 - int(''.join(str(int(c, 36)) for c in body + head + '00')) % 97:02d}{body}"
        return rng.choice([span, " ".join(span[i : i + 4] for i in range(0, len(span), 4))])

    def date() -> str:
        return rng.choice([f"{rng.randint(1930, 2012)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1930, 2012)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1930, 2012)}"])

    made = {"EMAIL": mail, "PHONE": phone, "IP": address, "CARD": card, "SSN": lambda: f"{d(3)}-{d(2)}-{d(4)}", "IBAN": iban, "BIRTHDATE": date, "ACCOUNT": lambda: d(rng.randint(7, 12))}
    names = {
        "EMAIL": ["email:", "contact", "mail to", "e-mail", "write to", "<"], "PHONE": ["phone:", "tel.", "call", "mobile", "fax", "Telefon", "ring us at"], "IP": ["ip", "host", "client", "login from", "server", "address"], "CARD": ["card", "credit card number", "visa", "paid with", "Mastercard:"], "SSN": ["SSN", "social security number", "ssn:"],
        "IBAN": ["IBAN", "bank account", "Konto"], "BIRTHDATE": ["born", "date of birth", "DOB:", "born on", "geboren am", "née le"], "ACCOUNT": ["account number", "acct", "passport no", "patient id", "account:", "member id"],
    }

    def real() -> tuple[str, str, str]:
        kind = rng.choice([*KINDS, "EMAIL", "PHONE", "PHONE", "IP", "CARD", "CARD"])
        span = made[kind]() if rng.random() > 0.06 or kind != "PHONE" else d(10)
        named = kind in ("BIRTHDATE", "ACCOUNT") or span.isdigit() and kind == "PHONE" or rng.random() < 0.35
        lead = rng.choice(names[kind]) + rng.choice([" ", " ", ": ", " = ", " is "]) if named else rng.choice(["", "", "", "(", "- ", "\n", '"', "["])
        return lead, span, kind

    def false() -> tuple[str, str, str]:
        year, month, day = rng.randint(1999, 2025), rng.randint(1, 12), rng.randint(1, 28)
        lead, span = rng.choice(
            [
                lambda: (rng.choice(["order #", "order ", "orders ", "order no. "]), rng.choice([d(rng.randint(6, 12)), luhn("4" + d(14)), d(16)])), lambda: ("invoice ", d(rng.randint(6, 14))), lambda: (rng.choice(["version ", "versions ", "release ", "build ", "firmware "]), f"{rng.randint(0, 12)}.{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 99)}"), lambda: ("v", f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}"),
                lambda: ("$", f"{d(3)},{d(3)}.{d(2)}"), lambda: ("", f"{rng.randint(1950, 2025)}-{rng.randint(1950, 2025)}"), lambda: (rng.choice(["updated ", "published ", "posted ", "deadline ", ""]), rng.choice([f"{year}-{month:02d}-{day:02d}", f"{day}.{month}.{year}", f"{month}/{day}/{year}"])), lambda: ("sha ", "".join(rng.choice("0123456789abcdef") for _ in range(40))),
                lambda: (rng.choice(["isbn ", "ISBN "]), rng.choice([f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", "978" + d(10)])), lambda: ("timestamp ", "1" + d(rng.choice([9, 12]))), lambda: ("", d(rng.randint(1, 6))), lambda: (rng.choice(["tracking ", "shipment ", "tracking number "]), rng.choice([d(rng.randint(12, 18)), luhn(d(15))])), lambda: (rng.choice(["section ", "chapter ", "sections "]), ".".join(str(rng.randint(1, 9)) for _ in range(4))),
                lambda: ("", f"{rng.randint(0, 23):02d}:{d(2)}:{d(2)}"), lambda: ("serial ", d(8) + "-" + d(4)), lambda: ("pp. ", f"{d(3)}-{d(3)}"), lambda: ("population ", d(7)), lambda: ("", d(rng.randint(7, 9))), lambda: ("10 ", f"{d(2)} {d(2)} {d(2)}"), lambda: ("ref. ", f"{d(4)} {d(4)}"), lambda: ("", f"{d(3)} {d(3)}"), lambda: (rng.choice(["ticket ", "case ", "sku ", "part no ", "batch "]), rng.choice([d(rng.randint(7, 16)), f"{d(4)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])),
                lambda: ("ref. ", f"{rng.randint(1990, 2025)}/{d(rng.randint(5, 7))}"), lambda: ("invoice ", f"{d(4)}-{d(rng.randint(6, 8))}"), lambda: ("order ", f"{d(rng.randint(6, 8))} {d(rng.randint(2, 7))}"), lambda: ("", f"{rng.choice(['std', 'add', 'face', 'Dec', 'cafe', 'b', *_WORDS[:9]])}::{rng.choice(['add', 'f', 'Bead', 'feed', *_WORDS[:9]])}"),
                lambda: ("score ", f"{d(1)}:{d(1)}"), lambda: ("", " ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(3, 9)))), lambda: ("pi = 3.", d(rng.randint(7, 16))), lambda: ("@", rng.choice(_GIVEN) + d(2)), lambda: ("id ", "-".join("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))),
            ]
        )()
        return lead, span, ""

    text, truth = prose(rng.randint(0, 12)), []
    for _ in range(rng.choice([1, 1, 1, 2, 3])):
        lead, span, kind = real() if rng.random() < 0.62 else false()
        text += lead
        if kind:
            truth.append((len(text), len(text) + len(span), kind))
        text += span + rng.choice([" ", " ", ". ", ", ", "\n", "; ", ") ", " | ", "> ", " and ", '" ', " ~~ ", "!! "]) + prose(rng.choice([0, 0, 1, 3, 6, 12]))
    return text, truth


class Detector:
    """Trees with the calibration and threshold of each kind."""

    def __init__(self, examples: int = EXAMPLES, seed: int = 11):
        rng = random.Random(seed)
        xs, ys, kinds, part, true = [], [], [], [], Counter()
        for n in range(examples):
            text, truth = _example(rng)
            found = candidates(text)
            if n % 4 == 3:  # those that no candidate equals count as missed
                true.update(k for _, _, k in truth)
            if found:
                xs.append(describe(text, found))
                ys += [any((s, e) == (a, b) and GENERATORS[g][0] == k for a, b, k in truth) for s, e, g in found]
                kinds += [GENERATORS[g][0] for _, _, g in found]
                part += [n % 4 == 3] * len(found)
        x, y, kind, held = np.concatenate(xs), np.array(ys, float), np.array(kinds), np.array(part)
        self.trees = Boosted(x[~held], y[~held])
        raw = self.trees.raw(x[held])
        self.slope, self.offset = platt(raw, y[held])
        p, y, kind = self.probability(raw), y[held], kind[held]
        self.threshold = {}
        for k in KINDS:
            own, real = p[kind == k], y[kind == k]
            grid = np.linspace(0.05, 0.95, 91)
            tp = np.array([(real[own >= t]).sum() for t in grid])
            shown = np.array([(own >= t).sum() for t in grid])
            f2 = 5 * tp / np.maximum(1e-9, 4 * true[k] + shown)
            best = np.flatnonzero(f2 >= f2.max() - 1e-12)
            self.threshold[k] = float(grid[best[len(best) // 2]])

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))

    def spans(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """Disjoint (start, end, kind, probability) to redact: over the threshold of the kind, the likeliest first, then the longest, then the first."""
        found = candidates(text) if text else []
        if not found:
            return []
        p = self.probability(self.trees.raw(describe(text, found)))
        chosen: list[tuple[int, int, str, float]] = []
        for at in sorted(range(len(found)), key=lambda i: (-round(p[i], 6), found[i][0] - found[i][1], found[i])):
            s, e, g = found[at]
            if p[at] >= self.threshold[GENERATORS[g][0]]:
                k = bisect_left(chosen, (s,))
                if (k == 0 or chosen[k - 1][1] <= s) and (k == len(chosen) or e <= chosen[k][0]):
                    chosen.insert(k, (s, e, GENERATORS[g][0], float(p[at])))
        return chosen


@cache
def detector() -> Detector:
    return Detector()


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    parts, at = [], 0
    for s, e, kind, _ in spans:
        parts += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*parts, text[at:]])


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])


def personal_data(docs: DataFrame, model: Detector | None = None) -> DataFrame:
    """Rows (doc_id, n_spans, spans, text) of the documents with personal data: the spans by character, and the whole text with the spans replaced by
    their kind in brackets. Found data itself isn't repeated.

    Null and empty texts, and texts without personal data, give no row. Texts of any length are scanned whole. Overlapping candidates that tie go to the
    longer, then to the earlier. Repeated rows give repeated results, a null id stays null, empty tables give no rows, further columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or detector())

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, rows = batch["doc_id"].to_pylist(), []
        for i, text in enumerate(batch["text"].to_pylist()):
            if spans := held.value.spans(text):
                rows.append((ids[i], len(spans), [dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in spans], redact(text, spans)))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.list_(_SPAN), pa.string()))], ["doc_id", "n_spans", "spans", "text"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), each, "doc_id bigint, n_spans bigint, spans array<struct<start:int,end:int,kind:string,score:double>>, text string")


def redact_documents(docs: DataFrame, model: Detector | None = None) -> DataFrame:
    """All rows and columns of docs, personal data in text replaced; n_chars, if it is there as an integer column, follows the new text (one of another type stays as it is).

    Null and empty texts stay as they are; texts of any length are scanned whole; overlapping candidates that tie go to the longer, then to the earlier. Repeated rows and
    rows with null ids are treated each by itself, further columns of any type are carried along, an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or detector())
    schema: T.StructType = docs.schema
    names = docs.columns
    counted = "n_chars" in names and isinstance(schema["n_chars"].dataType, T.IntegralType)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch["text"].to_pylist()
        out = [redact(t, s) if (s := held.value.spans(t)) else t for t in texts]
        columns = [*batch.columns]
        columns[names.index("text")] = pa.array(out, pa.string())
        if counted:
            old = columns[names.index("n_chars")]
            columns[names.index("n_chars")] = pa.array([n if a is b or a == b else len(b) for n, a, b in zip(old.to_pylist(), texts, out, strict=True)], old.type)
        yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs, each, schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
