"""Secret scan by assignment-aware lexing.

Assignment signs (``=``, ``:``, ``:=``, ``=>``) are found first; the name is lexed to the left (identifiers, dotted or quoted keys, subscripts, flags) and the
value to the right (quoted or triple-quoted literals, indented blocks of configuration, bare values, sums of literals and names, ``${NAME}`` and f-string references, calls with a default).
Mark-up is lexed by itself: elements with text, and elements that name a setting in one attribute and give its value in another or as their text.
Constants assigned earlier in the document are propagated into later uses, so a literal is also scored under every name that it reaches. The score adds
how sensitive the name is to how random the literal looks; placeholders and references to a vault or the environment don't count.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipole.llm.common import arrow_map

THRESHOLD = 0.6
_SIGN = re.compile(r":=|=>|(?<![=!<>+\-*/%&|^])=(?![=~])|:(?![:/=])")
_NAME = re.compile(r"""(?:(?:^|[^\w.$@\-])|(?<=[\s,;({\[]))(?:--?|\$|@)?(?:[A-Za-z_][\w.\-]*\[\s*)?["'`]?([A-Za-z_][\w.\-]*)["'`]?\s*\]?\s*(?:\s*:\s*[A-Za-z_][\w.\[\], |]*\s*)?$""")
_GAP = re.compile(r"[ \t]*(?:\\\r?\n[ \t]*)?\(?[ \t]*")
_QUOTED = re.compile(r"""(?:[rbuf]{1,2})?(\"\"\"|'''|"|'|`)""", re.I)
_BARE = re.compile(r"(?:\$\{[^}\n]*+\}|[^\s\"'`,;(){}\[\]<>#|&*]){1,16384}")
_REST = re.compile(_BARE.pattern.replace("{1,16384}", "*+"))
_BRACED = re.compile(r"\$\{[^}\n]*+\}")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.|&|\.)?[ \t]*(?:\\?\r?\n[ \t]*)?")
_REF = re.compile(r"\$\{([A-Za-z_]\w*)(?:(?::-|:)([^}]*))?\}|\$\(?([A-Za-z_]\w*)\)?|\{([A-Za-z_]\w*)\}|%\(([A-Za-z_]\w*)\)s")
_IDENT_HEAD = re.compile(r"[A-Za-z_][\w.]*")
_OTHER = re.compile(r"[A-Za-z_.]*")
_CALL = re.compile(r"(?:os\.)?(?:getenv|environ\.get|env|ENV\.fetch|config|System\.getProperty|getProperty|get)\(\s*[\"'][^\"'\n]*+[\"']\s*,\s*")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?\d?[+-]?[ \t]*(?:#[^\n]*+)?\r?\n")
_TAG = re.compile(r"<([A-Za-z_][\w.\-:]*+)((?:\s[^<>]*+)?)>(?:([^<>]*+)</\1\s*>)?")
_ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.\-:]*+)\s*+=\s*+(?:"([^"<>]*+)"|'([^'<>]*+)')""")
_DASHED = re.compile(r"[A-Za-z_][\w.\-]*")
_DOTLESS = re.compile(r"[\w\-]*")
_WORD = re.compile(r"[^\W_]+")
#: Values that joining makes longer than this are held as a Summary, since repeated doubling would fill memory; so are the ends of unquoted values that begin at many signs.
_HELD, _STEP = 4096, 512
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_WORDS = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.8, "signature": 0.5, "salt": 0.5, "pass": 0.8, "pat": 0.6, "jwt": 0.9, "dsn": 0.6, "cookie": 0.5, "passwort": 1.0, "contrasena": 1.0, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0, "clientsecret": 1.0, "connectionstring": 0.8}
_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("account", "key"): 0.9, ("auth", "key"): 0.9, ("master", "key"): 0.9, ("session", "id"): 0.5, ("session", "key"): 0.9, ("connection", "string"): 0.8, ("license", "key"): 0.6, ("ssh", "key"): 0.9, ("aws", "key"): 0.9}
_HARMLESS = {"count", "length", "len", "size", "limit", "max", "min", "num", "type", "name", "file", "path", "url", "uri", "expiry", "expires", "ttl", "field", "label", "policy", "enabled", "regex", "pattern", "public", "hint", "prompt", "index", "column", "position", "header", "issuer", "algorithm"}
_REFERENCE = re.compile(r"(?:\*+$|x{3,}$|\.\.\.|<[^>]*>$|\$\{|\{\{|%\(|process\.env\b|os\.environ\b|env\[|vault:|secretsmanager\b|ref\+)", re.I)
_LEAD = frozenset("your my the some insert enter change replace example sample dummy fake test todo put add none null nil true false undefined".split())
_FILLER = _LEAD | frozenset("password passwd pass secret token key api access private client user username name value string text default placeholder foo bar baz admin here this me it with your own real actual goes to in of is not set a an be xxx tbd redacted removed hidden masked empty changed please must".split())


def _words_of_filler(word: str) -> bool:
    """Whether the word is filler or filler words put together, such as changeme."""
    ends = [True] + [False] * len(word)
    for j in range(1, len(word) + 1):
        ends[j] = any(ends[i] and word[i:j] in _FILLER for i in range(max(0, j - 12), j))
    return ends[-1]


def _plain(word: str) -> bool:
    return word.isascii() and word.isalpha() and (word.islower() or word.isupper() or word.istitle())


class Summary:
    """What a score asks of a string, without the string. Summaries add up like the strings: the words that a cut may have parted are kept as ``left`` and
    ``right`` (41 characters of them, since longer words are all alike to placeholder()), those between as ``words``: (number, first, all plain, all filler, all short)."""

    def __init__(self, n: int, counts: Counter, head: str, tail: str, blanks: tuple[bool, bool, bool, bool], left: str, words: tuple | None, right: str):
        self.n, self.counts, self.head, self.tail, self.blanks, self.left, self.words, self.right = n, counts, head, tail, blanks, left, words, right

    @staticmethod
    @lru_cache(64)
    def of(text: str) -> Summary:
        core = text.strip()
        at = text.index(core)
        blanks = (bool(core), " " in text[:at], " " in core, " " in text[at + len(core) :]) if core else (False, " " in text, False, " " in text)
        runs = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        if runs == [(0, len(text))] or not text:
            left, words, right = text[:41], None, ""
        else:
            left = text[: min(runs[0][1], 41)] if runs and runs[0][0] == 0 else ""
            right = text[runs[-1][0] : runs[-1][0] + 41] if runs and runs[-1][1] == len(text) else ""
            words = _Words.none
            for a, b in runs[bool(left) : len(runs) - bool(right)]:
                words = _Words.add(words, _Words.of(text[a : min(b, a + 41)]))
        return Summary(len(text), Counter(text), text[:64], text[-2:], blanks, left, words, right)

    def __add__(self, other: Summary) -> Summary:
        (full, lead, inner, trail), (full2, lead2, inner2, trail2) = self.blanks, other.blanks
        blanks = (full or full2, lead or not full and lead2, full and full2 and (inner or trail or lead2 or inner2) or full and not full2 and inner or full2 and not full and inner2, trail2 or not full2 and trail)
        if self.words is None and other.words is None:
            left, words, right = (self.left + other.left)[:41], None, ""
        elif self.words is None:
            left, words, right = (self.left + other.left)[:41], other.words, other.right
        elif other.words is None:
            left, words, right = self.left, self.words, (self.right + other.left)[:41]
        else:
            left, words, right = self.left, _Words.add(_Words.add(self.words, _Words.of((self.right + other.left)[:41])), other.words), other.right
        return Summary(self.n + other.n, self.counts + other.counts, (self.head + other.head)[:64], (self.tail + other.tail)[-2:], blanks, left, words, right)


class _Words:
    """Facts on words: (number, first, all plain, all filler, all short)."""

    none = (0, "", True, True, True)

    @staticmethod
    def of(word: str) -> tuple:
        return (1, word.lower(), _plain(word), len(word) <= 40 and _words_of_filler(word.lower()), len(word) <= 12) if word else _Words.none

    @staticmethod
    def add(a: tuple, b: tuple) -> tuple:
        return (a[0] + b[0], a[1] or b[1], a[2] and b[2], a[3] and b[3], a[4] and b[4])


def joined(*parts: str | Summary) -> str | Summary:
    """The parts one after the other, as a string while that is short."""
    if len(parts) == 1 or all(isinstance(p, str) for p in parts) and sum(map(len, parts)) <= _HELD:
        return parts[0] if len(parts) == 1 else "".join(parts)
    whole = None
    for p in parts:
        if p != "":
            one = Summary.of(p) if isinstance(p, str) else p
            whole = one if whole is None else whole + one
    return whole if whole is not None else ""


def placeholder(literal: str | Summary) -> bool:
    """A reference to somewhere else, or whole words that only stand for a value: all filler, or several plain words of which the first says so. Anything with digits among letters
    or with mixed case in a word counts as a value."""
    s = literal
    if isinstance(literal, str):
        if _REFERENCE.match(literal):
            return True
        s = Summary.of(literal)
    elif _REFERENCE.match(s.head + "\0") or s.head[:1] == "<" and s.counts[">"] == 1 and s.tail.removesuffix("\n")[-1:] == ">":
        return True
    number, first, plain, filler, short = _Words.add(_Words.add(_Words.of(s.left), s.words or _Words.none), _Words.of(s.right))
    return number > 0 and plain and (filler or number > 1 and first in _LEAD and short)


def sensitivity(name: str) -> float:
    """How far a name says that its value is secret, 0 to 1."""
    parts = [p.lower() for p in _SPLIT.findall(name)]
    best = max([_WORDS.get(p.removesuffix("s") if p not in _WORDS else p, 0) for p in parts] + [_PAIRS.get(x, 0) for x in zip(parts, parts[1:], strict=False)] + [_WORDS.get("".join(x), 0) for x in zip(parts, parts[1:], strict=False)] + [0])
    return best * (0.35 if parts and (parts[-1] in _HARMLESS or parts[0] in ("public", "is", "has")) else 1)


def randomness(literal: str | Summary) -> float:
    """0 to 1 from length, character entropy and the mix of character classes."""
    if isinstance(literal, str):
        n, counts, spaced = len(literal), Counter(literal), " " in literal.strip()
    else:
        n, counts, spaced = literal.n, literal.counts, literal.blanks[2]
    if not n:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(any(re.match(p, c) for c in counts) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w\s]"))
    return min(1.0, 0.45 * min(n, 24) / 24 + 0.45 * min(entropy, 4.0) / 4.0 + 0.1 * (kinds >= 2)) * (0.5 if spaced else 1)


def score(name: str, literal: str | Summary) -> float:
    """0 to 1; nothing for names that aren't sensitive, literals of under 6 characters, placeholders and pure references."""
    sensitive = sensitivity(name)
    if not sensitive or (isinstance(literal, str) and len(literal) < 6) or placeholder(literal) or len(set(literal) if isinstance(literal, str) else literal.counts) < 4:
        return 0.0
    return round(sensitive * (0.35 + 0.65 * randomness(literal)), 6)


class _Runs:
    """Unquoted values of any length, each read once for all signs in it."""

    def __init__(self, text: str):
        self.text, self.slots = text, [None, None]  # a run, and one inside the braces of a reference in it

    def _run(self, at: int) -> tuple:
        """(start, end, references, summaries of its ends by place) of a run that ``at`` is a beginning in."""
        for k, slot in enumerate(self.slots):
            if slot is None or not slot[0] <= at < slot[1]:
                break
            i = bisect_right(slot[2], (at, -1)) - 1
            if i < 0 or not slot[2][i][0] < at < slot[2][i][1]:
                return slot
        end = _REST.match(self.text, at).end()
        found = at, end, [m.span() for m in _BRACED.finditer(self.text, at, end)], {}
        self.slots[min(k, 1) :] = [found] + [None] * (1 - min(k, 1))
        return found

    def inside(self, at: int) -> bool:
        """Whether ``at`` is in a run that was read, with more than _STEP to go."""
        return self.slots[0] is not None and self.slots[0][0] <= at < self.slots[0][1] - _STEP

    def end(self, at: int) -> int:
        return self._run(at)[1]

    def dollar(self, at: int) -> bool:
        """Whether the value from ``at`` on holds a reference."""
        *_, held = run = self._run(at)
        if "$" not in held:
            held["$"] = self.text.rfind("$", *run[:2])
        return held["$"] >= at

    def summary(self, at: int) -> Summary:
        start, end, _, held = self._run(at)
        first = -(-start // _STEP) * _STEP
        if end not in held:
            held[end] = Summary.of("")
            for cut in range((end - 1) // _STEP * _STEP, first - 1, -_STEP):
                held[cut] = Summary.of(self.text[cut : min(end, cut + _STEP)]) + held[min(end, cut + _STEP)]
        cut = min(end, -(-at // _STEP) * _STEP)
        return Summary.of(self.text[at:cut]) + held[cut]


def _literal(text: str, at: int) -> tuple[str, int, int] | None:
    """(content, start, end) of the quoted literal at ``at``; it must close, on the same line unless it is triple-quoted."""
    m = _QUOTED.match(text, at)
    if not m:
        return None
    quote, start = m[1], m.end()
    end = start
    while True:
        end = text.find(quote, end)
        if end < 0 or (len(quote) == 1 and "\n" in text[start:end]):
            return None
        back = 0
        while end - back > start and text[end - back - 1] == "\\":
            back += 1
        if back % 2 == 0:
            return text[start:end], start, end
        end += 1


def _block(text: str, sign: int, at: int) -> tuple[str, int, int] | None:
    """(content, start, end) of the indented lines after ``|`` or ``>``, all that are further in than the line of the sign."""
    if not (m := _BLOCK.match(text, at)):
        return None
    head = text.rfind("\n", 0, sign) + 1
    outer = len(text[head:sign]) - len(text[head:sign].lstrip(" \t-"))
    lines, start, end, here = [], -1, m.end(), m.end()
    while here < len(text):
        stop = text.find("\n", here)
        stop = len(text) if stop < 0 else stop
        line = text[here:stop]
        body = line.strip()
        if body:
            if len(line) - len(line.lstrip(" \t")) <= outer:
                break
            start = here + line.index(body) if start < 0 else start
            end = here + len(line.rstrip())
            lines.append(body)
        here = stop + 1
    return ("\n".join(lines), start, end) if lines else None


def _markup(text: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """Pairs of elements: ``<name>value</name>``, ``<x name="n" value="v"/>``, ``<x key="n">v</x>``."""
    for m in _TAG.finditer(text):
        held = {a[1].rpartition(":")[2].lower(): a for a in _ATTRIBUTE.finditer(text, m.start(2), m.end(2))}
        named = next((held[k] for k in ("name", "key", "id", "property") if k in held), None)
        name = (named[2] or named[3] or "") if named else m[1].rpartition(":")[2]
        if value := next((held[k] for k in ("value", "content", "default") if k in held), None) if named else None:
            g = 2 if value[2] is not None else 3
            yield name, value[g], value.start(g), value.end(g), False
        if m[3] and m[3].strip():
            body = m[3].strip()
            start = m.start(3) + m[3].index(body)
            yield name, body, start, start + len(body), False


def pairs(text: str) -> Iterator[tuple[str, str | Summary, int, int, bool]]:
    """(name, literal, start, end, propagated) of every name that a literal is assigned to, in order of the assignments; start and end are the
    literal's place in the text, the first part's where several are joined. A literal that joining makes long is given as its Summary."""
    known: dict[str, tuple[str | Summary, int, int]] = {}

    def resolve(value: str) -> tuple[str | Summary, bool]:
        if not ("$" in value or "{" in value or "%(" in value):
            return value, False
        parts, at, used = [], 0, False
        for m in _REF.finditer(value):
            name = next(g for g in (m[1], m[3], m[4], m[5]) if g)
            used = used or name in known
            parts += [value[at : m.start()], known[name][0] if name in known else m[2] or m[0]]
            at = m.end()
        return joined(*parts, value[at:]), used

    def pure(start: int, end: int) -> tuple[str | Summary, int, int] | None:
        """The constant that is all of the value, with its own place."""
        m = _REF.fullmatch(text, start, end)
        return known.get(next(g for g in (m[1], m[3], m[4], m[5]) if g)) if m else None

    runs = _Runs(text)

    def run_end(at: int) -> tuple[int, bool]:
        """(end of the unquoted value, ``at`` if there is none, whether it is long)."""
        m = None if runs.inside(at) else _BARE.match(text, at)
        return (m.end() if m else at, False) if not runs.inside(at) and (m is None or m.end() - at < 16384) else (runs.end(at), True)

    def starts_known(at: int) -> bool:
        stop, _ = run_end(at)
        end = _DOTLESS.match(text, at, stop).end()
        return (end == stop or text[end] in ".+") and text[at:end] in known

    last, before, bare = 0, 0, 0
    for sign in _SIGN.finditer(text):
        # a name begins in this line; the sign before may belong to its type
        lo = max(text.rfind("\n", before, sign.start()) + 1, before)
        before, last = last, sign.start()
        named = _NAME.search(text, lo, sign.start())
        if not named:
            continue
        if sign[0] == ":" and (found := _block(text, sign.start(), sign.end())):
            known[named[1]] = found
            yield named[1], *found, False
            continue
        name, at = named[1], _GAP.match(text, sign.end()).end()
        if sign.start() < bare and not sensitivity(name):
            continue  # inside an unquoted value, which would else be read anew from each of its signs
        if call := _CALL.match(text, at):
            at = call.end()
        value, place, used = "", None, False
        while True:
            if found := _literal(text, at):
                got, start, end = found
                at = end + (3 if text[end : end + 3] in ('"""', "'''") and text[start - 3 : start] == text[end : end + 3] else 1)
                if constant := pure(start, end):
                    (got, start, end), used = constant, True
                else:
                    got, was = resolve(got)
                    used = used or was
            elif run_end(at)[0] > at and (value == "" or starts_known(at)):
                start, stop, long = at, *run_end(at)
                m = _IDENT_HEAD.match(text, at, stop)
                end = m.end() if m and (m.end() == stop or text[m.end()] == "+") else stop
                after = end
                bare = max(bare, end)
                m = _DASHED.match(text, at, end)
                if constant := (known.get(text[at:end]) if m and m.end() == end else None) or pure(at, end):
                    (got, start, end), used = constant, True
                elif value == "" and text[at] != "+":
                    if long and end == stop and not runs.dollar(at):
                        got, used = runs.summary(at), False
                    else:
                        got, used = resolve(text[at:end])
                    if not used and (sign[0] in (":=", "=>") or _OTHER.fullmatch(text, at, end) and (text.find("_", at, end) >= 0 or text.find(".", at, end) >= 0 or sign[0] == "=" and text[at - 1] in " \t")):
                        break  # the name of something that isn't known
                else:
                    break
                at = after
            else:
                break
            value = joined(value, got) if value != "" else got
            place = place or (start, end)
            more = _PLUS.match(text, at)
            if not more[0].strip(" \t\\\r\n"):
                break
            at = more.end()
        if place and value != "":
            known[name] = (value, *place)
            yield name, value, *place, used
    if "<" in text:
        yield from _markup(text)


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, name, score, propagated) of the literals over the threshold: once each, under the name that scores highest, the first of equals."""
    best: dict[tuple[int, int], tuple[float, str, bool]] = {}
    for name, literal, start, end, used in pairs(text or ""):
        s = score(name, literal)
        if s >= threshold and s > best.get((start, end), (0.0,))[0]:
            best[start, end] = (s, name, used)
    return sorted((a, b, name, s, used) for (a, b), (s, name, used) in best.items())


def find_secrets(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, start, end, name, score, propagated, sha256) of secret literals: place by character, the name that gave it away, and a digest of the
    literal's text instead of the literal.

    Null and empty texts give no rows; texts of any length are lexed whole. A literal that reaches several names counts once, under the highest score, and
    of equal scores under the first. Repeated rows give repeated results, a null id stays null, empty tables give no rows, further columns aren't read.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import hashlib

        ids, rows = batch["doc_id"].to_pylist(), []
        for i, text in enumerate(batch["text"].to_pylist()):
            if text and ("=" in text or ":" in text or "</" in text):
                rows += [(ids[i], a, b, name, s, used, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()) for a, b, name, s, used in scan(text, threshold)]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string())
        names = ("doc_id", "start", "end", "name", "score", "propagated", "sha256")
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], list(names))

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), each, "doc_id bigint, start int, end int, name string, score double, propagated boolean, sha256 string")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
