"""Personal data: base detection and offset-preserving deobfuscation.

Besides the plain patterns, every text that shows a trace of a disguise is run
through transducers that replace homoglyphs (full-width and look-alike letters
and digits), spelled digits ("five five"), at/dot disguises ("(at)",
" dot ") and the bare words of an address or IP, while a map keeps for every normalised character the source range it
came from. Identifiers found in the normalised text are mapped back to source
offsets (code points), and added unless plain detections cover them wholly.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_texts, span_digest

KINDS = ("email", "ip", "card", "phone")
#: What the method adds, after the base kinds in the order of spans.
ALL_KINDS = KINDS + tuple(f"hidden_{k}" for k in KINDS)

_LOCAL_CHAR = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str):
    """Leftmost non-overlapping e-mail spans, in linear time: the local part of
    a match is the run of its characters before an @, back to the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and _LOCAL_CHAR.match(text, a - 1):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = "".join(_DIGIT.findall(m.group()))
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


#: Spelled digits by language of the texts.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("асеорхуіјѕԁһԛԝАВЕКМНОРСТХУοαρνικΟΑΡΕΤΗΚΜΝΒΙΧΥΖ", "aceopxyijsdhqwABEKMHOPCTXYoapvikOAPETHKMNBIXYZ"))
#: How "at" and "dot" are spelled in the languages of the texts.
AT_WORDS, DOT_WORDS = ("at", "ät", "arroba", "arobase"), ("dot", "punkt", "punto", "point")
#: Which of them make a bare address together, outside English: a language's own.
BARE_PAIRS = (("at|ät", "punkt"), ("ät", "punkt|dot"), ("arroba", "punto|dot"), ("arobase", "point|dot"))
_ATS, _DOTS = "|".join(AT_WORDS), "|".join(DOT_WORDS)


def _bracketed(words: str) -> str:
    return "|".join(rf"{a}[\x20]*(?:{words})[\x20]*{b}" for a, b in ((r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"), ("<", ">")))


_AT = rf"[\x20]*(?:{_bracketed(_ATS)})[\x20]*"
_DOT = rf"[\x20]*(?:{_bracketed(_DOTS)}|\[\.\]|\(\.\))[\x20]*"
#: Last labels that a spelled-out address may end in.
_TOP = "com|org|net|edu|gov|info|biz|io|co|eu|de|fr|es|uk|us"
#: Bare " at " and " dot " count only up to a spelled-out last label.
_BARE = rf"(?<=[A-Za-z0-9])\x20at\x20(?=[A-Za-z0-9-]+(?:(?:\x20dot\x20|\.)[A-Za-z0-9-]+){{0,4}}\x20dot\x20(?:{_TOP})\b)"
_BARE_DOT = rf"(?<=[A-Za-z0-9])\x20dot\x20(?=(?:[A-Za-z0-9-]+(?:\x20dot\x20|\.)){{0,4}}(?:{_TOP})\b)"
_WORDS = "|".join(sorted(SPELLED, key=lambda w: (-len(w), w)))
#: Runs of at least three spelled digits; separators between them are dropped.
_TIMES = r"(?:(?:double|triple)[\x20-]+)?"
_RUN = rf"(?<!\w){_TIMES}(?:{_WORDS})(?:[\x20-]+(?:{_TIMES}(?:{_WORDS})|[0-9]+)){{2,}}(?!\w)"
#: Four or more groups of one to three digits, written or spelled, with dots.
_GROUP = rf"(?:{_WORDS}|[0-9]{{1,3}})(?:[\x20-]+(?:{_WORDS}|[0-9])){{0,2}}"
_SPOKEN = rf"(?<![\w.]){_GROUP}(?:(?:\x20(?:{_DOTS})\x20|{_DOT}|\.){_GROUP}){{3,}}(?!\w)"
_STEP = re.compile(rf"(?P<at>{_AT}|{_BARE})|(?P<ip>{_SPOKEN})|(?P<dot>{_DOT}|{_BARE_DOT})|(?P<run>{_RUN})|(?P<plus>\bplus[\x20]+(?=[0-9]|{_TIMES}(?:{_WORDS})))", re.I)
_PART = re.compile(rf"(?P<dot>\x20(?:{_DOTS})\x20|{_DOT}|\.)|{_WORDS}|[0-9]+", re.I)
#: Words joined by bare " at " and " dot ", and the pieces of such a chain.
_BARE_TRACE = re.compile(r"\x20dot\x20", re.I)
_CHAIN = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+@-]++(?:\x20(?:at|dot)\x20[A-Za-z0-9._%+@-]++)+", re.I)
_LINK = re.compile(r"(?P<at>\x20at\x20|@)|(?P<dot>\x20dot\x20)|[A-Za-z0-9._%+-]+", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]+\.(?:[A-Za-z0-9-]+\.)*(?:xn--[A-Za-z0-9-]+|[A-Za-z]{2,})(?![A-Za-z0-9-])", re.I)
#: Words that make the dot of "at this dot here" a noun.
_NOUN = frozenset("a an the this that these those each every any some no another either which what my your his her its our their".split())
_TOKEN = re.compile(rf"(?:(?P<times>double|triple)[\x20-]+)?(?P<word>{_WORDS}|[0-9]+)", re.I)
_LABEL = "[A-Za-z0-9-]{1,63}"
#: Whole addresses of bare words outside English: a local part, the language's at, and a host whose
#: last label has two letters or more; German ones need a spelled dot in the host.
_FOREIGN = [re.compile(rf"(?<![\w.%+@-])[A-Za-z0-9_%+.-]{{1,64}}(?:\x20(?:{dot})\x20[A-Za-z0-9_%+.-]{{1,64}}){{0,5}}(?P<at>\x20(?:{at})\x20){_LABEL}"
                       rf"(?:(?:\x20(?:{dot})\x20|\.){_LABEL}){{0,5}}{rf'\x20(?:{dot})\x20' if '|' in at else rf'(?:\x20(?:{dot})\x20|\.)'}[A-Za-z]{{2,24}}(?![\w-])", re.I)
            for at, dot in BARE_PAIRS]
_FOREIGN_TRACE = re.compile(r"\x20(?:ät|arroba|arobase|punkt)\x20", re.I)
_FOREIGN_DOT = re.compile(r"\x20(?:punkt|punto|point|dot)\x20", re.I)
#: A plain @ with a space on both sides, and words joined by underscores up to a common last label.
_SPACED = re.compile(r"(?<=[A-Za-z0-9])\x20@\x20(?=(?:[A-Za-z0-9-]{1,63}\.){1,5}[A-Za-z]{2,24}(?![\w-]))")
_JOINED = re.compile(rf"(?<![A-Za-z0-9_.%+-])[A-Za-z0-9.%+-]+(?:_dot_[A-Za-z0-9.%+-]+)*_at_[A-Za-z0-9-]+(?:(?:_dot_|\.)[A-Za-z0-9-]+)*_dot_(?:{_TOP})(?![A-Za-z0-9_-])", re.I)
_JOINT = re.compile("_at_|_dot_", re.I)
_TRACE = re.compile(rf"[\[({{<]\s*(?:{_ATS}|{_DOTS}|\.)\s*[\])}}>]|\x20(?:{_ATS}|{_DOTS}|@)\x20|_at_|\b(?:{_WORDS})[\x20-]+(?:{_WORDS}|double|triple)\b", re.I)
_ODD = re.compile("[" + "".join(LOOKALIKES) + "！-～­​-‍⁠﻿٠-٩۰-۹०-९\U0001d400-\U0001d7ff]")


class Mapped:
    """A normalised text and the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.runs = text, None

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> "Mapped":
        """Replaces non-overlapping ranges of the current text."""
        if not pieces:
            return self
        out, starts, runs, pos, length = [], [], [], 0, 0
        for a, b, new in pieces:
            if a > pos:
                out.append(self.text[pos:a]); starts.append(length); runs.append((pos, a, True)); length += a - pos
            if new:
                out.append(new); starts.append(length); runs.append((a, b, False)); length += len(new)
            pos = b
        if pos < len(self.text):
            out.append(self.text[pos:]); starts.append(length); runs.append((pos, len(self.text), True))
        nxt = Mapped("".join(out))
        nxt.runs, nxt.before = (starts, runs), self
        return nxt

    def source(self, a: int, b: int) -> tuple[int, int]:
        """Source range of the normalised range a..b (b > a)."""
        if self.runs is None:
            return a, b
        starts, runs = self.runs
        i, j = bisect.bisect_right(starts, a) - 1, bisect.bisect_right(starts, b - 1) - 1
        x = runs[i][0] + (a - starts[i] if runs[i][2] else 0)
        y = runs[j][0] + (b - starts[j]) if runs[j][2] else runs[j][1]
        return self.before.source(x, y)


def fold_char(c: str) -> str:
    """A look-alike's plain form; zero-width characters vanish."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    return unicodedata.normalize("NFKC", c)


def spoken_addresses(text: str) -> list[tuple[int, int, str]]:
    """Pieces for the bare " at " and " dot " of addresses: a local part, an at
    and a host whose last label has two letters or more, with a bare " dot "
    somewhere between them."""
    pieces = []
    for chain in _CHAIN.finditer(text) if _BARE_TRACE.search(text) else ():
        sides, ats = [[]], []
        for x in _LINK.finditer(text, chain.start(), chain.end()):
            if x.lastgroup == "at":
                ats.append(x.span())
                sides.append([])
            else:
                sides[-1].append((x.start(), x.end(), x.lastgroup == "dot"))
        host = None  # the side that is a host already
        for n, at in enumerate(ats):
            left, right = sides[n], sides[n + 1]
            m = _HOST.match("".join("." if dot else text[a:b] for a, b, dot in right))
            if n == host or not left or left[-1][2] or not m:
                continue
            dots, pos = [x for x in left if x[2]], 0
            for x in right:
                if x[2] and pos < m.end():
                    dots.append(x)
                pos += 1 if x[2] else x[1] - x[0]
            bare = at[1] - at[0] > 1
            if dots and not (bare and len(right) == 3 and text[right[0][0]:right[0][1]].lower() in _NOUN):
                host = n + 1
                pieces += sorted([(a, b, ".") for a, b, _ in dots] + ([(*at, "@")] if bare else []))
    return pieces


def other_addresses(text: str) -> list[tuple[int, int, str]]:
    """Pieces for addresses of bare words outside English, for a plain @ between
    spaces, and for words joined by underscores."""
    found = [(m.start(), m.end(), "@") for m in _SPACED.finditer(text)] if " @ " in text else []
    if "_" in text:
        for m in _JOINED.finditer(text):
            found += [(x.start(), x.end(), "@" if len(x.group()) == 4 else ".") for x in _JOINT.finditer(text, m.start(), m.end())]
    for pattern in _FOREIGN if _FOREIGN_TRACE.search(text) else ():
        for m in pattern.finditer(text):
            found.append((*m.span("at"), "@"))
            found += [(x.start(), x.end(), ".") for a, b in ((m.start(), m.start("at")), (m.end("at"), m.end())) for x in _FOREIGN_DOT.finditer(text, a, b)]
    pieces = []
    for piece in sorted(set(found)):
        if not pieces or piece[0] >= pieces[-1][1]:
            pieces.append(piece)
    return pieces


def normalise(text: str) -> Mapped:
    """The transducers in turn: characters, disguises, spoken addresses."""
    m = Mapped(text)
    m = m.rewrite([(x.start(), x.end(), fold_char(x.group())) for x in _ODD.finditer(m.text)])
    pieces = []
    for x in _STEP.finditer(m.text):
        if x.lastgroup == "at":
            pieces.append((x.start(), x.end(), "@"))
        elif x.lastgroup == "dot":
            pieces.append((x.start(), x.end(), "."))
        elif x.lastgroup == "plus":
            pieces.append((x.start(), x.end(), "+"))
        elif x.lastgroup == "ip":
            pos = x.start()
            for t in _PART.finditer(m.text, x.start(), x.end()):
                pieces.append((pos, t.end(), "." if t.lastgroup else SPELLED.get(t.group().lower(), t.group())))
                pos = t.end()
        else:
            pos = x.start()
            for t in _TOKEN.finditer(m.text, x.start(), x.end()):
                times = {"double": 2, "triple": 3}.get((t["times"] or "").lower(), 1)
                pieces.append((pos, t.end(), SPELLED.get(t["word"].lower(), t["word"]) * times))
                pos = t.end()
    m = m.rewrite(pieces)
    m = m.rewrite(other_addresses(m.text))
    return m.rewrite(spoken_addresses(m.text))


def hidden(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the normalised text shows, on source offsets."""
    if not (_TRACE.search(text) or not text.isascii() and _ODD.search(text)):
        return []
    m = normalise(text)
    if m.runs is None:
        return []
    starts, ends = [], []  # of the stretches that plain spans cover
    for a, b in sorted((a, b) for a, _, b in plain):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for a, k, b in detect(m.text):
        x, y = m.source(a, b)
        i = bisect.bisect_right(starts, x) - 1  # the last stretch that begins at x or before
        if i < 0 or ends[i] < y:
            out.append((x, k + len(KINDS), y))
    return out


def _scan(texts: list[str]) -> list[list]:
    rows = []
    for t in texts:
        base = detect(t)
        more = hidden(t, base)
        joined = span_digest(base, KINDS)
        n = [0] * len(KINDS)
        for _, k, _ in base:
            n[k] += 1
        rows.append((*n, hashlib.sha256(joined.encode()).hexdigest(), span_digest(base + more, ALL_KINDS), len(more)))
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_hidden.

    Every whole text is scanned (null as empty: no spans, the digest of the
    empty string); rows that repeat an id stay separate rows. Offsets are code
    points of the source text, ends exclusive. ``spans`` holds the base spans
    and the ``hidden_*`` spans the normalised text shows. Very long texts are
    scanned whole in linear time; an empty table gives no rows; further columns,
    whatever their names, play no part.
    """
    return map_texts(docs, {"doc_id": F.col(id_col)}, text_col,
                     "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long", _scan)
