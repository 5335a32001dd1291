"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, digits,
plus signs, URL schemes and identifier cues.  A local parser per kind expands
each anchor to its boundaries and validates it; no expression is searched over
the text."""

from __future__ import annotations

import hashlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, map_texts, texts

DIGITS = frozenset("0123456789")
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
ACCOUNT = ALNUM | frozenset("-")
#: Base kinds, in the order in which spans that start together are listed.
BASE = ("email", "ip", "card", "phone")
#: Kinds that this method adds.
ADDED = ("url", "account")
KINDS = BASE + ADDED
SCHEMES = ("http", "https", "ftp", "sftp", "ssh", "git", "mailto")
#: Lower-case of A-Z alone: every character keeps its place.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words that announce an account or identity number.
CUES = ("iban", "account", "acct", "routing", "passport", "ssn", "tax id", "social security")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _run(text: str, i: int, allowed: frozenset, most: int | None = None) -> int:
    n = len(text) if most is None else min(len(text), i + most)
    while i < n and text[i] in allowed:
        i += 1
    return i


def email(text: str, at: int, floor: int) -> Span | None:
    """Expand an at-sign; ``floor`` is where the last address ended."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dotted = False
    while end < len(text) and text[end] == ".":
        label = _run(text, end + 1, LABEL)
        if label == end + 1:
            break
        end, dotted = label, True
    return ("email", start, end) if dotted else None


def dotted_numbers(text: str, start: int) -> tuple[list[Span], int]:
    """IPv4 addresses in the chain of numbers joined by single dots that
    starts here: each four numbers in turn, kept if all are at most 255."""
    found, parts, i = [], [], start
    while True:
        end = _run(text, i, DIGITS)
        parts.append((i, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            i = end + 1
        else:
            break
    for k in range(0, len(parts) - 3, 4):
        four = parts[k: k + 4]
        if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in four):
            found.append(("ip", four[0][0], four[3][1]))
    return found, end


def card(text: str, start: int) -> tuple[Span | None, int]:
    """The digits joined by at most one space or hyphen each that start here."""
    end, digits = start + 1, [text[start]]
    n = len(text)
    while end < n:
        if text[end] in DIGITS:
            step = 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            step = 2
        else:
            break
        end += step
        digits.append(text[end - 1])
    ok = 12 <= len(digits) <= 19 and luhn("".join(digits))
    return (("card", start, end) if ok else None), end


def phone(text: str, plus: int) -> tuple[Span | None, int]:
    """A plus sign, a digit, then digits and separators up to the last digit."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None, plus + 1
    end = _run(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end - (plus + 2) < 2:  # one separator or digit at least before the last digit
        return None, plus + 1
    n = sum(c in DIGITS for c in text[plus:end])
    return (("phone", plus, end) if 9 <= n <= 15 else None), end


def url(text: str, colon: int, size: int, floor: int) -> Span | None:
    """A scheme before ``://``, or ``mailto`` before ``:`` (``size`` characters),
    and what follows up to white space, quotes or brackets, less closing
    punctuation."""
    start = colon
    while start > floor and text[start - 1] in ALNUM:
        start -= 1
    if text[start:colon].lower() not in SCHEMES:
        return None
    end = colon + size
    while end < len(text) and text[end] not in URL_END:
        end += 1
    while end > colon + size and text[end - 1] in ".,;:!?)]":
        end -= 1
    return ("url", start, end) if end > colon + size else None


def account(text: str, end_of_cue: int) -> Span | None:
    """The number after an identifier cue: a valid IBAN, or 6 to 20 letters,
    digits and hyphens of which six are digits."""
    i = end_of_cue
    for word in (" number", " no.", " no", " #", ":", "=", "#", " "):
        if text[i: i + len(word)].lower() == word:
            i += len(word)
    i = _run(text, i, frozenset(" "))
    end = _run(text, i, ACCOUNT, 21)  # longer ones are none, wherever they end
    code = text[i:end]
    if code[:2].isalpha() and (stop := iban_end(text, i)):
        return ("account", i, stop)
    if 6 <= len(code) <= 20 and sum(c in DIGITS for c in code) >= 6:
        return ("account", i, end)
    return None


def iban_end(text: str, start: int) -> int | None:
    """Where the longest valid IBAN that starts here ends; it may stand in groups
    with blanks between. An IBAN has at most 34 letters and digits, so no more
    are read."""
    ends, code, i, n = [], "", start, len(text)
    while i < n and len(code) <= 34:
        if text[i] == " ":
            ends.append((len(code), i))
            i = _run(text, i, frozenset(" "))
        elif text[i] in ALNUM:
            code += text[i]
            i += 1
            if len(code) == 4 and not code[2:].isdigit():
                return None
        else:
            break
    if i > start and text[i - 1] != " " and (i == n or text[i] != "-"):
        ends.append((len(code), i))
    for size, end in reversed(ends):
        if iban(code[:size].upper()):
            return end
    return None


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c if c in "@+" else "d", 1))
    a.add_word("://", ("://", 3))
    a.add_word("mailto:", ("mailto:", 7))
    for cue in CUES:
        a.add_word(cue, ("cue", len(cue)))
    a.make_automaton()
    return a


def find(text: str, machine) -> list[Span]:
    """All spans of one text, in order of start, then of kind."""
    spans: list[Span] = []
    ends = dict.fromkeys(KINDS, 0)
    for last, (what, size) in machine.iter(text.translate(LOWER)):
        i = last - size + 1
        if what == "d":
            if i >= ends["ip"]:
                found, ends["ip"] = dotted_numbers(text, i)
                spans += found
            if i >= ends["card"]:
                span, ends["card"] = card(text, i)
                if span:
                    spans.append(span)
        elif what == "@":
            if span := email(text, i, ends["email"]):
                spans.append(span)
                ends["email"] = span[2]
        elif what == "+":
            if i >= ends["phone"]:
                span, ends["phone"] = phone(text, i)
                if span:
                    spans.append(span)
        elif what in ("://", "mailto:"):
            colon, width = (i, 3) if what == "://" else (last, 1)
            if colon >= ends["url"] and (span := url(text, colon, width, ends["url"])):
                spans.append(span)
                ends["url"] = span[2]
        elif i >= ends["account"] and not (i and text[i - 1] in ALNUM) and (span := account(text, last + 1)):
            spans.append(span)
            ends["account"] = span[2]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row per input row: the id, ``n_email``, ``n_ip``, ``n_card``,
    ``n_phone``, ``base_sha256`` (of the base spans), ``spans`` (all spans as
    ``kind:start:end``, code points, end exclusive) and, on ``redact``,
    ``redacted``: the text with every span replaced by ``<KIND>`` (of spans
    that overlap, the first stands).

    A null or empty text has no spans; null ids and repeated rows pass as they
    are; an empty table gives an empty result; other columns are ignored. Work
    and memory follow one text at a time, whole."""
    added = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def make():
        machine = automaton()

        def work(batch):
            out: list[list] = [[] for _ in range(6 + redact)]
            for text in texts(batch):
                spans = find(text, machine)
                base = [s for s in spans if s[0] in BASE]
                row = [sum(s[0] == k for s in base) for k in BASE]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                if redact:
                    parts, at = [], 0
                    for kind, start, end in spans:
                        if start >= at:
                            parts += [text[at:start], f"<{kind.upper()}>"]
                            at = end
                    row.append("".join(parts) + text[at:])
                for column, value in zip(out, row):
                    column.append(value)
            return None, out

        return work

    found = map_texts(id_and_text(df, id_col, text_col), added + ", redacted string" * redact, make)
    return found.select(F.col("id").alias(id_col), *found.columns[1:])
