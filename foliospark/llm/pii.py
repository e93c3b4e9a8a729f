"""Personal data: high-recall generators propose overlapping spans, boosted trees select, base rules stay.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of four fixed patterns with
their checks. The generators also propose looser spans: addresses with a spelled-out or parted at and dot,
IPv6 and defanged IPv4, cards with other separators or lengths, phone numbers of national and other forms, and
secrets (values of keys and tokens, long runs of mixed characters). A boosted-tree classifier reads each
proposal's format and context. Its scores are calibrated by isotonic regression over out-of-fold cases, each
kind by itself, and a proposal is kept if its calibrated probability reaches its kind's threshold, the lowest
at and above which out-of-fold cases have the wanted precision. The tables hold no labelled personal data, so
the classifier learns from TRAIN_CASES cases that training_cases() writes by rule, positive, negative and
doubtful. Of overlapping proposals the more probable stays, and none may overlap a base span.

Edge cases. A null text is empty: no spans; redact() leaves it null. A null id is kept; repeated rows are
each judged. Ties in probability go to the earlier, then longer, span. An empty table gives no rows. Extra
columns pass through redact() whatever their names. Texts are scanned whole, in time linear in their
length. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import boosting
from foliospark.llm.words import pieces
from foliospark.sources import table

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
TRAIN_CASES = 5000
FOLDS = 3
TREES = 48
PRECISION = 0.98
Span = tuple[str, int, int]

_ADDRESS_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """The pattern's matches, found from each @ outwards: the local part is all of its run since the last match or @."""
    for run in _ADDRESS_RUN.finditer(text):
        here, end = run.span()
        at = text.find("@", here, end)
        while at >= 0:
            found = _DOMAIN.match(text, at + 1, end) if at > here else None
            if found:
                yield "email", here, found.end()
                here = found.end()
            else:
                here = at + 1
            at = text.find("@", here, end)


def _ips(text: str) -> Iterator[Span]:
    for chain in _DOTTED.finditer(text):
        parts, here = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = here + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", here, end
            here = end + 1


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as in KINDS, then start."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += _ips(text)
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PLUS.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return out


_GAP = r"[\x20\xa0\t]{0,2}"
_BRACKETED = lambda word: rf"{_GAP}[(\[{{<]{_GAP}(?:{word}){_GAP}[)\]}}>]{_GAP}"
_AT = re.compile("@|＠|at(?![A-Za-z0-9])|AT(?![A-Za-z0-9])|At(?![A-Za-z0-9])|arroba|Arroba|ARROBA|chez(?![A-Za-z])")
_BEFORE_AT = re.compile(rf"(?:{_GAP}[(\[{{<]{_GAP}|[\x20\xa0\t]{{1,3}})\Z")
_AFTER_AT = re.compile(rf"{_GAP}[)\]}}>]{_GAP}|[\x20\xa0\t]{{1,3}}")
_DOT = rf"(?:{_BRACKETED('dot|punkt|punto|point|[.]')}|[\x20\xa0]+(?:dot|punkt|punto)[\x20\xa0]+|\.)"
_HOST = re.compile(rf"[a-z0-9](?:[a-z0-9-]{{0,62}})(?:{_DOT}[a-z0-9-]{{2,63}}){{1,4}}", re.IGNORECASE)
_LOCAL = re.compile(rf"[a-z0-9_%+-][a-z0-9._%+-]{{0,63}}(?:{_DOT}[a-z0-9_%+-]{{1,64}}){{0,3}}\Z", re.IGNORECASE)
_V6_RUN = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{1,40}(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?(?![0-9A-Za-z])")
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\[({](?:\.|dot)[\])}][0-9]{1,3}|\.[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20\xa0._/‐-—-]{0,2}[0-9]){12,18}(?![0-9])")
_LOOSE_PHONE = re.compile(r"[0-9](?<![0-9.,][0-9])(?:[\x20\xa0()./‐-—-]{0,3}[0-9]){6,14}(?![0-9])")
_CUE = re.compile("|".join(f"{w}|{w.title()}|{w.upper()}" for w in ("token", "secret", "passw", "pwd", "key", "bearer", "credential", "auth", "contrase", "api")))
_VALUE = re.compile(r"""[A-Za-zñ]{0,9}["']?[\x20\t]{0,3}(?:(?:[:=]|=>|is\b|ist\b)[\x20\t]{0,3})?["'`]?([^\s"'`<>,;]{6,512})""")
_LONG_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,512}={0,2}(?![A-Za-z0-9+/_-])")


def _spelled(text: str) -> Iterator[Span]:
    for m in _AT.finditer(text):
        sign = m.group() in "@＠"
        before = _BEFORE_AT.search(text, max(0, m.start() - 6), m.start())
        after = _AFTER_AT.match(text, m.end())
        if not (before and after or sign and (before or after) or m.group() == "＠"):
            continue
        host = _HOST.match(text, after.end() if after else m.end())
        stop = before.start() if before else m.start()
        local = _LOCAL.search(text, max(0, stop - 80), stop) if host else None
        if local:
            yield "email", local.start(), host.end()
            if (found := _ADDRESS_RUN.search(text, local.start(), stop)) and found.start() != local.start() or " " in local.group():
                word = re.search(r"[A-Za-z0-9._%+-]+\Z", local.group())
                yield "email", local.start() + word.start(), host.end()
            parts = list(re.finditer(_DOT, host.group(), re.IGNORECASE))
            if len(parts) > 1 and "." in host.group():  # a sentence may end within
                yield "email", local.start(), host.start() + parts[-1].start()


def proposals(text: str) -> list[Span]:
    """High-recall candidates besides the base spans; they may overlap."""
    out: list[Span] = list(_spelled(text))
    if ":" in text:
        for m in _V6_RUN.finditer(text):
            run = m.group().rstrip(":") if not m.group().endswith("::") else m.group()
            try:
                ipaddress.IPv6Address(run)
            except ValueError:
                continue
            out.append(("ip", m.start(), m.start() + len(run)))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _DEFANGED.finditer(text)]
        out += [("card", *m.span()) for m in _LOOSE_CARD.finditer(text)]
        for m in _LOOSE_PHONE.finditer(text):
            lead = next((x for x in ("(+", "+", "(") if text.endswith(x, 0, m.start())), "")
            if lead[:1] == "(" and ")" not in m.group():  # the bracket is around the number, not of it
                lead = lead[1:]
            out.append(("phone", m.start() - len(lead), m.end()))
    for m in _CUE.finditer(text):
        value = _VALUE.match(text, m.end())
        if value:
            out.append(("secret", *value.span(1)))
            at, whole = value.span(1)
            for bare in (whole - (text[whole - 1] in ".!?:)]}"), at + len(value.group(1).rstrip(".!?:)]}"))):  # marks of the sentence
                if bare - at >= 6:
                    out.append(("secret", at, bare))
    out += [("secret", *m.span()) for m in _LONG_RUN.finditer(text)]
    return list(dict.fromkeys(out))


#: Fixed cue words of the context features.
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write", "reach", "schreib", "schreiben", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "ipv6", "ipv4", "adresse", "servidor", "client", "ping", "dns"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "kreditkarte", "carte", "tarjeta", "payment", "credit", "paid"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "telephone", "appelez", "llame", "whatsapp", "handy", "teléfono", "téléphone", "ring", "text"),
    "secret": ("token", "secret", "password", "passwort", "pwd", "key", "api", "apikey", "bearer", "credential", "auth", "passwd"),
    "other": ("version", "order", "isbn", "page", "total", "invoice", "id", "no", "ref", "serial", "sku", "date", "bestellung", "numero", "article", "between", "from", "population"),
    "digest": ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "revision", "uuid", "guid", "etag", "build"),
}


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def features(text: str, span: Span) -> list[float]:
    """Format and context of one proposal."""
    kind, start, end = span
    s, left, right = text[start:end], text[max(0, start - 40) : start], text[end : end + 8]
    digits = _only_digits(s)
    groups = re.findall(r"[0-9]+", s) or [""]
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*[0-9]{0,3}", left.lower())[-4:]
    lowered = s.lower()
    letters = sum(c.isalpha() for c in s)
    edge = lambda c: 0.0 if not c or c.isspace() else 2.0 if c.isalnum() else 1.0
    return [
        *(float(kind == k) for k in ALL_KINDS),
        float(len(s)), float(len(digits)), float(len(groups)), float(max(map(len, groups))), float(min(map(len, groups))), float(len(groups[0])), float(len(groups[-1])),
        float(sum(c in "  " for c in s)), float(s.count(".")), float(sum(c in "-‐‑‒–—" for c in s)), float(s.count("/")), float(s.count(":")),
        float("(" in s), float(s[:1] == "+"), float(digits[:2] == "00"), float(digits[:1] == "0"), float(luhn(digits)) if digits else 0.0, float(digits[:1] in "3456") if digits else 0.0,
        float(len(set(digits))), float(re.match(r"(?:19|20)[0-9][0-9](?![0-9])", s) is not None), float(bool(re.search(r"[(\[{<]\s*(?:at|dot|@|\.)", lowered))), float("dot" in lowered), float(" at " in lowered),
        float(bool(re.search(r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|example)\Z", lowered))), float(letters), float(letters / max(1, len(s))),
        _entropy(s), float(any(c.isupper() for c in s)) + float(any(c.islower() for c in s)) + float(bool(digits)), float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) is not None),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s) is not None), float(max(map(len, re.findall(r"[a-z]+|[A-Z]+", s)), default=0)), float(s.count("_")),
        edge(left[-1:]), edge(right[:1]), float(bool(re.search(r"[0-9]\W?\Z", left))), float(bool(re.match(r"\W?[0-9]", right))), float(left[-1:] in ("$", "€", "#", "£")),
        float(left.rstrip("\"'` ")[-1:] in ("=", ":")), float(left[-1:] in ("\"", "'", "`")), *(float(any(w in CUES[c] for w in words)) for c in CUES),
    ]


def training_cases(n: int, seed: int = 20) -> list[tuple[str, Span, int]]:
    """n cases (text, span, label) by rule: personal data in several forms, numbers and phrases that look like it, and forms that are either."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    word = lambda: "".join(pick("bcdfghklmnprst") + pick("aeiou") for _ in range(int(rng.integers(1, 5))))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card(k: int) -> str:
        body = pick("3456") + number(k - 2)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def grouped(digits: str, sep: str, sizes: list[int]) -> str:
        out, at = [], 0
        for z in sizes:
            out.append(digits[at : at + z])
            at += z
        return sep.join(x for x in [*out, digits[at:]] if x)

    def one(kind: str, good: bool) -> tuple[str, bool, float]:
        """(span text, label, how often a cue of the kind stands before it)."""
        if kind == "email":
            end = pick(["com", "org", "net", "example", "de", "io", "co.uk", "fr", "info"])
            if good:
                at = pick([" (at) ", "(at)", "[at]", " [at] ", " at ", " AT ", " ( at ) ", "{at}", " <at> ", " @ ", "@ ", " (AT) ", "[ @ ]"])
                dot = pick([" (dot) ", ".", "[dot]", " dot ", " DOT ", "(.)", " [dot] ", "."]) if at.strip().lower() != "at" else pick([" dot ", ".", " dot ", " [dot] "])
                return f"{word()}{pick(['', '.', '_', dot])}{word()}{at}{word()}{dot}{end.replace('.', dot)}", True, 0.6
            tail = pick([f". {word().title()}", f".{number(2)}", f" dot {word()}", f".{word()}", f".{end}"])
            return f"{word()}{pick([' at ', ' at ', ' @ '])}{word()}{tail}", False, 0.05
        if kind == "ip":
            if good:
                full = ":".join(f"{int(x):x}" for x in rng.integers(0, 65536, 8))
                k = int(rng.integers(1, 6))
                short = ":".join(full.split(":")[:k]) + "::" + ":".join(full.split(":")[k + 1 : k + 2 + int(rng.integers(0, 2))])
                four = [str(int(x)) for x in rng.integers(0, 256, 4)]
                return pick([full, short, "fe80::" + ":".join(full.split(":")[:4]), "2001:db8::" + full[-4:].strip(":"), "::1", "[.]".join(four), "(dot)".join(four), f"{four[0]}.{four[1]}.{four[2]}[.]{four[3]}"]), True, 0.6
            return pick([f"{pick(['a', 'be', 'cafe', 'dead', 'add', 'face'])}::{pick(['a', 'b', 'dd', 'fade', 'bed'])}", "::", f"{number(1)}::{number(1)}", ".".join(str(int(x)) for x in rng.integers(256, 999, 4)), f"{number(3)}[.]{number(3)}[.]{int(rng.integers(256, 999))}[.]9"]), False, 0.1
        if kind == "card":
            if good:
                k = int(pick([13, 15, 15, 16, 16, 16, 16, 19]))
                return grouped(card(k), pick([" ", ".", "/", "-", " ", "  ", "", "–"]), [4, 6, 5] if k == 15 else [4, 4, 4, 4]), True, 0.7
            s = pick([number(13), number(16), number(16), grouped(number(15), ".", [3, 3, 3, 3, 3]), f"{number(8)} {number(8)}", grouped(number(16), " ", [4, 4, 4, 4]), "978" + number(10), f"20{number(2)}-0{number(1)}-1{number(1)} 1{number(1)}.{number(2)}.{number(2)}"])
            if rng.random() < 0.15:  # by chance a checked number, and no card
                s = grouped(pick("0126789") + card(16)[1:], " ", [16])
            return s, False, 0.04
        if kind == "phone":
            if good:
                return pick(
                    [f"({number(3)}) {number(3)}-{number(4)}", f"0{number(2)} {number(3)} {number(4)}", f"00{number(2)} {number(3)} {number(6)}", f"{number(3)}-{number(3)}-{number(4)}", f"0{number(1)}." + ".".join(number(2) for _ in range(4)),
                     f"0{number(3)}/{number(6)}", f"+{number(2)}/{number(3)}/{number(6)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(1)} " + " ".join(number(2) for _ in range(4)), f"{number(3)} {number(3)} {number(3)}",
                     f"+{number(2)} {number(3)} {number(6)}", f"0{number(4)}-{number(6)}", f"{number(3)}-{number(4)}", f"1-800-{number(3)}-{number(4)}", f"0{number(9)}"]
                ), True, 0.65
            return pick(
                [f"20{number(2)}-0{number(1)}-1{number(1)}", f"{number(3)}.{number(3)}.{number(3)}", number(int(rng.integers(7, 16))), f"19{number(2)} {number(4)}", f"{number(1)}.{number(2)}.{number(5)}", f"{number(4)} {number(4)}",
                 f"1{number(1)}/0{number(1)}/20{number(2)}", f"19{number(2)}-20{number(2)}", f"{number(2)}.{number(2)}.19{number(2)}", f"{number(1)} {number(3)} {number(3)}", f"{number(3)} {number(3)} {number(3)}", f"20{number(2)}{number(2)}{number(2)}", f"{number(3)}-{number(4)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}"]
            ), False, 0.03
        if good:
            return pick([chars(hexa, 40), chars(hexa, 32), chars(mixed, 24), chars(mixed, 36), "sk_live_" + chars(mixed, 24), "ghp_" + chars(mixed, 36), "AKIA" + chars(mixed[:26] + "0123456789", 16), chars(mixed + "+/", 40), chars(mixed + "!$%&", 12), chars(mixed, 10), word() + number(3) + "!"]), True, 1.0
        if rng.random() < 0.5:  # as random as a secret, told by what stands before it
            return pick([chars(hexa, 40), chars(hexa, 32), chars(hexa, 64), "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), number(20)]), False, 0.0
        return pick([word() * 5, f"{word()}_{word()}_{word()}_{word()}_{word()}", f"{word()}/{word()}/{word()}/{word()}/{word()}", word(), word() + word(), f"{word()}-{word()}-{word()}-{word()}-{word()}", "=" * 24, "-" * 30, "_" * 22]), False, 0.25

    out = []
    while len(out) < n:
        kind, good = pick(ALL_KINDS), bool(rng.integers(0, 2))
        s, good, cued = one(kind, good)
        mark = pick([" ", ": ", ". ", " ", " is ", " no. "])
        if kind == "secret":
            sep = pick([" = ", "=", ": ", ' = "', '="', ': "', " is "]) if rng.random() < 0.85 else " "
            cue = pick(CUES["secret"]) if rng.random() < cued else pick([*CUES["digest"], *CUES["other"], word(), word()])
            left = f"{word()} {word()} {cue}{sep}"
            right = '"' if sep.endswith('"') else pick([" ", ". ", ", ", "\n"]) + word()
        else:
            cue = pick(CUES[kind]) if rng.random() < cued else pick(CUES["other"]) if not good and rng.random() < 0.5 else word()
            hug = pick(["", "a", "f", "$", "#", "9-", "/"]) if not good and rng.random() < 0.4 else pick(["", "", "", "(", "'"]) if good else ""
            left = f"{word()} {word()} {cue}{mark}{hug}"
            right = pick([" ", ". ", ", ", "\n", ") "]) + word() if not (not good and rng.random() < 0.2) else pick(["a", "kg", "%", "-7", "e"])
        out.append((left + s + right, (kind, len(left), len(left) + len(s)), int(good)))
    return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities) of the non-decreasing step function nearest to the labels, by pooling of neighbours that violate the order."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least score
    for x, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
        blocks.append([y, 1.0, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, _ = blocks.pop()
            y1, w1, low = blocks.pop()
            blocks.append([(y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2, low])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Selector(NamedTuple):
    """The trees, each kind's calibration of their scores, and its threshold of probability."""

    model: boosting.Model
    steps: dict[str, tuple[np.ndarray, np.ndarray]]
    cut: dict[str, float]

    def probabilities(self, kinds: list[str], x: np.ndarray) -> np.ndarray:
        """Calibrated; within a step, the raw score parts ties by next to nothing."""
        raw = self.model.score(x)
        out = np.empty(len(raw))
        for i, (k, r) in enumerate(zip(kinds, raw, strict=True)):
            at, p = self.steps[k]
            out[i] = p[max(0, int(np.searchsorted(at, r, "right")) - 1)] + 1e-9 / (1 + math.exp(-max(-30.0, min(30.0, float(r)))))
        return out


@functools.lru_cache(maxsize=2)
def trained(cases: int = TRAIN_CASES, precision: float = PRECISION) -> Selector:
    """The classifier; a kind's threshold is the lowest probability at and above which its out-of-fold cases have the precision, and half at least."""
    drawn = training_cases(cases)
    x, y = np.array([features(t, s) for t, s, _ in drawn]), np.array([float(g) for *_, g in drawn])
    fold, raw = np.arange(len(drawn)) % FOLDS, np.empty(len(drawn))
    for k in range(FOLDS):
        raw[fold == k] = boosting.fit(x[fold != k], y[fold != k], trees=TREES).score(x[fold == k])
    steps, cut = {}, {}
    for kind in ALL_KINDS:
        own = np.array([s[0] == kind for _, s, _ in drawn])
        at, p = steps[kind] = isotonic(raw[own], y[own])
        level = p[np.searchsorted(at, raw[own], "right") - 1]
        good = [q for q in np.unique(level) if q >= 0.5 and y[own][level >= q].mean() >= precision]
        cut[kind] = float(min(good)) if good else 1.1
    return Selector(boosting.fit(x, y, trees=TREES), steps, cut)


def clear_of(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that no base span overlaps."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = []
    for s in spans:
        k = bisect_left(starts, s[2])  # base spans that begin before its end
        if not k or reach[k - 1] <= s[1]:
            out.append(s)
    return out


def added_spans(text: str, base: list[Span], selector: Selector) -> list[Span]:
    """Selected proposals, none overlapping another or a base span."""
    clear = clear_of(proposals(text), base)
    if not clear:
        return []
    kinds = [s[0] for s in clear]
    p = selector.probabilities(kinds, np.array([features(text, s) for s in clear]))
    out: list[Span] = []
    for q, s in sorted(zip(p, clear, strict=True), key=lambda x: (-x[0], x[1][1], -x[1][2])):
        if q >= selector.cut[s[0]] and clear_of([s], out):
            out.append(s)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256, spans (all, joined) and n_added for every row of docs."""
    selector = trained()
    empty = hashlib.sha256(b"").hexdigest()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, 1)):
            n = batch.num_rows
            counts, digest, spans = np.zeros((5, n), np.int64), [empty] * n, [""] * n
            for i in range(n):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                base = base_spans(text)
                more = added_spans(text, base, selector)
                if not base and not more:
                    continue
                for k, kind in enumerate(KINDS):
                    counts[k, i] = sum(s[0] == kind for s in base)
                counts[4, i] = len(more)
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(base + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts[:4]), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(counts[4])], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each stretch of overlapping spans replaced by the kind of its first span, as <EMAIL>."""
    out, here = [], 0
    stretch: list = []
    for kind, a, b in [*sorted(spans, key=lambda s: (s[1], -s[2], ALL_KINDS.index(s[0]))), ("", len(text) + 1, len(text) + 1)]:
        if stretch and a < stretch[2]:
            stretch[2] = max(stretch[2], b)
            continue
        if stretch:
            out += [text[here : stretch[1]], f"<{stretch[0].upper()}>"]
            here = stretch[2]
        stretch = [kind, a, b]
    return "".join([*out, text[here:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; all other columns and rows as they are."""
    selector = trained()
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, place)):
            texts = batch.column(place).cast(pa.string()).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    texts[i] = redacted(text, base + added_spans(text, base, selector))
            cols = list(batch.columns)
            cols[place] = pa.array(texts, pa.string()).cast(batch.column(place).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find(table(spark, sf_dir, "documents"))
