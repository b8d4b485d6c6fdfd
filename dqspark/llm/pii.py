"""Personal data: anchors are found first, local parsers then set and check the boundaries.

One Aho-Corasick pass over a text finds at-signs, plus signs, address schemes and
identifier cues ("iban", "account no", "password" ...).  Digits open number clusters.
From each anchor a small deterministic parser walks outwards to the real end of the value,
however long that is; walks stop at the next anchor's sign or share their end, so a text is
read a fixed number of times whatever it holds.

Kinds, in order: ``email``, ``ip``, ``card``, ``phone`` by fixed grammars (leftmost,
without overlap within a kind), then what the cues add: ``mailbox`` (addresses with
letters beyond ASCII), ``login`` (user part of an address with a scheme, mailto and tel
targets), ``account`` (IBANs by check digits, cued numbers) and ``secret`` (cued keys).
Added spans never overlap a span of a fixed grammar or each other.

Null and empty texts have no spans.  Rows are judged one by one, so repeated rows give
repeated results, and no other column is read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import by_value

by_value(__name__)

SPANS = "array<struct<kind:string,start:int,stop:int>>"
BASE = ("email", "ip", "card", "phone")
ADDED = ("mailbox", "login", "account", "secret")

# Cues by what they announce.
SCHEMES = ("://", "mailto:", "tel:")
ACCOUNT_CUES = (
    "iban", "account no", "account number", "account id", "account:", "account #", "acct", "bank account",
    "routing number", "sort code", "passport no", "passport number", "passport:", "ssn", "social security number",
    "tax id", "customer id", "customer no", "member id", "kontonummer", "numero de cuenta", "numéro de compte",
)
SECRET_CUES = ("password", "passwd", "pwd", "passphrase", "token", "api_key", "apikey", "api key", "secret", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CLUSTER = re.compile(r"[0-9][0-9.\x20-]{6,}")
# a number that fails at its first digit fails at every later one, so only first digits are tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_VALUE = re.compile(r"[\s:=#.\"']{0,4}(?:no\.?|number|is)?[\s:=#.\"']{0,4}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){3,34})", re.ASCII)  # one more than the 34 of an IBAN
_NUMBER = re.compile(r"[A-Za-z]{0,4}[ -]?[0-9](?:[ -]?[0-9])*+", re.ASCII)
_IBAN_SHAPE = re.compile(r"[A-Za-z]{2}[0-9]{2}[ -]?[A-Za-z0-9]{4}", re.ASCII)
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?=[^\s\"']{8})")
_UNBROKEN = re.compile(r"[^\s\"']++")
_BARE = re.compile(r"[^\s\"'&;,)}<>]++")  # an unquoted value also ends where a query or a list goes on
_NO_WORDS = re.compile(r"\d|[a-z][^\W\d_]*[A-Z]|[^\w.:!?/'’-]|_")
_AUTHORITY = re.compile(r"([^\s/?#@<>\"]++)@[A-Za-z0-9.-]+")
_TARGET = re.compile(r"[A-Za-z0-9+().-]{5,}+")

_automaton = None


def anchors():
    """The automaton over lower-case cues, built once per process."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        found = ahocorasick.Automaton()
        for cue in ("@", "+"):
            found.add_word(cue, (cue, 1))
        for name, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            for cue in cues:
                found.add_word(cue, (name, len(cue)))
        found.make_automaton()
        _automaton = found
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    """Two letters, two check digits, 11 to 30 more characters, remainder 1 modulo 97."""
    v = value.replace(" ", "").replace("-", "").upper()
    if not (15 <= len(v) <= 34 and v[:2].isalpha() and v[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _lowered(text: str) -> str:
    """Lower case of the same length, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of every span, in kind order, then by start; code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    ats, plus, cues = [], [], []
    for end, (name, size) in anchors().iter(_lowered(text)):
        (ats if name == "@" else plus if name == "+" else cues).append((end - size + 1, end + 1, name))
    done = 0
    loose = []
    for at, after, _ in ats:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, after)
        if domain and start < at:
            out["email"].append((start, domain.end()))
            done = domain.end()
        else:
            loose.append(at)
    for cluster in _CLUSTER.finditer(text):
        lo, hi = cluster.span()
        for m in _IP.finditer(text, lo, hi):
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text, lo, hi):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    done = 0
    for at, _, _ in plus:
        if at >= done and (m := _PHONE.match(text, at)):
            done = m.end()
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out["phone"].append(m.span())
    if loose or cues:
        taken = _merged(s for k in BASE for s in out[k])
        for kind, lo, hi in sorted(set(_added(text, loose, cues)), key=lambda x: (x[1], ADDED.index(x[0]))):
            i = bisect.bisect_left(taken, (lo, hi))
            if (i == 0 or taken[i - 1][1] <= lo) and (i == len(taken) or hi <= taken[i][0]):
                taken.insert(i, (lo, hi))
                out[kind].append((lo, hi))
    return [(k, a, b) for k in BASE + ADDED for a, b in sorted(out[k])]


def _merged(found) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _word_like(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def _random_looking(value: str) -> bool:
    """Whether an unquoted value is more than words: a digit, capitals after small letters, or a sign words do not hold."""
    return _NO_WORDS.search(value.rstrip(".:!?")) is not None


def _added(text: str, loose: list[int], cues: list[tuple[int, int, str]]) -> Iterator[tuple[str, int, int]]:
    """Candidates of the added kinds, each checked by its parser."""
    first = last = 0  # the run read last; cues inside it share its end and its verdict
    was_quoted = looks = False
    for at in loose:
        lo, hi = at, at + 1
        while lo > 0 and (_word_like(text[lo - 1]) or text[lo - 1] in "._%+-"):
            lo -= 1
        while hi < len(text) and (_word_like(text[hi]) or text[hi] in ".-"):
            hi += 1
        while hi > at + 1 and text[hi - 1] in ".-":
            hi -= 1
        labels = text[at + 1 : hi].split(".")
        if lo < at and len(labels) > 1 and all(labels) and len(labels[-1]) > 1 and labels[-1].isalpha():
            yield "mailbox", lo, hi
    for start, stop, name in cues:
        if name == "scheme":
            if text[start:stop] == "://":
                m = _AUTHORITY.match(text, stop)
                if m:
                    yield "login", m.start(1), m.end(1)
            elif start == 0 or not _word_like(text[start - 1]):
                m = _TARGET.match(text, stop)
                if m and sum(c.isdigit() for c in m.group()) >= 5:
                    yield "login", m.start(), m.end()
        elif start and _word_like(text[start - 1]) and text[start - 1] != "_":
            continue
        elif name == "account":
            m = _VALUE.match(text, stop)
            if not m:
                continue
            value, lo = m.group(1), m.start(1)
            for size in range(len(value), 14, -1):  # the longest IBAN at this place
                if (size == len(value) or value[size] in " -") and iban_ok(value[:size]):
                    yield "account", lo, lo + size
                    break
            else:
                if _IBAN_SHAPE.match(value):  # an IBAN whose check digits are wrong is none
                    continue
                head = _NUMBER.match(text, lo)
                if head and sum("0" <= c <= "9" for c in head.group()) >= 6:
                    yield "account", lo, head.end()
        else:
            m = _SECRET.match(text, stop)
            if m:
                lo = m.end()
                quoted = text[lo - 1] in "\"'"
                if not (quoted is was_quoted and first <= lo < last):
                    run = (_UNBROKEN if quoted else _BARE).match(text, lo)
                    first, last, was_quoted = lo, run.end() if run else lo, quoted
                    looks = quoted or _random_looking(text[first:last])
                if looks and last - lo >= 8:
                    yield "secret", lo, last


def _span_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([[{"kind": k, "start": a, "stop": b} for k, a, b in find(t)] if t else [] for t in batch])


def _masked_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([mask(t) if t else t for t in batch])


def mask(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    runs: list[list] = []
    for kind, lo, hi in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if runs and lo < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], hi)
        else:
            runs.append([kind, lo, hi])
    out, at = [], 0
    for kind, lo, hi in runs:
        out += [text[at:lo], f"<{kind}>"]
        at = hi
    return "".join(out) + text[at:]


def spans(text: Column) -> Column:
    """Column of (kind, start, stop) arrays."""
    return F.pandas_udf(_span_batches, SPANS)(text)


def mask_column(text: Column) -> Column:
    """Column of masked texts; null stays null."""
    return F.pandas_udf(_masked_batches, "string")(text)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``spans``."""
    return docs.select(F.col(doc_id).alias("doc_id"), spans(F.col(text).cast("string")).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the fixed-grammar spans, and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    written = lambda a: F.concat_ws(",", F.transform(a, line))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
