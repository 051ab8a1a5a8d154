"""Operator 4: secrets by patterns and by sliding-window entropy.

Three fixed patterns give the base spans. Beside them, candidate strings (long
runs of token characters) are searched by character class with a window whose
Shannon entropy is kept up by incremental counts; windows above the class's
threshold join into spans, unless an allow-list pattern covers them. Entropy
spans are found in their own right, also where a base span stands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siglex.llm.arrow_text import map_arrow, runs

#: The base patterns (all characters are ASCII, so they run on UTF-8 bytes), least lengths, order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_upper", "entropy_base64")


@dataclass(frozen=True)
class CharClass:
    """A class of characters, its window, and the least entropy in bits of a window."""

    kind: str
    chars: bytes
    window: int
    bits: float
    needs: tuple[bytes, ...]  # a span holds one of each


DIGITS, CAPITALS, SMALL = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", DIGITS + b"abcdef", 24, 3.0, (DIGITS, b"abcdef")),
    CharClass("entropy_hex", DIGITS + b"ABCDEF", 24, 3.0, (DIGITS, b"ABCDEF")),
    CharClass("entropy_upper", DIGITS + CAPITALS, 20, 3.4, (DIGITS, CAPITALS)),
    CharClass("entropy_base64", DIGITS + CAPITALS + SMALL + b"+/_-=", 24, 4.0, (DIGITS, CAPITALS, SMALL)),
)
#: Strings that look random and are none, or stand for examples.
ALLOWED = (
    rb"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}",
    rb"(?i)[a-z0-9+/_=-]*(?:example|sample|dummy|placeholder|changeme|xxxx)[a-z0-9+/_=-]*",
    rb"(?i)0?123456789(?:0|abcdef)[a-z0-9]*",
    rb"(?i)abcdefghijklmnopqrstuvwxyz[a-z0-9+/]*",
    rb"d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)


@dataclass(frozen=True)
class SecretScan:
    classes: tuple[CharClass, ...] = CLASSES
    allowed: tuple[bytes, ...] = ALLOWED
    least: int = field(default=20)  # of a candidate string


def windows_above(s: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """Spans (joined windows) of ``s`` whose entropy is ``bits`` or more; one step costs two count changes."""
    if len(s) < window:
        return []
    cost = [0.0] + [c * log2(c) for c in range(1, window + 2)]  # one more until the oldest is gone
    counts, total = [0] * 256, 0.0
    out: list[list[int]] = []
    for i, c in enumerate(s):
        total += cost[counts[c] + 1] - cost[counts[c]]
        counts[c] += 1
        if i >= window:
            gone = s[i - window]
            total += cost[counts[gone] - 1] - cost[counts[gone]]
            counts[gone] -= 1
        if i >= window - 1 and log2(window) - total / window >= bits:
            if out and out[-1][1] >= i - window + 1:
                out[-1][1] = i + 1
            else:
                out.append([i - window + 1, i + 1])
    return [(a, b) for a, b in out]


def _runs_of(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """(begin, end) of the maximal runs of ``least`` bytes or more of a class, which never cross rows."""
    if not len(data):
        return np.zeros((0, 2), np.int64)
    first = inside[data].copy()
    last = first.copy()
    edge = starts[(starts > 0) & (starts < len(data))]
    joined = first[1:] & first[:-1]
    joined[edge - 1] = False
    first[1:] &= ~joined
    last[:-1] &= ~joined
    spans = np.stack([np.flatnonzero(first), np.flatnonzero(last) + 1], 1)
    return spans[spans[:, 1] - spans[:, 0] >= least]


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def _extra(text: bytes, begin: int, end: int, scan: SecretScan, allowed: re.Pattern | None) -> list[tuple[int, int, str]]:
    """Entropy spans of the candidate ``text[begin:end]``."""
    s, out = text[begin:end], []
    covered = [m.span() for m in allowed.finditer(s)] if allowed else []
    for c in scan.classes:
        for m in re.finditer(b"[" + re.escape(c.chars) + b"]{%d,}" % c.window, s):
            for a, b in windows_above(m[0], c.window, c.bits):
                a, b = a + m.start(), b + m.start()
                piece = s[a:b]
                if all(any(x in piece for x in map(lambda v: bytes([v]), need)) for need in c.needs) and not any(x < b and a < y for x, y in covered) and not any(x <= begin + a and begin + b <= y for x, y, _ in out):
                    out.append((begin + a, begin + b, c.kind))
    return out


def scan_text(text: bytes, hexes: list[tuple[int, int]], candidates: list[tuple[int, int]], scan: SecretScan, allowed: re.Pattern | None) -> tuple[list, list]:
    """(base spans, all spans) of one text, as byte positions."""
    base = [(a, b, "hex") for a, b in hexes]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    return base, base + [x for a, b in candidates for x in _extra(text, a, b, scan, allowed)]


def find_secrets(docs: DataFrame, scan: SecretScan | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start
    and then by kind. Null and empty texts have none (and the digest of the
    empty string). Repeated rows give repeated rows; an empty table gives an
    empty result. Other columns are not read.
    """
    scan = scan or SecretScan()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, hexes = _table(DIGITS + CAPITALS + SMALL + b"+/_=-"), _table(DIGITS + b"abcdef")
        allowed = re.compile(b"|".join(b"(?:" + p.replace(b"(?i)", b"") + b")" for p in scan.allowed), re.IGNORECASE) if scan.allowed else None
        for batch in batches:
            rows = []
            for first, starts, data in runs(batch.column(1)):
                raw = data.tobytes()
                found: dict[int, tuple[list, list]] = {}
                for k, (table, least) in enumerate(((hexes, HEX_CHARS), (token, scan.least))):
                    spans = _runs_of(data, table, starts, least)
                    for row, (a, b) in zip(np.searchsorted(starts, spans[:, 0], "right") - 1, spans.tolist(), strict=True):
                        found.setdefault(int(row), ([], []))[k].append((a - int(starts[row]), b - int(starts[row])))
                for row in range(len(starts) - 1):
                    text = raw[starts[row] : starts[row + 1]]
                    base, every = scan_text(text, *found.get(row, ([], [])), scan, allowed)
                    rows.append(_row(text, base, every) if every else (0, 0, 0, hashlib.sha256(b"").hexdigest(), ""))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_arrow(docs.select("doc_id", "text"), scanned, schema)


def _row(text: bytes, base: list, every: list) -> tuple[int, int, int, str, str]:
    ascii_only = text.isascii()

    def said(spans: list) -> str:
        spans = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))
        if not ascii_only:
            spans = [(len(text[:a].decode()), len(text[:b].decode()), k) for a, b, k in spans]
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
    return (*n, hashlib.sha256(said(base).encode()).hexdigest(), said(every))
