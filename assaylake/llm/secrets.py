"""Secret scans: base patterns, and weak parts linked across a scope.

Base spans (always reported): key assignments, access identifiers and long hex
strings, found leftmost and non-overlapping for each kind in the whole text.

Linked spans. A credential is often split: an account or client identifier
here, a short secret there, an endpoint beside them; so are the candidates of the
base patterns that fail only their length. Alone each part is too
weak to report. Every part (weak or base) covers the interval of its own
characters widened by ``SCOPE``; a weak part is reported when its interval
meets the interval of a part of a complementary role (identifier with secret,
endpoint with identifier or secret) in the same document. Base access spans
count as identifiers, base assign and hex spans as secrets. The interval join
is a sweep over the sorted interval ends of one document: it asks for the
nearest complementary interval only, and never forms pairs.

Positions are code points, end exclusive. Cases: a null or empty text has no
span; texts of any length are scanned whole; spans that start together come by
kind, then end; repeated rows and null ids keep their own result; an empty table
gives no rows; extra columns are not returned by :func:`secret_spans` but survive
:func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: characters on each side of a part that belong to its scope
SCOPE = 120

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

# Weak parts, by role.
WEAK = {
    "identifier": re.compile(r"\b(?:user(?:name)?|login|account|client_?id|tenant_?id|access_?key)"
                             r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.IGNORECASE | re.ASCII),
    "short_secret": re.compile(r"\b(?:pwd|pass|pin|passphrase|credential|auth|bearer|private_?key)"
                               r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", re.IGNORECASE | re.ASCII),
    "endpoint": re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~@:-]+|"
                           r"""\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}""",
                           re.IGNORECASE | re.ASCII),
}
#: candidates of the base patterns that are too short to be base spans
SHORT = ("short_assign", "short_access", "short_hex")
SHORT_HEX = re.compile(r"[0-9a-f]{8,}")
KINDS = ["assign", "access", "hex", *WEAK, *SHORT]
ROLE = {"assign": 1, "access": 0, "hex": 1, "identifier": 0, "short_secret": 1, "endpoint": 2,
        "short_assign": 1, "short_access": 0, "short_hex": 1}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def weak_parts(text: str) -> list[Span]:
    out = []
    if ":" in text or "=" in text:             # every pattern of a name and its value holds one of them
        out = [(kind, *m.span()) for kind, p in WEAK.items() for m in p.finditer(text)]
        out += [("short_assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) < 6]
    if "AKIA" in text:
        out += [("short_access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) < 20]
    # a run of 8 to 23 hex digits, one decimal digit at least
    out += [("short_hex", *m.span()) for m in SHORT_HEX.finditer(text) if len(m[0]) < 24 and not m[0].isalpha()]
    return out


def link_parts(base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak parts whose widened interval meets one of another role."""
    if not weak:
        return []
    parts = base + weak
    role = np.array([ROLE[k] for k, _, _ in parts])
    start = np.array([s for _, s, _ in parts])
    end = np.array([e for _, _, e in parts])
    linked = np.zeros(len(parts), bool)
    for r in np.unique(role):
        mine, other = role == r, role != r
        if not other.any():
            continue
        # of the others that start before my widened end, the largest end so far must reach my widened start
        order = np.argsort(start[other], kind="stable")
        starts, reach = start[other][order], np.maximum.accumulate(end[other][order])
        upto = np.searchsorted(starts, end[mine] + 2 * scope, side="right")
        linked[mine] = (upto > 0) & (reach[np.maximum(upto, 1) - 1] >= start[mine] - 2 * scope)
    return [p for p, on in zip(weak, linked[len(base):], strict=True) if on]


def all_spans(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """(base spans, linked weak spans), each by start, then kind as listed."""
    order = lambda p: (p[1], KINDS.index(p[0]), p[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted(link_parts(base, weak_parts(text), scope), key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda p: (p[1], KINDS.index(p[0]), p[2])))


def _digest(base: list[Span]) -> str:
    return hashlib.sha256(joined(base).encode()).hexdigest()


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked), one row a document."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b["__text"]:
                base, linked = all_spans(t.as_py() or "", scope)
                kinds = [k for k, _, _ in base]
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), _digest(base),
                            joined(base + linked), len(linked)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b["__id"], *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()],
                                                             strict=True)]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])
    return (docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
            .mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                              "spans string, n_linked long"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span of ``text`` (base and linked) replaced by ``mask``; null stays null."""
    from .frames import map_text

    def clean(t: str) -> str:
        base, linked = all_spans(t, scope)
        out, at = [], 0
        for _, s, e in sorted(base + linked, key=lambda p: (p[1], -p[2])):
            if s >= at:
                out += [t[at:s], mask]
            at = max(at, e)
        return "".join([*out, t[at:]]) if out else t

    return map_text(docs, text, clean)
