"""Secrets in texts: one automaton over the bytes finds where a rule can begin, anchored ones then read the exact spans."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.automaton import Automaton, accepting_places, compile_rules
from plumbline.llm.common import pieces_of

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]"
#: Kind, and the pattern as it is read.
BASE = (("assign", _ASSIGN + "+"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))
#: Public shapes of further credentials.
FURTHER = (
    ("session_access", "ASIA[A-Z0-9]{16,}"),
    ("forge_token", "gh[opsur]_[A-Za-z0-9]{36,}"),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("map_key", "AIza[A-Za-z0-9_-]{35}"),
    ("payment_key", "[rs]k_live_[A-Za-z0-9]{16,}"),
    ("private_key", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
)
#: What every kept match begins with, for the combined scan: long counted runs of several rules would multiply its states.
CORES = (
    _ASSIGN,
    "AKIA[A-Z0-9]",
    "[0-9a-f]{12}",
    "ASIA[A-Z0-9]",
    "gh[opsur]_[A-Za-z0-9]",
    "xox[abprs]-[A-Za-z0-9-]",
    "AIza[A-Za-z0-9_-]",
    "[rs]k_live_[A-Za-z0-9]",
    "-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
)
KINDS = tuple(k for k, _ in BASE + FURTHER)
SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


@lru_cache(maxsize=1)
def rules() -> tuple[Automaton, tuple[Automaton, ...]]:
    """The combined automaton that may begin anywhere, and one anchored automaton for each kind."""
    return compile_rules(list(CORES)), tuple(compile_rules([p], anchored=True) for _, p in BASE + FURTHER)


def _long_enough(kind: int, match: bytes) -> bool:
    if kind == 0:
        mark = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0)
        value = match[mark + 1 :].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'")) >= 6
    return len(match) >= {1: 20, 2: 24}.get(kind, 0)


def _spans_in(one: Automaton, kind: int, data: bytes, low: int, high: int) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches between two bytes that no match can hold."""
    first = one.step[one.start * one.width + one.kind] != one.dead * one.width
    found = []
    while low < high:
        end = one.longest(data, low, high) if first[data[low]] else -1
        if end > low and _long_enough(kind, data[low:end]):
            found.append((low, end))
        low = max(end, low + 1)
    return found


def secrets_in(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """For each text its spans (kind, start, end), in code points, by start and then kind."""
    whole, each = rules()
    parts = [(t or "").encode() for t in texts]
    data = b"\n".join(parts)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    out: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    raw = np.frombuffer(data, np.uint8)
    places, marks = accepting_places(whole, raw)
    if len(places):
        walls = np.concatenate([[-1], np.flatnonzero(whole.breaks[raw]), [len(raw)]])
        region = np.searchsorted(walls, places)
        for kind, one in enumerate(each):
            for r in np.unique(region[(marks >> kind) & 1 == 1]):
                low, high = int(walls[r - 1]) + 1, int(walls[r])
                doc = int(np.searchsorted(begins, low, side="right")) - 1
                begin, text = int(begins[doc]), parts[doc]
                for a, b in _spans_in(one, kind, data, low, high):
                    a, b = a - begin, b - begin
                    if not text.isascii():
                        a, b = len(text[:a].decode()), len(text[:b].decode())
                    out[doc].append((a, kind, b))
    return [[(KINDS[k], a, b) for a, k, b in sorted(spans)] for spans in out]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 32_000_000) -> DataFrame:
    """Rows (id, spans), one for each row of ``docs``; a span is (kind, start, end) in code points, end exclusive.

    One pass over the bytes, by the rules' beginnings (``CORES``), marks the lines that can hold a span; the rule's own automaton
    then reads the spans of each marked line. Spans of one kind never overlap; those of two kinds may. A null or
    empty text has no spans. Repeated rows and null ids keep their own rows; other columns are not read; an empty table
    gives no rows. A text is read whole, at any length.
    """
    shape = T.StructType([docs.schema[id_col], T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        spans_type = to_arrow_type(shape["spans"].dataType)
        for piece in pieces_of(batches, text_col, piece_bytes):
            found = secrets_in(piece.column(text_col).to_pylist())
            rows = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], spans_type)
            yield from pa.table({id_col: piece.column(id_col), "spans": rows}).to_batches()

    rules()
    return docs.select(id_col, text_col).mapInArrow(run, shape)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", piece_bytes: int = 32_000_000) -> DataFrame:
    """The same rows and columns with every span, overlapping ones taken together, replaced by ``mark``."""

    def hide(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        if text is None or not spans:
            return text
        out, at = [], 0
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        import pyarrow as pa

        for piece in pieces_of(batches, text_col, piece_bytes):
            texts = piece.column(text_col).to_pylist()
            clean = [hide(t, s) for t, s in zip(texts, secrets_in(texts), strict=True)]
            at = piece.schema.get_field_index(text_col)
            yield from piece.set_column(at, piece.schema.field(at), pa.array(clean, piece.schema.field(at).type)).to_batches()

    return docs.mapInArrow(run, docs.schema)
