"""Secret scans by token efficiency.

Patterns find the base spans: assignments, access keys and long runs of hexadecimal digits. Beyond these, every other run
of 16 or more letters, digits and the signs of Base64 is a candidate. Forms that are known to be no secrets go: UUIDs, digests
of the usual lengths, subresource integrity values, numbers, and identifiers made of words and short numbers. What is left is
encoded with a tiktoken vocabulary. Its merges were learned from written text, so words take one token for three or more
characters and random strings hardly more than one character a token: a ratio of at most 1.9 exposes them. Of 20 random
letters and digits, hexadecimal digits aside, more than 99.9 % are below that.

Each task scans whole texts, one Arrow batch at a time; a linear-time search skips the texts without any candidate.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order of their spans; the first three are the base.
KINDS = ("assign", "access", "hex", "random")
BASE = 3
# The base patterns. Letters of the first are matched in either case. A run of 24 or more is the whole run,
# because matches are as long as can be, and shorter ones do not count.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
VALUE_LENGTH, ACCESS_LENGTH = 6, 20
# Candidates; the most characters a token of a random string, and characters encoded at a time.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
RATIO, STRETCH = 1.9, 512
# Forms that are no secrets: lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), and others.
DIGESTS = (32, 40, 56, 64, 96, 128)
_HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_KNOWN = re.compile(
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}|sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}|[0-9+/_=-]+"
)
# A word, or several with capitals in front, and up to four digits behind; or a short number.
_HUMPS = r"(?:[A-Z][a-z]++)"
_WORD = rf"(?:[a-z]{{2,}}+{_HUMPS}*+|{_HUMPS}++|[A-Z]++|[a-z])[0-9]{{0,4}}+|[0-9]{{1,8}}+"
_IDENTIFIER = re.compile(rf"(?:(?:{_WORD})?[+/_-]++)*+(?:{_WORD})?=?")
# One search that any text with something to find passes.
_ANY = rf"(?i:{ASSIGN})|{CANDIDATE}"

Span = tuple[int, int, int, float | None]  # start, place of the kind, end, characters a token


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, place, end)`` of the base kinds."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= VALUE_LENGTH]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


# Without re.ASCII, matching in either case would also take letters such as the long s.
_ASSIGN, _ACCESS, _HEX, _CANDIDATE = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX), re.compile(CANDIDATE)


def known_form(run: str) -> bool:
    """Whether a run is a digest, an identifier or a number."""
    bare = run.rstrip("=")
    if _HEXADECIMAL.fullmatch(bare) and len(bare) in DIGESTS:
        return True
    return bool(_KNOWN.fullmatch(run) or _IDENTIFIER.fullmatch(run))


class Scanner:
    """Finds spans; ``ranks`` are the tokens of a tiktoken vocabulary, ``pattern`` splits text before its merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, ratio: float = RATIO) -> None:
        import tiktoken

        encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.most = encoding.encode_ordinary, ratio
        self.ratio = lru_cache(1 << 14)(self._ratio)

    def _ratio(self, run: str) -> float:
        """Characters a token; long runs are encoded stretch by stretch."""
        return len(run) / sum(len(self.encode(run[k : k + STRETCH])) for k in range(0, len(run), STRETCH))

    def spans(self, text: str) -> list[Span]:
        """All spans by start and kind. Spans of the method overlap no base span."""
        found: list[Span] = [(*s, None) for s in base_spans(text)]
        taken = sorted((a, b) for a, _, b, _ in found)
        k, ended = 0, 0
        for m in _CANDIDATE.finditer(text):
            run, start, end = m[0], m.start(), m.end()
            while k < len(taken) and taken[k][0] < end:
                ended, k = max(ended, taken[k][1]), k + 1
            if ended > start or known_form(run):
                continue
            ratio = self.ratio(run) if len(run) <= STRETCH else self._ratio(run)
            if ratio <= self.most:
                found.append((start, BASE, end, ratio))
        return sorted(found, key=lambda s: s[:3])


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


SPANS = "array<struct<start:bigint,place:int,end:bigint,ratio:double>>"


def find_secrets(docs: DataFrame, path: str, pattern: str, keep: list[str], ratio: float = RATIO) -> DataFrame:
    """The columns ``keep`` with ``spans array<start, place, end, ratio>`` of each text, by start and kind.

    ``place`` is the kind's place in ``KINDS``; starts and ends count code points, ends exclusive; ``ratio`` is null for base
    spans. A null text is an empty one and has no spans. ``path`` names a ``.tiktoken`` file on the driver, from where its tokens,
    a megabyte, are sent to the tasks once. Rows stay rows, repeated ones too. Other columns than ``keep`` and ``text``
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, pattern, ratio)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("place", pa.int32()), ("end", pa.int64()), ("ratio", pa.float64())]))
        names = ("start", "place", "end", "ratio")
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            hits = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_pylist()
            spans = [
                [dict(zip(names, s)) for s in scanner.spans(texts[k].as_py())] if hit else [] for k, hit in enumerate(hits)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], names=[*keep, "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(scan, f"{fields}, spans {SPANS}")


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(named, ",")


def secrets_summary(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts and digests, one row for each of :func:`find_secrets`."""

    def count(place: int) -> Column:
        # A lambda of two parameters would get the span's position as its second one.
        return F.size(F.filter("spans", lambda s: s["place"] == place)).cast("bigint")

    counts = [count(place).alias(f"n_{KINDS[place]}") for place in range(BASE)]
    base = F.filter("spans", lambda s: s["place"] < BASE)
    return found.select(
        *keep, *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )
