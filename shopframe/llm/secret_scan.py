"""Secret scan by token efficiency.

Natural text and code identifiers compress well under a byte-pair vocabulary:
several characters per token.  Random strings do not.  Every run of at least
``min_chars`` key-like characters is measured in characters per token under a
tiktoken vocabulary; low ratios are reported as spans of kind ``random``
after strings of a known harmless shape are excluded: hexadecimal digests of
the usual lengths, UUIDs, plain words and identifiers made of words, which is
asked of their letters' own ratio.

A run of a higher ratio, or of a harmless shape as a whole, may still hold a
random string behind the words of a path or a name.  Its pieces between the
separators are measured one by one, and so are its stretches of low ratio,
which join the pieces of a string that itself holds separators.

Three fixed patterns are reported beside it (``assign``, ``access``, ``hex``)
and are never removed by the exclusions.

Defined cases: a null or empty text has no spans; positions are code points,
ends exclusive; equal starts are ordered by kind in the order of ``KINDS``;
repeated rows give repeated results; an empty table gives an empty result.
Only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

KINDS = ("assign", "access", "hex", "random")

# The three base patterns and the least sizes of their matches.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Known harmless shapes.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))  # MD5, SHA-1, SHA-2 family in hex
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\Z")
HEX_ANY_CASE = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
LETTERS = re.compile(r"[A-Za-z]+")
# runs of letters in one of the usual cases, or short numbers, joined by - _ or /
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})(?:[-_/=+]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}))*[-_/=+]*\Z")

SEPARATORS = "+/_=-"
PIECE = re.compile(r"[A-Za-z0-9]+")
# digests and UUIDs as whole pieces of a run
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}|(?:%s))(?![A-Za-z0-9])"
    % "|".join("[0-9a-f]{%d}|[0-9A-F]{%d}" % (n, n) for n in sorted(DIGEST_LENGTHS))
)

# a run long enough; a maximal run of the hex kind is a part of such a run
HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % HEX_MIN)


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    # runs are maximal, so those of HEX_MIN characters and more are the
    # matches of HEX that do not fail
    found += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    return sorted(found)


def worded(s: str, encoding, max_ratio: float) -> bool:
    """Whether the letter runs of an identifier have the ratio of words.  Runs
    of one or two letters that are one token tell nothing.  Case is left out,
    and the better of a run at the start and inside of a text counts, as
    capitals and starts of lines are rarer in vocabularies."""
    chars = tokens = 0
    for run in LETTERS.findall(s):
        run = run.lower()
        n = min(len(encoding.encode_ordinary(run)), len(encoding.encode_ordinary(" " + run)))
        if n > 1 or len(run) > 2:
            chars, tokens = chars + len(run), tokens + n
    return chars > max_ratio * tokens or not tokens


def harmless(s: str, encoding, max_ratio: float) -> bool:
    if HEX_ANY_CASE.match(s):
        return len(s) in DIGEST_LENGTHS
    return bool(UUID.match(s) or IDENTIFIER.match(s) and worded(s, encoding, max_ratio))


def is_random(s: str, encoding, min_chars: int, max_ratio: float) -> bool:
    return len(s) >= min_chars and len(s) <= max_ratio * len(encoding.encode_ordinary(s)) and not harmless(s, encoding, max_ratio)


def dense_parts(s: str, encoding, min_chars: int, max_ratio: float) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(start, end) and the core's (start, end) of the parts of ``s`` covered by
    token stretches of at least ``min_chars`` whose ratio is low.  The core is
    the part's sum of ``max_ratio`` less characters, over tokens, at its
    greatest: the part without the words at its ends."""
    at = [0]
    for t in encoding.decode_tokens_bytes(encoding.encode_ordinary(s)):
        at.append(at[-1] + len(t))
    parts, j = [], 0
    for i in range(len(at)):
        while j < len(at) and at[j] - at[i] < min_chars:
            j += 1
        if j == len(at):
            break
        if at[j] - at[i] <= max_ratio * (j - i):
            if parts and i <= parts[-1][1]:
                parts[-1][1] = j
            else:
                parts.append([i, j])
    out = []
    for i, j in parts:
        best, core, total, first = 0.0, (i, j), 0.0, i
        for k in range(i, j):
            total += max_ratio - (at[k + 1] - at[k])
            if total <= 0:
                total, first = 0.0, k + 1
            elif total > best:
                best, core = total, (first, k + 1)
        out.append(((at[i], at[j]), (at[core[0]], at[core[1]])))
    return out


def random_parts(s: str, encoding, min_chars: int, max_ratio: float) -> list[tuple[int, int]]:
    """Random strings inside a run that is none as a whole."""
    found = []
    cuts = [0, *(x for m in KNOWN.finditer(s) for x in m.span()), len(s)]
    for a, b in zip(cuts[::2], cuts[1::2]):
        if b - a < min_chars:
            continue
        part = s[a:b]
        pieces = [m.span() for m in PIECE.finditer(part)]
        found += [(a + i, a + j) for i, j in pieces if is_random(part[i:j], encoding, min_chars, max_ratio)]
        for part_span, core in dense_parts(part, encoding, min_chars, max_ratio):
            touched = [p for p in pieces if p[1] > core[0] and p[0] < core[1]]
            if not touched:
                continue
            # the core grown to whole pieces, and if these hold words too, as it is
            whole = touched[0][0], touched[-1][1]
            if harmless(part[whole[0]:whole[1]], encoding, max_ratio):
                continue
            for i, j in (whole, core, part_span):
                i, j = i + len(part[i:j]) - len(part[i:j].lstrip(SEPARATORS)), i + len(part[i:j].rstrip(SEPARATORS))
                if is_random(part[i:j], encoding, min_chars, max_ratio):
                    found.append((a + i, a + j))
                    break
    merged: list[tuple[int, int]] = []
    for i, j in sorted(found):
        if merged and i < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(j, merged[-1][1]))
        else:
            merged.append((i, j))
    return merged


def random_spans(text: str, encoding, min_chars: int, max_ratio: float) -> list[tuple[int, int, int]]:
    found = []
    for m in _runs(min_chars).finditer(text):
        s, at = m.group(), m.start()
        if is_random(s, encoding, min_chars, max_ratio):
            found.append((at, 3, m.end()))
        else:
            found += [(at + a, 3, at + b) for a, b in random_parts(s, encoding, min_chars, max_ratio)]
    return found


@lru_cache(maxsize=8)
def _runs(min_chars: int) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % min_chars)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    max_ratio: float = 2.2,
) -> DataFrame:
    """Per document: the id, counts of the base kinds, ``base_spans`` and
    ``spans`` (``kind:start:end`` joined by commas), and ``secrets``, the
    texts of the spans in the same order."""

    def make():
        encoding = vocabulary(vocabulary_path)

        def row(doc_id, text):
            text = text or ""
            base = base_spans(text)
            every = sorted(base + random_spans(text, encoding, min_chars, max_ratio))
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            return doc_id, *n, written(base), written(every), [text[a:b] for a, _, b in every]

        return row

    return map_rows(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")),
        "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, secrets array<string>",
        make,
    )


def redacted(text: str, spans: str) -> str:
    """The text with every span replaced by the name of its kind."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, a, b = part.split(":")
        if int(a) >= at:
            out += [text[at:int(a)], f"[{kind}]"]
        at = max(at, int(b))
    return "".join([*out, text[at:]])


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
