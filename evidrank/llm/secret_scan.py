"""Secret scans: patterns for known kinds, and dictionary-primed zstandard novelty for the rest.

``spans_of`` gives (kind, start, end) in code points, end exclusive. Kinds assign, access and hex are fixed patterns.
Kind novel is measured: a token of key-like characters after a sensitive word is compressed by zstandard, primed with a
dictionary of common identifiers and the text around the token. The marginal bytes (compressed size with the token
less the size of its context alone) over the token's length say how much of it neither the surroundings nor the
dictionary explain; random strings stay near their entropy, words and repeated identifiers nearly vanish.

NULL texts are empty and hold no spans. All of a text is scanned, however long. Repeated rows give repeated results.
Tokens without a letter (card numbers, addresses of machines), further away than the line after a sensitive word, or shorter than twelve characters, are not measured. Other
columns are kept whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrank.llm.common import append

KINDS = ("assign", "access", "hex", "novel")
_ORDER = {k: i for i, k in enumerate(KINDS)}

# Fixed patterns of the base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Tells characters of hex from all others.
_HEX_MAP = bytes(ord("x" if chr(c) in "0123456789abcdef" else " ") for c in range(256))

#: Sensitive words, plurals and camel case too (``credentials``, ``secretKey``); a small letter after one makes another word.
_CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase)?|pwd|secret(?:[ _-]?key)?|token|credential|auth(?:orization)?|bearer|api[ _-]?key|access[ _-]?key|"
    r"private[ _-]?key|signing[ _-]?key|client[ _-]?id|session[ _-]?id|signature|conn(?:ection)?[ _-]?str(?:ing)?)"
    r"s?(?-i:(?![a-z]))",
    re.I | re.A,
)
#: What every sensitive word, and every name of an assign span, begins with in small letters.
_STEMS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "api", "access", "private", "sign", "client", "session", "conn")
#: A whole run of key-like characters or of a password's symbols, without a name and an equals sign before it.
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9+/_~.!@#$%^&*-])(?:[A-Za-z_.-]+=(?=[A-Za-z0-9+/_~.!@#$%^&*-]))?+([A-Za-z0-9+/_~.!@#$%^&*-][A-Za-z0-9+/_=~.!@#$%^&*-]{11,})"
)
_SYMBOLS = frozenset("!@#$%^&*")
_LETTER = re.compile(r"[A-Za-z]")
#: Blank lines and the line after them.
_NEXT = re.compile(r"(?:\n[ \t\r]*)*[^\n]*")
#: Mail addresses look like tokens with a symbol; they are personal data, not secrets.
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Identifiers and phrases that are common in code and configuration; plain words are not secrets.
IDENTIFIERS = (
    "password username user_name api_key apikey access_key secret_key client_id client_secret session_id private_key "
    "public_key authorization bearer token refresh_token access_token id_token csrf_token connection_string endpoint "
    "application/json content-type text/plain user-agent accept-encoding localhost example.com http:// https:// www. "
    "config.get os.environ getenv environment production staging development default placeholder changeme your_api_key "
    "your_password_here your_token_here insert_token_here example_secret undefined null none true false function return "
    "import export class const string integer boolean public private static void self.this. request response header "
    "body params query database server client service account storage bucket region version release debug warning error "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx XXXXXXXX ********"
).encode()


@dataclass(frozen=True)
class Novelty:
    around: int = 256
    least_bytes: float = 8.0
    least_ratio: float = 0.7
    #: For letters of both cases without a digit, and for tokens of one kind: names and words lie closer to random strings.
    least_case_ratio: float = 0.96
    least_case_bytes: float = 9.0
    least_plain_ratio: float = 1.07
    least_plain_bytes: float = 15.0
    dictionary: bytes = IDENTIFIERS


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)


def marginal_bytes(token: str, before: str, after: str, p: Novelty = Novelty()) -> int:
    """Compressed bytes that the token adds to its surroundings."""
    squeeze = _compressor(p.dictionary).compress
    context = (before + "\n" + after + "\n").encode("utf-8", "replace")
    return len(squeeze(context + token.encode("utf-8", "replace"))) - len(squeeze(context))


def _least(token: str, p: Novelty) -> float:
    """Marginal bytes from which a token counts as random."""
    lower, upper, digit = (any(map(kind, token)) for kind in (str.islower, str.isupper, str.isdigit))
    if digit and (lower or upper):
        return max(p.least_bytes, p.least_ratio * len(token) * 0.75)
    if lower and upper and any(map(str.isupper, token[1:])) and any(map(str.islower, token[1:])):
        return max(p.least_case_bytes, p.least_case_ratio * len(token) * 0.75)
    return max(p.least_plain_bytes, p.least_plain_ratio * len(token) * 0.75)


def undecorated(text: str, a: int, b: int) -> tuple[int, int]:
    """The place a:b without the doubled symbols at its ends, in time linear in its length."""
    word = text[a:b]
    rest = word.lstrip(word[0]) if word[0] in _SYMBOLS else word
    if len(word) - len(rest) > 1:
        a, word = b - len(rest), rest
    rest = word.rstrip(word[-1]) if word and word[-1] in _SYMBOLS else word
    return (a, a + len(rest)) if len(word) - len(rest) > 1 else (a, b)


def places(text: str) -> list[int]:
    """Where a stem stands in any case. Plain searches take a small part of the time of the patterns, which match only there."""
    small = text.replace("\u0130", " ").lower()  # the one letter whose small form is longer
    found = []
    for stem in _STEMS:
        at = small.find(stem)
        while at >= 0:
            found.append(at)
            at = small.find(stem, at + 1)
    return sorted(found)


def _matches(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """What ``finditer`` gives where every match begins at one of the starts."""
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def candidates(text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
    """Every token that follows a sensitive word in its line or stands in the next line that is not blank, once."""
    line = reach = done = 0  # ends of the word's line and of the line after it; tokens up to done are out
    for word in _matches(_CONTEXT, text, starts):
        if word.end() > line or not reach:
            line = text.find("\n", word.end())
            line = len(text) if line < 0 else line
            reach = _NEXT.match(text, line).end()
        start = max(word.end(), done)
        if start < reach:
            for m in _TOKEN.finditer(text, start, reach):
                a, b = undecorated(text, *m.span(1))
                if _LETTER.search(text, a, b) and not _MAIL.fullmatch(text[a:b].rstrip("=.-")):
                    yield a, b
            done = reach


def spans_of(text: str, p: Novelty = Novelty()) -> list[tuple[str, int, int]]:
    """Spans by start, then kind; novel spans do not overlap the others."""
    word_starts = places(text)
    found = [("assign", *m.span(2)) for m in _matches(_ASSIGN, text, word_starts) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if b"x" * 24 in text.encode("utf-8", "replace").translate(_HEX_MAP):
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b in found)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for a, b in candidates(text, word_starts):
        token = text[a:b].rstrip(".=-!")
        b = a + len(text[a:b].rstrip(".-!"))  # padding belongs to the secret
        before = bisect_left(starts, b)
        if len(token) < 12 or before and ends[before - 1] > a:
            continue
        if marginal_bytes(token, text[max(0, a - p.around) : a], text[b : b + p.around], p) >= _least(token, p):
            found.append(("novel", a, b))
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans become one."""
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, p: Novelty = Novelty(), masks: bool = False, kept: list[str] | None = None) -> DataFrame:
    """The columns of ``docs``, or ``kept``, then n_assign, n_access, n_hex, n_novel, base_sha256, spans and, with ``masks``, the
    masked text. base_sha256 is taken over the written spans of the base kinds alone."""
    added = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string"} | ({"masked": "string"} if masks else {})

    def work(texts: list[str]) -> list[pa.Array]:
        spans = [spans_of(t, p) for t in texts]
        counts = [pa.array([sum(s[0] == k for s in each) for each in spans], pa.int64()) for k in KINDS]
        base = [written([s for s in each if s[0] != "novel"]) for each in spans]
        digests = [hashlib.sha256(b.encode()).hexdigest() for b in base]
        words = [digests, list(map(written, spans)), *([list(map(masked, texts, spans))] if masks else [])]
        return [*counts, *(pa.array(w, pa.string()) for w in words)]

    return append(docs, work, added, kept=kept)


def mask(docs: DataFrame, p: Novelty = Novelty()) -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` replaced; NULL texts stay NULL."""
    others = [c for c in docs.columns if c != "text"]
    plain = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    rows = docs.select(*plain, F.col("text").isNull().alias("null_text"), "text")
    rows = scan(rows, p, masks=True, kept=[*(f"c{i}" for i in range(len(others))), "null_text"])
    made = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {"text": F.when(~F.col("null_text"), F.col("masked"))}
    return rows.select(*[made[c].alias(c) for c in docs.columns])
