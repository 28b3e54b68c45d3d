"""Secrets in texts: fixed patterns, and values in a credential context that are costly to guess.

The cost of a value is the logarithm of the guesses that the cheapest way of putting it together needs: a dynamic
program over segmentations into words of a ranked list, dates, repeats, keyboard walks and brute-force spans.
Placeholders and plain words are cheap; keys and good passwords are not.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from casemill.llm.common import add_columns, quoted

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client|secret)[_-]?(?:key|secret|token))"""
    r"""["']?[\x20\t]*[:=][\x20\t]*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|["']?([^\s"']\S*))""",
    re.IGNORECASE,
)
#: What closes something around a value that has no quotes, and what would open it inside the value.
_CLOSERS = {"'": "", '"': "", ",": "", ";": "", ")": "(", "]": "[", "}": "{", ">": "<"}
#: Values that stand for a secret kept elsewhere: they are guessed at once.
PLACEHOLDER = re.compile(
    r"""\$\{[^}]*\}|\$\(\w+\)|\$[A-Z_][A-Z0-9_]*|\{\{[^}]*\}\}|\{\w+\}|<[^>]*>|%\w+%|\[\w+\]|"""
    r"""(?:os\.environ|os\.getenv|process\.env|getenv|env)\b.*|[*x.•_-]+""",
    re.IGNORECASE,
)
KINDS = ("assign", "access", "hex", "guess")
MIN_GUESS_LENGTH, MIN_LOG10_GUESSES = 6, 6.0

#: The rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEYS = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
#: Spans of walks and repeats are at most this long, or begin where their run begins; repeated units are at most this long.
SPAN, UNIT = 16, 8
_DATES = [
    (re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), math.log10(200 * 365)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"), math.log10(200 * 365)),
    (re.compile(r"\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"), math.log10(100 * 365)),
    (re.compile(r"(?:19|20)\d\d"), math.log10(200)),
]


@lru_cache(maxsize=2)
def ranked_words(path: str) -> dict[str, int]:
    """Whole words of a public vocabulary file (``model.vocab``, word ends marked ``</w>``) by their rank."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    words = sorted((i, t[:-4]) for t, i in vocabulary.items() if t.endswith("</w>"))
    return {w: n for n, w in enumerate((w for _, w in words if len(w) > 2 and w.isalpha()), 1)}


_lengths: dict[int, int] = {}


def _longest(words: dict[str, int]) -> int:
    """Letters of the longest word; word lists are few and stay."""
    if id(words) not in _lengths:
        _lengths[id(words)] = max(map(len, words), default=0)
    return _lengths[id(words)]


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def log10_guesses(value: str, words: dict[str, int]) -> float:
    """The least cost over all segmentations; linear in the length of the value. A placeholder costs nothing, and so do
    several words in a row, which are text and no secret."""
    if PLACEHOLDER.fullmatch(value) or (" " in value and all(p.strip(".,;:!?()").isalpha() for p in value.split())):
        return 0.0
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    best = [0.0] * (n + 1)
    dates: dict[int, list[tuple[int, float]]] = {}  # by the end of a date: (its start, cost)
    for i in range(n):
        if value[i].isdigit():
            for pattern, cost in _DATES:
                if found := pattern.match(value, i):
                    dates.setdefault(found.end(), []).append((i, cost))
    longest = _longest(words)
    walk_from, turns, way = 0, 0, None  # of the walk that ends here
    turned = [0] * n
    walks = [0] * n
    for i in range(1, n):
        a, b = _KEYS.get(low[i - 1]), _KEYS.get(low[i])
        step = (b[0] - a[0], b[1] - a[1]) if a and b else None
        if step is None or step == (0, 0) or max(map(abs, step)) > 1:
            walk_from, turns, way = i, 0, None
        else:
            turns, way = turns + (way is not None and step != way), step
        walks[i], turned[i] = walk_from, turns
    same = [[0] * (n + 1) for _ in range(UNIT + 1)]  # same[p][j]: characters up to j that equal those p before
    for p in range(1, min(UNIT, n) + 1):
        row = same[p]
        for j in range(p, n):
            row[j + 1] = row[j] + 1 if value[j] == value[j - p] else 0
    for j in range(1, n + 1):
        cost = best[j - 1] + _char_cost(value[j - 1])
        for i in range(max(0, j - longest), j - 2):
            rank = words.get(low[i:j])
            if rank is not None:
                part = value[i:j]
                cost = min(cost, best[i] + math.log10(rank + 1) + (0.0 if part == low[i:j] else math.log10(2)))
        for i, extra in dates.get(j, ()):
            cost = min(cost, best[i] + extra)
        begun = walks[j - 1]
        for i in {begun, *range(max(begun, j - SPAN), j - 2)}:
            if j - i > 2:
                cost = min(cost, best[i] + math.log10(47 * (j - i)) + (turned[j - 1] - turned[i + 1]) * math.log10(6))
        for p in range(1, UNIT + 1):
            run = same[p][j] // p * p
            if run >= max(p, 2 if p == 1 else p):
                for i in {j - p - run, *range(j - 2 * p if p > 1 else j - 3, max(j - p - run, j - SPAN) - 1, -p)}:
                    unit = sum(map(_char_cost, value[i : i + p]))
                    cost = min(cost, best[i] + unit + math.log10((j - i) // p))
        best[j] = cost
    return best[n]


def _without_closers(value: str) -> str:
    while value and (opener := _CLOSERS.get(value[-1])) is not None:
        if opener and value.count(opener) >= value.count(value[-1]):
            break
        value = value[:-1]
    return value


def find_spans(text: str, words: dict[str, int]) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, log10 of guesses)`` by start, then kind. Ends are exclusive, in code points."""
    found = []
    given = ":" in text or "=" in text  # without one no value is assigned
    if given:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                found.append(("assign", m.start(), m.end(), log10_guesses(m[2], words)))
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), log10_guesses(m[0], words)) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end(), log10_guesses(m[0], words)) for m in HEX.finditer(text)]
    if given:
        base: list[list[int]] = []  # without overlaps
        for s, e in sorted((s, e) for _, s, e, _ in found):
            if base and s <= base[-1][1]:
                base[-1][1] = max(base[-1][1], e)
            else:
                base.append([s, e])
        k = 0
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            if m.lastindex == 3:
                end = start + len(_without_closers(m[3]))
            while k < len(base) and base[k][1] <= start:
                k += 1
            whole = k < len(base) and base[k][0] <= start and end <= base[k][1]  # nothing of the value is left
            if not whole and end - start >= MIN_GUESS_LENGTH:
                cost = log10_guesses(text[start:end], words)
                if cost >= MIN_LOG10_GUESSES:
                    found.append(("guess", start, end, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str, spans) -> str:
    """The text with every span, overlapping ones together, replaced by the kind of the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i][:3]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{kind}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind: string, start: bigint, end: bigint, log10_guesses: double>>"


def scan(docs: DataFrame, words_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` in place of the text; other columns stay. A null text has none. No shuffle."""

    def make():
        words = ranked_words(words_path)

        def work(batch: pa.RecordBatch) -> list:
            texts = batch.column(batch.schema.get_field_index(text))
            return [[[dict(zip(("kind", "start", "end", "log10_guesses"), s, strict=True)) for s in find_spans(t.as_py() or "", words)] for t in texts]]

        return work

    return add_columns(docs, f"spans {SPANS}", make, (text,))


def redact(docs: DataFrame, words_path: str, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets of the text replaced by their kind, in the same columns; clean rows stay as they are.

    ``length`` names a column that gets the new length of a changed text, if there is one. A null text stays null.
    """
    counted = length is not None and length in docs.columns

    def make():
        words = ranked_words(words_path)

        def work(batch: pa.RecordBatch) -> list:
            texts = [t.as_py() for t in batch.column(batch.schema.get_field_index(text))]
            made = [t if t is None else redacted(t, find_spans(t, words)) for t in texts]
            if not counted:
                return [made]
            sizes = batch.column(batch.schema.get_field_index(length)).to_pylist()
            return [made, [n if new == old else len(new) for n, old, new in zip(sizes, texts, made, strict=True)]]

        return work

    fields = f"`{text}` string" + (f", `{length}` {docs.schema[length].dataType.simpleString()}" if counted else "")
    return add_columns(docs, fields, make).select(*[quoted(c) for c in docs.columns])


def spelled(spans: Column, kinds=KINDS) -> Column:
    """``kind:start:end`` of the spans of these kinds, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
