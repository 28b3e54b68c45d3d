"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

**Encoding.** Two neighbouring tokens are compatible if encoding their joined bytes gives them back; a token
sequence is the encoding of its bytes exactly if all neighbours are compatible. So for every prefix there is one
last token, and the encodings of all prefixes form a tree. A position of the tree stays alive as long as the bytes
after it begin some token. What all live paths share can no longer change and is emitted. A state of the
transducer is therefore (last emitted token, bytes not yet covered); its look-ahead is bounded by the longest
token; only a token that covers all pending bytes asks for the last one, so states are kept by their bytes and
paths. They and their transitions are made when first needed and forgotten when there are ``max_states``.

**Decoding.** Token by token, with a state machine over UTF-8 bytes (the well-formed sequences of the Unicode
standard): a character is put out when its last byte arrives, and a maximal ill-formed part becomes U+FFFD. The
moves of whole tokens are remembered by (state, token).
"""

from __future__ import annotations

import base64
import gc
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

from casemill.llm.common import Ragged, add_columns, slices, without

#: Where a text may be cut: before a space between letters, digits or ASCII signs.
_CUT = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")
#: A space where a text may not be cut.
_UNCUT = re.compile(r" (?:(?<![\w!-~] )|(?![\w!-~]))")


_NONE = 1 << 40  # above every rank


@lru_cache(maxsize=1)
def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file with lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours whose bytes have the lowest rank, leftmost first, until none is left."""
    none = _NONE
    parts = [piece[i : i + 1] for i in range(len(piece))]
    joined = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while joined and (lowest := min(joined)) < none:
        i = joined.index(lowest)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joined[i]
        if i < len(joined):
            joined[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            joined[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


class _State:
    """Bytes that are not covered by emitted tokens, with the paths through them that may still win.

    What follows also depends on the last emitted token, which the transducer keeps in a register: it only
    matters for a token that covers all pending bytes.
    """

    __slots__ = ("bytes", "paths", "alive", "moves", "refused", "ends")

    def __init__(self, pending: bytes, paths: tuple, alive: tuple):
        self.bytes, self.moves, self.refused, self.ends = pending, {}, None, None
        self.paths = paths  # position of the pending bytes, start of its last token, the token; and so on
        self.alive = alive  # positions at which a token may start that is not ended yet

    def last_tokens(self) -> dict[int, tuple[int, int]]:
        """Position of the pending bytes: (start of its last token, the token)."""
        p = self.paths
        return {p[i]: (p[i + 1], p[i + 2]) for i in range(0, len(p), 3)}

    def rest(self) -> tuple:
        """The tokens of the pending bytes if nothing follows."""
        if self.ends is None:
            out, at, paths = [], len(self.bytes), self.last_tokens()
            while at:
                at, token = paths[at]
                out.append(token)
            self.ends = tuple(out[::-1])
        return self.ends


class Transducer:
    """Encodes pieces of bytes. ``max_states`` and ``max_pairs`` bound the memory, not the results."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 160_000, max_pairs: int = 250_000):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.begins = {t[:i] for t in ranks for i in range(1, len(t))}
        self.max_states, self.max_pairs = max_states, max_pairs
        self.pairs: dict[int, bool] = {}
        self.merges: dict[int, list] = {}  # of the tokens met, at most the vocabulary
        self.start = _State(b"", (), (0,))
        self.states = {(b"", ()): self.start}

    def _forget(self) -> None:
        """Keep the states with several moves, unless they are most of all."""
        kept = [x for x in self.states.values() if len(x.moves) + len(x.refused or ()) > 1]
        if 2 * len(kept) > self.max_states or self.start not in kept:
            self.start = _State(b"", (), (0,))
            kept = [self.start]
        known = set(kept)
        for x in kept:
            x.moves = {b: m for b, m in x.moves.items() if m[1] in known}
            x.refused = {b: m for b, m in (x.refused or {}).items() if m[1] in known} or None
        for x in self.states.values():
            if x not in known:  # states refer to each other
                x.moves, x.refused = {}, None
        self.states = {(x.bytes, x.paths): x for x in kept}

    def clear(self) -> None:
        """Break the cycles between the states."""
        for x in self.states.values():
            x.moves, x.refused = {}, None
        self.states = {}

    def _merges(self, token: int) -> list[tuple[int, bytes, bytes]]:
        """``(rank, first part, last part)``: the parts of a token before its first merge and after each one, with the rank
        of the merge that comes next."""
        found = self.merges.get(token)
        if found is None:
            parts, found = [bytes((b,)) for b in self.tokens[token]], []
            while True:
                ranks = [self.ranks.get(x + y, _NONE) for x, y in zip(parts, parts[1:])]
                lowest = min(ranks, default=_NONE)
                found.append((lowest, parts[0], parts[-1]))
                if lowest == _NONE:
                    break
                i = ranks.index(lowest)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.merges[token] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge goes over the border: both tokens merge their own parts, always the lowest rank first and of
        equal ones the leftmost, while the parts at the border have none as low."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            left, right = iter(self._merges(a)), iter(self._merges(b))
            (low, _, x), (high, y, _) = next(left), next(right)
            while True:
                over = self.ranks.get(x + y, _NONE)
                if over < low and over <= high:
                    known = False
                    break
                if low == high == _NONE:
                    known = True
                    break
                if low <= high:
                    low, _, x = next(left)
                else:
                    high, y, _ = next(right)
            self.pairs[a << 32 | b] = known
        return known

    def _move(self, state: _State, byte: int, refused: bool = False) -> tuple[int, _State, tuple]:
        """``(token, next state, emitted tokens)``: the move holds if the token, unless it is -1, fits behind the
        last emitted one. ``refused`` gives the move for the case that it doesn't."""
        text, old, begins = state.bytes + bytes((byte,)), state.last_tokens(), self.begins
        n, alive, last, asked = len(text), [], None, -1
        for j in state.alive:
            part = text[j:]
            if part in begins:
                alive.append(j)
            if last is None and (token := self.ranks.get(part)) is not None:
                if not j:
                    asked = token
                    last = None if refused else (j, token)
                elif self._compatible(old[j][1], token):
                    last = (j, token)
        alive.append(n)
        # What the paths of all live positions begin with is settled.
        root = alive[0]
        for j in alive[1:]:
            if not root:
                break
            while root != j:
                if j > root:
                    j = (last if j == n else old[j])[0]
                else:
                    root = (last if root == n else old[root])[0]
        out, at = [], root
        while at:
            at, token = last if at == n else old[at]
            out.append(token)
        paths = {}
        for at in alive:
            while at > root and at - root not in paths:
                start, token = last if at == n else old[at]
                paths[at - root] = (start - root, token)
                at = start
        # Which positions are alive follows from the bytes.
        flat = []
        for at, (start, token) in paths.items():
            flat += (at, start, token)
        key = (text[root:], tuple(flat))
        known = self.states.get(key)
        if known is None:
            if len(self.states) >= self.max_states:
                self._forget()
            known = self.states[key] = _State(*key, tuple(j - root for j in alive))
        move = (asked, known, tuple(out[::-1]))
        if refused and state.refused is None:
            state.refused = {}
        (state.refused if refused else state.moves)[byte] = move
        return move

    def encode(self, piece: bytes) -> list[int]:
        return list(self.encode_sorted([piece])[0])

    def encode_sorted(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece. What a piece begins with like the one before it is not walked again, so sorted ones
        take fewest steps."""
        made, out, before, pairs = [], [], b"", self.pairs
        trail = [(self.start, -1, 0)]  # after each byte: state, last token, tokens emitted
        for piece in pieces:
            same = 0
            for a, b in zip(before, piece):
                if a != b:
                    break
                same += 1
            del trail[same + 1 :]
            state, last, sent = trail[same]
            del out[sent:]
            for byte in piece[same:]:
                asked, following, sent = state.moves.get(byte) or self._move(state, byte)
                if asked >= 0 and last >= 0:
                    fits = pairs.get(last << 32 | asked)
                    if not (self._compatible(last, asked) if fits is None else fits):
                        _, following, sent = (state.refused or {}).get(byte) or self._move(state, byte, True)
                if sent:
                    out += sent
                    last = sent[-1]
                state = following
                trail.append((state, last, len(out)))
            made.append((*out, *state.rest()))
            before = piece
        return made


def cut(text: str) -> list[str]:
    """The parts of a text, each but the first with its space. Most texts can be cut at every space, which needs no pattern."""
    if "\0" in text or _UNCUT.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


class TextEncoder:
    """Whole texts: each match of the pattern is a piece, and each different piece goes through the transducer once.

    ``spaced`` says that no match of the pattern goes on over a space between two other characters that are not
    white space, so that such a space begins a match. Texts are cut there (only between letters, digits and ASCII signs), and each
    different part is encoded once, as long as it is remembered: beyond ``max_known`` characters (with eight more for
    each part) all are forgotten, so what comes late is remembered like what comes early.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = False, max_known: int = 10_000_000):
        self.matches = regex.compile(pattern).findall
        self.cut = cut if spaced else (lambda text: [text] if text else [])
        self.max_known = max_known
        self.transducer = Transducer(ranks)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.ids, self.chars = Ragged(), 0

    def _learn(self, parts) -> None:
        new = [p for p in parts if p not in self.index]
        split = list(map(self.matches, new))
        known, missing = self.pieces, {}
        for piece in chain.from_iterable(split):
            if piece not in known:
                missing[piece] = piece.encode()
        order = sorted(missing, key=missing.__getitem__)
        known.update(zip(order, self.transducer.encode_sorted([missing[p] for p in order])))
        made, ends = [], []
        for part, pieces in zip(new, split):
            for piece in pieces:
                made += known[piece]
            ends.append(len(made))
            self.index[part] = len(self.index)
            self.chars += len(part) + 8
        self.ids.extend(np.array(made, np.uint32), ends)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.cut(t) for t in texts]
        if self.chars > self.max_known:
            self._forget()
        self._learn(dict.fromkeys(chain.from_iterable(split)))
        sizes = np.array(list(map(len, split)), np.int64)
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
        ids, lengths = self.ids.rows(numbers)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        return np.split(ids, ends[:-1])

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian numbers."""
        return self.encode_all([text])[0].astype("<u4").tobytes()


#: Second bytes allowed after a first byte: fixed values of the UTF-8 standard.
_FIRST = (
    [(b, 1, 0x80, 0xBF) for b in range(0xC2, 0xE0)]
    + [(0xE0, 2, 0xA0, 0xBF)]
    + [(b, 2, 0x80, 0xBF) for b in (*range(0xE1, 0xED), 0xEE, 0xEF)]
    + [(0xED, 2, 0x80, 0x9F), (0xF0, 3, 0x90, 0xBF)]
    + [(b, 3, 0x80, 0xBF) for b in range(0xF1, 0xF4)]
    + [(0xF4, 3, 0x80, 0x8F)]
)


class StreamDecoder:
    """Decodes ids one after the other. A state is the bytes of an unfinished character."""

    def __init__(self, tokens: dict[int, bytes], max_moves: int = 80_000):
        self.tokens, self.moves, self.n_moves, self.max_moves = tokens, {b"": {}}, 0, max_moves
        self.first = {b: (n, lo, hi) for b, n, lo, hi in _FIRST}

    def _step(self, state: bytes, byte: int) -> tuple[bytes, str]:
        if state:
            need, lo, hi = self.first[state[0]]
            if len(state) > 1:
                lo, hi = 0x80, 0xBF
            if lo <= byte <= hi:
                state += bytes((byte,))
                return (state, "") if len(state) <= need else (b"", state.decode())
            again, out = self._step(b"", byte)
            return again, "\ufffd" + out
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes((byte,)), "") if byte in self.first else (b"", "\ufffd")

    def move(self, state: bytes, token: int) -> tuple[bytes, str]:
        """The state after one more token, and the characters that it completes."""
        found = self.moves.get(state, {}).get(token)
        if found is None:
            at, out = state, []
            for byte in self.tokens[token]:
                at, made = self._step(at, byte)
                out.append(made)
            found = (at, "".join(out))
            if self.n_moves >= self.max_moves:
                for known in self.moves.values():  # a decode in progress may hold one of them
                    known.clear()
                self.n_moves = 0
            self.n_moves += 1
            self.moves.setdefault(state, {})[token] = found
        return found

    def decode(self, ids) -> str:
        state, out, moves = b"", [], self.moves
        here = moves[state]
        for token in ids:
            move = here.get(token) or self.move(state, token)
            out.append(move[1])
            if move[0] != state:
                state = move[0]
                here = moves.get(state, {})
        return "".join(out) + ("\ufffd" if state else "")


def unpacked(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data)


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    spaced: bool = False,
    keep_text: bool = False,
    decoded: str | None = None,
) -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids`` (unsigned 32-bit little-endian numbers, as bytes) instead of the text.

    Every text is encoded whole, without special tokens; a null or empty text has no ids. Other columns stay
    (a column called like a result is replaced). No shuffle; rows keep their order within a partition.
    ``decoded`` names a column for the text that the ids decode to, read back from them in the same pass.
    """

    def run(batches):
        # What is remembered goes with the task.
        encoder = TextEncoder(load_ranks(path), pattern, spaced)
        decoder = StreamDecoder(encoder.transducer.tokens) if decoded else None
        # Python's collector would walk through all states again and again; without it the task breaks their cycles itself.
        gc.disable()
        try:
            for batch in batches:
                for part in slices(batch, text, 2_000_000):
                    made = encoder.encode_all([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()])
                    columns = [list(map(len, made)), [m.astype("<u4").tobytes() for m in made]]
                    if decoded:
                        columns.append([decoder.decode(m.tolist()) for m in made])
                    new = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    old = [part.column(part.schema.get_field_index(n)) for n in names]
                    yield pa.RecordBatch.from_arrays([*old, *new], [*names, *added.names])
        finally:
            encoder.transducer.clear()
            gc.enable()

    fields = "n_tokens bigint, ids binary" + (f", `{decoded}` string" if decoded else "")
    added = T._parse_datatype_string(fields)
    types = [to_arrow_type(f.dataType) for f in added.fields]
    names = without(df, [*added.names, *([] if keep_text else [text])]).columns
    kept = [f for f in df.schema.fields if f.name in names]
    clashing = [n for n in added.names if n.lower() != text.lower()]
    return without(df, clashing).mapInArrow(run, T.StructType([*kept, *added.fields]))


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``into``; null ids give an empty text."""

    def make():
        decoder = StreamDecoder({i: t for t, i in load_ranks(path).items()})

        def work(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.get_field_index(ids))
            return [[decoder.decode(unpacked(data.as_py() or b"")) for data in column]]

        return work

    return add_columns(df, f"{into} string", make)
