"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The first tokenizer (A, byte-level) reads a space and the text, the second (B, pieces with byte fallback) the text, to
which it adds that space itself. The spans that the libraries report (characters for A, bytes for B) are coarse cuts:
a span whose length agrees with the decoded bytes of its token is taken as it is; where several tokens share a
character (multibyte characters, byte-fallback tokens) the decoded bytes say where each one ends. Offsets at which
tokens of both end cut the text into groups; tokens whose byte ranges overlap are links.

**Words.** Neither tokenizer has a token that goes on over a single space between two printable characters: A's pattern
begins a match there, and no piece of B has a space behind another character (checked when the pieces are loaded).
So such spaces cut a text into words with token sequences of their own; each different word is encoded once per task as long as it is
remembered, many of them in one call. Texts without such spaces are words themselves. What is remembered is bounded and
begins anew when it is full; this changes the time, not the results.

**Jobs.** One pass writes the ids of both tokenizers; all else follows from them and the bytes of their entries, with
arrays over many documents at once. The number of documents that hold a pair of ids linked is summed within a task first, then by Spark.
The table of pairs is joined to the links: broadcast up to ``BROADCAST_PAIRS`` rows, beyond that by a shuffle of each
document's own pairs. Every row of the table is a document, also if ids or rows repeat.

Texts that are null, empty, or that the decoded tokens of A or B do not give back have no tokens, groups or links.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from casemill.llm.common import Ragged, slices, without
from casemill.session import write_through

#: Pairs of a table that is broadcast: 17 bytes each in every worker.
BROADCAST_PAIRS = 4_000_000
#: Characters of the words that a task remembers, with eight more for each word.
KNOWN_CHARS = 10_000_000
#: Characters of the words that are encoded in one call.
BLOCK_CHARS = 3_000
#: Pairs that a task adds up before they are handed to Spark.
PENDING_PAIRS = 2_000_000
_CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
#: A space that does not cut a text into words.
_UNCUT = re.compile(r" (?:(?<![\w!-~] )|(?![\w!-~]))")
_PLAIN = re.compile(r"[\w!-~](.*[\w!-~])?", re.S)
_PAIR = 1 << 31  # above every pair number
RESULT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def _byte_of_char() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


def refined(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse ones: the end of a span as long as the decoded bytes of its token is taken, the
    ends behind it are where the decoded bytes end, up to the next such span."""
    agree = np.diff(coarse, prepend=0) == sizes
    last = np.maximum.accumulate(np.where(agree, np.arange(len(coarse)), -1))
    decoded = np.cumsum(sizes)
    # Before the first span that agrees, tokens are placed from the beginning.
    base = np.where(last >= 0, coarse[last] - decoded[last], 0)
    return base + decoded


class Tokenizers:
    """Both tokenizers, the bytes of their entries and how many they are."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = _byte_of_char()
        names = {i: t for t, i in self.a.get_vocab().items()}
        entries = [names.get(i, "") for i in range(max(names) + 1)]
        self.a_bytes = [bytes(map(chars.__getitem__, t)) if all(c in chars for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [_piece_bytes(p, self.b.is_byte(i)) for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.base = len(pieces)
        self.names = pa.array([str(i) for i in range(max(len(entries), len(pieces)))])
        if len(entries) * self.base > _PAIR:
            raise ValueError("too many pairs of ids")
        #: Whether words can be encoded by themselves.
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)

    def words(self, text: str) -> list[str]:
        if not self.cuttable:
            return [text]
        return _CUT.split(text) if _UNCUT.search(text) else text.split(" ")

    def encode(self, text: str):
        """``(A ids, A ends, B ids, B ends)`` of a space and the text in bytes, or None if decoded tokens differ."""
        data = f" {text}".encode()
        tokens = self.a.encode(" " + text, add_special_tokens=False)
        pieces = self.b.encode(text, return_type="proto").pieces
        a, b = tokens.ids, [p.id for p in pieces]
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        ends = np.array([end for _, end in tokens.offsets], np.int64)
        if len(data) != len(text) + 1:
            points = np.frombuffer(f" {text}".encode("utf-32-le"), np.uint32)
            places = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
            ends = places[ends - 1]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        b_ends = np.array([p.end for p in pieces], np.int64) + 1  # its spans leave the first space out
        return a, refined(ends, self.a_sizes[a]), b, refined(b_ends, self.b_sizes[b])


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class WordTable:
    """The ids of the words of a task."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = Ragged(), Ragged()
        self.bad: list[bool] = []
        self.chars = 0

    def _add(self, words: list[str], ids=None, ends=None) -> None:
        for word in words:
            self.index[word] = len(self.index)
            self.chars += len(word) + 8
        self.bad += [ids is None] * len(words)
        for side in (0, 1):
            self.ids[side].extend(*((ids[side], ends[side]) if ids else (np.zeros(0), [0] * len(words))))

    def _block(self, words: list[str]) -> None:
        """Encode words that may be joined by spaces; one by one if that does not give their bytes back."""
        found = self.tokenizers.encode(" ".join(words))
        if found is not None:
            a, a_ends, b, b_ends = found
            at = np.cumsum([len(w.encode()) + 1 for w in words])
            cuts = [np.searchsorted(x, at) for x in (a_ends, b_ends)]
            if all((x[c] == at).all() for x, c in zip((a_ends, b_ends), cuts)):
                return self._add(words, (a, b), [c + 1 for c in cuts])
        if len(words) == 1:
            return self._add(words)
        for word in words:
            self._block([word])

    def learn(self, words) -> None:
        block, size = [], 0
        for word in words:
            if word in self.index:
                continue
            if not _PLAIN.fullmatch(word):
                self._block([word])
                continue
            block.append(word)
            size += len(word)
            if size > BLOCK_CHARS:
                self._block(block)
                block, size = [], 0
        if block:
            self._block(block)

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of both tokenizers of each text; none for texts without tokens."""
        split = [self.tokenizers.words(t) if t else [] for t in texts]
        if self.chars > KNOWN_CHARS:
            self.forget()
        self.learn(dict.fromkeys(chain.from_iterable(split)))
        sizes = np.array(list(map(len, split)), np.int64)
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
        doc = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(doc, np.array(self.bad, float)[numbers], len(texts)) > 0 if len(numbers) else np.zeros(len(texts), bool)
        sides = []
        for side in self.ids:
            ids, lengths = side.rows(numbers)
            ends = np.cumsum(np.bincount(doc, lengths, len(texts)).astype(np.int64))
            sides.append(np.split(ids, ends[:-1]))
        return [(a[:0], b[:0]) if out else (a, b) for a, b, out in zip(*sides, bad)]


def encode_both(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``a_ids`` and ``b_ids`` (unsigned 16-bit little-endian numbers, as bytes) instead of the text."""
    known = _tokenizers(a_path, b_path)
    if max(len(known.a_bytes), len(known.b_bytes)) > 1 << 16:
        raise ValueError("ids of more than 16 bits")

    def run(batches):
        table = WordTable(_tokenizers(a_path, b_path))
        for batch in batches:
            for part in slices(batch, text):
                ids = table.encoded(part.column(part.schema.get_field_index(text)).to_pylist())
                made = [pa.array([x[side].astype("<u2").tobytes() for x in ids], pa.binary()) for side in (0, 1)]
                old = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*old, *made], [*names, "a_ids", "b_ids"])

    names = without(docs, [text, "a_ids", "b_ids"]).columns
    fields = [f for f in docs.schema.fields if f.name in names]
    made = [T.StructField(c, T.BinaryType()) for c in ("a_ids", "b_ids")]
    return without(docs, ["a_ids", "b_ids"]).mapInArrow(run, T.StructType([*fields, *made]))


class Links:
    """Tokens, links and groups of a batch of documents, as arrays over all of them."""

    def __init__(self, tokenizers: Tokenizers, batch: pa.RecordBatch):
        self.rows = batch.num_rows
        ids, sizes = [], []
        for name in ("a_ids", "b_ids"):
            values = batch.column(batch.schema.get_field_index(name)).to_pylist()
            ids.append(np.frombuffer(b"".join(values), "<u2").astype(np.int64))
            sizes.append(np.array([len(v) // 2 for v in values], np.int64))
        self.a, self.b = ids
        self.n_a, self.n_b = sizes
        # Documents follow each other: the tokens of both sides end where a document ends.
        a_ends, b_ends = np.cumsum(tokenizers.a_sizes[self.a]), np.cumsum(tokenizers.b_sizes[self.b])
        marks = np.zeros((2, (a_ends[-1] if len(a_ends) else 0) + 1), np.int8)
        marks[0, a_ends], marks[1, b_ends] = 1, 1
        ends = np.flatnonzero(marks[0] | marks[1])  # between two of them lie one token of A and one of B
        a_cuts, b_cuts = marks[0, ends], marks[1, ends]
        self.a_at, self.b_at = (np.cumsum(cuts, dtype=np.int64) - cuts for cuts in (a_cuts, b_cuts))
        self.common = (a_cuts & b_cuts).astype(bool)
        self.doc = np.repeat(np.arange(self.rows), self.n_a)[self.a_at]
        self.pairs = self.a[self.a_at] * tokenizers.base + self.b[self.b_at]
        self.names = tokenizers.names

    def per_document(self, weights=None) -> np.ndarray:
        if weights is None:
            return np.bincount(self.doc, minlength=self.rows)
        out = np.zeros(self.rows, np.int64)
        np.add.at(out, self.doc, weights)
        return out

    def held(self) -> np.ndarray:
        """The pairs of each document, each once."""
        return np.unique(self.doc * _PAIR + self.pairs) % _PAIR

    def groups(self) -> np.ndarray:
        return np.bincount(self.doc[self.common], minlength=self.rows)

    def spelled(self) -> pa.Array:
        """The groups of each document."""

        def joined(parts: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), parts), by)

        sides = []
        for ids, at in ((self.a, self.a_at), (self.b, self.b_at)):
            sizes = np.diff(at[self.common] + 1, prepend=0)
            sides.append(joined(self.names.take(pa.array(ids)), sizes, ","))
        return joined(pc.binary_join_element_wise(*sides, "|"), self.groups(), ";")


def pair_counts(encoded: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``pair, n, best``: how many documents hold a pair (``A id * size of B + B id``) linked, and whether no other pair
    of its A id has more."""

    def run(batches):
        known = _tokenizers(a_path, b_path)
        waiting: list[tuple] = []
        size = 0

        def added():
            pairs = np.concatenate([p for p, _ in waiting])
            order = np.argsort(pairs, kind="stable")
            pairs, counts = pairs[order], np.concatenate([n for _, n in waiting])[order]
            starts = np.flatnonzero(np.diff(pairs, prepend=-1))
            return pairs[starts], np.add.reduceat(counts, starts)

        def rows(pairs, counts):
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

        for batch in batches:
            for part in slices(batch, "a_ids", 1_000_000):
                held = Links(known, part).held()
                if len(held):
                    waiting.append(np.unique(held, return_counts=True))
                    size += len(waiting[-1][0])
                if size > PENDING_PAIRS:
                    waiting = [added()]
                    size = len(waiting[0][0])
                    if size > PENDING_PAIRS // 2:
                        yield rows(*waiting.pop())
                        size = 0
        if waiting:
            yield rows(*added())

    base = _tokenizers(a_path, b_path).base
    made = encoded.select("a_ids", "b_ids").mapInArrow(run, "pair bigint, n bigint")
    counted = made.groupBy("pair").agg(F.sum("n").alias("n"))
    counted = write_through(counted.withColumn("a", F.expr(f"CAST(pair DIV {base} AS INT)")))
    tops = counted.groupBy("a").agg(F.max("n").alias("top"))
    return counted.join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", broadcast_pairs: int | None = None) -> DataFrame:
    """``docs`` without the text and with ``n_a, n_b, n_groups, n_links`` (tokens, groups and links), ``n_best`` (links
    whose pair has the highest count of its A id), ``count_sum`` (of the counts of all links) and ``groups``
    (``a1,a2|b1;a3|b2,b3``: the ids of each group).

    Columns of the table that are called like a result are replaced.
    """
    spark = docs.sparkSession
    results = T._parse_datatype_string(RESULT)
    encoded = write_through(encode_both(without(docs, results.names), a_path, b_path, text))
    pairs, seen = write_through(pair_counts(encoded, a_path, b_path), F.count(F.lit(1)).alias("n"))
    limit = BROADCAST_PAIRS if broadcast_pairs is None else broadcast_pairs
    small = seen["n"] <= limit
    shared = None
    if small:
        found = pairs.orderBy("pair").toArrow()  # bounded by the limit
        shared = spark.sparkContext.broadcast([found[c].to_numpy() for c in ("pair", "n", "best")])
    kept = [f for f in encoded.schema.fields if f.name not in ("a_ids", "b_ids")]
    names = [f.name for f in kept]
    extra = [] if small else [T.StructField(_free("pairs", names), T.ArrayType(T.LongType()))]
    fields = T.StructType([*kept, *results.fields, *extra])
    types = [to_arrow_type(f.dataType) for f in fields.fields[len(kept) :]]

    def run(batches):
        known = _tokenizers(a_path, b_path)
        for batch in batches:
            for part in slices(batch, "a_ids", 1_000_000):
                links = Links(known, part)
                none = np.zeros(links.rows, np.int64)
                best, total = none, none
                if small and len(links.pairs):
                    table, counts, tops = shared.value
                    places = np.searchsorted(table, links.pairs)
                    best, total = links.per_document(tops[places]), links.per_document(counts[places])
                made = [links.n_a, links.n_b, links.groups(), links.per_document(), best, total, links.spelled()]
                if not small:
                    made.append(np.split(links.pairs, np.cumsum(links.per_document())[:-1]))
                old = [part.column(part.schema.get_field_index(n)) for n in names]
                new = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*old, *new], fields.names)

    made = encoded.mapInArrow(run, fields)
    if small:
        return made
    row, totals = _free("row", names), _free("totals", names)
    rows = write_through(made.withColumn(row, F.monotonically_increasing_id()))
    links = rows.select(F.col(row).alias("row"), F.explode(extra[0].name).alias("pair"))
    times = links.groupBy("row", "pair").agg(F.count("*").alias("times"))
    best, total = F.when(F.col("best"), F.col("times")).otherwise(0), F.col("times") * F.col("n")
    sums = times.join(pairs, "pair").groupBy("row").agg(F.sum(best).alias("best"), F.sum(total).alias("total"))
    joined = rows.join(sums.select(F.col("row").alias(row), F.struct("best", "total").alias(totals)), row, "left")
    filled = {c: F.coalesce(F.col(totals)[s], F.lit(0)) for c, s in (("n_best", "best"), ("count_sum", "total"))}
    return joined.withColumns(filled).select(*[f"`{c}`" for c in [*names, *results.names]])


def _free(name: str, taken: list[str]) -> str:
    """A column name that no column has."""
    used = {n.lower() for n in taken}
    while name in used:
        name += "_"
    return name
