"""Removal of repeated passages, found by difference-cover anchors.

A difference cover D modulo p holds, for any two places, a shift k < p that brings both to places whose remainders are
in D. So two equal windows of ``window`` words share an anchor, ``window - p + 1`` words long, that begins at a cover
place in either document. Only these anchors are hashed for the whole corpus. Around anchors that different contents
share, the match is extended: every window that holds one is hashed whole (128 bits) and looked up.

Exact copies meet by a hash of all their words and take part in the search once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from casemill.llm.common import add_columns, make_rows, quoted, release, text_of
from casemill.session import write_through

WINDOW, PERIOD = 50, 31
_FLUSH = 1 << 16
_SIGN = 1 << 63


@lru_cache(maxsize=8)
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of remainders whose differences are all remainders of ``period``."""
    for size in range(1, period + 1):
        if size * (size - 1) + 1 < period:
            continue
        for rest in combinations(range(2, period), max(size - 2, 0)):
            cover = ((0, 1) + rest)[:size]
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise AssertionError("the set of all remainders is a cover")


def _signed(number: int) -> int:
    return (number ^ _SIGN) - _SIGN


class _Words:
    """The words of a text and the places of their runs in the joined bytes."""

    def __init__(self, words: list[bytes]):
        self.words, self.joined = words, b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def runs(self, places: np.ndarray, length: int) -> Iterator[bytes]:
        joined = self.joined
        for a, b in zip(self.starts[places].tolist(), self.ends[places + length - 1].tolist(), strict=True):
            yield joined[a:b]

    def content(self) -> tuple[int, int]:
        digest = xxhash.xxh3_128_intdigest(self.joined)
        return _signed(digest >> 64), _signed(digest & (2 * _SIGN - 1))


def cover_places(n_words: int, window: int, period: int) -> np.ndarray:
    places = np.arange(max(n_words - (window - period), 0) if n_words >= window else 0)
    return places[np.isin(places % period, difference_cover(period))]


def anchors(words: _Words, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover places and the hashes of the anchors that begin there."""
    places = cover_places(len(words.words), window, period)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words.runs(places, window - period + 1)), np.uint64, len(places))
    return places, hashes.view(np.int64)


def _contents(docs: DataFrame, window: int, period: int) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> list:
            out = []
            for text in batch.column(batch.schema.get_field_index("text")):
                words = _Words((text.as_py() or "").encode().split())
                out.append((*words.content(), len(words.words), sha256(words.joined).hexdigest(), anchors(words, window, period)[1]))
            return [list(x) for x in zip(*out, strict=True)]

        return work

    return add_columns(docs, "c1 bigint, c2 bigint, n_words bigint, whole string, anchors array<bigint>", make, ("text",))


def _packed(docs: DataFrame) -> DataFrame:
    """The text compressed, for a shuffle."""

    def make():
        press = zstandard.ZstdCompressor(level=1).compress

        def work(batch: pa.RecordBatch) -> list:
            out = []
            for text in batch.column(batch.schema.get_field_index("text")):
                words = (text.as_py() or "").encode().split()
                out.append((_Words(words).content()[0], press(b" ".join(words))))
            return [list(x) for x in zip(*out, strict=True)]

        return work

    return add_columns(docs, "c1 bigint, packed binary", make, ("text",))


def _unpacked(data: bytes) -> _Words:
    return _Words(zstandard.ZstdDecompressor().decompress(data).split())


def _windows(found: DataFrame, window: int, period: int) -> DataFrame:
    """``w1, w2, doc_id, c1, place`` of every window that holds a shared anchor."""

    def make():
        column = lambda batch, name: batch.column(batch.schema.get_field_index(name))

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            rows: list[list] = [[], [], [], [], []]
            for doc, c1, packed, shared in zip(*(column(batch, n) for n in ("doc_id", "c1", "packed", "shared")), strict=True):
                words = _unpacked(packed.as_py())
                places, hashes = anchors(words, window, period)
                places = places[np.isin(hashes, np.array(shared.as_py(), np.int64))]
                n = len(words.words) - window + 1
                mark = np.zeros(n + 1, np.int64)
                np.add.at(mark, np.maximum(places - (period - 1), 0), 1)
                np.add.at(mark, np.minimum(places + 1, n), -1)
                chosen = np.flatnonzero(np.cumsum(mark[:n]) > 0)
                for at in range(0, len(chosen), _FLUSH):
                    part = chosen[at : at + _FLUSH]
                    for run in words.runs(part, window):
                        digest = xxhash.xxh3_128_intdigest(run)
                        rows[0].append(_signed(digest >> 64))
                        rows[1].append(_signed(digest & (2 * _SIGN - 1)))
                    rows[2] += [doc.as_py()] * len(part)
                    rows[3] += [c1.as_py()] * len(part)
                    rows[4] += part.tolist()
                    if len(rows[0]) >= _FLUSH:
                        yield rows
                        rows = [[], [], [], [], []]
            if rows[0]:
                yield rows

        return work

    kind = found.schema["doc_id"].dataType.simpleString()
    return make_rows(found.select("doc_id", "c1", "packed", "shared"), f"w1 bigint, w2 bigint, doc_id {kind}, c1 bigint, place int", make)


def _cut(found: DataFrame, window: int) -> DataFrame:
    """``n_removed, kept`` of documents with the ``places`` of repeated windows."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            out = []
            packed, places = (batch.column(batch.schema.get_field_index(n)) for n in ("packed", "places"))
            for data, starts in zip(packed, places, strict=True):
                words = _unpacked(data.as_py()).words
                mark = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(np.array(starts.as_py(), np.int64))
                mark[starts] += 1
                mark[starts + window] -= 1
                covered = np.cumsum(mark[:-1]) > 0
                out.append((int(covered.sum()), b" ".join(w for w, gone in zip(words, covered.tolist(), strict=True) if not gone).decode()))
            return [list(x) for x in zip(*out, strict=True)]

        return work

    return add_columns(found, "n_removed bigint, kept string", make, ("packed", "places"))


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD
) -> tuple[DataFrame, DataFrame]:
    """``(documents, cut)``.

    ``documents`` has a row per document: ``doc_id, c1, n_words, whole`` (SHA-256 of all words joined by spaces), ``first``
    (the smallest id with the same words). A document of ``window`` words or more whose ``first`` is smaller is
    removed whole. ``cut`` has ``doc_id, c1, n_removed, kept`` for those of the others that lose words: every word
    in a window that also starts in a document with a smaller id.

    Null texts have no words. A document without an id keeps its words and takes none from others. Rows with the same
    id do not take words from one another.
    """
    spark = docs.sparkSession
    plain = docs.select(quoted(doc_id).alias("doc_id"), text_of(text).alias("text"))
    contents = write_through(_contents(plain, window, period))
    first = contents.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"))
    documents = contents.drop("anchors").join(first, ["c1", "c2"])

    placed = contents.filter(F.col("doc_id").isNotNull()).select("c1", F.explode("anchors").alias("anchor"))
    shared = placed.groupBy("anchor").agg(F.min("c1").alias("low"), F.max("c1").alias("high")).filter("low < high")
    hits = placed.join(shared.select("anchor"), "anchor").groupBy("c1").agg(F.collect_set("anchor").alias("shared"))
    owners = documents.filter(F.col("doc_id") == F.col("first")).select("doc_id", "c1").distinct()
    wanted = write_through(owners.join(hits, "c1"))
    release(spark)
    found = write_through(_packed(plain).join(wanted, ["doc_id", "c1"]).dropDuplicates(["doc_id", "c1"]))
    release(spark)

    windows = _windows(found, window, period)
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    repeated = earliest.filter("earliest < latest").select("w1", "w2", "earliest")
    places = windows.join(repeated, ["w1", "w2"]).filter("earliest < doc_id").groupBy("doc_id", "c1").agg(F.collect_list("place").alias("places"))
    cut = _cut(found.select("doc_id", "c1", "packed").join(places, ["doc_id", "c1"]), window)
    return documents, cut


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    documents, cut = remove_repeats(docs, doc_id, text, window, period)
    cut = cut.select(F.col("doc_id").alias("d"), F.col("c1").alias("c"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    joined = documents.join(cut, (F.col("doc_id") == F.col("d")) & (F.col("c1") == F.col("c")), "left")
    copy = (F.col("n_words") >= window) & (F.col("first") < F.col("doc_id"))
    return joined.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
