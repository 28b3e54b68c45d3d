"""Language-model scores from subword lattices.

A word is read as any sequence of pieces of an existing subword vocabulary that spells it, each character also as its
bytes; its probability is the sum over all readings, by a forward recursion in logarithms over the places of the word. The
probability of a text is the product over its words and one end. As pieces only begin, never go on, behind a space, this
is the sum over all segmentations of the whole text.

The scores of a merge vocabulary are ranks, no probabilities. So the weights of its pieces are fitted to the training
texts: they start at the uses of the pieces in the vocabulary's own segmentation of the training words, and each pass of
expectation maximisation (forward and backward recursion over all distinct training words, with their counts) replaces
them by the expected uses. The lattices of many words are walked together, one place after the other.

Counts are taken of all training texts. Only the most common words, up to ``frequent``, the pieces (both bounded by a
parameter) and totals reach the driver; all other words are joined with their counts, which changes no score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from casemill.llm.common import make_rows, quoted, release, text_key, text_of
from casemill.session import discard, write_through

#: Words that are broadcast with their counts, and passes of the fit.
FREQUENT, PASSES = 200_000, 3
_MARK = "▁"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FLUSH = 200_000


def held_out(doc_id: Column, parts: int = 7, rest: int = 2) -> Column:
    """True if crc32 of the id as text leaves this rest; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == rest


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


class Pieces:
    """An existing vocabulary as the arcs of a lattice. Every character also has the arc of its bytes."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.processor
        self.size = p.get_piece_size()
        usable = [i for i in range(self.size) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {t: i for i in usable if _MARK not in (t := p.id_to_piece(i))[1:]}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # A tree of the pieces: sorted keys of node and character, the node each leads to, and the piece that ends there.
        nodes, edges, ends = 1, {}, {}
        for piece, number in self.ids.items():
            node = 0
            for letter in piece:
                key = node << 21 | ord(letter)
                if key not in edges:
                    edges[key], nodes = nodes, nodes + 1
                node = edges[key]
            ends[node] = number
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.full(nodes, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def count(self, words: list[str], times: Iterable[int] | None = None) -> Counter:
        """Uses of each piece id in the vocabulary's own segmentation of the words."""
        used = Counter()
        for ids, n in zip(self.processor.encode(words), times if times is not None else repeat(1)):
            for i in ids:
                used[i] += n
        return used


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


class Arcs:
    """The lattices of some words: their places one behind the other, and arcs ordered by where they begin in their word.

    A place is a character or the end of a word. The arcs of one step begin at the same distance from the start of their
    words and have the same length, so that all of a step begin and end at different places.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        letters = np.frombuffer("".join(f"{_MARK}{w}\0" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        self.ends = np.cumsum(sizes) - 1
        self.starts = self.ends - sizes + 1
        self.word = np.repeat(np.arange(len(words)), sizes)
        inside = np.ones(len(letters), bool)
        inside[self.ends] = False
        at = np.flatnonzero(inside)
        self.letters, spelled = np.unique(letters[at], return_inverse=True)
        begins, lengths, labels = [at], [np.zeros(len(at), np.int64)], [pieces.size + spelled]  # length 0: by its bytes
        node, length = np.zeros(len(at), np.int64), 1
        while len(at):
            key = node << 21 | letters[at + length - 1]
            found = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            hit = pieces.keys[found] == key
            at, node = at[hit], pieces.child[found[hit]]
            piece = pieces.piece[node]
            whole = piece >= 0
            begins.append(at[whole])
            lengths.append(np.full(int(whole.sum()), length))
            labels.append(piece[whole])
            length += 1
        begin, size, label = np.concatenate(begins), np.concatenate(lengths), np.concatenate(labels)
        step = (begin - self.starts[self.word[begin]]) * length + size
        if step.max(initial=0) < 1 << 16:
            step = step.astype(np.uint16)  # sorted by counting
        order = np.argsort(step, kind="stable")
        self.begin, self.label, step = begin[order], label[order], step[order]
        self.end = self.begin + np.maximum(size[order], 1)
        cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(step)]
        self.steps = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]

    def weights(self, pieces: Pieces, log: np.ndarray) -> np.ndarray:
        """The weight of each arc, for weights of the piece ids."""
        spelled = [sum(log[pieces.bytes[b]] for b in chr(x).encode()) for x in self.letters.tolist()]
        return np.concatenate([log, spelled])[self.label]

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all ways from the start of its word to each place."""
        sums = np.full(len(self.word), -np.inf)
        sums[self.starts] = 0.0
        for s in self.steps:
            into = self.end[s]
            sums[into] = np.logaddexp(sums[into], sums[self.begin[s]] + weights[s])
        return sums

    def backward(self, weights: np.ndarray) -> np.ndarray:
        """The same for the ways from each place to the end of its word."""
        sums = np.full(len(self.word), -np.inf)
        sums[self.ends] = 0.0
        for s in reversed(self.steps):
            out = self.begin[s]
            sums[out] = np.logaddexp(sums[out], sums[self.end[s]] + weights[s])
        return sums

    def expected(self, pieces: Pieces, weights: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of the piece ids in words that occur so many times, and the logarithm of their likelihood."""
        ways = self.forward(weights)
        whole = ways[self.ends]
        word = self.word[self.begin]
        share = np.exp(ways[self.begin] + weights + self.backward(weights)[self.end] - whole[word]) * times[word]
        used = np.bincount(self.label, share, pieces.size + len(self.letters))
        for x, n in zip(self.letters.tolist(), used[pieces.size :].tolist()):
            for b in chr(x).encode():
                used[pieces.bytes[b]] += n
        return used[: pieces.size], float(whole @ times)


class Lattice:
    """Log probabilities of words, for the uses of the pieces and the number of ends of a text."""

    def __init__(self, pieces: Pieces, uses: dict[int, float], ends: int, smoothing: float = 0.01):
        counts = np.zeros(pieces.size)
        counts[list(uses)] = list(uses.values())
        total = math.log(counts.sum() + ends + 1 + smoothing * pieces.size)
        self.log, self.pieces = np.log(counts + smoothing) - total, pieces
        self.end = math.log(ends + 1) - total

    @property
    def arcs(self) -> dict[str, float]:
        return {t: float(self.log[i]) for t, i in self.pieces.ids.items()}

    @property
    def bytes(self) -> list[float]:
        return self.log[self.pieces.bytes].tolist()

    def words(self, words: list[str]) -> np.ndarray:
        """The natural logarithm of the sum over all segmentations of each word."""
        if not words:
            return np.zeros(0)
        arcs = Arcs(self.pieces, words)
        return arcs.forward(arcs.weights(self.pieces, self.log))[arcs.ends]

    def expected(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, float]:
        arcs = Arcs(self.pieces, words)
        return arcs.expected(self.pieces, arcs.weights(self.pieces, self.log), times)

    def log_probability(self, word: str) -> float:
        """Of the text that consists of this word."""
        return float(self.words([word])[0]) + self.end


def _counts(docs: DataFrame) -> DataFrame:
    """``word, n_train``, added up within a batch only; words of held-out texts have rows, too."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            seen: dict[bool, Counter] = {False: Counter(), True: Counter()}
            texts, held = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "held_out"))
            for text, out in zip(texts, held.to_pylist(), strict=True):
                seen[out].update(tokens(text.as_py()))
            for out, words in seen.items():
                names, numbers = list(words), list(words.values())
                for at in range(0, len(names), _FLUSH):
                    some = numbers[at : at + _FLUSH]
                    yield [[w.decode() for w in names[at : at + _FLUSH]], [0] * len(some) if out else some]

        return work

    return make_rows(docs.select("text", "held_out"), "word string, n_train bigint", make)


def _gathered(words: DataFrame, make) -> dict[int, float]:
    """Sums by piece of ``make()(words, times) -> vector`` over all words; a task gives a row per piece it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, total = make(), 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + work(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
        if isinstance(total, np.ndarray):
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["piece", "n"])

    rows = words.select("word", "n_train").mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r["piece"]: r["n"] for r in rows.collect()}  # a row per piece of the vocabulary at most, and the likelihood


def fit(words: DataFrame, path: str, ends: int, passes: int = PASSES) -> tuple[dict[int, float], list[float]]:
    """Uses of the pieces in all words (``word, n_train``), and the log-likelihood of the words before each pass."""
    spark, steps = words.sparkSession, []

    def start():
        pieces = load_pieces(path)

        def work(names: list[str], times: np.ndarray) -> np.ndarray:
            used = np.zeros(pieces.size + 1)
            for i, n in pieces.count(names, times.tolist()).items():
                used[i] = n
            return used

        return work

    uses = _gathered(words, start)
    for _ in range(passes):
        known = spark.sparkContext.broadcast(uses)

        def step(known=known):
            pieces = load_pieces(path)
            lattice = Lattice(pieces, known.value, ends)

            def work(names: list[str], times: np.ndarray) -> np.ndarray:
                return np.append(*lattice.expected(names, times))

            return work

        uses = _gathered(words, step)
        known.unpersist()
        steps.append(uses.pop(load_pieces(path).size, 0.0))
    return uses, steps


def _with_lattice(words: DataFrame, path: str, uses: dict[int, float], ends: int) -> DataFrame:
    """``words`` with ``spelled`` (the lattice's log probability); the word is the first column."""
    known = words.sparkSession.sparkContext.broadcast(uses)

    def make():
        lattice = Lattice(load_pieces(path), known.value, ends)

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            yield [*batch.columns, lattice.words(batch.column(0).to_pylist())]

        return work

    return make_rows(words, "word string, n_train bigint, spelled double", make)


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The repeated training words above a count that at most ``most`` words reach; counts are told apart to an eighth power of two."""
    counted = words.filter("n_train > 1").withColumn("level", F.floor(F.log2("n_train") * 8))
    chosen, lowest = 0, None
    for level, n in sorted(map(tuple, counted.groupBy("level").count().collect()), reverse=True):
        chosen += n
        if chosen > most:
            break
        lowest = level
    return counted.filter(F.lit(False) if lowest is None else F.col("level") >= lowest)


def score(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, passes: int = PASSES) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``path`` is a vocabulary file. Null texts are empty and consist of their end; null ids are allowed; repeated rows give
    a row each. Without any training text all pieces weigh the same and every base score is 0.
    """
    spark = docs.sparkSession
    plain = docs.select(
        quoted(doc_id).alias("doc_id"), text_of(text).alias("text"), text_key(text_of(text)).alias("key")
    ).withColumn("held_out", held_out(F.col("doc_id")))
    texts = plain.filter(~F.col("held_out")).count()
    words, seen = write_through(
        _counts(plain).groupBy("word").agg(F.sum("n_train").alias("n_train")),
        F.sum("n_train").alias("tokens"),
        F.sum((F.col("n_train") > 0).cast("long")).alias("types"),
    )
    release(spark)
    total, distinct = (seen["tokens"] or 0) + texts, (seen["types"] or 0) + (texts > 0)
    uses, _ = fit(words.filter("n_train > 0"), path, texts, passes)
    spelled = write_through(_with_lattice(words, path, uses, texts))
    discard(words)

    # At most ``frequent`` rows are broadcast and gathered.
    listed = _frequent(spelled, frequent).select("word", "n_train", "spelled").toArrow()
    model = {
        "where": {w.encode(): i for i, w in enumerate(listed["word"].to_pylist())},
        "log": np.append(listed["spelled"].to_numpy(), Lattice(load_pieces(path), uses, texts).end),  # the last one is the end
        "counts": np.append(listed["n_train"].to_numpy(), texts),
        "total": total,
        "distinct": distinct,
    }
    rows = _scored(plain, spark.sparkContext.broadcast(model))

    count = F.coalesce("n_train", F.lit(0))
    times, header = F.col("times"), F.col("headers") > 0
    added = rows.join(spelled, "word", "left").select(
        "doc_id", "key", "held_out", "headers", "n_tokens",
        F.when(header, F.col("base")).otherwise(times * F.log10((count + 1) / F.lit(float(total + distinct + 1)))).alias("base"),
        F.when(header, F.col("log")).otherwise(times * F.col("spelled")).alias("log"),
        (F.col("n_known") + F.when(count > 0, times).otherwise(0)).alias("n_known"),
    )
    sums = ("headers", "n_tokens", "base", "log", "n_known")
    summed = added.groupBy("doc_id", "key").agg(*[F.sum(c).alias(c) for c in sums], F.first("held_out").alias("held_out"))
    # Rows that agree in id and text have been added up; each gets its share.
    each = summed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("headers").cast("int"))))
    part = lambda c: (F.col(c) / F.col("headers")).cast("long")
    return each.select(
        "doc_id", "held_out", part("n_tokens").alias("n_tokens"), part("n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("headers")).alias("base_score"),
        (F.col("log") / F.col("headers") / math.log(10)).alias("score"),
    )


def _scored(plain: DataFrame, shared) -> DataFrame:
    """A header row per document with the sums of its broadcast words, and a row for each of its other words."""

    def make():
        model = shared.value
        where, logs, counts = model["where"], model["log"], model["counts"]
        base = np.log10((counts + 1) / (model["total"] + model["distinct"] + 1))
        end = len(counts) - 1

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "key", "held_out")]
            rows: list[list] = [[] for _ in range(10)]
            for doc, key, out, text in zip(*(c.to_pylist() for c in columns), batch.column(batch.schema.get_field_index("text")), strict=True):
                words = tokens(text.as_py())
                at, times, others, rest = [end], [1], [], []
                for word, n in Counter(words).items():
                    found = where.get(word)
                    if found is None:
                        others.append(word)
                        rest.append(n)
                    else:
                        at.append(found)
                        times.append(n)
                each = np.array(times, float)
                known = sum(n for i, n in zip(at, times, strict=True) if counts[i] > 0)
                # No word has a space, so the header joins with nothing; its own text spreads headers over the tasks.
                for column, values in zip(rows, (
                    [doc] * (len(others) + 1), [key] * (len(others) + 1), [out] * (len(others) + 1),
                    [f" {doc} {key}", *(w.decode() for w in others)], [0, *rest], [1, *[0] * len(others)],
                    [len(words) + 1, *[0] * len(others)], [float(each @ base[at]), *[0.0] * len(others)],
                    [float(each @ logs[at]), *[0.0] * len(others)], [known, *[0] * len(others)],
                ), strict=True):
                    column += values
                if len(rows[0]) >= _FLUSH:
                    yield rows
                    rows = [[] for _ in range(10)]
            if rows[0]:
                yield rows

        return work

    kind = plain.schema["doc_id"].dataType.simpleString()
    return make_rows(
        plain.select("doc_id", "key", "held_out", "text"),
        f"doc_id {kind}, key bigint, held_out boolean, word string, times bigint, headers bigint, n_tokens bigint, base double, log double, n_known bigint",
        make,
    )
