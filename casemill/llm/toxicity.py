"""Toxicity by a weighted grammar of clauses.

Small transducers read the words of a clause: the lexical one turns a word into a symbol with a weight (insult, threat,
target, negation, reported speech), and those for target, negation and report keep their own state. Composed, they give
each insult or threat a reading: aimed at someone, plain, negated or reported. A reading counts by how often it was
found in toxic training documents, and the evidence of all clauses is turned into a probability.

Insults are words or beginnings of words, learned from labelled documents; the other lists are fixed. A threat needs a
target.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from casemill.llm.common import add_columns, make_rows, quoted, text_key, text_of
from casemill.session import write_through

#: Training rows of either label that are used at most, those with the smallest hash of their id.
TOXIC_ROWS, CLEAN_ROWS = 8_000, 16_000
SHORTEST, LONGEST, TERMS = 3, 12, 5_000
MIN_G2, MIN_ODDS, MAX_CLEAN_RATE = 30.0, 1.8, 0.025
#: A term is in this share of the toxic rows or more: words that one group of copies has are not.
MIN_SHARE = 0.03
THRESHOLD = 0.7

# Word lists of four languages.
THREATS = "kill hurt stab shoot strangle destroy töten umbringen erschießen verprügeln tuer égorger frapper matar golpear apuñalar".split()
TARGETS = "you your yours u he she they them these those him her du dich dir dein deine ihr euch sie er tu te toi vous votre ton ta vos tú ti usted ustedes tu vosotros él ella ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais non nunca jamás ni".split()
REPORTS = "said says say wrote writes told called calls claimed quoted sagte sagt schrieb nannte dit écrit écrivit appelle dijo dice escribió llamó".split()

READINGS = ("aimed", "plain", "negated", "reported")
#: What a reading counts before any training row is seen, and how many rows that is worth.
PRIOR, PRIOR_ROWS = {"aimed": 1.0, "plain": 0.9, "negated": 0.3, "reported": 0.4}, 5
NEGATION_REACH = 3
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;\n]")


class Negation:
    """Counts down the words that a negation still reaches."""

    start = 0

    def step(self, state: int, symbol: str) -> int:
        return NEGATION_REACH if symbol == "negation" else max(state - 1, 0) if symbol == "other" else state


class Seen:
    """Remembers that a symbol came up in the clause."""

    start = False

    def __init__(self, symbol: str):
        self.symbol = symbol

    def step(self, state: bool, symbol: str) -> bool:
        return state or symbol == self.symbol


@dataclass
class Grammar:
    """``terms`` are insults with their weights; a term that ends in ``$`` is a whole word, any other a beginning."""

    terms: dict[str, float]

    def __post_init__(self):
        self.machines = (Seen("target"), Negation(), Seen("report"))
        self.symbols = {w: s for s, ws in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
        self.hints = ahocorasick.Automaton()
        for hint in {t.rstrip("$") for t in self.terms} | set(THREATS):
            self.hints.add_word(hint, len(hint))
        self.hints.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        """The lexical transducer."""
        best = self.terms.get(word + "$", 0.0)
        for n in range(SHORTEST, len(word) + 1):
            best = max(best, self.terms.get(word[:n], 0.0))
        return ("insult", best) if best else (self.symbols.get(word, "other"), 1.0)

    def read(self, clause: str) -> list[tuple[str, float]]:
        """``(reading, weight)`` of the insults and threats of a clause."""
        states = tuple(m.start for m in self.machines)
        found = []
        for word in _WORD.findall(clause):
            symbol, weight = self.symbol(word)
            states = tuple(m.step(s, symbol) for m, s in zip(self.machines, states, strict=True))
            if symbol in ("insult", "threat"):
                found.append((symbol, weight, states[1] > 0, states[2]))
        targeted = states[0]  # a target may also follow
        return [
            ("reported" if reported else "negated" if negated else "aimed" if targeted else "plain", weight)
            for symbol, weight, negated, reported in found
            if symbol == "insult" or targeted
        ]

    def evidence(self, text: str) -> list[float]:
        """The summed weights of each reading over the clauses of a text."""
        low, sums, done = text.lower(), dict.fromkeys(READINGS, 0.0), -1
        for last, length in self.hints.iter(low):
            first = last - length + 1
            if first < done or (first and low[first - 1].isalpha()):
                continue
            begin = max(low.rfind(c, max(done, 0), first) for c in ".!?;\n") + 1
            ended = _CLAUSE_END.search(low, last)
            begin, done = max(begin, done, 0), ended.start() if ended else len(low)
            for reading, weight in self.read(low[begin:done]):
                sums[reading] += weight
        return list(sums.values())


def in_training(doc_id: Column, parts: int = 3, rest: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts != rest


def training_sample(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``doc_id, toxic`` of the training rows to learn from: all up to the documented bounds, then those first by hash."""
    rows = labels.select(quoted(doc_id).alias("doc_id"), quoted(label).cast("int").alias("toxic")).filter(
        in_training(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)
    )
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = lambda value, n: rows.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return some(1, TOXIC_ROWS).unionByName(some(0, CLEAN_ROWS))


def _beginnings(text: str) -> set[str]:
    out = set()
    for word in set(_WORD.findall(text.lower())):
        if len(word) >= SHORTEST:
            out.update(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
            out.add(word[:64] + "$")
    return out


def learn_terms(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Words and beginnings that mark toxic documents (``sample``: ``text, toxic``), with weights up to 2.

    The log-likelihood ratio must be high, and clean documents with the term rare.
    """

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(_beginnings(text.as_py()))
            for toxic, counts in enumerate(seen):
                yield [list(counts), [n * toxic for n in counts.values()], [n * (1 - toxic) for n in counts.values()]]

        return work

    counted = make_rows(sample.select("text", "toxic"), "term string, hits bigint, clean bigint", make).groupBy("term").agg(
        F.sum("hits").alias("hits"), F.sum("clean").alias("clean")
    )
    total = n_toxic + n_clean
    h, c = F.col("hits").cast("double"), F.col("clean").cast("double")
    term = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    g2 = 2 * (
        term(h, (h + c) * n_toxic / total)
        + term(c, (h + c) * n_clean / total)
        + term(n_toxic - h, (total - h - c) * n_toxic / total)
        + term(n_clean - c, (total - h - c) * n_clean / total)
    )
    odds = F.log((h + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    good = counted.select("term", "hits", g2.alias("g2"), odds.alias("odds")).filter(
        (F.col("hits") >= max(3.0, MIN_SHARE * n_toxic)) & (F.col("g2") >= MIN_G2) & (c / max(n_clean, 1) <= MAX_CLEAN_RATE)
    )
    # With few clean rows no term can have the full odds.
    enough = min(MIN_ODDS, 0.75 * math.log(2 * (n_clean + 1)))
    rows = good.filter(F.col("odds") >= enough).orderBy(F.desc("g2"), "term").limit(TERMS).collect()
    return choose_terms({r["term"]: (r["hits"], r["odds"]) for r in rows})


def choose_terms(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of beginnings that say the same, the longest; none that begins with a chosen one."""
    chosen: dict[str, float] = {}
    longer: dict[str, list[str]] = {}
    for t in found:
        longer.setdefault(t[:-1], []).append(t)
    for t in sorted(found, key=lambda t: (len(t.rstrip("$")), t)):
        if any(t[:n] in chosen for n in range(SHORTEST, len(t))):
            continue
        while following := [x for x in longer.get(t, ()) if found[x][0] >= 0.85 * found[t][0]]:
            t = max(following, key=lambda x: (found[x][0], x))
        chosen[t] = min(found[t][1] / 4, 2.0)
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and intercept by Newton's method; labels count alike."""
    if not len(y) or y.min() == y.max():
        return 2.0, -3.0
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    design, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (weight * (p - y)) + ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class Model:
    grammar: Grammar
    counts_as: list[float]  # of each reading
    slope: float
    intercept: float

    def score(self, text: str) -> float:
        total = math.log1p(sum(w * e for w, e in zip(self.counts_as, self.grammar.evidence(text), strict=True)))
        return 1 / (1 + math.exp(-min(max(self.slope * total + self.intercept, -500), 500)))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled training documents. Only bounded samples of labels and their evidence are gathered."""
    sample = training_sample(labels, doc_id, label)
    plain = docs.select(quoted(doc_id).alias("doc_id"), text_of(text).alias("text"))
    # At most TOXIC_ROWS + CLEAN_ROWS ids, and as many rows: an id can have several texts, and repeated rows are one.
    keyed = plain.join(F.broadcast(sample), "doc_id").withColumn("key", text_key(F.col("text")))
    rows = keyed.select("doc_id", "key", "toxic").distinct()
    some = lambda value, n: rows.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(n)
    chosen = write_through(some(1, TOXIC_ROWS).unionByName(some(0, CLEAN_ROWS)))
    own = keyed.join(F.broadcast(chosen.select("doc_id", "key")), ["doc_id", "key"])
    joined = write_through(own.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    terms = learn_terms(joined, sizes.get(1, 0), sizes.get(0, 0)) if sizes.get(1) and sizes.get(0) else {}

    def make():
        grammar = Grammar(terms)

        def work(batch: pa.RecordBatch) -> list:
            return [[grammar.evidence(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]]

        return work

    rows = add_columns(joined, "evidence array<double>", make, ("text",)).toPandas()
    found = np.array(rows["evidence"].tolist(), float).reshape(len(rows), len(READINGS))
    toxic = rows["toxic"].to_numpy(float)
    counts_as = []
    for i, reading in enumerate(READINGS):
        has = found[:, i] > 0
        counts_as.append(float((toxic[has].sum() + PRIOR_ROWS * PRIOR[reading]) / (has.sum() + PRIOR_ROWS)))
    slope, intercept = fit_logistic(np.log1p(found @ np.array(counts_as)), toxic)
    return Model(Grammar(terms), counts_as, slope, intercept)


def score(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; labels and other columns are no input of a score.

    Null and empty texts have no evidence and get the lowest score. Null ids are allowed, repeated rows give a row
    each. Without training rows of both labels there is no lexicon, and only threats count.
    """
    model = learn(docs, labels, doc_id, text, label)
    settings = (model.grammar.terms, model.counts_as, model.slope, model.intercept)
    plain = docs.select(quoted(doc_id).alias("doc_id"), text_of(text).alias("text"))

    def make():
        terms, *rest = settings
        ready = Model(Grammar(terms), *rest)

        def work(batch: pa.RecordBatch) -> list:
            return [[ready.score(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]]

        return work

    scored = add_columns(plain, "score double", make, ("text",))
    return scored.select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
