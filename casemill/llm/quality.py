"""Quality rules for documents, with verdicts on whole hosts.

The rules look at one document. Their failures are counted by host; the rate of a host is shrunk with a beta
prior whose mean and strength are estimated from all hosts (by moments), so a host with few documents is judged
like the average. A host whose shrunk rate reaches ``host_rate`` is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casemill.llm.common import SPACES, let, quoted, text_key, text_of, without, words_of
from casemill.session import write_through

SYMBOLS = "#*$%&|<>"
RUN = 5  # words of a window that must not come back
MIN_WORDS, MAX_REPEATED_PERCENT, HOST_RATE = 10, 20, 0.9
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``RUN`` words found twice or more, the first one included."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    keys = let(
        hashed,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - RUN), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(RUN)])
        ),
    )

    def covered(keys: Column) -> Column:
        order = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        twice = lambda s: F.filter(
            s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"])
        )
        starts = F.array_sort(F.transform(let(order, twice), lambda x: x["i"]))
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(RUN)), F.lit(RUN))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    return F.when(F.size(words) < RUN, 0).otherwise(
        let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(covered(k)))
    )


def metrics(text: Column) -> Column:
    """The measures of one text, as a struct of longs."""
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    values = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return values


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and ``base_failed``. A null text is empty; it has no words and so fails."""
    plain = without(docs, [*METRICS, "base_failed"])
    # A generator, unlike a projection, is not computed anew for every use of its columns.
    measured = plain.select(*[quoted(c) for c in plain.columns], F.inline(F.array(metrics(text_of(text)))))
    few = F.col("n_words") < MIN_WORDS
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    return measured.withColumn("base_failed", few | repeated)


def rejected_hosts(measured: DataFrame, host: str, host_rate: float = HOST_RATE) -> DataFrame:
    """``host`` of the hosts to reject; a null host is a host of its own."""
    hosts = measured.groupBy(quoted(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    hosts = write_through(hosts)
    rate = F.col("failed") / F.col("n")
    n, failed, squares, count = hosts.agg(
        F.sum("n"), F.sum("failed"), F.sum(F.col("n") * rate * rate), F.count(F.lit(1))
    ).first()
    if not n:
        return hosts.select("host").limit(0)
    mean = failed / n
    within = mean * (1 - mean)
    # The variance between hosts is what the variance of the rates has beyond chance.
    between = max(squares / n - mean * mean - within * count / n, 0.0)
    strength = min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.filter(shrunk >= host_rate).select("host")


def judge(measured: DataFrame, host: str, host_rate: float = HOST_RATE) -> DataFrame:
    """``measured`` (written, since it is read twice) with ``kept``."""
    bad = rejected_hosts(measured, host, host_rate).withColumn("bad", F.lit(True))
    plain = without(measured, ["kept"])
    joined = plain.join(bad, quoted(host).eqNullSafe(F.col("host")), "left")
    return joined.select(
        *[quoted(c) for c in plain.columns], (~F.col("base_failed") & F.col("bad").isNull()).alias("kept")
    )


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: its id, measures, ``base_failed`` and ``kept``; the text is not carried along.

    Null ids and hosts are allowed, repeated rows give a row each, an empty table gives no row.
    """
    chosen = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), quoted(host).alias("host_name"))
    measured = write_through(measure(chosen).drop("text"))
    return judge(measured, "host_name").drop("host_name")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the rules and the verdict on their host keep, with all their columns."""
    row = F.struct(quoted(doc_id), quoted(host), text_key(text_of(text)))
    chosen = docs.select(row.alias("_row"), quoted(text).alias("text"), quoted(host).alias("host_name"))
    verdicts = judge(write_through(measure(chosen).drop("text")), "host_name")
    gone = verdicts.filter(~F.col("kept")).select("_row").distinct()
    return docs.join(gone, row == gone["_row"], "left_anti")
