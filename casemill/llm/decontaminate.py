"""Benchmark decontamination by a prefix-filtered set join.

The words of a benchmark item are cut into windows of ``size`` words (a shorter item is one window). A document
contains a window only if it contains every shingle of it, so one shingle is a sufficient prefix: the one found in
the fewest places of the corpus. Only the places of these shingles are joined; the offset in the window gives
the place where the window would start, which must lie in the document with its whole length, and there the words
are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casemill.llm.common import LOWER, UPPER, let, quoted, text_key, text_of
from casemill.session import write_through

SIZE, SHINGLE = 13, 3
#: Rows of the benchmark side that are broadcast at most; beyond them the join shuffles.
BROADCAST_ROWS = 200_000
#: ASCII characters that no word has, but for the capitals, which are lower-cased.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def item_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after A-Z are lower-cased."""
    plain = F.translate(text, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _shingles(words: Column, k: int) -> Column:
    def of(w: Column) -> Column:
        hashed = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
        return F.when(F.size(w) < k, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - k), hashed)
        )

    return let(words, of)


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``window`` (words joined by spaces), ``length``, ``items``: each distinct window once."""
    words = benchmark.select(quoted(item_id).alias("item"), item_words(text_of(text)).alias("words")).filter(F.size("words") > 0)
    cut = words.select(
        "item",
        F.explode(
            let(
                F.col("words"),
                lambda w: F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.slice(w, i + 1, size)
                ),
            )
        ).alias("words"),
    )
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        F.array_join("words", " ").alias("window"), F.size("words").alias("length"), "items", "words"
    )


def _places(docs: DataFrame, k: int) -> DataFrame:
    return docs.select("doc_id", "key", "words", F.posexplode(_shingles(F.col("words"), k)).alias("at", "shingle"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, key, start, length, items``: the occurrences of windows in ``docs`` (``doc_id, key, words``)."""
    parts = [
        windows.filter((F.col("length") >= SHINGLE) if k == SHINGLE else (F.col("length") == k)).select(
            "window", "length", "items", F.lit(k).alias("k"),
            F.posexplode(_shingles(F.col("words"), k)).alias("offset", "shingle"),
        )
        for k in range(1, SHINGLE + 1)
    ]
    shingles = parts[0]
    for part in parts[1:]:
        shingles = shingles.unionByName(part)
    shingles, counted = write_through(shingles, F.count(F.lit(1)).alias("n"), F.collect_set("k").alias("k"))
    sizes, rows = sorted(counted["k"] or []), counted["n"]
    wanted = shingles.select("shingle").distinct()
    frequency = None
    for k in sizes:
        found = _places(docs, k).select("shingle").join(_small(wanted, rows), "shingle", "left_semi")
        frequency = found if frequency is None else frequency.unionByName(found)
    if frequency is None:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key bigint, start int, length int, items {windows.schema['items'].dataType.simpleString()}"
        )
    frequency = frequency.groupBy("shingle").count()
    # A shingle that no document has rules its window out.
    rarest = shingles.join(frequency, "shingle", "left").groupBy("window", "length", "k").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset")).alias("rarest"),
        F.first("items").alias("items"),
    )
    prefixes = write_through(
        rarest.filter(F.col("rarest.count") > 0).select("window", "length", "k", "items", "rarest.shingle", "rarest.offset")
    )
    hits = None
    for k in sizes:
        start = F.col("at") - F.col("offset")
        found = (
            _places(docs, k)
            .join(_small(prefixes.filter(F.col("k") == k).drop("k"), rows), "shingle")
            .filter((start >= 0) & (start + F.col("length") <= F.size("words")))
            .filter(F.array_join(F.slice("words", start + 1, F.col("length")), " ") == F.col("window"))
            .select("doc_id", "key", start.alias("start"), "length", "items")
        )
        hits = found if hits is None else hits.unionByName(found)
    return hits


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, key, n_words, n_hit, items, contaminated``.

    A word is hit inside any occurrence of a window; a document is contaminated if hits are a twentieth of its
    words or more. Null texts have no words; null ids are allowed; repeated rows give a row each; without items
    nothing is hit.
    """
    named = docs.select(quoted(doc_id).alias("doc_id"), text_key(text_of(text)).alias("key"), item_words(text_of(text)).alias("words"))
    hits = find_hits(named, benchmark_windows(benchmark, item_id, item_text))
    by_document = hits.groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("start", "length")).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    ).select(
        F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "items",
        F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1))))).cast("long").alias("n_hit"),
    )
    counts = named.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    joined = counts.join(by_document, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast(by_document.schema["items"].dataType)).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, doc_id, text).filter("contaminated").select("doc_id", "key").distinct()
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    same = quoted(doc_id).eqNullSafe(bad["_id"]) & (text_key(text_of(text)) == bad["_key"])
    return docs.join(bad, same, "left_anti")
