"""Registered relational queries; each has an equivalent in ``plans/sql.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casemill.functions.scalar import list_label, to_number
from casemill.operators import evidence as ev, profile as pr, ranking as rk, splits as sp
from casemill.operators.range_lookup import label_of_mask, range_lookup
from casemill.plans import table_cases as tc
from casemill.plans.load import case_table
from casemill.schema import CASE_SCHEMA, KEY, TARGET
from casemill.session import write_through
from casemill.sources.cases import builtin_chapters

ROUND = 6


def age_in_months(spark: SparkSession, sf: str) -> DataFrame:
    return tc.with_age(tc.people(spark, sf)).select(KEY, F.col("age_in_months").cast("long"))


def case_features(spark, sf):
    nested = tc.nested_cases(spark, sf)
    return nested.select(
        KEY,
        "sex",
        F.col("age_in_months").cast("long"),
        list_label(F.col("evidence_present")).alias("evidence_present"),
        list_label(F.col("evidence_absent")).alias("evidence_absent"),
        ev.PRESENT_COUNT,
        ev.ABSENT_COUNT,
    )


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """``value``: every case as a raw JSON record, with whole codes."""
    item = lambda x: F.struct(x.alias("id"))
    coded = tc.codes(spark, sf).distinct().groupBy(KEY).agg(
        F.array_sort(F.collect_set("code")).alias("codes")
    )
    people = tc.people(spark, sf)
    nested = tc.nested_cases(spark, sf).select(KEY, "evidence_present", "evidence_absent")
    record = F.to_json(
        F.struct(
            F.col(KEY).alias("public_test_case_id"),
            F.col("codes").alias("expected_condition_icd10_codes"),
            F.struct(
                F.transform("evidence_present", item).alias("present"),
                F.transform("evidence_absent", item).alias("absent"),
            ).alias("evidence"),
            F.struct(
                "sex", F.struct(F.col("age").alias("value"), "unit").alias("age")
            ).alias("api_payload"),
        )
    )
    return people.join(nested, KEY).join(coded, KEY, "left").select(record.alias("value"))


def nested_record_scan(spark, sf):
    """Cases as JSON records, parsed with the raw schema and flattened."""
    raw = raw_records(spark, sf).select(F.from_json("value", CASE_SCHEMA).alias("r")).select("r.*")
    return case_table(raw).select(
        KEY,
        "sex",
        "age_in_months",
        list_label(F.col("evidence_present")).alias("evidence_present"),
        list_label(F.col("evidence_absent")).alias("evidence_absent"),
        TARGET,
    )


def code_range_lookup(spark, sf):
    coded = tc.codes(spark, sf).distinct()
    return range_lookup(coded, "code", builtin_chapters(spark))


def wide_range_lookup(spark, sf):
    """Lookup in a range table that grows with the data: price bands of parts over customers."""
    part = tc.read_table(spark, sf, "part")
    bands = part.select(
        F.col("p_partkey").alias("pos"),
        F.concat(F.substring("p_name", 1, 2), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("lo"),
        F.concat(F.substring("p_name", 1, 2), F.lpad((F.col("p_size") + 3).cast("string"), 2, "0")).alias("hi"),
        F.col("p_brand").alias("block"),
    )
    keys = tc.read_table(spark, sf, "lineitem").select(
        F.concat(
            F.element_at(F.array(*[F.lit(x) for x in ("la", "ho", "bl", "re", "gr", "sm")]), (F.col("l_partkey") % 6 + 1).cast("int")),
            F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"),
        ).alias("code")
    )
    return range_lookup(keys, "code", bands).groupBy("code", "block").agg(F.count("*").alias("n"))


def case_target_label(spark, sf):
    return tc.targets(spark, sf)


def target_counts(spark, sf):
    """Cases per target: counted by mask, so that only the counts are rendered as labels."""
    keys = tc.people(spark, sf).select(KEY)
    masks = keys.join(tc.code_masks(tc.codes(spark, sf)), KEY, "left")
    counts = masks.groupBy("mask").agg(F.count("*").alias("n"))
    label = label_of_mask(F.col("mask")).alias(TARGET)
    return counts.select(label, "n").orderBy(F.col("n").desc(), TARGET)


def rare_targets(spark, sf):
    return pr.count_rare(tc.targets(spark, sf), TARGET, threshold=5)


def block_counts(spark, sf):
    """Distinct cases per single block, unmatched codes included."""
    blocks = tc.code_blocks(tc.codes(spark, sf))
    return (
        blocks.select(F.explode("blocks").alias("block"))
        .groupBy(F.coalesce("block", F.lit("None")).alias("block"))
        .agg(F.count("*").alias("n"))
    )


def evidence_vocabulary(spark, sf):
    return ev.vocabulary(tc.evidence(spark, sf))


def evidence_vocabulary_present_only(spark, sf):
    return ev.vocabulary(tc.evidence(spark, sf), include_absent=False)


def evidence_ternary(spark, sf):
    return ev.encode_long(tc.evidence(spark, sf))


def evidence_ternary_present_only(spark, sf):
    return ev.encode_long(tc.evidence(spark, sf), include_absent=False)


def evidence_ternary_fitted(spark, sf):
    """Present-evidence vocabulary of the newborns, applied to all; unknown ids are ignored."""
    table = tc.evidence(spark, sf)
    newborns = tc.with_age(tc.people(spark, sf)).filter("age_in_months <= 1").select(KEY)
    known = ev.distinct_ids(table.join(newborns, KEY, "left_semi"), include_absent=False)
    return ev.encode_long(table, known)


def evidence_ternary_lists(spark, sf):
    """The fitted encoder on nested list columns."""
    nested = write_through(tc.nested_cases(spark, sf))
    return ev.EvidenceEncoder().fit(nested).transform_long(nested)


def evidence_counts(spark, sf):
    counts = ev.counts_long(tc.evidence(spark, sf))
    return (
        tc.people(spark, sf)
        .select(KEY)
        .join(counts, KEY, "left")
        .select(
            KEY,
            F.coalesce(ev.PRESENT_COUNT, F.lit(0)).alias(ev.PRESENT_COUNT),
            F.coalesce(ev.ABSENT_COUNT, F.lit(0)).alias(ev.ABSENT_COUNT),
        )
    )


def fd_check(spark, sf):
    read = lambda name: tc.read_table(spark, sf, name)
    checks = [
        ("nation", "n_nationkey", ["n_name", "n_regionkey"]),
        ("nation", "n_regionkey", ["n_name"]),
        ("customer", "c_nationkey", ["c_mktsegment", "c_acctbal"]),
        ("customer", "c_custkey", ["c_name", "c_nationkey"]),
        ("part", "p_partkey", ["p_name", "p_brand", "p_size"]),
        ("part", "p_name", ["p_brand", "p_type"]),
        ("events", "user_id", ["event_type", "value"]),
        ("events", "event_id", ["ts", "props"]),
    ]
    found = [pr.derivable(read(t), k, cols).withColumn("source", F.lit(t)) for t, k, cols in checks]
    return pr.union_all(found).select("source", "key", "column", "derivable")


PROFILED = ["customer", "part", "nation", "region", "supplier", "events"]


def profile_columns(spark, sf):
    parts = []
    for name in PROFILED:
        parts.append(pr.profile(tc.read_table(spark, sf, name), minimal=True).withColumn("source", F.lit(name)))
    numbers = [F.round(c, ROUND).alias(c) for c in ("distinct_share", "min", "max", "mean", "std")]
    top = F.when(F.col("min").isNull(), F.col("top_value")).alias("top_value")
    return pr.union_all(parts).select(
        "source", "column", "n_rows", "n_missing", "n_distinct", "top_n", top, *numbers
    )


def profile_full(spark, sf):
    """Profile with quartile sketches of the feature table."""
    return pr.profile(write_through(tc.nested_cases(spark, sf).join(tc.targets(spark, sf), KEY)))


def profile_encoded(spark, sf):
    """Per evidence id: cases present, absent and neither, from the long encoding."""
    encoded = ev.encode_long(tc.evidence(spark, sf))
    n = tc.people(spark, sf).count()
    return encoded.groupBy("evidence_id").agg(
        F.count(F.when(F.col("value") == 1, 1)).alias("n_present"),
        F.count(F.when(F.col("value") == -1, 1)).alias("n_absent"),
        (F.lit(n) - F.count("*")).alias("n_zero"),
        F.round(F.sum("value") / F.lit(n), ROUND).alias("mean"),
    )


def duplicate_rows(spark, sf):
    return pr.duplicate_rows(tc.read_table(spark, sf, "lineitem"))


def correlations(spark, sf):
    return pr.correlations(tc.read_table(spark, sf, "lineitem")).select("left", "right", F.round("corr", ROUND).alias("corr"))


def histogram(spark, sf):
    table = tc.read_table(spark, sf, "lineitem")
    return pr.histogram(table, pr.numeric_columns(table), bins=10)


def folded_cases(spark, sf):
    """The labels are written first: ranks need them several times, the lines only once."""
    return sp.stratified_folds(write_through(tc.labelled(spark, sf)), KEY, TARGET)


def stratified_folds(spark, sf):
    return folded_cases(spark, sf).select(KEY, TARGET, sp.FOLD)


def holdout_split(spark, sf):
    return sp.holdout_split(tc.people(spark, sf).select(KEY), KEY, test_size=0.25, seed=7)


def holdout_split_sizes(spark, sf):
    return holdout_split(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


def learning_curve_prefixes(spark, sf):
    folded = write_through(folded_cases(spark, sf).select(KEY, sp.FOLD))
    return sp.prefix_cutoffs(folded, KEY, [0.85, 0.9, 0.95, 1.0])


def majority_baseline_cv(spark, sf):
    """Cross-validated accuracy of the most frequent label, from one count per fold and label."""
    counts = folded_cases(spark, sf).groupBy(sp.FOLD, TARGET).agg(F.count("*").alias("n"))
    folds = range(5)
    outside = [F.sum(F.when(F.col(sp.FOLD) != i, F.col("n")).otherwise(0)) for i in folds]
    inside = [F.sum(F.when(F.col(sp.FOLD) == i, F.col("n")).otherwise(0)) for i in folds]
    per_label = counts.groupBy(TARGET).agg(
        *[outside[i].alias(f"_o{i}") for i in folds], *[inside[i].alias(f"_i{i}") for i in folds]
    )
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("fold"), F.col(f"_o{i}").alias("train"), F.col(f"_i{i}").alias("test"))
            for i in folds
        ]
    )
    long = per_label.select(TARGET, F.explode(cells).alias("_c")).select(TARGET, "_c.*")
    # The smallest label wins a tie, so it is the minimum of (-count, label).
    best = F.min(F.struct((-F.col("train")).alias("neg"), F.col(TARGET), F.col("test")))
    scored = long.groupBy("fold").agg(
        best.alias("_b"), F.sum("train").alias("_train"), F.sum("test").alias("_test")
    )
    return scored.select(
        "fold",
        F.col(f"_b.{TARGET}").alias("prediction"),
        F.round(-F.col("_b.neg") / F.col("_train"), ROUND).alias("train_score"),
        F.round(F.col("_b.test") / F.col("_test"), ROUND).alias("test_score"),
    )


def params_explode(spark, sf):
    """Parameter maps of all event rows as ``event_id, param, value, numeric_value``."""
    params = F.from_json("props", "map<string,string>")
    return (
        tc.read_table(spark, sf, "events")
        .select("event_id", F.explode(params).alias("param", "value"))
        .select("event_id", "param", "value", to_number(F.col("value")).alias("numeric_value"))
    )


def distinct_param_values(spark, sf):
    """Parameters with more than one value: those that can form a series."""
    return (
        params_explode(spark, sf)
        .groupBy("param")
        .agg(F.countDistinct("numeric_value").alias("n_values"))
        .filter("n_values > 1")
    )


def group_mean_std(spark, sf):
    scored = tc.read_table(spark, sf, "events").select(
        F.from_json("props", "map<string,string>")["k"].alias("k"), "value"
    )
    stats = rk.mean_and_std(scored, "k", ["value"])
    return stats.select("k", *[F.round(c, ROUND).alias(c) for c in ("value_mean", "value_std")])


def _scores(spark, sf, kind):
    return (
        tc.read_table(spark, sf, "events")
        .filter(F.col("event_type") == kind)
        .select(F.col("event_id").alias("seq"), F.col("user_id").alias("model_str"), "value", "props")
    )


def best_per_group(spark, sf):
    scored = tc.read_table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type", "value"
    )
    return rk.best_per_group(scored, "user_id", "value")


def best_overall(spark, sf):
    scored = tc.read_table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type", "value"
    )
    return rk.best_per_group(scored, None, "value")


def best_overlay(spark, sf):
    """Best first-stage row per group, replaced by the best second-stage row where there is one."""
    first = rk.best_per_group(_scores(spark, sf, "view").drop("props"), "model_str", "value")
    second = rk.best_per_group(_scores(spark, sf, "purchase"), "model_str", "value")
    return rk.overlay(first, second, "model_str", ["value"], extra=["props"])


QUERIES = {
    f.__name__: f
    for f in (
        age_in_months,
        case_features,
        nested_record_scan,
        code_range_lookup,
        wide_range_lookup,
        case_target_label,
        target_counts,
        rare_targets,
        block_counts,
        evidence_vocabulary,
        evidence_vocabulary_present_only,
        evidence_ternary,
        evidence_ternary_present_only,
        evidence_ternary_fitted,
        evidence_ternary_lists,
        evidence_counts,
        fd_check,
        profile_columns,
        profile_full,
        profile_encoded,
        duplicate_rows,
        correlations,
        histogram,
        stratified_folds,
        holdout_split,
        holdout_split_sizes,
        learning_curve_prefixes,
        majority_baseline_cv,
        params_explode,
        distinct_param_values,
        group_mean_std,
        best_per_group,
        best_overall,
        best_overlay,
    )
}
