"""Statistics by instruction type and category, and the comparison of two models."""

from pyspark.sql import Column, DataFrame, functions as F

from adherence.operators.scoring import score_samples, unnest

# Fixed values of the comparison.
TIE_BELOW = 0.001
TYPE_LEVEL, CATEGORY_LEVEL, OVERALL_LEVEL = "type", "category", "overall"


def type_stats(scored: DataFrame, by=("run_file",)) -> DataFrame:
    """Passes and totals per instruction type. Partial sums are taken before the
    shuffle, so what moves is one row per type, group and task."""
    long = unnest(scored, by, "scores")
    return long.groupBy(*by, "category", "inst_id").agg(
        F.count_if("strict").alias("strict_pass"),
        F.count_if("loose").alias("loose_pass"),
        F.count(F.lit(1)).alias("total"),
    )


def level_stats(stats: DataFrame, by=("run_file",)) -> DataFrame:
    """Type, category and overall level out of the type statistics: the grouping
    sets expand the few aggregated rows, never the scores."""
    cols = [F.col(c) for c in (*by, "category", "inst_id")]
    head, category, inst = cols[: len(by)], cols[-2], cols[-1]
    rolled = stats.groupingSets([[*head, category, inst], [*head, category], head], *cols).agg(
        F.grouping_id().alias("_gid"),
        F.sum("strict_pass").alias("strict_pass"),
        F.sum("loose_pass").alias("loose_pass"),
        F.sum("total").alias("total"),
    )
    level = (
        F.when(F.col("_gid") == 0, TYPE_LEVEL)
        .when(F.col("_gid") == 1, CATEGORY_LEVEL)
        .otherwise(OVERALL_LEVEL)
    )
    return rolled.select(
        *by, level.alias("level"), "category", "inst_id", "strict_pass", "loose_pass", "total",
        ratio(F.col("strict_pass"), F.col("total")).alias("strict_acc"),
        ratio(F.col("loose_pass"), F.col("total")).alias("loose_acc"),
    )


def ratio(part, whole) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def winner(diff, level) -> Column:
    wins = F.when(level == CATEGORY_LEVEL, F.lit(" wins")).otherwise(F.lit(""))
    return (
        F.when(F.abs(diff) < TIE_BELOW, F.lit("tie"))
        .when(diff > 0, F.concat(F.lit("<- M1"), wins))
        .otherwise(F.concat(F.lit("-> M2"), wins))
    )


def compare_models(scored1: DataFrame, scored2: DataFrame, use_strict=True) -> DataFrame:
    """Two models side by side at every level.

    A group only one model has counts 0/0 for the other, as a full outer join
    would give; adding up by side gets there with one aggregation.
    """
    sides = scored1.select(F.lit(1).alias("side"), "scores").unionByName(
        scored2.select(F.lit(2).alias("side"), "scores")
    )
    return compare_stats(level_stats(type_stats(sides, ("side",)), ("side",)), use_strict)


def scored_sides(samples1: DataFrame, samples2: DataFrame, options=None) -> DataFrame:
    """The scores of two models' samples next to their `side`, 1 or 2: one table is scored
    once, so there is one scoring plan, not one a model."""
    both = samples1.withColumn("side", F.lit(1)).unionByName(samples2.withColumn("side", F.lit(2)))
    return score_samples(both, options, keep=("side",)).select("side", "scores")


def compare_samples(samples1: DataFrame, samples2: DataFrame, options=None, use_strict=True) -> DataFrame:
    """compare_models straight from the samples (of the same columns)."""
    levels = level_stats(type_stats(scored_sides(samples1, samples2, options), ("side",)), ("side",))
    return compare_stats(levels, use_strict)


def compare_stats(levels: DataFrame, use_strict=True, with_stats=False) -> DataFrame:
    """Comparison rows out of level statistics by `side`; with_stats keeps both sides' counts."""
    passed = F.col("strict_pass" if use_strict else "loose_pass")

    def side(n, value):
        return F.coalesce(F.sum(F.when(F.col("side") == n, value)), F.lit(0))

    counts = F.struct("strict_pass", "loose_pass", "total")
    both = levels.groupBy("level", "category", "inst_id").agg(
        side(1, passed).alias("p1"), side(1, F.col("total")).alias("t1"),
        side(2, passed).alias("p2"), side(2, F.col("total")).alias("t2"),
        *[F.max(F.when(F.col("side") == n, counts)).alias(f"stats{n}") for n in (1, 2)],
    )
    both = both.withColumns(
        {
            "model1_acc": ratio(F.col("p1"), F.col("t1")),
            "model2_acc": ratio(F.col("p2"), F.col("t2")),
        }
    ).withColumn("diff", F.col("model1_acc") - F.col("model2_acc"))
    return both.select(
        "level", "category", F.col("inst_id").alias("instruction_type"),
        "model1_acc", "model2_acc",
        F.concat_ws("/", "p1", "t1").alias("model1_count"),
        F.concat_ws("/", "p2", "t2").alias("model2_count"),
        "diff", winner(F.col("diff"), F.col("level")).alias("winner"),
        *(["stats1", "stats2"] if with_stats else []),
    )


def sorted_comparison(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy("level", "category", "instruction_type")


def wins(comparison: DataFrame) -> DataFrame:
    """Wins and ties per level, by side: equal model names stay apart."""
    return (
        comparison.where(F.col("level") != OVERALL_LEVEL)
        .groupBy("level")
        .agg(
            F.count_if(F.startswith("winner", F.lit("<-"))).alias("model1_wins"),
            F.count_if(F.startswith("winner", F.lit("->"))).alias("model2_wins"),
            F.count_if(F.col("winner") == "tie").alias("ties"),
        )
    )


def comparison_document(comparison: DataFrame, name1, name2, known_ids) -> DataFrame:
    """The comparison (with its counts) as one nested row, by one aggregation: per model
    its statistics by type and by category and the overall accuracy, and the list of
    type comparisons.

    `known_ids` are the instruction types of the registry. Other ids are user data
    without a bound; they stay in the comparison rows and count in the categories' and
    overall figures, but are not listed here."""
    known = F.col("instruction_type").isin(list(known_ids))
    categories = sorted({i.split(":")[0] for i in known_ids})
    types = (F.col("level") == TYPE_LEVEL) & known
    by_category = (F.col("level") == CATEGORY_LEVEL) & F.col("category").isin(categories)

    def entries(wanted, key, n):
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(
            wanted & F.col(f"stats{n}").isNotNull(),
            F.struct(F.col(key).alias("key"), F.col(f"stats{n}").alias("value"))))))

    def model(n, name):
        overall = F.max(F.when(F.col("level") == OVERALL_LEVEL, F.col(f"model{n}_acc")))
        return F.struct(
            F.lit(name).alias("name"), entries(types, "instruction_type", n).alias("by_type"),
            entries(by_category, "category", n).alias("by_category"),
            F.coalesce(overall, F.lit(0.0)).alias("overall"),
        )

    row = F.struct("instruction_type", "model1_acc", "model2_acc", "model1_count", "model2_count", "diff", "winner")
    return comparison.agg(
        model(1, name1).alias("model1"), model(2, name2).alias("model2"),
        F.array_sort(F.collect_list(F.when(types, row))).alias("comparison"),
    )
