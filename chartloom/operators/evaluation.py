"""Matching predictions with gold, and the metrics over matches and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.functions.spans import char_jaccard, overlap_tokens, token_jaccard
from chartloom.operators.lineage import cut_lineage
from chartloom.operators.matching import folded, with_component


def candidate_pairs(predicted: DataFrame, gold: DataFrame, threshold: float = 0.5, exact_only: bool = False, strategy: str = "char-jaccard") -> DataFrame:
    """Pairs of one source and type with a score of at least the threshold.

    Both sides: (source_id, idx, entity_type, text, start_char, end_char); idx is the row's place in its list.  Exact spans
    score 1.  Source ids must not be null here: for those see any_source_pairs.
    """
    p = predicted.select("source_id", "entity_type", *[F.col(c).alias(f"p_{c}") for c in ("idx", "text", "start_char", "end_char")])
    g = gold.select("source_id", "entity_type", *[F.col(c).alias(f"g_{c}") for c in ("idx", "text", "start_char", "end_char")])
    exact = (F.col("p_start_char") == F.col("g_start_char")) & (F.col("p_end_char") == F.col("g_end_char"))
    if strategy == "char-jaccard":
        score = char_jaccard(F.col("p_start_char"), F.col("p_end_char"), F.col("g_start_char"), F.col("g_end_char"))
    else:
        score = token_jaccard(F.col("p_text"), F.col("g_text"))
    pairs = p.join(g, ["source_id", "entity_type"]).withColumn("exact", exact).withColumn("score", F.when(exact, F.lit(1.0)).otherwise(score))
    pairs = pairs.where("exact") if exact_only else pairs
    return pairs.where(F.col("score") >= threshold).select("source_id", "entity_type", "p_idx", "g_idx", "score", "exact")


def any_source_pairs(predicted: DataFrame, gold: DataFrame, threshold: float = 0.5, exact_only: bool = False, strategy: str = "char-jaccard") -> DataFrame:
    """As candidate_pairs, where a row without a source fits any source: (p_source, p_idx, g_source, g_idx, entity_type, score, exact).

    Rows without a source meet the others where their spans overlap (or, by the token strategy, where texts share a token):
    they are joined by type and block of 64 characters, or by type and token, never all with all.  threshold must be over 0.
    """
    if threshold <= 0:
        raise ValueError("threshold must be over 0")
    names = ("idx", "text", "start_char", "end_char", "source")
    p = predicted.withColumnRenamed("source_id", "source").select("entity_type", *[F.col(c).alias(f"p_{c}") for c in names])
    g = gold.withColumnRenamed("source_id", "source").select("entity_type", *[F.col(c).alias(f"g_{c}") for c in names])
    exact = (F.col("p_start_char") == F.col("g_start_char")) & (F.col("p_end_char") == F.col("g_end_char"))
    by_span = strategy == "char-jaccard" or exact_only
    overlap_score = char_jaccard(F.col("p_start_char"), F.col("p_end_char"), F.col("g_start_char"), F.col("g_end_char"))
    score = F.when(exact, F.lit(1.0)).otherwise(overlap_score if strategy == "char-jaccard" else token_jaccard(F.col("p_text"), F.col("g_text")))

    def meeting(df: DataFrame, side: str) -> DataFrame:
        blocks = F.sequence(F.floor(F.col(f"{side}_start_char") / 64), F.floor((F.greatest(F.col(f"{side}_end_char"), F.col(f"{side}_start_char") + 1) - 1) / 64))
        spans = F.transform(blocks, lambda b: b.cast("string"))
        tokens = F.transform(F.concat(overlap_tokens(F.col(f"{side}_text")), F.array(F.lit(""))), lambda t: F.concat(F.lit("t"), t))
        return df.withColumn("meet", F.explode(spans if by_span else F.array_union(spans, tokens)))

    same = p.where("p_source IS NOT NULL").join(g.where("g_source IS NOT NULL"), (p["entity_type"] == g["entity_type"]) & (F.col("p_source") == F.col("g_source"))).drop(g["entity_type"])
    loose = meeting(p, "p").join(meeting(g, "g"), ["entity_type", "meet"]).where("p_source IS NULL OR g_source IS NULL").drop("meet").distinct()
    pairs = same.unionByName(loose).withColumn("exact", exact).withColumn("score", score)
    pairs = pairs.where("exact") if exact_only else pairs
    return pairs.where(F.col("score") >= threshold).select("p_source", "p_idx", "g_source", "g_idx", "entity_type", "score", "exact")


def any_source_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one assignment of any_source_pairs: the best pair first, by score, then predicted and gold row.

    Rows without a source tie sources together; what hangs together by shared rows is found first, and each such component
    is folded alone.
    """
    left, right = ["entity_type", "p_source", "p_idx"], ["entity_type", "g_source", "g_idx"]
    order = [F.desc("score"), F.asc_nulls_first("p_source"), F.asc("p_idx"), F.asc_nulls_first("g_source"), F.asc("g_idx")]
    return folded(with_component(pairs, left, right), ["component"], left, right, order).drop("component")


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one assignment: the best pair first, by score, then predicted and gold index.

    Pairs of different (source, type) never touch, so each such group is folded in one sorted scan.
    """
    kept = folded(pairs, ["source_id", "entity_type"], ["p_idx"], ["g_idx"], [F.desc("score"), F.asc("p_idx"), F.asc("g_idx")])
    return kept.select("source_id", "entity_type", "p_idx", "g_idx", "score", "exact")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for an empty denominator."""
    return F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double"))


def with_prf(counts: DataFrame) -> DataFrame:
    """(n_match, n_predicted, n_gold, ...) gain counts and precision, recall, f1; null where a denominator is empty."""
    out = counts.withColumn("true_positive", F.col("n_match"))
    out = out.withColumn("false_positive", F.greatest(F.lit(0), F.col("n_predicted") - F.col("n_match"))).withColumn("false_negative", F.greatest(F.lit(0), F.col("n_gold") - F.col("n_match")))
    p, r = ratio(F.col("n_match"), F.col("n_predicted")), ratio(F.col("n_match"), F.col("n_gold"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def metrics(predicted: DataFrame, gold: DataFrame, matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and P/R/F1, over all or by columns such as entity_type; a class of either side has a row."""

    def tagged(df: DataFrame, **flags: int) -> DataFrame:
        return df.select(*by, *[F.lit(flags.get(c, 0)).alias(c) for c in ("m", "p", "g")])

    rows = tagged(predicted, p=1).unionByName(tagged(gold, g=1)).unionByName(tagged(matches, m=1))
    sums = rows.groupBy(*by).agg(F.sum("m").alias("n_match"), F.sum("p").alias("n_predicted"), F.sum("g").alias("n_gold"))
    return with_prf(sums).drop("n_match", "n_predicted", "n_gold")


def attribute_accuracy(predicted: DataFrame, gold: DataFrame, matches: DataFrame, attribute: str = "assertion") -> DataFrame:
    """(attribute, correct, total, accuracy) over matches whose gold value is not null."""
    p = predicted.select("source_id", F.col("idx").alias("p_idx"), F.col(attribute).alias("p_value"))
    g = gold.select("source_id", F.col("idx").alias("g_idx"), F.col(attribute).alias("g_value"))
    rows = matches.join(p, ["source_id", "p_idx"]).join(g, ["source_id", "g_idx"]).where("g_value IS NOT NULL")
    out = rows.agg(F.count_if(F.col("p_value").eqNullSafe(F.col("g_value"))).alias("correct"), F.count("*").alias("total"))
    return out.select(F.lit(attribute).alias("attribute"), "correct", "total", ratio(F.col("correct"), F.col("total")).alias("accuracy"))


def attribute_mismatches(predicted: DataFrame, gold: DataFrame, matches: DataFrame, attribute: str = "assertion") -> DataFrame:
    """(source_id, p_idx, g_idx, predicted, gold): matches whose gold value is not null and differs from the prediction."""
    p = predicted.select("source_id", F.col("idx").alias("p_idx"), F.col(attribute).alias("predicted"))
    g = gold.select("source_id", F.col("idx").alias("g_idx"), F.col(attribute).alias("gold"))
    rows = matches.select("source_id", "p_idx", "g_idx").join(p, ["source_id", "p_idx"]).join(g, ["source_id", "g_idx"])
    return rows.where("gold IS NOT NULL AND NOT predicted <=> gold").select("source_id", "p_idx", "g_idx", "predicted", "gold")


def class_accuracy(predicted: DataFrame, gold: DataFrame, matches: DataFrame, classes: Sequence[str], attribute: str = "assertion") -> DataFrame:
    """(ord, value, correct, total, accuracy) for every gold class of the vocabulary; accuracy is null where a class has no match."""
    p = predicted.select("source_id", F.col("idx").alias("p_idx"), F.col(attribute).alias("p_value"))
    g = gold.select("source_id", F.col("idx").alias("g_idx"), F.col(attribute).alias("value"))
    rows = matches.join(p, ["source_id", "p_idx"]).join(g, ["source_id", "g_idx"])
    counts = rows.groupBy("value").agg(F.count_if(F.col("p_value") == F.col("value")).alias("correct"), F.count("*").alias("total"))
    every = predicted.sparkSession.createDataFrame(list(enumerate(classes)), "ord int, value string")
    out = every.join(counts, "value", "left").select("ord", "value", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("correct", "total")])
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def f1_gate(found: DataFrame, least: float = 0.39) -> DataFrame:
    """metrics gain passed and exit_code: 1 where f1, or 0 in its place, is under the gate."""
    passed = F.coalesce("f1", F.lit(0.0)) >= least
    return found.withColumn("passed", passed).withColumn("exit_code", F.when(passed, 0).otherwise(1))


def case_results(expected: DataFrame, found: DataFrame, cases: DataFrame) -> DataFrame:
    """Names expected and found by case: cases(case_id, specialty), both sides (case_id, name), repeats once.

    -> (case_id, specialty, expected_count, found_count, matched_count, precision, recall, f1, missed, extra), the names of
    the last two in order.  Precision of nothing found, and recall of nothing expected, is 1.
    """
    e = expected.select("case_id", "name").distinct().withColumn("e", F.lit(True))
    f = found.select("case_id", "name").distinct().withColumn("f", F.lit(True))
    both = e.join(f, ["case_id", "name"], "full").select("case_id", "name", F.coalesce("e", F.lit(False)).alias("e"), F.coalesce("f", F.lit(False)).alias("f"))
    names = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("name"))))
    counts = both.groupBy("case_id").agg(
        F.count_if("e").alias("expected_count"), F.count_if("f").alias("found_count"), F.count_if(F.col("e") & F.col("f")).alias("matched_count"),
        names(F.col("e") & ~F.col("f")).alias("missed"), names(F.col("f") & ~F.col("e")).alias("extra"),
    )
    none = F.array().cast("array<string>")
    rows = cases.join(counts, "case_id", "left").select("case_id", "specialty", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("expected_count", "found_count", "matched_count")], *[F.coalesce(c, none).alias(c) for c in ("missed", "extra")])
    return _with_rates(rows)


def _with_rates(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("precision", F.coalesce(ratio(F.col("matched_count"), F.col("found_count")), F.lit(1.0))).withColumn("recall", F.coalesce(ratio(F.col("matched_count"), F.col("expected_count")), F.lit(1.0)))
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def backlog(results: DataFrame) -> DataFrame:
    """(case_id, specialty, name): every name that a case missed."""
    return results.select("case_id", "specialty", F.explode("missed").alias("name"))


def hotspots(results: DataFrame) -> DataFrame:
    """The cases with a gap, the widest first, then by id: (place, case_id, gap)."""
    gap = F.size("missed") + F.size("extra")
    rows = results.where(gap > 0).select("case_id", gap.alias("gap"))
    return ranked(rows, [F.col("gap")], [F.col("case_id")])


def ranked(rows: DataFrame, falling: Sequence[Column], rising: Sequence[Column]) -> DataFrame:
    """rows gain place, from 1, by falling then rising keys, without gathering all rows in one task."""
    return running(rows, [], [*[c.desc() for c in falling], *[c.asc() for c in rising]], {"place": F.lit(1)})


def by_specialty(results: DataFrame, specialties: Sequence[str]) -> DataFrame:
    """Sums and rates of the case results for every specialty, those without a case included."""
    sums = results.groupBy("specialty").agg(
        *[F.sum(c).alias(c) for c in ("expected_count", "found_count", "matched_count")], F.sum(F.size("missed")).alias("missed_count"), F.sum(F.size("extra")).alias("extra_count")
    )
    every = results.sparkSession.createDataFrame([(s,) for s in specialties], "specialty string")
    counts = ("expected_count", "found_count", "matched_count", "missed_count", "extra_count")
    return _with_rates(every.join(sums, "specialty", "left").select("specialty", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts]))


def coverage(entities: DataFrame) -> DataFrame:
    """entities(entity_type, assertion, n_codings) -> (dimension, key, found_count, coded_count): by type and by assertion, one pass."""
    rows = entities.select("entity_type", F.coalesce("assertion", F.lit("present")).alias("assertion"), (F.col("n_codings") > 0).cast("int").alias("coded"))
    sums = rows.groupingSets([[F.col("entity_type")], [F.col("assertion")]], "entity_type", "assertion").agg(F.grouping("entity_type").alias("_other"), F.count("*").alias("found_count"), F.sum("coded").alias("coded_count"))
    dimension, key = F.when(F.col("_other") == 0, "type").otherwise("assertion"), F.when(F.col("_other") == 0, F.col("entity_type")).otherwise(F.col("assertion"))
    return sums.select(dimension.alias("dimension"), key.alias("key"), "found_count", "coded_count")


def in_order(rows: DataFrame, by: Sequence[str] = (), counts: Sequence[str] = ("found_count",)) -> DataFrame:
    """Metric rows (by, key, counts) gain place, from 1 in each group of by: the highest count first, then by key.

    The count of a row is the first of counts that is not null, 0 where none is.  Keys sort by their code points.
    """
    most = F.coalesce(*[F.col(c) for c in counts], F.lit(0))
    return running(rows, by, [most.desc(), F.asc("key")], {"place": F.lit(1)})


def ambiguity_results(expected: DataFrame, resolved: DataFrame) -> DataFrame:
    """Both (case_id, abbreviation, meaning): (case_id, expected_count, matched_count, missed), missed as abbreviation=meaning."""
    hit = resolved.select("case_id", "abbreviation", "meaning").distinct().withColumn("hit", F.lit(True))
    rows = expected.distinct().join(hit, ["case_id", "abbreviation", "meaning"], "left")
    missed = F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.concat_ws("=", "abbreviation", "meaning"))))
    return rows.groupBy("case_id").agg(F.count("*").alias("expected_count"), F.count("hit").alias("matched_count"), missed.alias("missed"))


def pair_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The share of (positive, negative) pairs in order, ties half; 0, not null, where one class is missing."""
    return roc_auc(scores, by).withColumn("roc_auc", F.coalesce("roc_auc", F.lit(0.0)))


def running(rows: DataFrame, by: Sequence[str], keys: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """rows gain the sums over the rows of their group (by) up to and with themselves, in the order of the keys.

    No group is gathered in one task: rows are range-partitioned by group and keys, summed within each partition, and moved on by
    what the partitions before hold of the group.
    """
    by = list(by)
    placed = cut_lineage(rows.repartitionByRange(*by, *keys).withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy("_part", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({n: F.sum(c).over(order) for n, c in sums.items()})
    parts = placed.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = parts.withColumns({f"_{n}": F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)) for n in sums})
    same = own["_part"] == parts["_part"]
    for c in by:
        same = same & own[c].eqNullSafe(parts[c])
    joined = own.join(parts, same)
    return joined.select(*[own[c] for c in rows.columns], *[(own[n] + parts[f"_{n}"]).alias(n) for n in sums])


def roc_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks; scores(y_true, y_score).  Null where one class is missing.

    Counts are first taken by distinct score; the ranks are running sums over these.
    """
    by = list(by)
    at = scores.groupBy(*by, "y_score").agg(F.sum("y_true").alias("pos"), F.count("*").alias("n"))
    ranked_ = running(at, by, [F.col("y_score").asc()], {"upto": F.col("n")}).withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked_.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    auc = ratio(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q"))
    return sums.select(*by, auc.alias("roc_auc"))


def average_precision(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean precision at the positives, by score descending, ties in the order of `ord`; scores(ord, y_true, y_score)."""
    by = list(by)
    rows = running(scores.select(*by, "ord", "y_true", "y_score"), by, [F.col("y_score").desc(), F.col("ord").asc()], {"k": F.lit(1), "hits": F.col("y_true")})
    out = rows.groupBy(*by).agg(F.sum(F.when(F.col("y_true") == 1, F.col("hits") / F.col("k")).otherwise(0.0)).alias("s"), F.sum("y_true").alias("p"))
    return out.select(*by, ratio(F.col("s"), F.col("p")).alias("average_precision"))


def classifier_report(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, sample_count, positive_count, negative_count, roc_auc, average_precision) of scores(ord, y_true, y_score).

    roc_auc is null where a class is missing, average_precision where there are no positives.  A row that lacks its label or
    its score, and a label that is neither 0 nor 1, are errors: both lists of a report must be whole.
    """
    by = list(by)
    whole = F.col("y_true").isNotNull() & F.col("y_score").isNotNull()
    label = F.when(~whole, F.raise_error(F.lit("labels and scores must be as many: a row lacks one of them")).cast("int")).when(F.col("y_true").isin(0, 1), F.col("y_true").cast("int")).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("int"))
    checked = cut_lineage(scores.select(*by, "ord", label.alias("y_true"), "y_score"))
    if not by:
        checked = checked.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    counts = checked.groupBy(*keys).agg(F.count("*").alias("sample_count"), F.count_if(F.col("y_true") == 1).alias("positive_count"), F.count_if(F.col("y_true") == 0).alias("negative_count"))
    out = counts.join(roc_auc(checked, keys), keys, "left").join(average_precision(checked, keys), keys, "left")
    return out.select(*by, "sample_count", "positive_count", "negative_count", "roc_auc", "average_precision")


def binary_report(scores: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, f1 (0 on empty denominators) and Brier score."""
    hot, pos = F.col("y_score") >= threshold, F.col("y_true") == 1
    out = scores.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(pos).alias("positives"), F.count_if(hot & pos).alias("tp"), F.count_if(hot & ~pos).alias("fp"),
        F.count_if(~hot & ~pos).alias("tn"), F.count_if(~hot & pos).alias("fn"), F.avg(F.pow(F.col("y_score") - F.col("y_true"), 2)).alias("brier"),
    )
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    out = out.withColumn("accuracy", zero(F.col("tp") + F.col("tn"), F.col("n"))).withColumn("precision", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", zero(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))), F.lit(0.0)))
