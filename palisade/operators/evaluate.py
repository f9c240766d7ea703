"""Classification of scored reports and their audit against labels.

A report is a flat row: name, score, label, group_score_range, evidence_coverage, instability_score,
provisional_positive, stability_enabled, stability_status, score_range, stable_negative_support,
stable_negative_score, provisional_positive_support, exploratory_positive_support, feasible_windows,
requested_budgets, transcode_enabled, transcode_status; every field may be null. Truth is a column `expected`
of positive, negative or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import robust as R
from palisade.session import durable

#: Default thresholds, largest range of evidence groups that a class may have, of window scores.
POSITIVE, NEGATIVE, GROUP_RANGE, SCORE_RANGE = 0.62, 0.30, 0.20, 0.35


def thresholds(positive: float, negative: float) -> None:
    if not 0.0 <= negative < positive <= 1.0:
        raise ValueError("thresholds must satisfy 0 <= negative < positive <= 1")


def valid(score: Column) -> Column:
    """A score between 0 and 1, else null."""
    return F.when(score.between(0.0, 1.0), score)


def yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def directional(df: DataFrame) -> DataFrame:
    """Adds directional_score and n_qualifying from cut_rate, temporal_score, face_score, geometry_cv, ambiguity,
    detection_rate, integrity_score, frequency_score. A score of 0 without evidence shows as n_qualifying 0."""
    cut, motion = R.or_zero(F.col("cut_rate")), R.or_zero(F.col("temporal_score"))
    edits_and_motion = (cut >= 0.015) & (motion >= 0.18)
    edits_alone = (cut >= 0.015) & (motion == 0)
    severe = (cut >= 0.025) & (motion == 0)
    face, shape, unclear, seen = (F.col(c) for c in ("face_score", "geometry_cv", "ambiguity", "detection_rate"))
    strong = (face >= 0.75) & (shape >= 0.25) & (seen >= 0.50) & (~severe | ((face >= 0.80) & (seen >= 0.80)))
    local = (face >= 0.70) & (shape >= 0.23) & (unclear <= 2.5) & (seen <= 0.70) & ~severe
    steady = (face >= 0.60) & (shape >= 0.28) & (unclear <= 3.0) & (seen >= 0.85) & ~severe
    known = face.isNotNull() & shape.isNotNull() & unclear.isNotNull() & seen.isNotNull()
    by_face = F.when(known & ~edits_and_motion & (strong | local | steady), face)
    others = [F.when(~edits_and_motion & ~edits_alone & F.col(c).between(low, 1.0), F.col(c)) for c, low in (("integrity_score", 0.45), ("frequency_score", 0.65))]
    qualifying = F.array_compact(F.array(by_face, *others))
    return df.withColumns({"directional_score": F.coalesce(F.array_max(qualifying), F.lit(0.0)), "n_qualifying": F.size(qualifying)})


def exploratory(df: DataFrame) -> DataFrame:
    """Adds exploratory_eligible and exploratory_reasons: the relaxed path of audits with few windows or budgets."""
    scope = (F.coalesce("feasible_windows", F.lit(0)) == 1) | (F.coalesce("requested_budgets", F.lit(3)) < 3)
    supported = yes("exploratory_positive_support")
    wide, apart = F.col("score_range") >= SCORE_RANGE, F.coalesce(F.col("group_score_range") > GROUP_RANGE, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~scope, "not-a-limited-resource-audit"), F.when(F.col("score_range").isNull(), "missing-window-score-range"), F.when(wide, "window-score-instability"),
        F.when(apart, "independent-evidence-disagrees"), F.when(~supported, "insufficient-positive-group-consensus"),
    ))
    eligible = yes("stability_enabled") & (F.col("stability_status") == "ok") & scope & supported & ~wide & ~apart
    return df.withColumns({"exploratory_eligible": F.coalesce(eligible, F.lit(False)), "exploratory_reasons": F.array_sort(reasons)})


def _reasons(explore: bool) -> Column:
    """Why a report abstains whatever its score."""
    ok, steady = F.coalesce(F.col("stability_status") == "ok", F.lit(False)), yes("stable_negative_support")
    eligible = F.col("exploratory_eligible") if explore else F.lit(False)
    broken = F.coalesce(F.col("transcode_status"), F.lit(""))
    score = F.col("score")
    return F.array_sort(F.array_compact(F.array(
        F.when(F.col("label").startswith("abstain"), "production-fusion-abstention"),
        F.when(yes("stability_enabled") & ~ok, "stability-check-unavailable"),
        F.when(ok & (F.col("score_range") >= SCORE_RANGE) & ~steady, "unstable-window-score"),
        F.when(ok & yes("stability_enabled") & ~steady & ~yes("provisional_positive_support") & ~eligible, "window-consensus-not-stable"),
        F.when(yes("transcode_enabled") & (broken == "unstable"), "unstable-after-transcode"),
        F.when(yes("transcode_enabled") & ~broken.isin("unstable", "stable"), "transcode-check-unavailable"),
        F.when(score.isNull(), "missing-score"),
        F.when(score.isNotNull() & ~score.between(0.0, 1.0), "score-out-of-range"),
        F.when((F.col("group_score_range") > GROUP_RANGE) & (F.col("group_score_range") <= 1.0), "independent-evidence-disagrees"),
    )))


def classify(df: DataFrame, positive: float = POSITIVE, negative: float = NEGATIVE, provisional: bool = True, explore: bool = False) -> DataFrame:
    """Adds predicted, decision_kind and abstain_reasons."""
    thresholds(positive, negative)
    df = exploratory(df).withColumn("abstain_reasons", _reasons(explore))
    score = F.col("score")
    kind = (
        F.when(F.size("abstain_reasons") > 0, "abstain")
        .when(score >= positive, "threshold-positive")
        .when(F.lit(provisional) & yes("provisional_positive"), "provisional-positive")
        .when(F.lit(explore) & F.col("exploratory_eligible"), "provisional-positive")
        .when(yes("stable_negative_support") & (F.col("stable_negative_score") <= negative), "stable-negative-consensus")
        .when(score <= negative, "threshold-negative")
        .otherwise("score-band-abstention")
    )
    df = df.withColumn("decision_kind", kind)
    predicted = (
        F.when(F.col("decision_kind").endswith("positive"), "positive")
        .when(F.col("decision_kind").isin("stable-negative-consensus", "threshold-negative"), "negative")
        .otherwise("abstain")
    )
    band = F.when(F.col("decision_kind") == "score-band-abstention", F.array(F.lit("score-between-analysis-thresholds"))).otherwise(F.col("abstain_reasons"))
    df = df.withColumns({"predicted": predicted, "abstain_reasons": band})
    if explore:
        df = df.withColumn("decision_kind", F.when(F.col("predicted") == "abstain", F.col("decision_kind")).otherwise(F.concat(F.lit("exploratory-"), "decision_kind")))
    return df


def ranking_confidence(df: DataFrame) -> DataFrame:
    """Adds confidence and confidence_label of an anomaly ranking."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    agreement = F.when(F.col("group_score_range").isNotNull(), 1 - unit("group_score_range")).otherwise(0.0)
    held = lambda c: F.when(F.col(c).isNotNull(), unit(c)).otherwise(0.0)
    confidence = held("evidence_coverage") * agreement * (1 - held("instability_score"))
    apart = F.coalesce(F.col("group_score_range") > GROUP_RANGE, F.lit(False))
    return df.withColumns({"confidence": F.round(confidence, 6), "confidence_label": F.when((confidence < 0.5) | apart, "low").otherwise("moderate")})


def metric(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 6)


def confusion(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and rates of predicted against expected, for labelled rows; rates over nothing are null."""
    labelled = df.where(F.col("expected").isin("positive", "negative"))
    hit = lambda e, p: F.count_if((F.col("expected") == e) & (F.col("predicted") == p))
    counts = labelled.groupBy(*(keys or [])).agg(
        hit("positive", "positive").alias("tp"), hit("negative", "positive").alias("fp"), hit("negative", "negative").alias("tn"), hit("positive", "negative").alias("fn"),
        F.count_if(F.col("predicted") == "abstain").alias("abstain"), F.count("*").alias("labeled"),
    )
    return rates(counts)


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "labeled"))
    done = tp + fp + tn + fn
    out = counts.withColumns({
        "coverage": metric(done, n), "abstention_rate": metric(F.col("abstain"), n), "sensitivity": metric(tp, tp + fn), "specificity": metric(tn, tn + fp),
        "false_positive_rate": metric(fp, tn + fp), "precision": metric(tp, tp + fp), "conditional_accuracy": metric(tp + tn, done),
    })
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def running(df: DataFrame, order: list[Column | str], *sums: str) -> DataFrame:
    """df with <c>_before, the sum of a column over the rows before in an order. Rows are sorted over ranges and
    added up within each; what comes together is one row of sums for each range."""
    # an id holds the number of the range above its lowest 33 bits
    rows = durable(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    before, starts = [0] * len(sums), []
    for r in sorted(rows.groupBy("_part").agg(*(F.sum(c) for c in sums)).collect()):
        starts.append((r[0], *before))
        before = [x + (y or 0) for x, y in zip(before, r[1:])]
    dim = df.sparkSession.createDataFrame(starts, ", ".join(["_part long", *(f"_{c} long" for c in sums)]))
    above = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(dim), "_part")
    return joined.select(*df.columns, *((F.col(f"_{c}") + F.coalesce(F.sum(c).over(above), F.lit(0))).alias(f"{c}_before") for c in sums))


def rank_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, positives, negatives, pairs, concordant, tied, discordant, auroc, average_precision of valid scores
    of labelled rows (name, expected, score). Pairs are counted from running counts by distinct score, not made."""
    hit = (F.col("expected") == "positive").cast("long")
    rows = df.where(F.col("expected").isin("positive", "negative") & F.col("score").between(0.0, 1.0)).withColumns({"hit": hit, "one": F.lit(1).cast("long")})

    def within(found: DataFrame, *sums: str) -> DataFrame:
        """Running sums from where a key begins; keys are few next to rows."""
        if not keys:
            return found
        starts = found.groupBy(*keys).agg(*(F.min(f"{c}_before").alias(f"_{c}") for c in sums))
        return found.join(starts, keys).withColumns({f"{c}_before": F.col(f"{c}_before") - F.col(f"_{c}") for c in sums})

    by_score = rows.groupBy(*keys, "score").agg(F.sum("hit").alias("p"), F.sum(F.col("one") - F.col("hit")).alias("n"))
    pairs = within(running(by_score, [*keys, "score"], "n"), "n").groupBy(*keys).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
        F.sum(F.col("p") * F.col("n_before")).alias("concordant"), F.sum(F.col("p") * F.col("n")).alias("tied"),
    )
    steps = within(running(rows.select(*keys, "score", "name", "hit", "one"), [*keys, F.desc("score"), "name"], "hit", "one"), "hit", "one")
    precision = steps.where("hit = 1").groupBy(*keys).agg(F.round(F.avg((F.col("hit_before") + 1) / (F.col("one_before") + 1)), 6).alias("average_precision"))
    out = pairs.withColumn("pairs", F.col("positives") * F.col("negatives"))
    out = out.withColumn("discordant", F.col("pairs") - F.col("concordant") - F.col("tied"))
    auroc = F.round(F.try_divide(F.col("concordant") + F.col("tied") * 0.5, F.col("pairs")), 6)
    joined = out.join(precision, keys, "left") if keys else out.join(precision, F.lit(True), "left")
    return joined.withColumn("auroc", auroc)


def operating_points(df: DataFrame, negative: float = NEGATIVE, provisional: bool = False, explore: bool = False) -> DataFrame:
    """Confusion counts and rates at every positive threshold: a grid of twentieths and the scores themselves; `provisional` and
    `explore` as in classify().
    Each report has one outcome at or above the threshold and one below it, so all thresholds come from sums
    over scores in order, without judging reports once for each threshold."""
    judged = classify(df, 1.0, negative, provisional, explore)
    low = F.when(F.size(_reasons(explore)) > 0, "abstain")
    below = (
        low.when(F.lit(provisional) & yes("provisional_positive"), "positive")
        .when(F.lit(explore) & F.col("exploratory_eligible"), "positive")
        .when(yes("stable_negative_support") & (F.col("stable_negative_score") <= negative), "negative")
        .when(F.col("score") <= negative, "negative")
        .otherwise("abstain")
    )
    above = low.otherwise("positive")
    rows = judged.where(F.col("expected").isin("positive", "negative")).select("expected", "score", below.alias("below"), above.alias("above"))
    one = lambda c, e, p: F.sum(((F.col("expected") == e) & (F.col(c) == p)).cast("int"))
    names = {"tp": ("positive", "positive"), "fp": ("negative", "positive"), "tn": ("negative", "negative"), "fn": ("positive", "negative")}
    by_score = rows.groupBy("score").agg(*(one(c, *e).alias(f"{n}_{c}") for c in ("below", "above") for n, e in names.items()), F.count("*").alias("labeled_here"))
    grid = df.sparkSession.createDataFrame([(k / 20.0,) for k in range(21)], "t double")
    own = rows.where(F.col("score").between(0.0, 1.0)).select(F.round("score", 6).alias("t"))
    marks = grid.unionByName(own).distinct().where((F.col("t") > negative) & (F.col("t") <= 1.0))
    # thresholds and scores in one order; a threshold comes before scores equal to it
    events = by_score.select(F.col("score").alias("v"), F.lit(1).alias("is_score"), *by_score.columns[1:]).unionByName(marks.select(F.col("t").alias("v"), F.lit(0).alias("is_score")), allowMissingColumns=True)
    cells = [f"{n}_{side}" for n in names for side in ("below", "above")]
    events = events.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in (*cells, "labeled_here")})
    totals = events.agg(*(F.sum(c).alias(f"{c}_all") for c in (*cells, "labeled_here")))
    so_far = running(events, [F.col("v").asc_nulls_first(), "is_score"], *cells)
    # a threshold has nothing of its own: what is not before it comes after it
    counts = so_far.join(F.broadcast(totals), F.lit(True)).select(
        "v", "is_score", *((F.col(f"{n}_below_before") + F.col(f"{n}_above_all") - F.col(f"{n}_above_before")).alias(n) for n in names), F.col("labeled_here_all").alias("labeled")
    )
    counts = counts.where("is_score = 0").select(F.col("v").alias("positive_threshold"), *names, "labeled")
    return rates(counts.withColumn("abstain", F.col("labeled") - F.col("tp") - F.col("fp") - F.col("tn") - F.col("fn")))


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with `rank`, from 1 over all rows in an order. Rows are sorted over ranges and numbered within each; what
    comes together is one count for each range."""
    # an id holds the number of the range above its lowest 33 bits and the place in the range in them
    rows = durable(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before, sums = 0, []
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):
        sums.append((r[0], before))
        before += r[1]
    starts = df.sparkSession.createDataFrame(sums, "_part long, _before long")
    joined = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn("rank", F.col("_before") + place + 1).drop("_id", "_part", "_before")


def ranking(df: DataFrame) -> DataFrame:
    """name, score, rank, confidence, confidence_label, evidence_coverage, group_score_range and reasons (sorted) of every report
    with a valid score, most anomalous first; abstain_reasons and vote_status too where df has them (classified reports).
    Reasons are those of fusion (reason_codes, where df has them) and what lowers confidence."""
    rows = ranking_confidence(df.where(F.col("score").between(0.0, 1.0)))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    apart, covered = F.when(F.col("group_score_range").isNotNull(), unit("group_score_range")), F.coalesce(F.when(F.col("evidence_coverage").isNotNull(), unit("evidence_coverage")), F.lit(0.0))
    mixed = F.col("vote_status") == "mixed-directional-votes" if "vote_status" in df.columns else F.lit(False)
    own = F.array_compact(F.array(
        F.when(apart.isNull(), "missing-group-range"), F.when(apart > GROUP_RANGE, "independent-evidence-disagrees"),
        F.when(covered < 0.20, "insufficient-evidence-coverage"), F.when(mixed, "mixed-directional-votes"),
    ))
    codes = F.coalesce("reason_codes", F.array().cast("array<string>")) if "reason_codes" in df.columns else F.array().cast("array<string>")
    rows = rows.select(
        "name", F.round("score", 6).alias("score"), "confidence", "confidence_label", F.round(covered, 6).alias("evidence_coverage"), F.round(apart, 6).alias("group_score_range"),
        F.array_sort(F.array_distinct(F.concat(codes, own))).alias("reasons"), *(c for c in ("abstain_reasons", "vote_status") if c in df.columns),
    )
    return ranked(rows, F.desc("score"), "name")


def ranking_coverage(df: DataFrame) -> DataFrame:
    """How many of the reports are ranked."""
    counts = df.agg(F.count_if(F.col("score").between(0.0, 1.0)).alias("ranked_report_count"), F.count("*").alias("report_count"))
    return counts.withColumn("fraction", metric(F.col("ranked_report_count"), F.col("report_count")))


def forced(score: Column, threshold: float) -> Column:
    """A bucket without any safeguard."""
    return F.when(valid(score).isNotNull(), F.when(score >= threshold, "synthetic").otherwise("original"))


#: The views of its evidence that a report can be judged by.
EVIDENCE_SETS = ("all", "legacy", "new_additions", "directional")


def evidence_view(fused: DataFrame, directional: DataFrame, evidence_set: str = "all") -> DataFrame:
    """clip_id, evidence_set, score and label by which a report is judged: those of one of the fused sets (clip_id,
    evidence_set, score, label), or the directional score (clip_id, score) with its label."""
    if evidence_set not in EVIDENCE_SETS:
        raise ValueError(f"evidence_set must be one of {', '.join(EVIDENCE_SETS)}")
    if evidence_set != "directional":
        return fused.where(F.col("evidence_set") == evidence_set).select("clip_id", "evidence_set", "score", "label")
    label = F.when(F.col("score").isNotNull(), F.lit("directional-anomaly-score"))
    return directional.select("clip_id", F.lit(evidence_set).alias("evidence_set"), "score", label.alias("label"))


def forced_metrics(df: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Counts and rates of forced buckets (expected, score), for each of keys; rates over nothing are null."""
    rows = df.withColumn("bucket", forced(F.col("score"), threshold))
    hit = lambda e, b: F.count_if((F.col("expected") == e) & (F.col("bucket") == b))
    known = F.coalesce(F.col("expected").isin("positive", "negative"), F.lit(False))
    counts = rows.groupBy(*(keys or [])).agg(
        hit("positive", "synthetic").alias("true_positive"), hit("negative", "synthetic").alias("false_positive"), hit("negative", "original").alias("true_negative"),
        hit("positive", "original").alias("false_negative"), F.count_if(~known | F.col("bucket").isNull()).alias("unscored"), F.count_if(known).alias("labeled"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))
    rates_ = {"coverage": metric(tp + fp + tn + fn, F.col("labeled")), "sensitivity": metric(tp, tp + fn), "specificity": metric(tn, tn + fp)}
    return counts.withColumns(rates_).drop("labeled")


def class_medians(df: DataFrame) -> DataFrame:
    rows = df.where(F.col("score").between(0.0, 1.0))
    of = lambda e: F.round(F.percentile(F.when(F.col("expected") == e, F.col("score")), F.lit(0.5)), 6)
    out = rows.agg(of("positive").alias("positive_median"), of("negative").alias("negative_median"))
    return out.withColumn("gap", F.round(F.col("positive_median") - F.col("negative_median"), 6))


def diagnostics(rows: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """How each branch's scores (name, expected, branch, score) tell the classes apart: rank metrics, class medians, and
    how many labelled reports have no valid score of it, whether the report lacks the branch, its score or a number there.
    Every branch that any report names has a row. reports (name, expected): all that are judged; those in `rows` without."""
    known = F.col("expected").isin("positive", "negative")
    labelled = (rows.select("name", "expected").distinct() if reports is None else reports).agg(F.count_if(known).alias("labeled"))
    ok = known & F.col("score").between(0.0, 1.0)
    of = lambda e: F.round(F.percentile(F.when(ok & (F.col("expected") == e), F.col("score")), F.lit(0.5)), 6)
    found = rows.groupBy("branch").agg(of("positive").alias("positive_median"), of("negative").alias("negative_median"), F.count_if(ok).alias("valid"))
    ranks = rank_metrics(rows, ["branch"]).select("branch", "positives", "negatives", "concordant", "tied", "auroc", "average_precision")
    out = found.join(ranks, "branch", "left").join(F.broadcast(labelled), F.lit(True))
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("positives", "negatives", "concordant", "tied")})
    out = out.withColumns({"missing_or_invalid": F.col("labeled") - F.col("valid"), "gap": F.round(F.col("positive_median") - F.col("negative_median"), 6)})
    return out.drop("valid", "labeled")


def audit(df: DataFrame, positive: float = POSITIVE, negative: float = NEGATIVE) -> DataFrame:
    """The whole evaluation as one row of nested structs: thresholds, metrics, ranking and class medians. What
    goes by report (decisions) or by threshold (operating points) stays a table of its own."""
    judged = classify(df, positive, negative)
    counts = confusion(judged)
    ranks = rank_metrics(judged.select("name", "expected", "score"), [])
    medians = class_medians(df)
    kinds = judged.agg(
        F.count_if(F.col("decision_kind") == "provisional-positive").alias("provisional_positive_count"),
        F.count_if(~F.coalesce(F.col("expected").isin("positive", "negative"), F.lit(False))).alias("unlabeled_count"),
    )
    one = lambda d, name: d.select(F.struct(*d.columns).alias(name))
    rows = one(counts, "metrics").join(F.broadcast(one(ranks, "ranking")), F.lit(True), "left")
    rows = rows.join(F.broadcast(one(medians, "medians")), F.lit(True), "left").join(F.broadcast(one(kinds, "counts")), F.lit(True), "left")
    bounds = F.struct(F.lit(positive).alias("positive"), F.lit(negative).alias("negative"))
    return rows.select(F.lit("palisade-evaluation-1").alias("schema_version"), bounds.alias("thresholds"), "metrics", "ranking", "medians", "counts")


def sections(df: DataFrame, branches: DataFrame, positive: float = POSITIVE, negative: float = NEGATIVE) -> dict[str, DataFrame]:
    """The whole evaluation as tables by name: its summary (one row of structs), each report's decision, the sweeps with
    and without provisional and exploratory decisions, the ranking of all reports and the branches' diagnostics. Each stays distributed.
    branches: name, expected, branch, score."""
    judged = classify(df, positive, negative)
    return {
        "summary": audit(df, positive, negative),
        "decisions": judged.select("name", "expected", "score", "predicted", "decision_kind", "abstain_reasons"),
        "operating_points": operating_points(df, negative),
        "consensus_operating_points": operating_points(df, negative, provisional=True),
        "exploratory_operating_points": operating_points(df, negative, provisional=True, explore=True),
        "ranking": ranking(judged),
        "branch_diagnostics": diagnostics(branches, df.select("name", "expected")),
    }
