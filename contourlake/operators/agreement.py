"""Cells that agree: consensus of their displacements and turns, and two rules for counting them.

All in DataFrame operations over ``registrations`` (see ``placement``), for any number of pairs at once.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refusal, number, one_of, whole
from .placement import best_over_angles


@dataclass(frozen=True)
class AgreementRule:
    down_threshold: float
    across_threshold: float
    rotation_threshold_deg: float
    correlation_threshold: float
    consensus: str
    translation_bin: float | None = None
    rotation_bin_deg: float | None = None


@dataclass(frozen=True)
class HighAgreementRule:
    down_threshold: float
    across_threshold: float
    correlation_threshold: float
    consensus: str
    high_tolerance: int
    translation_bin: float | None = None


def check_rule(p) -> None:
    for name in ("down_threshold", "across_threshold", *(["rotation_threshold_deg"] if isinstance(p, AgreementRule) else [])):
        number(getattr(p, name), name, least=0)
    number(p.correlation_threshold, "correlation_threshold", least=-1, most=1)
    one_of(p.consensus, "consensus", ("median", "histogram-mode"))
    bins = [p.translation_bin] + ([p.rotation_bin_deg] if isinstance(p, AgreementRule) else [])
    if p.consensus == "median":
        if any(b is not None for b in bins):
            raise Refusal("unused-parameter", "bins belong to histogram-mode")
    else:
        for b in bins:
            number(b, "bin", above=0)
    if isinstance(p, HighAgreementRule):
        whole(p.high_tolerance, "high_tolerance", least=0)


def record(search, rule) -> dict:
    """What a comparison used: its method, version and every parameter by dotted name, sorted."""
    from dataclasses import asdict

    method = "high-congruent-matching-cells" if isinstance(rule, HighAgreementRule) else "congruent-matching-cells"
    values = {f"search.{k}": v for k, v in asdict(search).items()} | {f"rule.{k}": v for k, v in asdict(rule).items()}
    return {"method": method, "version": "1", "parameters": dict(sorted(values.items()))}


def score_pairs(pairs: DataFrame, search, rule) -> tuple[DataFrame, dict]:
    """Registration and either rule over a table of pairs, with the record of the comparison."""
    from .placement import registrations

    by_angle = registrations(pairs, search)
    if isinstance(rule, HighAgreementRule):
        from ..functions.heights import angles

        return score_high(by_angle, rule, angles(search.rotation_range_deg, search.rotation_step_deg)), record(search, rule)
    return score(by_angle, rule), record(search, rule)


def consensus_median(matches: DataFrame, keys: list[str], columns: dict[str, float | None]) -> DataFrame:
    return matches.groupBy(*keys).agg(*(F.median(c).alias(f"{c}_at") for c in columns))


def consensus_mode(matches: DataFrame, keys: list[str], columns: dict[str, float | Column]) -> DataFrame:
    """Median of the members of the fullest bin, the lowest of equals; bins are anchored at zero."""
    out = matches.select(*keys).distinct()
    for column, width in columns.items():
        binned = matches.withColumn("_bin", F.floor(F.col(column) / (width if isinstance(width, Column) else F.lit(float(width)))))
        counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.median(column).alias(f"{column}_at"))
        rank = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), "_bin")
        out = out.join(counts.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").select(*keys, f"{column}_at"), keys)
    return out


def consensus(matches: DataFrame, p, keys: list[str]) -> DataFrame:
    columns: dict[str, float | None] = {"down": p.translation_bin, "across": p.translation_bin}
    if isinstance(p, AgreementRule):
        columns["angle_deg"] = p.rotation_bin_deg
    return (consensus_median if p.consensus == "median" else consensus_mode)(matches, keys, columns)


def _near(column: str, limit: float | Column) -> Column:
    return F.abs(F.col(column) - F.col(f"{column}_at")) <= limit


def judged(matches: DataFrame, p: AgreementRule) -> DataFrame:
    """Each cell's best placement with the four conditions and whether it meets all."""
    check_rule(p)
    return _tested(matches.join(consensus(matches, p, ["pair_id"]), "pair_id"), p)


def _tested(joined: DataFrame, p: AgreementRule) -> DataFrame:
    """Limits of ``p`` may be columns."""
    tests = {
        "near_down": _near("down", p.down_threshold),
        "near_across": _near("across", p.across_threshold),
        "near_rotation": _near("angle_deg", p.rotation_threshold_deg),
        "correlated": F.col("correlation") >= p.correlation_threshold,
    }
    out = joined.withColumns(tests)
    return out.withColumn("congruent", F.expr("near_down AND near_across AND near_rotation AND correlated"))


def _cells(condition: str) -> Column:
    return F.array_sort(F.collect_list(F.when(F.expr(condition), F.struct("cell_r", "cell_c"))))


def score(by_angle: DataFrame, p: AgreementRule) -> DataFrame:
    """One row for each pair: counts, failures of each kind (they overlap), consensus and the congruent cells."""
    return _counted(judged(best_over_angles(by_angle), p), "pair_id")


def score_each(matches: DataFrame) -> DataFrame:
    """``score`` by ``cell`` of best placements that bring a cell and, as columns, the values of its ``AgreementRule``, checked before."""
    medians = consensus_median(matches.where("consensus = 'median'"), ["cell"], {"down": None, "across": None, "angle_deg": None})
    width = {"down": F.col("translation_bin"), "across": F.col("translation_bin"), "angle_deg": F.col("rotation_bin_deg")}
    modes = consensus_mode(matches.where("consensus = 'histogram-mode'"), ["cell"], width)
    rule = AgreementRule(*(F.col(f.name) for f in fields(AgreementRule)))
    return _counted(_tested(matches.join(medians.unionByName(modes), "cell"), rule), "cell")


def _counted(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(
        F.count_if("congruent").alias("congruent"),
        F.count("*").alias("eligible"),
        F.count_if(~F.col("congruent")).alias("discarded"),
        F.count_if(~F.col("near_down")).alias("failed_down"),
        F.count_if(~F.col("near_across")).alias("failed_across"),
        F.count_if(~F.col("near_rotation")).alias("failed_rotation"),
        F.count_if(~F.col("correlated")).alias("failed_correlation"),
        F.first("down_at").alias("down_at"),
        F.first("across_at").alias("across_at"),
        F.first("angle_deg_at").alias("angle_deg_at"),
        _cells("congruent").alias("cells"),
    )


def angle_counts(by_angle: DataFrame, p: HighAgreementRule) -> DataFrame:
    """Every row with whether its cell agrees with its own angle's consensus."""
    check_rule(p)
    joined = by_angle.join(consensus(by_angle, p, ["pair_id", "angle_deg"]), ["pair_id", "angle_deg"])
    return joined.withColumn("agrees", _near("down", p.down_threshold) & _near("across", p.across_threshold) & (F.col("correlation") >= p.correlation_threshold))


def score_high(by_angle: DataFrame, p: HighAgreementRule, angles: list[float] | None = None) -> DataFrame:
    """One row for each pair: cells that agree at any angle whose count is within the tolerance of the peak.

    ``angles`` are those searched, so that one without any placement counts none; by default those present.
    """
    marked = angle_counts(by_angle, p)
    counts = marked.groupBy("pair_id", "angle_deg").agg(F.count_if("agrees").alias("n"))
    if angles is not None:
        every = by_angle.select("pair_id").distinct().withColumn("angle_deg", F.explode(F.array(*map(F.lit, angles))))
        counts = every.join(counts, ["pair_id", "angle_deg"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    peak = counts.groupBy("pair_id").agg(F.max("n").alias("peak"))
    high = counts.join(peak, "pair_id").where((F.col("peak") > 0) & (F.col("n") >= F.col("peak") - p.high_tolerance))
    agreeing = marked.where("agrees").join(high.select("pair_id", "angle_deg"), ["pair_id", "angle_deg"]).groupBy("pair_id").agg(F.array_sort(F.collect_set(F.struct("cell_r", "cell_c"))).alias("cells"))
    at = high.groupBy("pair_id").agg(F.array_sort(F.collect_list("angle_deg")).alias("high_angles"))
    eligible = by_angle.groupBy("pair_id").agg(F.count_distinct("cell_r", "cell_c").alias("eligible"))
    out = eligible.join(peak, "pair_id").join(at, "pair_id", "left").join(agreeing, "pair_id", "left")
    none = F.array().cast("array<struct<cell_r:int,cell_c:int>>")
    out = out.withColumn("cells", F.coalesce("cells", none)).withColumn("high_angles", F.coalesce("high_angles", F.array().cast("array<double>")))
    return out.select("pair_id", F.size("cells").cast("long").alias("congruent"), "eligible", (F.col("eligible") - F.size("cells")).alias("discarded"), "peak", "high_angles", "cells")


def disagreements(original: DataFrame, high: DataFrame) -> DataFrame:
    """Cells counted by one rule only, for each pair, in order."""
    both = original.select("pair_id", F.col("cells").alias("a")).join(high.select("pair_id", F.col("cells").alias("b")), "pair_id")
    return both.select("pair_id", F.array_sort(F.array_except("a", "b")).alias("only_original"), F.array_sort(F.array_except("b", "a")).alias("only_high"))
