"""Scores as evidence: reference distributions, bounded log10 likelihood ratios, source-level bootstrap.

``comparisons``: set_name, n_cells (the support is 0..n_cells), score, source_a, source_b. A comparison is
of one source if both ends are equal. Counts and ratios are aggregates; nothing is gathered but final rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Refusal, one_of, whole
from ..plans.scratch import cut, kept

LEVEL = 0.95


def same_source() -> Column:
    return F.col("source_a") == F.col("source_b")


def proposition() -> Column:
    return F.when(same_source(), "same-source").otherwise("different-source")


def _ends(comparisons: DataFrame) -> DataFrame:
    """A row for each distinct end of each comparison."""
    return comparisons.withColumn("proposition", proposition()).withColumn("source", F.explode(F.array_distinct(F.array("source_a", "source_b"))))


def proposition_counts(comparisons: DataFrame) -> DataFrame:
    """Pairs and distinct sources (of either end) of each set under each proposition."""
    pairs = comparisons.groupBy("set_name", proposition().alias("proposition")).agg(F.count("*").alias("pairs"))
    sources = _ends(comparisons).groupBy("set_name", "proposition").agg(F.count_distinct("source").alias("sources"))
    return pairs.join(sources, ["set_name", "proposition"])


def score_distribution(comparisons: DataFrame) -> DataFrame:
    """Unsmoothed frequency of every score of the support under each proposition; unseen ones have none."""
    seen = comparisons.groupBy("set_name", "n_cells", proposition().alias("proposition"), "score").agg(F.count("*").alias("n"))
    total = seen.groupBy("set_name", "n_cells", "proposition").agg(F.sum("n").alias("total"))
    support = total.withColumn("score", F.explode(F.sequence(F.lit(0), F.col("n_cells").cast("int"))))
    return support.join(seen.drop("n_cells"), ["set_name", "proposition", "score"], "left").select("set_name", "proposition", "score", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("frequency"))


def diagnostics(comparisons: DataFrame) -> DataFrame:
    """Range and number of scores, the share of the most frequent source, and of the support that is unseen."""
    own = comparisons.groupBy("set_name", proposition().alias("proposition")).agg(F.min("score").alias("least"), F.max("score").alias("most"), F.count_distinct("score").alias("distinct_scores"), F.count("*").alias("pairs"), F.max("n_cells").alias("n_cells"))
    each = _ends(comparisons).groupBy("set_name", "proposition", "source").agg(F.count("*").alias("n")).groupBy("set_name", "proposition").agg(F.max("n").alias("largest"))
    joined = own.join(each, ["set_name", "proposition"])
    return joined.select("set_name", "proposition", "least", "most", "distinct_scores", (F.col("largest") / F.col("pairs")).alias("largest_source_share"), (F.lit(1) - F.col("distinct_scores") / (F.col("n_cells") + 1)).alias("unobserved_share"))


def supportable_range(comparisons: DataFrame) -> DataFrame:
    """The most that so many sources can support: minus log10 of the same-source ones to log10 of the others."""
    counts = proposition_counts(comparisons)

    def sources(name: str) -> Column:
        return F.max(F.when(F.col("proposition") == name, F.col("sources")))

    return counts.groupBy("set_name").agg((-F.log10(sources("same-source"))).alias("low"), F.log10(sources("different-source")).alias("high"))


def hold_within(value: Column, low: Column, high: Column) -> Column:
    """Clamped, at either bound inclusively; a value that isn't a number is refused."""
    clamped = F.when(value >= high, high).when(value <= low, low).otherwise(value)
    return F.when(F.isnan(value), F.raise_error(F.lit("not-a-number")).cast("double")).otherwise(clamped)


def _log_ratio(at_same: Column, same: Column, at_other: Column, other: Column) -> Column:
    """log10 of the ratio of frequencies: infinite if one is zero, null if both are or a proposition is empty."""
    known = (same > 0) & (other > 0) & ((at_same > 0) | (at_other > 0))
    ratio = F.log10(F.try_divide(F.try_divide(at_same, same), F.try_divide(at_other, other)))
    return F.when(known, F.when(at_same == 0, F.lit(-math.inf)).when(at_other == 0, F.lit(math.inf)).otherwise(ratio))


def _weighted(rows: DataFrame, keys: list[str], score: int, same_weight: Column, other_weight: Column) -> DataFrame:
    def total(condition: Column, weight: Column) -> Column:
        return F.sum(F.when(condition, weight).otherwise(F.lit(0))).cast("double")

    same, hit = same_source(), F.col("score") == score
    sums = rows.groupBy(*keys).agg(total(same & hit, same_weight).alias("a"), total(same, same_weight).alias("b"), total(~same & hit, other_weight).alias("c"), total(~same, other_weight).alias("d"))
    return sums.select(*keys, _log_ratio(*(F.col(x) for x in "abcd")).alias("log_ratio"))


def log_ratio_point(comparisons: DataFrame, score: int) -> DataFrame:
    return _weighted(comparisons, ["set_name"], score, F.lit(1), F.lit(1))


def cumulated(rows: DataFrame, within: list[str], order: list[str], weight: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``weight`` over the rows of the same ``within`` that come earlier by ``order``.

    Rows are dealt by ranges of (within, order) and kept, so that no task holds a whole group: each range adds
    up its own, and what earlier ranges hold is added to it. Sums of ranges number the ranges and groups
    together at most. Weights must not be null; rows with equal keys lie in one range, so group those first.
    """
    keys = [F.col(c) for c in (*within, *order)]
    held = cut(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy(*within, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*within, "_range").agg(F.sum(weight).alias("_sum"))
    earlier = sums.select(*within, "_range", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_earlier"))
    own = held.withColumn("_own", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return own.join(earlier, [*within, "_range"]).withColumn("before", F.col("_own") + F.col("_earlier")).drop("_range", "_own", "_earlier")


def numbered(sources: DataFrame) -> DataFrame:
    """(source, k): the distinct sources, numbered from 0 in their order. Null isn't a source."""
    each = sources.where("source IS NOT NULL").select("source").distinct().withColumn("_one", F.lit(1).cast("long"))
    return cumulated(each, [], ["source"], "_one").select("source", F.col("before").alias("k"))


def hashed_draws(spark: SparkSession, sources: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(resample, source, m): as many draws as sources for each resample, by MD5 of (seed, resample, draw).

    A draw is a function of its number alone, so any task makes any of them, and the same again; draws are
    added up where they are made. The same in any SQL that has MD5. ``sources``: one column ``source``;
    they are numbered in their order.
    """
    places = numbered(sources)
    n = places.count()
    parts = max(spark.sparkContext.defaultParallelism, (resamples * n >> 22) + 1)
    draws = spark.range(0, resamples * n, 1, parts).select(F.expr(f"id div {max(n, 1)}").cast("int").alias("resample"), (F.col("id") % max(n, 1)).alias("draw"))
    text = F.concat_ws("-", F.lit(str(seed)), F.col("resample").cast("string"), F.col("draw").cast("string"))
    k = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    counted = draws.groupBy("resample", k.alias("k")).agg(F.count("*").alias("m"))
    return counted.join(places, "k").select("resample", "source", "m")


#: Draws of NumPy's generator that the driver makes at most: it has one sequence, so no task can begin inside it.
SEQUENTIAL = 1 << 20


def generator_draws(spark: SparkSession, sources: DataFrame, resamples: int, seed: int) -> DataFrame:
    """The same from NumPy's generator. The driver makes these; more than ``SEQUENTIAL`` are refused, for which there is ``hashed_draws``."""
    each = sources.where("source IS NOT NULL").select("source").distinct().limit(SEQUENTIAL // resamples + 1)
    ordered = sorted(r[0] for r in each.collect())
    if len(ordered) * resamples > SEQUENTIAL:
        raise Refusal("too-many-draws", f"over {SEQUENTIAL} by one sequence; take draws='hashed'")
    rng, rows = np.random.default_rng(seed), []
    for resample in range(resamples):
        k, m = np.unique(rng.integers(0, len(ordered), size=len(ordered)), return_counts=True)
        rows += [(resample, ordered[i], int(n)) for i, n in zip(k.tolist(), m.tolist(), strict=True)]
    return spark.createDataFrame(rows, "resample int, source string, m long")


#: Resamples whose weights of a source travel as one array.
RESAMPLES = 256
#: Sources of a group, and pairs of sources for each pair of groups, that a task holds at most (about: groups are dealt by hash).
SOURCES = 1 << 15
PAIRS = 1 << 18
#: Pairs of sources that are weighed at a time.
AT_ONCE = 2048

_SUMS = pa.schema([("set_name", pa.string()), ("resample", pa.int32()), *((x, pa.int64()) for x in "abcd")])
_SUMS_DDL = "set_name string, resample int, a long, b long, c long, d long"


def _matrix(weights: pa.Table) -> np.ndarray:
    """Weights of sources (rows) in the resamples of a block."""
    m = weights.column("m").combine_chunks()
    sizes = m.value_lengths().to_numpy()
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = m.flatten().to_numpy()
    return out


def _weighed(size: int):
    def weigh(pairs: pa.Table, weights: pa.Table) -> pa.Table:
        out = [_SUMS.empty_table()]
        if pairs.num_rows and weights.num_rows:
            (first, ma), (second, mb) = ((x.column("source"), _matrix(x)) for x in (weights.filter(pc.equal(weights.column("side"), k)) for k in (0, 1)))
            width = max(ma.shape[1], mb.shape[1])
            ma, mb = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (ma, mb))
            met = pairs.filter(pc.and_(pc.is_in(pairs.column("source_a"), value_set=first), pc.is_in(pairs.column("source_b"), value_set=second)))
            sets = met.column("set_name").combine_chunks().dictionary_encode()
            ia, ib = (pc.index_in(met.column(c), value_set=v).to_numpy() for c, v in (("source_a", first), ("source_b", second)))
            same, code = pc.equal(met.column("source_a"), met.column("source_b")).to_numpy(), sets.indices.fill_null(-1).to_numpy()
            counts = np.stack([met.column(c).to_numpy() for c in ("hit", "n")]).astype(float)
            order = np.lexsort((same, code))
            ends = np.append(np.flatnonzero(np.diff(code[order])) + 1, len(order)) if len(order) else []
            for begin, end in zip([0, *ends], ends, strict=False):
                sums = np.zeros((4, width))
                for at in range(begin, end, AT_ONCE):
                    k = order[at : min(end, at + AT_ONCE)]
                    w, alone = ma[ia[k]], np.searchsorted(same[k], True)
                    w[:alone] *= mb[ib[k[:alone]]]  # a comparison of one source weighs its draws once
                    sums[2:] += counts[:, k[:alone]] @ w[:alone]
                    sums[:2] += counts[:, k[alone:]] @ w[alone:]
                drawn = np.flatnonzero(sums.any(0))
                name = sets.dictionary[code[order[begin]]].as_py() if code[order[begin]] >= 0 else None
                resample = pairs.column("block")[0].as_py() * size + drawn
                out.append(pa.table([pa.array([name] * len(drawn), pa.string()), pa.array(resample, pa.int32()), *(pa.array(np.rint(x[drawn]).astype(np.int64)) for x in sums)], schema=_SUMS))
        return pa.concat_tables(out)

    return weigh


def tallied(comparisons: DataFrame, score: int) -> DataFrame:
    """(set_name, source_a, source_b, n, hit): how many comparisons each pair of sources has, and how many at the score. Written once."""
    hit = F.count_if(F.col("score") == score).alias("hit")
    return kept(comparisons.groupBy("set_name", "source_a", "source_b").agg(F.count("*").alias("n"), hit), "pairs")


def resampled(comparisons: DataFrame, score: int, draws: DataFrame) -> DataFrame:
    """(set_name, resample, log_ratio): null where a resample has no ratio. A comparison weighs its sources' draws."""
    return resampled_pairs(tallied(comparisons, score), draws)


def resampled_pairs(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """``resampled`` of what ``tallied`` gives.

    Sources are dealt to groups by hash. A pair of sources goes, once for each block of ``RESAMPLES`` resamples, to
    its pair of groups, without weights; weights, as an array for each source and block, go to each pair of groups
    with that source. So what is shuffled is a narrow row for each distinct pair and 2 x sources x groups arrays;
    groups number the root of pairs / ``PAIRS``, or sources / ``SOURCES`` if that is more. A task holds what
    belongs to one pair of groups, and gives sums only; these are exact up to 2**53.
    """
    block, at = F.floor(F.col("resample") / RESAMPLES).cast("int").alias("block"), (F.col("resample") % RESAMPLES).cast("int")
    drawn = draws.groupBy("source", block).agg(F.map_from_entries(F.collect_list(F.struct(at, F.col("m")))).alias("_m"))
    weights = kept(drawn.select("source", "block", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_m"))), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0)).cast("int")).alias("m")), "weights")
    groups = max(1, math.ceil(math.sqrt(rows.count() / PAIRS)), math.ceil(weights.count() / SOURCES))

    def group(source: str) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(groups)).cast("int")

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    sides = weights.select("*", F.lit(0).alias("side"), group("source").alias("group_a"), every_group.alias("group_b")).unionByName(weights.select("*", F.lit(1).alias("side"), group("source").alias("group_b"), every_group.alias("group_a")))
    blocks = weights.select(F.col("block").alias("_k")).distinct().select(F.col("_k").alias("block"))
    pairs = rows.where("source_a IS NOT NULL AND source_b IS NOT NULL").select("*", group("source_a").alias("group_a"), group("source_b").alias("group_b")).crossJoin(F.broadcast(blocks))
    keys = ["block", "group_a", "group_b"]
    parts = pairs.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(_weighed(RESAMPLES), _SUMS_DDL)
    sums = cut(parts.groupBy("set_name", "resample").agg(*(F.sum(x).cast("double").alias(x) for x in "abcd")))  # so that pairs are weighed once
    found = sums.select("set_name", "resample", _log_ratio(*(F.col(x) for x in "abcd")).alias("log_ratio"))
    every = weights.select("block", F.posexplode("m").alias("_at", "_n")).where("_n > 0").select((F.col("block") * RESAMPLES + F.col("_at")).alias("resample")).distinct()
    cells = rows.select("set_name").distinct().crossJoin(every)  # sets times resamples: a row of the result for each
    return cells.join(found, ["set_name", "resample"], "left")


def interval(ratios: DataFrame) -> DataFrame:
    """Order statistics of the resamples that have a ratio, without interpolation, and how many have none.

    Equal ratios are one row with a count; the ranks asked for are found by sums over ranges of ratios.
    """
    tail = (1.0 - LEVEL) / 2.0
    sizes = ratios.groupBy("set_name").agg(F.count("log_ratio").alias("_usable"), F.count_if(F.col("log_ratio").isNull()).alias("unusable"))
    counts = ratios.where("log_ratio IS NOT NULL").groupBy("set_name", "log_ratio").agg(F.count("*").alias("_n"))
    last = F.col("_usable") - 1
    placed = cumulated(counts, ["set_name"], ["log_ratio"], "_n").join(sizes, "set_name")

    def at(rank: Column, name: str) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("_n")), F.col("log_ratio"))).alias(name)

    found = placed.groupBy("set_name").agg(at(F.floor(F.lit(tail) * last), "low"), at(F.ceil(F.lit(1.0 - tail) * last), "high"))
    return sizes.join(found, "set_name", "left").select("set_name", "low", "high", "unusable")


def touching(comparisons: DataFrame, evaluated: tuple[str, str]) -> DataFrame:
    """Comparisons that share a source with an evaluated pair."""
    wanted = [F.lit(x) for x in evaluated]
    return comparisons.where(F.col("source_a").isin(*wanted) | F.col("source_b").isin(*wanted))


def check_disjoint(comparisons: DataFrame, evaluated: tuple[str, str]) -> None:
    if touching(comparisons, evaluated).limit(1).count():
        raise Refusal("reference-touches-the-pair", " and ".join(evaluated))


@dataclass(frozen=True)
class Propositions:
    numerator: str
    denominator: str
    population: str

    def __post_init__(self):
        for name in ("numerator", "denominator", "population"):
            value = getattr(self, name)
            if not isinstance(value, str) or not value.strip():
                raise Refusal("blank-proposition", name)
        if self.numerator == self.denominator:
            raise Refusal("equal-propositions", self.numerator)


@dataclass(frozen=True)
class LogRatio:
    """A held ratio with all that it is conditional on. It can be printed whole, and not as a bare number."""

    propositions: Propositions
    evaluated: tuple[str, str]
    score: int
    raw: float
    value: float
    low: float
    high: float
    width: float
    bounds: tuple[float, float]
    counts: dict
    resamples: int
    unusable: int
    seed: int

    def __format__(self, spec: str) -> str:
        if spec:
            raise Refusal("quoted-alone", "a ratio is stated with its interval, bounds and propositions")
        return str(self)

    def __str__(self) -> str:
        held = "" if self.raw == self.value else f" (held at the bound the reference set supports; unheld {self.raw})"
        return (
            f"log10 ratio {self.value}{held}, {LEVEL:.0%} interval {self.low} to {self.high} from {self.resamples} resamples of sources "
            f"({self.unusable} without a ratio, seed {self.seed}); score {self.score} of {self.evaluated}; "
            f"{self.propositions.numerator} against {self.propositions.denominator} in {self.propositions.population}; {self.counts}"
        )


def _held(value: float, bounds: tuple[float, float]) -> float:
    if value != value:
        raise Refusal("not-a-number", "ratio")
    return bounds[1] if value >= bounds[1] else bounds[0] if value <= bounds[0] else value


def log_ratio(comparisons: DataFrame, score: int, *, propositions: Propositions, evaluated: tuple[str, str], resamples: int, seed: int, draws: str = "generator") -> LogRatio:
    """The bounded log ratio of one set at a score, with its bootstrap interval over sources.

    ``draws``: by NumPy's ``generator``, as published figures were made, or ``hashed``, which has no limit.
    """
    made = {"generator": generator_draws, "hashed": hashed_draws}[one_of(draws, "draws", ("generator", "hashed"))]
    whole(resamples, "resamples", least=2)
    whole(seed, "seed")
    if not isinstance(propositions, Propositions):
        raise Refusal("no-propositions")
    check_disjoint(comparisons, evaluated)
    spark = comparisons.sparkSession
    point = log_ratio_point(comparisons, score).first()
    if point is None or point["log_ratio"] is None:
        raise Refusal("no-ratio", f"score {score}")
    pairs = tallied(comparisons, score)
    found = interval(resampled_pairs(pairs, made(spark, _ends(pairs).select("source"), resamples, seed))).first()
    if found["low"] is None:
        raise Refusal("no-usable-resample")
    bound = supportable_range(comparisons).first()
    bounds = (bound["low"], bound["high"])
    counts = {r["proposition"]: (r["pairs"], r["sources"]) for r in proposition_counts(comparisons).collect()}
    width = math.inf if math.isinf(found["low"]) or math.isinf(found["high"]) else found["high"] - found["low"]
    return LogRatio(propositions, evaluated, score, point["log_ratio"], _held(point["log_ratio"], bounds), _held(found["low"], bounds), _held(found["high"], bounds), width, bounds, counts, resamples, found["unusable"], seed)
