"""Registered queries: every operator of the surface library over whole driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import micrometres
from .functions.heights import ALPHA, rotated, smoothed
from .operators import agreement as A
from .operators import evidence as V
from .operators import forms as FM
from .operators import guards as G
from .operators import masks as M
from .operators import placement as P
from .operators import regions as R
from .operators import tiled as O
from .operators import turned as U
from .operators.blocked import blocked_correlations
from .operators.wording import conclusion_words
from .plans import design as D
from .plans import manifest as N
from .plans import sql as Q
from .plans import sweep as S
from .plans.profile import Profile
from .plans.scratch import folder
from .plans.steps import Applied, BandParameters, EdgeParameters, LevelParameters, MarkParameters, OutlierParameters, PinParameters, run_chain
from .sources import container, synthetic
from .sources.surfaces import from_embeddings, mapped, rows_from_embeddings, samples
from .sources.tiles import tile_samples, tiled, tiled_rows

CELLS = P.CellParameters(4, 0.5)
SEARCH = P.SearchParameters(4, 0.5, 6.0, 6.0, 3)
RULE = A.AgreementRule(1.0, 1.0, 2.0, 0.3, "median")
MODE_RULE = A.AgreementRule(1.0, 1.0, 2.0, 0.3, "histogram-mode", 2.0, 4.0)
HIGH_RULE = A.HighAgreementRule(1.0, 1.0, 0.3, "median", 1)
KEYS = ("surface_id", "r", "c")
STEMS = ("identif", "exclud", "match", "ther")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_embeddings(spark, sf_dir)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(fields(spark, sf_dir))


def _heights(rows: DataFrame, places: int | None = None) -> DataFrame:
    return rows.select(*KEYS, (F.round("h", places) if places is not None else F.col("h")).alias("h"))


def _chain(*steps: Applied, places: int | None = None):
    return lambda spark, sf_dir: _heights(samples(run_chain(fields(spark, sf_dir), list(steps))), places)


def _native(of, places: int | None = None):
    return lambda spark, sf_dir: _heights(of(_samples(spark, sf_dir)), places)


def shifted(h: np.ndarray, row: dict) -> np.ndarray:
    """The field two rows down and three columns to the left, with a small disturbance: a known displacement."""
    out = np.full(h.shape, np.nan)
    if h.shape[0] > 2:
        out[2:, :-3] = h[:-2, 3:]
    r, c = np.indices(h.shape)
    return out + 0.01 * ((7 * r + 13 * c) % 11)


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped(fields(spark, sf_dir), shifted)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.correlations(_samples(spark, sf_dir), samples(_moved(spark, sf_dir)), CELLS, 3)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.col("surface_id").alias("pair_id")
    return P.paired(fields(spark, sf_dir).select(named, "*"), _moved(spark, sf_dir).select(named, "*"))


def _by_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.registrations(_pairs(spark, sf_dir), SEARCH)


def _turned(degrees: float):
    return lambda spark, sf_dir: _heights(samples(mapped(fields(spark, sf_dir), lambda h, _: rotated(h, degrees))), 6)


def event_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registration made of ``events``: 25 cells at five angles for each pair, with placements taken from values."""
    e, value = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value")
    k = F.col("event_id") % 125
    cell = F.floor(k / 5)
    return e.select(
        F.floor(F.col("event_id") / 125).cast("string").alias("pair_id"),
        ((k % 5 - 2) * 2).cast("double").alias("angle_deg"),
        F.floor(cell / 5).cast("int").alias("cell_r"),
        (cell % 5).cast("int").alias("cell_c"),
        (F.floor(value * 10) % 5 - 2).cast("int").alias("down"),
        (F.floor(value * 100) % 5 - 2).cast("int").alias("across"),
        F.round(value - F.floor(value), 4).alias("correlation"),
        F.lit(100).cast("long").alias("overlap"),
    )


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of suppliers that meet in an order; the score is the first line's quantity modulo 21."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    a, b = lines.alias("a"), lines.alias("b")
    met = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return met.select(F.lit("suppliers").alias("set_name"), F.lit(20).alias("n_cells"), (F.col("a.l_quantity").cast("int") % 21).alias("score"), F.col("a.l_suppkey").cast("string").alias("source_a"), F.col("b.l_suppkey").cast("string").alias("source_b"))


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.select(*((F.round(c, places[c]) + F.lit(0.0)).alias(c) if c in places else F.col(c) for c in df.columns))


def _cell_list(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["cell_r"].cast("string"), x["cell_c"].cast("string"))), " ").alias(column)


def _score(rule):
    def query(spark, sf_dir):
        found = A.score(event_registrations(spark, sf_dir), rule)
        return _rounded(found, down_at=6, across_at=6, angle_deg_at=6).select("pair_id", "congruent", "eligible", "discarded", "failed_down", "failed_across", "failed_rotation", "failed_correlation", "down_at", "across_at", "angle_deg_at", _cell_list("cells"))

    return query


def _high(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.score_high(event_registrations(spark, sf_dir), HIGH_RULE)
    return found.select("pair_id", "congruent", "eligible", "discarded", "peak", F.array_join(F.transform("high_angles", lambda x: x.cast("int").cast("string")), " ").alias("high_angles"), _cell_list("cells"))


def _disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_angle = event_registrations(spark, sf_dir)
    found = A.disagreements(A.score(by_angle, RULE), A.score_high(by_angle, HIGH_RULE))
    return found.select("pair_id", _cell_list("only_original"), _cell_list("only_high"))


def _bootstrap(spark: SparkSession, sf_dir: str, resamples: int = 20) -> DataFrame:
    pairs = V.tallied(comparisons(spark, sf_dir), 7)
    sources = pairs.select(F.explode(F.array("source_a", "source_b")).alias("source"))
    found = V.interval(V.resampled_pairs(pairs, V.hashed_draws(spark, sources, resamples, 11)))
    return _rounded(found, low=6, high=6)


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field written as a container and read again: whether heights agree to a billionth of a metre's part."""
    before = fields(spark, sf_dir)
    after = container.decoded(container.encoded(before)).select(F.regexp_replace("surface_id", "\\.x3p$", "").alias("surface_id"), F.col("heights").alias("again"), "refused")
    off = F.aggregate(F.zip_with("heights", "again", lambda a, b: F.coalesce(F.abs(a - b), (a.isNotNull() | b.isNotNull()).cast("double"))), F.lit(0.0), lambda m, x: F.greatest(m, x))
    return before.join(after, "surface_id").select("surface_id", "n_rows", "n_cols", F.col("refused").isNull().alias("was_read"), (off < 1e-9).alias("heights_agree"))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field for each nation, with its key as seed."""
    keys = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    base = synthetic.FieldParameters(rows=96, columns=96, pixel_spacing_um=8.0)
    fixed = [F.lit(v).cast(synthetic.PARAMETERS[n].dataType).alias(n) for n, v in vars(base).items() if n != "seed"]
    rows = keys.select(F.col("n_nationkey").cast("string").alias("surface_id"), *fixed, F.col("n_nationkey").cast("long").alias("seed"), F.col("n_nationkey").cast("long").alias("source_id"), F.lit(0.0).alias("shift_rows"), F.lit(0.0).alias("shift_columns"), F.lit(0.0).alias("turn_deg"))
    return synthetic.generated(rows.select(*synthetic.PARAMETERS.names))


def _pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_chain(_generated(spark, sf_dir), [Applied("mask-firing-pin", PinParameters("detected", None, None, None, 10.0, 8.0))])
    outcome = F.from_json(F.element_at("provenance", -1)["outcomes"], "centre_y double, centre_x double, radius double, masked_radius double, masked_samples long")
    return found.select("surface_id", outcome.alias("o")).select("surface_id", *(F.round(f"o.{c}", 6).alias(c) for c in ("centre_y", "centre_x", "radius")), "o.masked_samples")


def _summary(surfaces: DataFrame) -> DataFrame:
    return samples(surfaces).groupBy("surface_id").agg(F.count("h").alias("measured"), F.round(F.avg("h"), 6).alias("mean"), F.round(F.min("h"), 6).alias("least"), F.round(F.max("h"), 6).alias("most"))


def _every_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [
        Applied("mask-firing-pin", PinParameters("detected", None, None, None, 10.0, 8.0)),
        Applied("trim-edge", EdgeParameters(40.0, "frame")),
        Applied("reject-outliers", OutlierParameters("median-absolute-deviation", 5.0, None)),
        Applied("level", LevelParameters("polynomial", 2, None, None)),
        Applied("bandpass", BandParameters(20.0, 120.0, 4.0, 3)),
    ]
    return _summary(run_chain(_generated(spark, sf_dir), chain))


def _marks(**changed):
    values = {"drag_width": 22.0, "drag_position": -31.0, "drag_angle_deg": 30.0, "exclude_drag": False, "extractor_radius": 41.0, "extractor_distance": 50.0, "extractor_angle_deg": 90.0, "exclude_extractor": False}
    return Applied("mask-marks", MarkParameters(**(values | changed)))


def _design_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter values for designs: each region's name with its nations' names, the first as the base."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parameter"), F.col("n_name").alias("value"))
    first = named.groupBy("parameter").agg(F.min("value").alias("first"))
    return named.join(first, "parameter").select("parameter", "value", (F.col("value") == F.col("first")).alias("is_base"))


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    values = part.select(F.concat(F.lit("p"), (F.col("p_partkey") % 4).cast("string")).alias("parameter"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("value"))
    bounds = spark.createDataFrame([("p0", 5.0, 20.0, False), ("p1", 1.0, 50.0, True), ("p2", 30.0, 30.0, True)], "parameter string, lower double, upper double, nullable boolean")
    return D.admitted(values, bounds).groupBy("parameter", "admitted").agg(F.count("*").alias("n"))


def _outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("cell"))
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("cell"))
    return D.outstanding(orders, done)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("nm", "um", "mm", "m"))), F.col("surface_id").cast("int") % 4 + 1)
    return _samples(spark, sf_dir).select(*KEYS, (F.round(micrometres(F.col("h"), unit), 6) + F.lit(0.0)).alias("h"))


def _transmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = F.col("s_suppkey").cast("double")

    def passed(cutoff: float):
        return F.exp(F.lit(-np.pi) * F.pow(F.lit(ALPHA * cutoff) / wave, F.lit(2.0)))

    return spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey > 0").select("s_suppkey", F.round(passed(20.0), 8).alias("low"), F.round(passed(20.0) - passed(120.0), 8).alias("band"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conclusion_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", stems=STEMS)


#: Rows and columns of a tile: fields are 64 wide, so that tiles meet both down and across.
SIDE = 48


def _tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one field, in tiles."""
    return tiled_rows(rows_from_embeddings(spark, sf_dir), SIDE)


def _tiled(of, places: int | None = None):
    return lambda spark, sf_dir: _heights(tile_samples(of(_tall(spark, sf_dir))), places)


def _deep_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.regions(R.depressions(_tall(spark, sf_dir), 0.1), lambda h, _: ~np.isnan(h))


def _capped(spark: SparkSession, sf_dir: str, radius: float = 600.0) -> DataFrame:
    """Fields in tiles, laid on a sphere."""
    at, half = F.col("cols"), F.lit(0.5)

    def raised(h, k):
        y = (F.col("top") + F.floor(k / at) - (F.col("n_rows") - 1) * half) * F.col("spacing_y")
        x = (F.col("left") + k % at - (F.col("n_cols") - 1) * half) * F.col("spacing_x")
        return h + F.sqrt(F.lit(radius * radius) - y * y - x * x) - radius

    return tiled(fields(spark, sf_dir), SIDE).withColumn("heights", F.transform("heights", raised))


def _from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    Q.register(spark)
    text = "SELECT f.surface_id, s.r, s.c, round(s.h, 6) AS h FROM {f} AS f, LATERAL preprocessed(f.n_rows, f.n_cols, f.spacing_y, f.spacing_x, f.heights, {chain}) AS s"
    return spark.sql(text, f=fields(spark, sf_dir), chain=Q.chain_text([Applied("level", LevelParameters("plane", None, None, None))]))


PROFILE = Profile("frame", "1", "Trims the frame", (Applied("trim-edge", EdgeParameters(12.0, "frame")),), ())
VARIED = {"compare.cmc.correlation_threshold": [0.3, 0.9], "compare.cmc.down_threshold": [0.0, 1.0], "trim-edge.width": [4.0, 12.0]}


def _swept(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the finished sweep of eight assignments over all pairs of fields."""
    where = folder(spark, "sweep")
    design = D.Design("frames", "1", "full-factorial", S.base_of(PROFILE, SEARCH, RULE), VARIED, ())
    assigned, pairs = S.assigned(spark, PROFILE, SEARCH, RULE, design.assignments()), _pairs(spark, sf_dir)
    cells = S.cells_of(design.name, design.version, assigned, pairs.select(F.col("pair_id").alias("pair"), F.lit(True).alias("same_source"), F.lit(0).cast("long").alias("seed")))
    S.run_cells(cells, assigned, pairs, PROFILE, where)
    return where


def _sweep_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = (F.variant_get(F.parse_json("assignment"), f"$['{v}']", "double").alias(v.split(".")[-1]) for v in VARIED)
    return S.finished(spark, _swept(spark, sf_dir)).select("pair", "same_source", *values, "congruent", "eligible", "discarded")


def _sweep_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests of a sweep say: for each width, cells with that step, and different files before and after it."""
    made = S.manifests(spark, _swept(spark, sf_dir))
    step = N.steps(made).select("cell", "pos", "identifier", F.variant_get("parameters", "$.width", "double").alias("width"), F.variant_get("parameters", "$.criterion", "string").alias("criterion"))
    inputs, outputs = (N.digests(made, k).groupBy("cell").agg(F.array_join(F.array_sort(F.collect_list("role")), " ").alias(f"{k}_roles"), F.min("sha256").alias(k)) for k in ("inputs", "outputs"))
    both = step.join(inputs, "cell").join(outputs, "cell")
    return both.groupBy("pos", "identifier", "criterion", "width", "inputs_roles", "outputs_roles").agg(F.count("*").alias("cells"), F.count_distinct("inputs").alias("inputs"), F.count_distinct("outputs").alias("outputs"))


QUERIES = {
    "surface_explode": lambda s, d: _heights(_samples(s, d)),
    "unit_convert": _units,
    "trim_frame": _native(lambda x: M.trim_frame(x, 12.0)),
    "trim_grow": _native(lambda x: M.trim_grow(x, 1, 1)),
    "mask_band": _native(lambda x: M.mask(x, M.band(22.0, -31.0, 30.0))),
    "mask_disc": _native(lambda x: M.mask(x, M.disc(50.0, 0.0, 41.0))),
    "mask_counts": lambda s, d: M.mask_counts(_samples(s, d), drag_samples=M.band(22.0, -31.0, 30.0), extractor_samples=M.disc(50.0, 0.0, 41.0)),
    "outlier_global_mad": _native(lambda x: M.reject_global(x, "median-absolute-deviation", 3.0)),
    "outlier_global_std": _native(lambda x: M.reject_global(x, "standard-deviation", 1.5)),
    "level_plane": _native(M.level_plane, 6),
    "chain_trim_frame": _chain(Applied("trim-edge", EdgeParameters(12.0, "frame"))),
    "chain_trim_grow": _chain(Applied("trim-edge", EdgeParameters(4.0, "grow"))),
    "chain_mask_marks": _chain(_marks(exclude_drag=True, exclude_extractor=True)),
    "mask_pin_fixed": _chain(Applied("mask-firing-pin", PinParameters("fixed", 10.0, -20.0, 30.0, None, 7.0))),
    "outlier_local": _chain(Applied("reject-outliers", OutlierParameters("median-absolute-deviation", 3.0, 8.0))),
    "chain_level_plane": _chain(Applied("level", LevelParameters("plane", None, None, None)), places=6),
    "level_poly2": lambda s, d: _summary(run_chain(fields(s, d), [Applied("level", LevelParameters("polynomial", 2, None, None))])),
    "level_huber": lambda s, d: _summary(run_chain(fields(s, d), [Applied("level", LevelParameters("plane", None, 4.0, 3))])),
    "level_sphere": lambda s, d: _summary(run_chain(_generated(s, d), [Applied("mask-firing-pin", PinParameters("detected", None, None, None, 10.0, 8.0)), Applied("level", LevelParameters("sphere", None, None, None))])),
    "gauss_smooth": lambda s, d: _heights(samples(mapped(fields(s, d), lambda h, _: smoothed(h, (~np.isnan(h)).astype(float), 12.0, 4.0, 4.0))), 6),
    "bandpass_linear": _chain(Applied("bandpass", BandParameters(8.0, 16.0, None, None)), places=6),
    "bandpass_robust": lambda s, d: _summary(run_chain(fields(s, d), [Applied("bandpass", BandParameters(12.0, 24.0, 4.0, 2))])),
    "transmission": _transmissions,
    "rotate_right_angle": _turned(90.0),
    "rotate_six": _turned(6.0),
    "cell_assign": lambda s, d: P.cells(_samples(s, d), P.CellParameters(5, 0.5)).select(*KEYS, "cell_r", "cell_c"),
    "cell_usable": lambda s, d: P.usable_cells(M.mask(_samples(s, d), M.disc(50.0, 0.0, 41.0)), CELLS),
    "masked_ncc": lambda s, d: _rounded(_placed(s, d), correlation=6),
    "best_placement": lambda s, d: _rounded(P.best_placements(_placed(s, d)), correlation=6),
    "register_by_angle": lambda s, d: _rounded(_by_angle(s, d), correlation=6),
    "register_best": lambda s, d: _rounded(P.best_over_angles(_by_angle(s, d)), correlation=6),
    "compare_one_orientation": lambda s, d: _rounded(P.compare(_pairs(s, d), CELLS), correlation=6),
    "consensus_median": lambda s, d: A.consensus(P.best_over_angles(event_registrations(s, d)), RULE, ["pair_id"]),
    "consensus_mode": lambda s, d: A.consensus(P.best_over_angles(event_registrations(s, d)), MODE_RULE, ["pair_id"]),
    "cmc_score": _score(RULE),
    "cmc_score_mode": _score(MODE_RULE),
    "high_cmc": _high,
    "rule_disagreements": _disagreements,
    "registered_score": lambda s, d: A.score(_by_angle(s, d), RULE).select("pair_id", "congruent", "eligible", "discarded"),
    "proposition_counts": lambda s, d: V.proposition_counts(comparisons(s, d)),
    "score_distribution": lambda s, d: _rounded(V.score_distribution(comparisons(s, d)), frequency=9),
    "diagnostics": lambda s, d: _rounded(V.diagnostics(comparisons(s, d)), largest_source_share=9, unobserved_share=9),
    "supportable_range": lambda s, d: _rounded(V.supportable_range(comparisons(s, d)), low=6, high=6),
    "log_ratio_point": lambda s, d: _rounded(V.log_ratio_point(comparisons(s, d), 7), log_ratio=6),
    "disjoint_check": lambda s, d: V.touching(comparisons(s, d), ("3", "8")).groupBy("source_a", "source_b").agg(F.count("*").alias("n")),
    "bootstrap_interval": _bootstrap,
    "bootstrap_interval_200": lambda s, d: _bootstrap(s, d, 200),
    "design_one_at_a_time": lambda s, d: D.one_at_a_time(_design_rows(s, d)),
    "design_factorial": lambda s, d: D.factorial({"grid": [3, 6, 12], "limit": [0, 8], "model": ["plane", "sphere"]}, s),
    "resume_anti_join": _outstanding,
    "range_admits": _admitted,
    "conclusion_words": _words,
    "synth_field": lambda s, d: _summary(_generated(s, d)),
    "pin_detect": _pin,
    "chain_every_step": _every_step,
    "container_roundtrip": _roundtrip,
    "tiled_smooth": _tiled(lambda t: O.smooth(t, SIDE, 12.0), 6),
    "tiled_bandpass": _tiled(lambda t: O.bandpass(t, SIDE, 8.0, 16.0), 6),
    "tiled_trim_grow": _tiled(lambda t: O.trim_grow(t, SIDE, 1, 1)),
    "tiled_outlier_local": _tiled(lambda t: O.reject_local(t, SIDE, "median-absolute-deviation", 3.0, 2, 2)),
    "tiled_median": lambda s, d: R.medians(tiled(fields(s, d), SIDE)),
    "tiled_regions": _deep_regions,
    "tiled_pins": lambda s, d: _rounded(R.detected_pins(tiled(fields(s, d), SIDE), 0.05), centre_y=6, centre_x=6, radius=6),
    "tiled_level_poly2": lambda s, d: _heights(tile_samples(FM.level(tiled(fields(s, d), SIDE), FM.Polynomial(2))), 6),
    "tiled_level_huber": lambda s, d: _heights(tile_samples(FM.level(tiled(fields(s, d), SIDE), FM.Polynomial(1), 1.5, 1)), 6),
    "tiled_level_sphere": lambda s, d: _heights(tile_samples(FM.level(_capped(s, d), FM.Sphere())), 6),
    "blocked_ncc": lambda s, d: _rounded(blocked_correlations(tiled(fields(s, d), SIDE), tiled(_moved(s, d), SIDE), SIDE, CELLS, 32), correlation=6),
    "tiled_rotate_six": lambda s, d: _heights(tile_samples(U.turn(tiled(fields(s, d), SIDE), SIDE, [6.0])), 6),
    "tiled_register_by_angle": lambda s, d: _rounded(U.registrations(tiled(fields(s, d), SIDE), tiled(_moved(s, d), SIDE), SIDE, SEARCH).withColumnRenamed("surface_id", "pair_id"), correlation=6),
    "registered_or_refused": lambda s, d: _rounded(G.register(_pairs(s, d), SEARCH), correlation=6),
    "correlation_work": lambda s, d: G.work_of(_pairs(s, d), SEARCH),
    "sql_preprocessed": _from_sql,
    "sweep_cells": _sweep_cells,
    "sweep_report": lambda s, d: S.report(S.finished(s, _swept(s, d)), list(VARIED)),
    "sweep_manifests": _sweep_steps,
    "digest": lambda s, d: container.digests(fields(s, d)),
}
