"""All queries of the reference's own operators, by name, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import expressions as E
from chronofold.operators import frames as bad
from chronofold.operators import mix, profile, series, sigma, stack
from chronofold.operators.sigma import _folder
from chronofold.plans.stacking import mask_places, reduce_tiles
from chronofold.sources import formats, images, tables
from chronofold.sources.frame_source import FrameSource
from chronofold.spec import StackSpec
from chronofold.streaming import stacks, upserts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- the same relations in SQL

EV = "ev AS (SELECT user_id AS k, event_type, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events)"
FR = (
    "ev AS (SELECT user_id AS k, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, "
    "count(*) OVER (PARTITION BY user_id) AS n, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events)"
)
EM = (
    "em AS (SELECT vec_id, label, pos, CAST(round_even((CAST(e AS DOUBLE) + 1) * 127.5e0, 0) AS BIGINT) AS v FROM "
    "(SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, unnest(embedding) AS e FROM embeddings))"
)
LN = "ln AS (SELECT l_returnflag AS rf, l_linestatus AS ls, CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS v FROM lineitem)"
MU = "CAST(round_even(CAST(s AS DOUBLE) / n, 0) AS BIGINT)"
VAR = "(CAST(q AS DOUBLE) - CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / n) / nullif(n - 1, 0)"
MEXP = "round(CASE WHEN n < 80 THEN 0.5e0 * pow(ln(n), 0.91e0) + 0.52e0 ELSE 0.5e0 * pow(ln(n + 1), 0.84e0) + 0.71e0 END, 9)"


def _moments(keys: str, source: str) -> str:
    return f"SELECT {keys}, count(v) AS n, CAST(sum(v) AS BIGINT) AS s, sum(CAST(v AS HUGEINT) * v) AS q FROM {source} GROUP BY {keys}"


def _finished(keys: str, source: str) -> str:
    return f"SELECT {keys}, n, {MU} AS mu, {VAR} AS var FROM ({_moments(keys, source)})"


def _weight(fin: float, fout: float) -> str:
    a, b = f"floor(n * {fin}e0)", f"floor(n * {fout}e0)"
    return f"(CASE WHEN i < {a} THEN (1 + i * (99e0 / nullif({a}, 0))) / 100 WHEN i >= n - {b} THEN (1 + (n - 1 - i) * (99e0 / nullif({b}, 0))) / 100 ELSE 1e0 END)"


# --- stacks: every relation, every reduction

_RELATIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], tuple[str, ...], str, str, bool]] = {
    "embeddings": (tables.embeddings_px, ("label", "pos"), EM, "em", False),
    "events": (tables.events_px, ("k",), EV, "ev", False),
    "event_types": (lambda s, d: tables.events_px(s, d, "event_type"), ("k",), EV.replace("user_id AS k, event_type", "event_type AS k"), "ev", True),
    "lineitem": (tables.lineitem_px, ("rf", "ls"), LN, "ln", True),
}


def _add_stacks() -> None:
    for name, (px, keys, cte, source, wide) in _RELATIONS.items():
        listed = ", ".join(keys)

        def run(mode: str, px=px, keys=keys, wide=wide) -> Query:  # noqa: ANN001
            spec = StackSpec(mode, keys, wide=wide)
            reduce = {"max": stack.max_stack, "min": stack.min_stack, "mean": stack.mean_stack}[mode]
            return lambda s, d: reduce(px(s, d), spec)

        query(f"stack_max_{name}", f"WITH {cte} SELECT {listed}, max(v) AS v FROM {source} GROUP BY {listed}")(run("max"))
        query(f"stack_min_{name}", f"WITH {cte} SELECT {listed}, min(v) AS v FROM {source} GROUP BY {listed}")(run("min"))
        query(f"stack_mean_{name}", f"WITH {cte} {_finished(listed, source)}")(run("mean"))
        mean = run("mean")
        query(f"stack_var_{name}", f"WITH {cte} SELECT {listed}, var FROM ({_finished(listed, source)})")(lambda s, d, mean=mean, keys=keys: mean(s, d).select(*keys, "var"))


_add_stacks()


@query("stack_all_fused", f"WITH {EV} SELECT k, most, least, n, {MU} AS mu, {VAR} AS var FROM (SELECT k, max(v) AS most, min(v) AS least, count(v) AS n, CAST(sum(v) AS BIGINT) AS s, sum(CAST(v AS HUGEINT) * v) AS q FROM ev GROUP BY k)")
def _(s: SparkSession, d: str) -> DataFrame:
    return stack.fused_stack(tables.events_px(s, d), ("k",))


@query("stack_mean_precise", f"WITH {EV} SELECT k, n, CAST(s AS DOUBLE) / n AS mu, {VAR} AS var FROM ({_moments('k', 'ev')})")
def _(s: SparkSession, d: str) -> DataFrame:
    return stack.mean_stack(tables.events_px(s, d), StackSpec("mean", precise=True))


# --- weights

_FIN, _FOUT = 0.3, 0.2
_W = _weight(_FIN, _FOUT)


@query("fade_weights", f"WITH {FR} SELECT k, i, {_W} AS w FROM ev")
def _(s: SparkSession, d: str) -> DataFrame:
    return tables.events_frames(s, d).select("k", "i", E.fade_weight(F.col("i"), F.col("n"), _FIN, _FOUT).alias("w"))


@query("stack_max_fade", f"WITH {FR} SELECT k, CAST(floor(max(v * {_W})) AS BIGINT) AS v FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return stack.max_stack(tables.events_frames(s, d), StackSpec("max", fade_in=_FIN, fade_out=_FOUT))


@query("stack_max_fade_int", f"WITH {FR} SELECT k, CAST(floor(max(v * CAST(floor({_W} * 257) AS BIGINT)) / 257) AS BIGINT) AS v FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return stack.max_stack(tables.events_frames(s, d), StackSpec("max", fade_in=_FIN, fade_out=_FOUT, int_weight=True))


@query("stack_min_fade", f"WITH {FR} SELECT k, CAST(floor(min(v * {_W})) AS BIGINT) AS v FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return stack.min_stack(tables.events_frames(s, d), StackSpec("min", fade_in=_FIN, fade_out=_FOUT))


@query("stack_max_fade_join", f"WITH {FR} SELECT k, CAST(floor(max(v * {_W})) AS BIGINT) AS v FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    frames = tables.events_frames(s, d)
    return stack.max_stack_by_table(frames, stack.weight_table(frames, _FIN, _FOUT), ("k",))


@query("int_weight_rescale", f"WITH {FR} SELECT k, i, CAST(floor(v * CAST(floor({_W} * 257) AS BIGINT) / 257) AS BIGINT) AS v FROM ev")
def _(s: SparkSession, d: str) -> DataFrame:
    w = E.int_weight(E.fade_weight(F.col("i"), F.col("n"), _FIN, _FOUT))
    return tables.events_frames(s, d).select("k", "i", F.floor(F.col("v") * w / 257).cast("bigint").alias("v"))


# --- sigma clipping


def _bounds(source: str, high: float, low: float) -> str:
    mean, sd = "round_even(CAST(s AS DOUBLE) / n, 0)", f"sqrt({VAR})"
    return f"SELECT k, CAST(greatest(0, ceil({mean} - {sd} * {low}e0)) AS BIGINT) AS lo, CAST(greatest(0, floor({mean} + {sd} * {high}e0)) AS BIGINT) AS hi FROM {source}"


def _passes(n: int, high: float = 3.0, low: float = 3.0) -> str:
    """CTEs ev, s0 (full), b1, s1, ..., the passes unrolled."""
    parts = [EV, f"s0 AS ({_moments('k', 'ev')})"]
    for p in range(1, n + 1):
        parts.append(f"b{p} AS ({_bounds(f's{p - 1}', high, low)})")
        parts.append(f"r{p} AS (SELECT k, count(*) FILTER (v BETWEEN lo AND hi) AS n1, sum(v) FILTER (v BETWEEN lo AND hi) AS s1, sum(CAST(v AS HUGEINT) * v) FILTER (v BETWEEN lo AND hi) AS q1 FROM ev JOIN b{p} USING (k) GROUP BY k)")
        parts.append(f"s{p} AS (SELECT k, CASE WHEN n1 = 0 THEN n ELSE n1 END AS n, CAST(CASE WHEN n1 = 0 THEN s ELSE s1 END AS BIGINT) AS s, CASE WHEN n1 = 0 THEN q ELSE q1 END AS q FROM r{p} JOIN s0 USING (k))")
    return "WITH " + ", ".join(parts)


def _clipped(n: int) -> str:
    return f" SELECT k, n, {MU} AS mu, {VAR} AS var FROM s{n}"


_CLIP = StackSpec("sigmaclip-mean")


def _sums(s: SparkSession, d: str, spec: StackSpec = _CLIP) -> tuple[DataFrame, DataFrame]:
    counts = sigma.counted(tables.events_px(s, d), spec)
    return counts, sigma.sums(counts, spec)


@query("sigma_bounds", f"WITH {EV}, s0 AS ({_moments('k', 'ev')}) {_bounds('s0', 3, 3)}")
def _(s: SparkSession, d: str) -> DataFrame:
    return sigma.bounds(_sums(s, d)[1], _CLIP)


@query("sigma_clip_iter1", _passes(1) + _clipped(1))
def _(s: SparkSession, d: str) -> DataFrame:
    return sigma.sigma_stack(tables.events_px(s, d), StackSpec("sigmaclip-mean", max_iter=1))


@query("sigma_clip_iter5", _passes(5) + _clipped(5))
def _(s: SparkSession, d: str) -> DataFrame:
    return sigma.sigma_stack(tables.events_px(s, d), _CLIP)


@query("sigma_asymmetric", _passes(5, 2, 4) + _clipped(5))
def _(s: SparkSession, d: str) -> DataFrame:
    return sigma.sigma_stack(tables.events_px(s, d), StackSpec("sigmaclip-mean", rej_high=2.0, rej_low=4.0))


@query("sigma_rejected", _passes(1) + " SELECT k, count(*) FILTER (NOT v BETWEEN lo AND hi) AS n, CAST(coalesce(sum(v) FILTER (NOT v BETWEEN lo AND hi), 0) AS BIGINT) AS s, CAST(coalesce(sum(v * v) FILTER (NOT v BETWEEN lo AND hi), 0) AS BIGINT) AS q FROM ev JOIN b1 USING (k) GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    counts, full = _sums(s, d)
    return sigma.clip_once(counts, full, full, _CLIP, keep_rejected=True)


@query("sigma_full_minus_rejected", _passes(1) + " SELECT k, n1 AS n, CAST(coalesce(s1, 0) AS BIGINT) AS s, CAST(coalesce(q1, 0) AS BIGINT) AS q FROM r1")
def _(s: SparkSession, d: str) -> DataFrame:
    counts, full = _sums(s, d)
    return stack.subtract_moments(full, sigma.clip_once(counts, full, full, _CLIP, keep_rejected=True), ("k",))


@query(
    "sigma_convergence",
    _passes(5) + ", c AS (" + " UNION ALL ".join(f"SELECT {p} AS pass, avg(CASE WHEN x.n = y.n THEN 1e0 ELSE 0e0 END) AS share FROM s{p} x JOIN s{p - 1} y USING (k)" for p in range(1, 6)) + ") SELECT pass, CASE WHEN coalesce(max(share) OVER (ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 1e0 ELSE share END AS share FROM c",
)
def _(s: SparkSession, d: str) -> DataFrame:
    return sigma.convergence(tables.events_px(s, d), _CLIP)


# --- mask mix


def _mix_sql(mask: str, guard: str) -> str:
    parts = _passes(5) + f", f AS (SELECT k, count(v) AS n, max(v) AS most FROM ev GROUP BY k), x AS (SELECT k, {MEXP} AS r, most FROM f), y AS (SELECT k, round_even(CAST(s AS DOUBLE) / n, 0) AS mu, {VAR} AS var FROM s5)"
    return parts + f" SELECT k, {guard} FROM (SELECT k, most, mu, r * sqrt(var) AS e, {mask} AS m FROM x JOIN y USING (k))"


_OFF = "(CASE WHEN most < e THEN 0e0 ELSE coalesce(e, 0e0) END)"


def _mask(px: DataFrame) -> DataFrame:
    return px.select("k").distinct().select("k", mix.normalised_mask((F.col("k") % 256).cast("double"), 8).alias("m"))


@query("mask_mix", _mix_sql("CAST(k % 256 AS DOUBLE) / 255e0", f"CAST(floor((most - {_OFF}) * m + (1 - m) * mu) AS BIGINT) AS v"))
def _(s: SparkSession, d: str) -> DataFrame:
    px = tables.events_px(s, d)
    return mix.mask_mix(px, _mask(px), StackSpec("mask-mix"))


@query("mask_mix_guard", f"WITH {EV}, f AS (SELECT k, n, most, {MEXP} AS r, {VAR} AS var, round_even(CAST(s AS DOUBLE) / n, 0) AS mu FROM (SELECT k, 3000 AS n0, max(v) // 50 AS most, count(v) AS n, CAST(sum(v) AS BIGINT) AS s, sum(CAST(v AS HUGEINT) * v) AS q FROM ev GROUP BY k)) SELECT k, CAST(floor(most - (CASE WHEN most < r * sqrt(var) THEN 0e0 ELSE coalesce(r * sqrt(var), 0e0) END)) AS BIGINT) AS v FROM f")
def _(s: SparkSession, d: str) -> DataFrame:
    px = tables.events_px(s, d)
    stats = stack.moments(px, ("k",))
    most = px.groupBy("k").agg(F.floor(F.max("v") / 50).cast("bigint").alias("most"))
    n, total = F.col("n"), F.col("s")
    parts = stats.select("k", E.rounded_mean(total, n).alias("mu"), E.variance(n, total, F.col("q")).alias("var"), n.alias("frames"), F.lit(1.0).alias("m")).join(most, "k")
    return mix.mixed(parts, ("k",))


@query("max_expmean", f"WITH {FR}, c AS (SELECT k, i + 1 AS n FROM ev) SELECT k, n, {MEXP} AS r FROM c")
def _(s: SparkSession, d: str) -> DataFrame:
    """What a maximum over a series' first n frames has to be expected to be, for every n."""
    return tables.events_frames(s, d).select("k", (F.col("i") + 1).alias("n")).withColumn("r", F.round(E.expected_max(F.col("n")), 9))


@query("mask_gray", f"WITH {EV} SELECT k, v, CAST(round_even((v % 256) * 0.299e0 + ((v // 256) % 256) * 0.587e0 + (k % 256) * 0.114e0, 0) AS BIGINT) AS g FROM ev")
def _(s: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return tables.events_px(s, d).select("k", "v", E.gray(v % 256, F.floor(v / 256) % 256, F.col("k") % 256).alias("g"))


@query("mask_normalised", f"WITH {EV}, x AS (SELECT k, max(v) AS g FROM ev GROUP BY k) SELECT k, g / CAST((SELECT max(g) FROM x) AS DOUBLE) AS m FROM x")
def _(s: SparkSession, d: str) -> DataFrame:
    grays = tables.events_px(s, d).groupBy("k").agg(F.max("v").alias("g"))
    most = grays.agg(F.max("g").alias("most"))  # one row
    return grays.crossJoin(F.broadcast(most)).select("k", mix.normalised_mask(F.col("g"), None, F.col("most").cast("double")).alias("m"))


# --- depths


def _rescale(name: str, low: int, high: int, sql: str) -> None:
    @query(name, f"WITH {EM} SELECT vec_id, pos, CAST({sql} AS BIGINT) AS v FROM em")
    def _(s: SparkSession, d: str) -> DataFrame:
        v = F.col("v") if low == 8 else F.col("v") * 251
        return tables.embeddings_px(s, d).select("vec_id", "pos", E.rescaled(v, low, high).alias("v"))


_rescale("rescale_8_16", 8, 16, "v * 257")
_rescale("rescale_8_32", 8, 32, "v * 16843009")
_rescale("rescale_16_8", 16, 8, "floor((v * 251) / 257e0)")
_rescale("rescale_16_32", 16, 32, "(v * 251) * 65537")
_rescale("rescale_none", 8, 8, "v")


@query("stack_max_16_bit", f"WITH {EM} SELECT label, pos, max(v) * 257 AS v FROM em GROUP BY label, pos")
def _(s: SparkSession, d: str) -> DataFrame:
    return stack.max_stack(tables.embeddings_px(s, d), StackSpec("max", ("label", "pos"), in_bits=8, out_bits=16))


# --- attributes and metadata

_ATTRS = "a AS (SELECT CAST(doc_id AS VARCHAR) AS fname, unnest(['lang', 'source']) AS attr, unnest([lang, source]) AS value FROM documents)"
_RANKED = "r AS (SELECT attr, value, n, CAST(row_number() OVER (PARTITION BY attr ORDER BY n DESC, value) AS INTEGER) AS rank FROM (SELECT attr, value, count(*) AS n FROM a GROUP BY attr, value))"


def _attrs(s: SparkSession, d: str) -> DataFrame:
    return profile.attributes(tables.table(s, d, "documents"), F.col("doc_id"), lang=F.col("lang"), source=F.col("source"))


@query("attr_mode", f"WITH {_ATTRS}, {_RANKED} SELECT attr, value, n FROM r WHERE rank = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.mode(_attrs(s, d))


@query("attr_other_dist", f"WITH {_ATTRS}, {_RANKED} SELECT * FROM r WHERE rank > 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.other_values(_attrs(s, d))


@query("attr_outliers", f"WITH {_ATTRS}, {_RANKED} SELECT attr, fname, a.value FROM a JOIN (SELECT attr, value AS common FROM r WHERE rank = 1) USING (attr) WHERE a.value IS DISTINCT FROM common")
def _(s: SparkSession, d: str) -> DataFrame:
    return profile.outliers(_attrs(s, d))


@query("attr_report", f"WITH {_ATTRS}, {_RANKED} SELECT attr, max(value) FILTER (rank = 1) AS mode_value, max(n) FILTER (rank = 1) AS mode_n, string_agg(value || '=' || n, ',' ORDER BY rank) FILTER (rank > 1) AS others FROM r GROUP BY attr")
def _(s: SparkSession, d: str) -> DataFrame:
    told = F.array_join(F.transform("others", lambda r: F.concat_ws("=", r["value"], r["n"].cast("string"))), ",")
    return profile.report(_attrs(s, d)).select("attr", "mode_value", "mode_n", told.alias("others"))


_PATHS = "p AS (SELECT doc_id, 'night/img.' || doc_id || '.' || CASE doc_id % 7 WHEN 0 THEN 'JPG' WHEN 1 THEN 'tiff' WHEN 2 THEN 'nef' WHEN 3 THEN 'txt' WHEN 4 THEN 'PNG' WHEN 5 THEN 'jpeg' ELSE 'ra2' END AS path FROM documents)"


def _paths(s: SparkSession, d: str) -> DataFrame:
    endings = F.array(*map(F.lit, ("JPG", "tiff", "nef", "txt", "PNG", "jpeg", "ra2")))
    return tables.table(s, d, "documents").select("doc_id", F.concat(F.lit("night/img."), F.col("doc_id").cast("string"), F.lit("."), F.get(endings, (F.col("doc_id") % 7).cast("int"))).alias("path"))


@query("suffix_filter", f"WITH {_PATHS} SELECT doc_id, path FROM p WHERE lower(split_part(path, '.', -1)) IN ('tif','tiff','png','jpg','jpeg','bmp','gif','fits','cr2','cr3','arw','nef','dng')")
def _(s: SparkSession, d: str) -> DataFrame:
    return _paths(s, d).where(E.supported(F.col("path")))


@query("suffix_normalised", f"WITH {_PATHS} SELECT doc_id, replace(replace(lower(split_part(path, '.', -1)), 'tiff', 'tif'), 'jpeg', 'jpg') AS suffix FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    return _paths(s, d).select("doc_id", E.plain_suffix(F.col("path")).alias("suffix"))


@query("ordered_paths", f"WITH {_PATHS} SELECT path, CAST(row_number() OVER (PARTITION BY doc_id % 7 ORDER BY path) - 1 AS BIGINT) AS i FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    paths = _paths(s, d).select("path", (F.col("doc_id") % 7).alias("series"))
    return stack.with_frames(paths, ("series",), ["path"]).select("path", "i")


@query("dedup_append", "SELECT DISTINCT c_mktsegment AS category, CAST(c_nationkey AS VARCHAR) AS path FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))")
def _(s: SparkSession, d: str) -> DataFrame:
    known = tables.table(s, d, "supplier").where("s_acctbal > 5000").select(F.lit("BUILDING").alias("category"), F.col("s_nationkey").cast("string").alias("path"))
    added = tables.table(s, d, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_nationkey").cast("string").alias("path"))
    return profile.new_paths(known, added)


@query("exposure_groups", "SELECT l_linenumber::BIGINT AS num, CAST(l_quantity AS BIGINT) AS den, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    written = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("bigint").cast("string"))
    return profile.exposure_groups(tables.table(s, d, "lineitem"), written)


_PROFILE = "CASE lang WHEN 'en' THEN 'desc sRGB IEC61966' WHEN 'fr' THEN 'Adobe RGB (1998)' WHEN 'de' THEN '' WHEN 'es' THEN 'ProPhoto RGB' ELSE 'P3' END"


@query("color_space_match", f"SELECT doc_id, CASE WHEN p = '' THEN NULL WHEN contains(p, 'Adobe RGB') THEN 'Adobe RGB' WHEN contains(p, 'ProPhoto RGB') THEN 'ProPhoto RGB' WHEN contains(p, 'sRGB') THEN 'sRGB' ELSE 'unsupported' END AS space FROM (SELECT doc_id, {_PROFILE} AS p FROM documents)")
def _(s: SparkSession, d: str) -> DataFrame:
    lang = F.col("lang")
    text = F.when(lang == "en", "desc sRGB IEC61966").when(lang == "fr", "Adobe RGB (1998)").when(lang == "de", "").when(lang == "es", "ProPhoto RGB").otherwise("P3")
    return tables.table(s, d, "documents").select("doc_id", E.color_space(text).alias("space"))


def _tagged(camera: pd.Series) -> pd.Series:
    """A PNG of one pixel that says which camera took it, if any."""
    told = lambda c: {"Software": "chronofold"} if c is None else {"Model": c, "Software": "chronofold"}
    return camera.map(lambda c: formats.encode_png(np.zeros((1, 1), np.uint8), info=formats.Info(told(c))), na_action=None)


@query("software_tag", "SELECT doc_id, lang AS camera, 'chronofold' AS software FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    """Tags written into image files and read from them again."""
    files = tables.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.pandas_udf(_tagged, "binary")("lang").alias("content"))
    tags = F.col("exif")
    return images.infos(files).select(F.col("path").cast("bigint").alias("doc_id"), tags["Model"].alias("camera"), tags["Software"].alias("software"))


@query("exposure_estimate", f"WITH {FR} SELECT k AS series, CAST((event_id % 9 + 1) * n AS BIGINT) AS num, CAST(event_id % 250 + 1 AS BIGINT) AS den FROM ev WHERE i = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    written = F.concat_ws("/", (F.col("event_id") % 9 + 1).cast("string"), (F.col("event_id") % 250 + 1).cast("string"))
    return profile.estimated_exposures(tables.events_frames(s, d, "event_id").withColumnRenamed("k", "series"), written)


# --- ordered cubes


def _cube(s: SparkSession, d: str) -> DataFrame:
    return stack.ordered_cube(tables.events_frames(s, d), ("k",))


@query("cube_collect", f"WITH {FR} SELECT k, string_agg(v, ',' ORDER BY i) AS vs FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return _cube(s, d).select("k", F.array_join(F.transform("vs", lambda v: v.cast("string")), ",").alias("vs"))


@query("cube_max", f"WITH {FR} SELECT k, CAST(floor(max(v * {_W})) AS BIGINT) AS v FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    n = F.size("vs").cast("bigint")
    weighted: Column = F.transform("vs", lambda v, i: v * E.fade_weight(i.cast("bigint"), n, _FIN, _FOUT))
    return _cube(s, d).select("k", F.floor(F.array_max(weighted)).cast("bigint").alias("v"))


@query("cube_min", f"WITH {EV} SELECT k, min(v) AS v FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return _cube(s, d).select("k", F.array_min("vs").alias("v"))


@query("cube_mean", f"WITH {EV} SELECT k, CAST(round_even(CAST(sum(v) AS DOUBLE) / count(v), 0) AS BIGINT) AS v FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("vs", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return _cube(s, d).select("k", E.rounded_mean(total, F.size("vs")).cast("bigint").alias("v"))


# --- bad frames, partitions

_BAD = "g AS (SELECT k AS series, i, v, event_id % 17 <> 0 AS ok, CASE WHEN event_id % 29 = 0 THEN '2x2' ELSE '4x4' END AS shape FROM ev)"


def _frames(s: SparkSession, d: str) -> DataFrame:
    rows = tables.events_frames(s, d, "event_id")
    return rows.select(F.col("k").alias("series"), "i", "v", (F.col("event_id") % 17 != 0).alias("ok"), F.when(F.col("event_id") % 29 == 0, "2x2").otherwise("4x4").alias("shape"))


@query("skip_failed", f"WITH {FR}, {_BAD} SELECT series, max(v) AS v FROM g WHERE ok GROUP BY series")
def _(s: SparkSession, d: str) -> DataFrame:
    good, _ = bad.skip_failed(_frames(s, d), F.col("ok"))
    return stack.max_stack(good, StackSpec("max", ("series",)))


@query("failed_frames", f"WITH {FR}, {_BAD} SELECT series, i, 'not decodable' AS reason FROM g WHERE NOT ok")
def _(s: SparkSession, d: str) -> DataFrame:
    return bad.skip_failed(_frames(s, d), F.col("ok"))[1]


@query("stop_on_failed", f"WITH {FR}, {_BAD} SELECT series, i, v FROM (SELECT *, max(CAST(NOT ok AS INT)) OVER (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM g) WHERE b = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return bad.stop_on_failed(_frames(s, d), F.col("ok")).select("series", "i", "v")


@query("shape_prefix_cut", f"WITH {FR}, {_BAD}, h AS (SELECT *, shape <> first(shape) OVER (PARTITION BY series ORDER BY i) AS x FROM g) SELECT series, i, v FROM (SELECT *, max(CAST(x AS INT)) OVER (PARTITION BY series ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM h) WHERE b = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return bad.prefix_of_first_shape(_frames(s, d), F.col("shape")).select("series", "i", "v")


@query("shape_drop", f"WITH {FR}, {_BAD} SELECT series, i, v FROM (SELECT *, first(shape) OVER (PARTITION BY series ORDER BY i) AS f FROM g) WHERE shape = f")
def _(s: SparkSession, d: str) -> DataFrame:
    return bad.of_first_shape(_frames(s, d), F.col("shape")).select("series", "i", "v")


@query("shape_merge", f"WITH {FR}, {_BAD}, h AS (SELECT *, first(shape) OVER (PARTITION BY series ORDER BY i) AS f FROM g) SELECT series, shape, count(v) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v * v) AS BIGINT) AS q FROM h WHERE shape = f GROUP BY series, shape")
def _(s: SparkSession, d: str) -> DataFrame:
    """Parts of every series reduced for themselves and by shape, then merged as far as their shapes agree with the first."""
    frames = bad.with_parts(_frames(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series"))), bad.wanted_parts(F.col("n"), 8))
    firsts = frames.groupBy("series", "part", "shape").agg(F.min("i").alias("first"), F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    return bad.merged_by_shape(firsts, ("series",))


@query("stack_counters", f"WITH {FR}, {_BAD} SELECT series, count(*) FILTER (ok) AS stacked, count(*) FILTER (NOT ok) AS failed FROM g GROUP BY series")
def _(s: SparkSession, d: str) -> DataFrame:
    return bad.counters(_frames(s, d), F.col("ok"))


@query("first_decodable", f"WITH {FR}, {_BAD} SELECT series, min(i) AS i FROM g WHERE ok GROUP BY series")
def _(s: SparkSession, d: str) -> DataFrame:
    good, _ = bad.skip_failed(_frames(s, d), F.col("ok"))
    return good.groupBy("series").agg(F.min("i").alias("i"))


_PARTS = "CAST(greatest(1, least(floor(sqrt(n)), 3)) AS BIGINT)"


def _in_parts(s: SparkSession, d: str) -> DataFrame:
    return bad.with_parts(tables.events_frames(s, d), bad.wanted_parts(F.col("n"), 8))


@query("partition_plan", f"WITH {FR}, p AS (SELECT DISTINCT k, n, {_PARTS} AS m FROM ev), r AS (SELECT k, n, m, unnest(range(m)) AS part FROM p) SELECT k, part, part * n // m AS lo, (part + 1) * n // m AS hi, (part + 1) * n // m - part * n // m AS frames FROM r")
def _(s: SparkSession, d: str) -> DataFrame:
    """The contiguous parts that every series falls into, from its frames."""
    return _in_parts(s, d).groupBy("k", "part").agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"), F.count(F.lit(1)).alias("frames"))


@query("stack_by_parts", f"WITH {EV} {_finished('k', 'ev')}")
def _(s: SparkSession, d: str) -> DataFrame:
    """Every part of a series reduced for itself, the parts' accumulators added up."""
    return stack.finished(stack.union_moments(stack.moments(_in_parts(s, d), ("k", "part")), ("k",)), ("k",))


@query("resize_plan", "SELECT p_partkey, h, w, CASE WHEN h >= w THEN 100 ELSE h * 100 // w END AS to_h, CASE WHEN h >= w THEN w * 100 // h ELSE 100 END AS to_w FROM (SELECT p_partkey, CAST(p_size * 7 + 10 AS BIGINT) AS h, CAST(p_partkey % 90 + 30 AS BIGINT) AS w FROM part)")
def _(s: SparkSession, d: str) -> DataFrame:
    h, w = (F.col("p_size") * 7 + 10).cast("bigint"), (F.col("p_partkey") % 90 + 30).cast("bigint")
    to_h, to_w = E.long_edge_size(F.col("h"), F.col("w"), 100)
    return tables.table(s, d, "part").select("p_partkey", h.alias("h"), w.alias("w")).withColumns({"to_h": to_h, "to_w": to_w})


@query("block_mean", f"WITH {EM} SELECT vec_id, CAST(pos // 8 // 2 AS BIGINT) AS y, CAST(pos % 8 // 2 AS BIGINT) AS x, CAST(round_even(CAST(sum(v) AS DOUBLE) / count(v), 0) AS BIGINT) AS v FROM em GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    px = tables.embeddings_px(s, d).select("vec_id", F.floor(F.col("pos") / 8).alias("y"), (F.col("pos") % 8).alias("x"), "v")
    return stack.block_mean(px, 2, ("vec_id",))


# --- accumulators


@query("moments_union", f"WITH {EV} {_finished('k', 'ev')}")
def _(s: SparkSession, d: str) -> DataFrame:
    parts = stack.moments(tables.table(s, d, "events").select(F.col("user_id").alias("k"), "event_type", E.hundredths(F.col("value")).alias("v")), ("k", "event_type"))
    return stack.finished(stack.union_moments(parts, ("k",)), ("k",))


@query("moments_subtract", f"WITH {EV} SELECT k, count(*) FILTER (event_type <> 'click') AS n, CAST(coalesce(sum(v) FILTER (event_type <> 'click'), 0) AS BIGINT) AS s, CAST(coalesce(sum(v * v) FILTER (event_type <> 'click'), 0) AS BIGINT) AS q FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    px = tables.table(s, d, "events").select(F.col("user_id").alias("k"), "event_type", E.hundredths(F.col("value")).alias("v"))
    return stack.subtract_moments(stack.moments(px, ("k",)), stack.moments(px.where("event_type = 'click'"), ("k",)), ("k",))


_WHOLE = "ev AS (SELECT user_id AS k, event_type, CAST(round_even(value, 0) AS BIGINT) AS v FROM events)"


def _told(s: SparkSession, d: str, where: str = "true", *keys: str) -> DataFrame:
    """(keys, n, mean, var) of whole amounts, in doubles."""
    px = tables.table(s, d, "events").where(where).select(F.col("user_id").alias("k"), "event_type", F.rint("value").cast("bigint").alias("v"))
    return px.groupBy("k", *keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def _whole(df: DataFrame) -> DataFrame:
    """Sums that follow from (n, mean, var): whole numbers, so nothing need be rounded off to compare them."""
    n = F.col("n")
    return df.select("k", "n", F.rint(F.col("mean") * n).cast("bigint").alias("s"), F.rint(F.col("var") * n * n).cast("bigint").alias("spread"))


@query("var_pop_merge", f"WITH {_WHOLE} SELECT k, count(v) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(count(v) * sum(v * v) - sum(v) * sum(v) AS BIGINT) AS spread FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return _whole(stack.merge_mean_variance(_told(s, d, "true", "event_type"), ("k",)))


@query("var_pop_subtract", f"WITH {_WHOLE}, x AS (SELECT k, v FROM ev WHERE event_type <> 'click'), r AS (SELECT k, count(v) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY k) SELECT k, coalesce(n, 0) AS n, CAST(s AS BIGINT) AS s, CAST(n * q - s * s AS BIGINT) AS spread FROM (SELECT DISTINCT k FROM ev) LEFT JOIN r USING (k)")
def _(s: SparkSession, d: str) -> DataFrame:
    return _whole(stack.subtract_mean_variance(_told(s, d), _told(s, d, "event_type = 'click'"), ("k",)))


# --- running stacks, streams, images


@query("running_max", f"WITH {FR} SELECT k, i, max(v) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS v FROM ev")
def _(s: SparkSession, d: str) -> DataFrame:
    return stack.running_max(tables.events_frames(s, d), ("k",))


def _streamed(s: SparkSession, d: str, files: int = 1) -> DataFrame:
    """events as a stream, of so many files taken one by one, stacked into a keyed table; its state at the end."""
    folder = f"{_folder(s.range(1))}/stream/{uuid.uuid4().hex}"
    if files > 1:
        tables.table(s, d, "events").repartition(files).write.parquet(f"{folder}/in/events.parquet")
    rows = stacks.stream_table(s, f"{folder}/in" if files > 1 else d, "events", 1)
    stacked = stacks.running_stack(rows.select(F.col("user_id").alias("k"), E.hundredths(F.col("value")).alias("v")), ("k",))
    kept = upserts.KeyedTable(s, f"{folder}/table", stacked.schema, ("k",), base_after=3)
    upserts.keep_up(stacked, kept, f"{folder}/state")
    return kept.read()


@query("stream_max", f"WITH {EV} SELECT k, max(v) AS most, min(v) AS least, count(v) AS n, CAST(sum(v) AS BIGINT) AS s FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return _streamed(s, d).drop("q")


@query("stream_mean", f"WITH {EV} {_finished('k', 'ev')}")
def _(s: SparkSession, d: str) -> DataFrame:
    return stack.finished(_streamed(s, d), ("k",))


@query("stream_batches", f"WITH {EV} SELECT k, most, least, n, {MU} AS mu, {VAR} AS var FROM (SELECT k, max(v) AS most, min(v) AS least, count(v) AS n, CAST(sum(v) AS BIGINT) AS s, sum(CAST(v AS HUGEINT) * v) AS q FROM ev GROUP BY k)")
def _(s: SparkSession, d: str) -> DataFrame:
    """The same over several batches, with bases written between them."""
    kept = _streamed(s, d, 5)
    return kept.select("k", "most", "least").join(stack.finished(kept, ("k",)), "k")


@query("stream_dedup", "SELECT DISTINCT event_type AS category, CAST(user_id AS VARCHAR) AS path FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    """New paths of a stream: the first of each (category, path), over several batches."""
    folder = f"{_folder(s.range(1))}/stream/{uuid.uuid4().hex}"
    tables.table(s, d, "events").repartition(4).write.parquet(f"{folder}/in/events.parquet")
    rows = stacks.stream_table(s, f"{folder}/in", "events", 1).select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    new = upserts.first_of_each(rows, ("category", "path"), "ts", "3650 days").select("category", "path")
    upserts.append_new(new, f"{folder}/new", f"{folder}/state")
    return s.read.schema(new.schema).parquet(f"{folder}/new")


# --- one series that holds half of all rows, over many tasks

_HOT = "CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END"
FH = (
    f"ev AS (SELECT {_HOT} AS k, event_id, CAST(row_number() OVER (PARTITION BY {_HOT} ORDER BY ts, event_id) - 1 AS BIGINT) AS i, "
    f"count(*) OVER (PARTITION BY {_HOT}) AS n, CAST(round_even(value * 100, 0) AS BIGINT) AS v FROM events)"
)


def _hot(s: SparkSession, d: str) -> DataFrame:
    user = F.when(F.col("user_id") % 2 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id"))
    return tables.table(s, d, "events").select(user.alias("k"), "ts", "event_id", E.hundredths(F.col("value")).alias("v"))


@query("hot_numbered", f"WITH {FH} SELECT k, event_id, i, n FROM ev")
def _(s: SparkSession, d: str) -> DataFrame:
    return series.numbered(_hot(s, d), ("k",), ["ts", "event_id"], "i", "n").select("k", "event_id", "i", "n")


@query("hot_running_max", f"WITH {FH} SELECT k, event_id, max(v) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS v FROM ev")
def _(s: SparkSession, d: str) -> DataFrame:
    return series.running_max(_hot(s, d), ("k",), ["ts", "event_id"]).select("k", "event_id", "v")


@query("hot_max_fade", f"WITH {FH} SELECT k, CAST(floor(max(v * {_W})) AS BIGINT) AS v FROM ev GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return stack.max_stack(series.numbered(_hot(s, d), ("k",), ["ts", "event_id"], "i", "n"), StackSpec("max", fade_in=_FIN, fade_out=_FOUT))


@query("hot_stop_on_failed", f"WITH {FH} SELECT k, event_id, v FROM (SELECT *, max(CAST(event_id % 997 = 0 AS INT)) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM ev) WHERE b = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return series.stop_on_failed(_hot(s, d), F.col("event_id") % 997 != 0, ("k",), ("ts", "event_id")).select("k", "event_id", "v")


@query("hot_shape_prefix", f"WITH {FH}, g AS (SELECT *, CASE WHEN event_id % 499 = 0 THEN '2x2' ELSE '4x4' END AS shape FROM ev), h AS (SELECT *, shape <> first(shape) OVER (PARTITION BY k ORDER BY i) AS x FROM g) SELECT k, event_id, v FROM (SELECT *, max(CAST(x AS INT)) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM h) WHERE b = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    shape = F.when(F.col("event_id") % 499 == 0, "2x2").otherwise("4x4")
    return series.prefix_of_first_shape(_hot(s, d), shape, ("k",), ("ts", "event_id")).select("k", "event_id", "v")


@query("ordered_paths_one_series", f"WITH {_PATHS} SELECT path, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS i FROM p")
def _(s: SparkSession, d: str) -> DataFrame:
    return series.numbered(_paths(s, d).select("path"), (), ["path"])


# --- image files: vectors drawn as 8 x 8 images, decoded again


def _drawn(s: SparkSession, d: str, kind: str = "gray8") -> DataFrame:
    """(path label/vec_id, content): gray PNG of 8 bits, PNG of three channels of 16 bits, or gray TIFF of 16 bits."""
    px = tables.embeddings_px(s, d)
    rows = px.groupBy("vec_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"].cast("int")).alias("data"))

    @F.pandas_udf("binary")
    def draw(data: pd.Series) -> pd.Series:
        def file(v: np.ndarray) -> bytes:
            gray = np.array(v).reshape(8, -1)
            if kind == "gray8":
                return formats.encode_png(gray.astype(np.uint8))
            if kind == "rgb16":
                return formats.encode_png(np.stack([gray * 251, gray * 257, (255 - gray) * 256], axis=2).astype(np.uint16))
            return formats.encode_tiff((gray * 257).astype(np.uint16))

        return data.map(file)

    return rows.select("vec_id", F.concat_ws("/", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("path"), draw("data").alias("content"))


def _good(files: DataFrame) -> DataFrame:
    return images.tiles(files).where("data IS NOT NULL")


_IMAGE = StackSpec("max", ("y", "x", "c"))
_YX = "CAST(pos // 8 AS BIGINT) AS y, CAST(pos % 8 AS BIGINT) AS x"


@query("image_stack", f"WITH {EM} SELECT label, pos, max(v) AS v FROM em GROUP BY label, pos")
def _(s: SparkSession, d: str) -> DataFrame:
    files = _drawn(s, d).withColumn("label", F.split("path", "/")[0].cast("int"))
    places = images.file_pixels(files, "label").select("label", (F.col("y") * 8 + F.col("x")).cast("int").alias("pos"), "v")
    return stack.max_stack(places, StackSpec("max", ("label", "pos")))


@query("image_stack_rgb16", f"WITH {EM} SELECT {_YX}, CAST(c AS BIGINT) AS c, max(CASE c WHEN 0 THEN v * 251 WHEN 1 THEN v * 257 ELSE (255 - v) * 256 END) AS v FROM em, (SELECT unnest(range(3)) AS c) GROUP BY pos, c")
def _(s: SparkSession, d: str) -> DataFrame:
    return reduce_tiles(_good(_drawn(s, d, "rgb16")), _IMAGE)


@query("image_mean_tiff", f"WITH {EM}, px AS (SELECT {_YX}, CAST(0 AS BIGINT) AS c, v * 257 AS v FROM em) {_finished('y, x, c', 'px')}")
def _(s: SparkSession, d: str) -> DataFrame:
    return reduce_tiles(_good(_drawn(s, d, "tiff16")), StackSpec("mean", ("y", "x", "c")))


def _image_passes() -> str:
    """The passes over the places of 16-bit RGB images; k is a place and channel."""
    value = "CASE c WHEN 0 THEN v * 251 WHEN 1 THEN v * 257 ELSE (255 - v) * 256 END"
    return _passes(5).replace(EV, f"{EM}, ev AS (SELECT CAST(pos * 3 + c AS BIGINT) AS k, CAST({value} AS BIGINT) AS v FROM em, (SELECT unnest(range(3)) AS c))", 1)


_PLACE = "k // 24 AS y, k // 3 % 8 AS x, k % 3 AS c"


@query(
    "image_partitions",
    f"WITH {EM}, f AS (SELECT *, dense_rank() OVER (ORDER BY 'f' || vec_id || '.png') - 1 AS i FROM em) "
    "SELECT CAST(i // 16 AS INTEGER) AS part, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last, count(DISTINCT i) AS frames, max(v) AS most FROM f GROUP BY i // 16",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """Files written by tasks, read as a sequence of partitions of 16 neighbouring frames; what each partition has."""
    folder = f"{_folder(s.range(1))}/frames/{uuid.uuid4().hex}"

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                images.write_file(f"{folder}/f{row.vec_id}.png", row.content)
            yield batch[["vec_id"]]

    _drawn(s, d).select("vec_id", "content").mapInPandas(put, "vec_id bigint").write.format("noop").mode("overwrite").save()
    s.dataSource.register(FrameSource)
    read = s.read.format("frames").option("partitionFrames", 16).load(folder)
    found = images.pixels(read, "i", "part").groupBy("part")
    return found.agg(F.min("i").alias("first"), F.max("i").alias("last"), F.countDistinct("i").alias("frames"), F.max("v").alias("most"))


@query("image_clip_tiles", _image_passes() + f" SELECT {_PLACE}, n, {MU} AS mu, {VAR} AS var FROM s5")
def _(s: SparkSession, d: str) -> DataFrame:
    """Sigma clipping over decoded images, without a row for each pixel of each frame."""
    tiles = sigma.settled(_good(_drawn(s, d, "rgb16")), "tiles")
    return reduce_tiles(tiles, StackSpec("sigmaclip-mean", ("y", "x", "c"), in_bits=16))


@query(
    "image_mix_tiles",
    _image_passes() + f", f AS (SELECT k, count(v) AS n, max(v) AS most FROM ev GROUP BY k), x AS (SELECT k, {MEXP} AS r, most FROM f), y AS (SELECT k, round_even(CAST(s AS DOUBLE) / n, 0) AS mu, {VAR} AS var FROM s5), "
    f"m AS (SELECT pos, v / 255e0 AS m FROM em WHERE vec_id = (SELECT min(vec_id) FROM em)) SELECT {_PLACE}, CAST(floor((most - {_OFF}) * m + (1 - m) * mu) AS BIGINT) AS v "
    "FROM (SELECT x.k, most, mu, r * sqrt(var) AS e, m FROM x JOIN y USING (k) JOIN m ON m.pos = x.k // 3)",
)
def _(s: SparkSession, d: str) -> DataFrame:
    """The mix over decoded images, with the first image, drawn in gray, as its mask."""
    tiles = sigma.settled(_good(_drawn(s, d, "rgb16")), "tiles")
    mask = _drawn(s, d).agg(F.min_by(F.struct("path", "content"), "vec_id").alias("f")).select("f.*")
    return reduce_tiles(tiles, StackSpec("mask-mix", ("y", "x", "c"), in_bits=16), mask=mask_places(_good(mask), 8, 8, 3))


@query("image_max_fade", f"WITH {EM}, f AS (SELECT CAST(vec_id AS VARCHAR) AS s, label, vec_id, count(*) OVER () AS n, row_number() OVER (ORDER BY CAST(label AS VARCHAR) || '/' || vec_id) - 1 AS i FROM (SELECT DISTINCT vec_id, label FROM em)) SELECT {_YX}, CAST(0 AS BIGINT) AS c, CAST(floor(max(v * {_W})) AS BIGINT) AS v FROM em JOIN f USING (vec_id, label) GROUP BY pos")
def _(s: SparkSession, d: str) -> DataFrame:
    files = _drawn(s, d)
    order = images.order(files)
    placed = order.crossJoin(F.broadcast(order.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return reduce_tiles(_good(files), StackSpec("max", ("y", "x", "c"), fade_in=_FIN, fade_out=_FOUT), placed)


@query("image_cached_runs", f"WITH {EM} SELECT {_YX}, CAST(0 AS BIGINT) AS c, max(v) AS most, min(v) AS least FROM em GROUP BY pos")
def _(s: SparkSession, d: str) -> DataFrame:
    """Files decoded once, two reductions run on the tiles."""
    tiles = sigma.settled(_good(_drawn(s, d)), "tiles")
    most, least = (reduce_tiles(tiles, StackSpec(mode, ("y", "x", "c"))) for mode in ("max", "min"))
    return most.withColumnRenamed("v", "most").join(least.withColumnRenamed("v", "least"), ["y", "x", "c"])


@query("image_resize", f"WITH {EM} SELECT vec_id, CAST(pos // 8 // 2 AS BIGINT) AS y, CAST(pos % 8 // 2 AS BIGINT) AS x, CAST(round_even(CAST(sum(v) AS DOUBLE) / count(v), 0) AS BIGINT) AS v FROM em GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    """Bilinear resizing to half the size, where every pixel is the mean of four."""
    files = _drawn(s, d).withColumn("vec_id", F.split("path", "/")[1].cast("int"))
    return images.file_pixels(files, "vec_id", resize="4x4").select("vec_id", "y", "x", "v")


@query("image_errors", "SELECT vec_id, 'not decodable: ' || CASE vec_id % 4 WHEN 1 THEN 'empty file' WHEN 2 THEN 'no decoder for JPEG and GIF files in tables' ELSE 'unknown kind of file' END AS reason FROM embeddings WHERE vec_id % 4 > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    """Files that can't be decoded, each with its reason; the others are left out."""
    files = _drawn(s, d)
    bytes_ = F.when(F.col("vec_id") % 4 == 0, F.col("content")).when(F.col("vec_id") % 4 == 1, F.lit(b"")).when(F.col("vec_id") % 4 == 2, F.lit(b"GIF89a")).otherwise(F.lit(b"no image"))
    found = images.files_of(images.tiles(files.select("path", bytes_.alias("content")))).where("NOT valid")
    return found.select(F.split("path", "/")[1].cast("int").alias("vec_id"), "reason")


@query("mask_size", f"WITH {EM}, m AS (SELECT pos, v / 255e0 AS m FROM em WHERE vec_id = (SELECT min(vec_id) FROM em)), p AS (SELECT unnest(range(12)) AS y), q AS (SELECT unnest(range(20)) AS x), r AS (SELECT unnest(range(3)) AS c) SELECT y, x, c, m FROM p, q, r JOIN m ON m.pos = (y * 8 // 12) * 8 + x * 8 // 20")
def _(s: SparkSession, d: str) -> DataFrame:
    """One image as the mask of frames of 12 x 20 pixels and three channels."""
    files = _drawn(s, d)
    first = files.agg(F.min_by(F.struct("path", "content"), "vec_id").alias("f")).select("f.*")
    return mask_places(_good(first), 12, 20, 3)


@query("recursive_scan", "SELECT 'region' || n_regionkey || '/nation' || n_nationkey || '.PNG' AS name, CAST(3 + n_nationkey AS INTEGER) AS width, CAST(2 + n_regionkey AS INTEGER) AS height, CAST(8 + n_nationkey % 2 * 8 AS INTEGER) AS bits, n_name AS model FROM nation")
def _(s: SparkSession, d: str) -> DataFrame:
    """Files in folders of folders - one for each nation, written by the executors - with their headers and tags."""
    folder = f"{_folder(s.range(1))}/scan/{uuid.uuid4().hex}"

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n in batch.itertuples():
                pixels = np.zeros((2 + n.n_regionkey, 3 + n.n_nationkey), np.uint16 if n.n_nationkey % 2 else np.uint8)
                at = f"{folder}/region{n.n_regionkey}/nation{n.n_nationkey}"
                images.write_file(f"{at}.PNG", formats.encode_png(pixels, info=formats.Info({"Model": n.n_name})))
                images.write_file(f"{at}.txt", b"no image")
            yield batch[["n_nationkey"]]

    tables.table(s, d, "nation").select("n_nationkey", "n_regionkey", "n_name").mapInPandas(drawn, "n_nationkey int").write.format("noop").mode("overwrite").save()
    files = images.scan(s, folder, recursive=True)
    found = images.headers(files).join(images.infos(files), "path")
    name = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    return found.select(name.alias("name"), "width", "height", "bits", F.col("exif")["Model"].alias("model"))
