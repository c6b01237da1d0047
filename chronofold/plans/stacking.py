"""Runs of a whole stack: by mode over a pixel relation, or over image files."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.expressions import fade_weight, gray, int_weight
from chronofold.operators.frames import counters
from chronofold.operators import tile_clip
from chronofold.operators.mix import mask_mix, mix_stats, normalised_mask
from chronofold.operators.profile import exposure_groups, file_attributes, total_exposure
from chronofold.operators.profile import report as profile_report
from chronofold.operators.sigma import settled, sigma_stack
from chronofold.operators.stack import finished, max_stack, mean_stack, min_stack, scaled, scaled_mean
from chronofold.sources import images
from chronofold.sources.formats import WRITTEN, Info
from chronofold.spec import Stacker, StackSpec, output_bits, scale_between

#: Modes by name; a further mode is a function of (px, spec) added here.
STACKERS: dict[str, Stacker] = {"max": max_stack, "min": min_stack, "mean": mean_stack, "sigmaclip-mean": sigma_stack}


def stack(px: DataFrame, spec: StackSpec, mask: DataFrame | None = None) -> DataFrame:
    """px(keys, v, and i and n where there are fades) reduced over the frames as the spec says."""
    if spec.mode == "mask-mix":
        if mask is None:
            raise ValueError("a mask mix needs a mask")
        return mask_mix(px, mask, spec)
    return STACKERS[spec.mode](px, spec)


@dataclass
class ImageStack:
    ok: bool
    message: str
    result: DataFrame | None
    errors: DataFrame
    counts: DataFrame
    bits: int | None
    info: Info | None = None
    report: DataFrame | None = None


def combined_info(about: DataFrame) -> Info:
    """What the first file says, its exposure replaced by the exact sum over all files that tell theirs."""
    first = about.orderBy("path").select("exif", "profile").first()
    found = Info(dict(first["exif"] or {}), bytes(first["profile"] or b"")) if first else Info()
    if "ExposureTime" in found.exif:
        found.exif["ExposureTime"] = str(total_exposure(exposure_groups(about, F.col("exif")["ExposureTime"])))
    found.exif["Software"] = "chronofold"
    return found


def mask_places(drawn: DataFrame, height: int, width: int, channels: int) -> DataFrame:
    """(y, x, c, m) for frames of a size, from tiles of one mask image: gray, 0..1, the same for every channel, brought to the
    frames' size by the nearest place."""
    size = drawn.select(F.col("height").alias("mh"), F.col("width").alias("mw"), F.col("channels").alias("mc"), F.col("bits").alias("mb")).limit(1)  # one row
    value = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    values = images.pixels(drawn).groupBy("y", "x").agg(value(0).alias("c0"), value(1).alias("c1"), value(2).alias("c2"))
    lines = drawn.sparkSession.range(height).select(F.col("id").alias("py"))
    places = lines.crossJoin(F.broadcast(size)).withColumn("px", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))))
    places = places.withColumn("y", F.floor(F.col("py") * F.col("mh") / height)).withColumn("x", F.floor(F.col("px") * F.col("mw") / width))
    tone = F.when(F.col("mc") >= 3, gray(F.col("c0"), F.col("c1"), F.col("c2"))).otherwise(F.col("c0"))
    level = normalised_mask(tone, None, F.pow(F.lit(2.0), F.col("mb")) - 1)
    spread = places.join(values, ["y", "x"]).withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(channels - 1).cast("bigint"))))
    return spread.select(F.col("py").alias("y"), F.col("px").alias("x"), "c", level.alias("m"))


def image_mask(spark: SparkSession, path: str, height: int, width: int, channels: int) -> DataFrame:
    """mask_places of a mask file."""
    return mask_places(images.folder_tiles(spark, path).where("data IS NOT NULL"), height, width, channels)


def reduce_tiles(good: DataFrame, spec: StackSpec, order: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Any mode over tiles of one shape (of 8 or 16 bits, but for maxima and minima), as the functions of STACKERS have it over
    pixels; with fades, order(path, i, n) says where a file stands. Clipping reads the tiles more than once: written ones."""
    weight = None
    if spec.faded and spec.mode not in ("mean", "sigmaclip-mean"):
        w = fade_weight(F.col("i"), F.col("n"), spec.fade_in, spec.fade_out)
        bits = spec.in_bits or 8
        good = good.join(order, "path").withColumn("w", (int_weight(w, bits) if spec.int_weight else w).cast("double"))
        weight = "w"
    unscaled = scale_between(spec.in_bits or 8, 2 * (spec.in_bits or 8)) if spec.int_weight and weight else 1
    whole = lambda v: F.floor(v / unscaled if unscaled > 1 else v).cast("bigint")
    if spec.mode in ("sigmaclip-mean", "mask-mix"):
        found = tile_clip.clipped(good.where("data IS NOT NULL"), spec, images.TILE, weight)
        if spec.mode == "mask-mix":
            return mix_stats(found.withColumn("most", whole(F.col("most"))), mask, spec)
        return scaled_mean(finished(found.select(*spec.keys, *"nsq"), spec.keys, spec.precise), spec)
    found = images.reduced(good, spec.mode, weight)
    if spec.mode == "mean":
        return scaled_mean(finished(found, spec.keys, spec.precise), spec)
    return scaled(found.select(*spec.keys, whole(F.col("most" if spec.mode == "max" else "least")).alias("v")), spec)


@dataclass
class DecodedImages:
    """A folder decoded once into tiles in the shared folder; any number of stacks run on it without decoding again."""

    files: DataFrame
    tiles: DataFrame


def decode_images(spark: SparkSession, folder: str, resize: str | None = None, recursive: bool = False) -> DecodedImages:
    return DecodedImages(images.scan(spark, folder, recursive), settled(images.folder_tiles(spark, folder, recursive, resize), "tiles"))


def not_ready(n_frames: int, spec: StackSpec, output: str | None, mask_file: str | None, least: int = 3) -> str | None:
    """Why an interactive run should not start: too few frames to stack, no output, or no mask for a mix. None: it may."""
    if n_frames < least:
        return f"at least {least} frames are needed, there are {n_frames}"
    if not output:
        return "an output path is needed"
    return "a mask mix needs a mask" if spec.mode == "mask-mix" and not mask_file else None


def stack_images(spark: SparkSession, folder: str, spec: StackSpec, output: str | None = None, mask_file: str | None = None, resize: str | None = None, recursive: bool = False, check: bool = False, level: int = 6, decoded: DecodedImages | None = None, quality: int = 95) -> ImageStack:
    """Stacks the images of a folder, or what decode_images has made of one; one bad frame never fails a run.

    Files are decoded once, into tiles in the shared folder; frames of another shape than the first good one are left out.
    Every mode goes over tiles, but for means, clipping and mixing of 32 bits, which go over pixels. With an output path the result is written as PNG,
    TIFF or JPEG (another suffix is an error before anything is read), with the first file's text and profile. ``check`` adds a
    report of the files' suffixes, sizes and depths.
    """
    if output is not None and output.rsplit(".", 1)[-1].lower() not in WRITTEN:
        raise ValueError(f"{output}: files can be written as {', '.join(WRITTEN)}")
    if spec.mode == "mask-mix" and mask_file is None:
        raise ValueError("a mask mix needs a mask")
    decoded = decoded or decode_images(spark, folder, resize, recursive)
    files, cut = decoded.files, decoded.tiles
    told = images.told(files, cut)
    report = profile_report(file_attributes(told)) if check else None
    found = images.files_of(cut).withColumn("series", F.lit("sequence"))
    place = images.order(files)
    errors = found.where("NOT valid").join(place, "path").select("series", "i", "path", "reason")
    counts = counters(found, F.col("valid"))
    shape = ["height", "width", "channels"]
    head = found.where("valid").orderBy("path").select(*shape, "bits").first()
    if head is None:
        return ImageStack(False, "no frame could be decoded", None, errors, counts, None, report=report)
    bits, warning = output_bits(output, spec.out_bits or head["bits"])
    spec = replace(spec, keys=("y", "x", "c"), in_bits=head["bits"], out_bits=bits if bits in (8, 16, 32) else None)
    good = cut.where("data IS NOT NULL")
    for name in shape:
        good = good.where(F.col(name) == head[name])
    placed = place.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("n"))))  # one row
    mask = None if mask_file is None else image_mask(spark, mask_file, head["height"], head["width"], head["channels"])
    if spec.mode in ("max", "min") or good.where("bits > 16").isEmpty():
        result = reduce_tiles(good, spec, placed, mask)
    else:
        px = images.pixels(good.join(placed, "path"), "i", "n") if spec.faded else images.pixels(good)
        result = stack(px, replace(spec, wide=True), mask)
    about = None
    if output is not None:
        image = result if "v" in result.columns else result.withColumn("v", F.col("mu"))
        about = combined_info(told)
        images.write_image(image, output, bits or 8, level, about, quality)
    return ImageStack(True, warning or "", result, errors, counts, bits, about, report)
