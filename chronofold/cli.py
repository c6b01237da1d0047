"""python -m chronofold.cli MODE FOLDER OUTPUT: stacks the images of a folder."""

from __future__ import annotations

import argparse
import sys

from chronofold.plans.stacking import stack_images
from chronofold.spec import BITS, MODES, StackSpec


def options() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="chronofold", description=__doc__)
    parser.add_argument("mode", choices=MODES)
    parser.add_argument("folder", help="folder of images, taken in the order of their paths")
    parser.add_argument("output", help="PNG, TIFF or JPEG file")
    parser.add_argument("--fade-in", type=float, default=0.0, help="share of the frames that fade in")
    parser.add_argument("--fade-out", type=float, default=0.0, help="share of the frames that fade out")
    parser.add_argument("--int-weight", action="store_true", help="whole-number weights")
    parser.add_argument("--mask", help="mask image, white where the maximum is wanted")
    parser.add_argument("--output-bits", type=int, choices=BITS)
    parser.add_argument("--resize", help='"WxH", or the length of the long edge')
    parser.add_argument("--rej-high", type=float, default=3.0)
    parser.add_argument("--rej-low", type=float, default=3.0)
    parser.add_argument("--max-iter", type=int, default=5)
    parser.add_argument("--png-level", type=int, default=6, choices=range(10))
    parser.add_argument("--jpg-quality", type=int, default=95, help="0 to 100")
    parser.add_argument("--recursive", action="store_true")
    parser.add_argument("--report", action="store_true", help="print the files' suffixes, sizes and depths first")
    return parser


def main(arguments: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = options().parse_args(arguments)
    spec = StackSpec(args.mode, fade_in=args.fade_in, fade_out=args.fade_out, int_weight=args.int_weight, rej_high=args.rej_high, rej_low=args.rej_low, max_iter=args.max_iter, out_bits=args.output_bits)
    spark = SparkSession.builder.getOrCreate()
    run = stack_images(spark, args.folder, spec, args.output, args.mask, args.resize, args.recursive, args.report, args.png_level, quality=args.jpg_quality)
    for row in run.report.collect() if run.report is not None else ():  # three rows
        print(f"{row['attr']}: mostly {row['mode_value']} ({row['mode_n']})" + "".join(f", {o['value']} ({o['n']})" for o in row["others"] or ()))
    for row in run.counts.collect():  # one row a sequence
        print(f"{row['stacked']} stacked, {row['failed']} failed")
    if run.message:
        print(run.message, file=sys.stderr)
    return 0 if run.ok else 1


if __name__ == "__main__":
    sys.exit(main())
