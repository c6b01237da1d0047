"""What a stack run is asked to do, and the small plans made on the driver before any Spark job."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

MODES = ("max", "min", "mean", "sigmaclip-mean", "mask-mix")
BITS = (8, 16, 32)


@dataclass(frozen=True)
class StackSpec:
    """Options of a run. Fades are shares of the frames; rejections are in standard deviations."""

    mode: str
    keys: tuple[str, ...] = ("k",)
    fade_in: float = 0.0
    fade_out: float = 0.0
    int_weight: bool = False
    rej_high: float = 3.0
    rej_low: float = 3.0
    max_iter: int = 5
    in_bits: int | None = None
    out_bits: int | None = None
    wide: bool = False
    precise: bool = False
    notes: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if min(self.fade_in, self.fade_out) < 0 or self.fade_in + self.fade_out > 1:
            raise ValueError("fades must not be negative and must not overlap")
        if self.max_iter < 1:
            raise ValueError("max_iter must be at least 1")
        if self.mode == "min" and self.int_weight and self.faded:
            raise ValueError("a minimum stack takes no integer weights")
        for bits in (self.in_bits, self.out_bits):
            if bits is not None and bits not in BITS:
                raise ValueError(f"bits must be one of {BITS}")

    @property
    def faded(self) -> bool:
        return self.fade_in > 0 or self.fade_out > 0

    @property
    def top(self) -> int | None:
        """Largest value of the input depth; None: unbounded data."""
        return None if self.in_bits is None else (1 << self.in_bits) - 1


def scale_between(low_bits: int, high_bits: int) -> int:
    """Full range to full range: 257 from 8 to 16 bits, 65537 from 16 to 32, 16843009 from 8 to 32."""
    return ((1 << high_bits) - 1) // ((1 << low_bits) - 1)


def partition_plan(n_frames: int, cores: int, wanted: int | None = None) -> list[tuple[int, int]]:
    """Frame ranges [from, to) that cover every frame: as many as wanted, else about the root of their number."""
    m = wanted or max(1, min(math.isqrt(n_frames), cores // 4 + (1 if cores <= 8 else 0)))
    m = max(1, min(m, max(1, n_frames)))
    return [(i * n_frames // m, (i + 1) * n_frames // m) for i in range(m)]


def resize_plan(option: str | None, height: int, width: int) -> tuple[int, int] | None:
    """(height, width) asked for by "WxH" or by the length of the long edge; None where nothing usable is asked."""
    if not option:
        return None
    if both := re.fullmatch(r"(\d+)x(\d+)", option):
        return int(both[2]), int(both[1])
    if not re.fullmatch(r"\d+", option):
        return None
    edge, long = int(option), max(height, width)
    return (edge, width * edge // long) if height >= width else (height * edge // long, edge)


def output_bits(file_name: str | None, bits: int | None) -> tuple[int | None, str | None]:
    """JPEG holds 8 bits only: the depth to write, and a warning where it is not the one asked for."""
    suffix = (file_name or "").rsplit(".", 1)[-1].lower()
    if suffix in ("jpg", "jpeg") and bits != 8:
        return 8, f"{suffix} files hold 8 bits; {bits} asked for"
    return bits, None


Stacker = Callable[[DataFrame, StackSpec], DataFrame]
