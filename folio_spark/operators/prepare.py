"""The fixed order of grid steps, with options and presets."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..session import settled
from . import grid as G
from .components import edges, trim_margins


@dataclass(frozen=True)
class Options:
    """Which steps run and how; ``None`` or ``False`` skips a step."""

    denoise: str | None = "median"
    median_size: int = 3
    upscale: float | None = None
    interpolation: str = "lanczos"
    sharpen: bool = False
    radius: float = 2.0
    percent: float = 150
    sharpen_threshold: float = 3
    contrast: str | None = "clahe"
    clip: float = 2.0
    tiles: tuple[int, int] = (8, 8)
    deskew: str | None = "lines"
    votes: int = 200
    least_angle: float = 0.5
    trim: bool = True
    margin_threshold: float = 240
    trim_kernel: tuple[int, int] | None = (10, 10)
    trim_pad: int = 10
    binary: str | None = "otsu"


DEFAULT = Options()
LIGHT = Options(denoise=None, deskew=None, trim=False, binary=None)
AGGRESSIVE = Options(median_size=5, clip=3.0, binary="adaptive")
PRESETS = {"default": DEFAULT, "light": LIGHT, "aggressive": AGGRESSIVE}


def preset(name: str, **changes) -> Options:
    """A named option set (unknown names give the default) with single changes."""
    return replace(PRESETS.get(name, DEFAULT), **changes)


def denoised(grid: DataFrame, method: str | None, size: int = 3) -> DataFrame:
    if method == "gaussian":
        return G.gaussian(grid, u8=True)
    if method == "bilateral":
        return G.bilateral(grid, u8=True)
    return G.median(grid, size) if method == "median" else grid


def deskewed(grid: DataFrame, options: Options) -> DataFrame:
    points = edges(grid)
    if options.deskew == "projection":
        angles = G.projection_angle(points)
    else:
        angles = G.dominant_angle(points, options.votes, options.least_angle)
    return G.rotate(grid, angles, u8=True)


def prepare(grid: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Denoise, upscale, sharpen, contrast, deskew, trim, binarise - in this order.

    Most steps read their input more than once, so every step is settled before the
    next one: without that the plan would double with each step.
    """
    out = settled(denoised(G.sized(grid), options.denoise, options.median_size))
    if options.upscale:
        out = settled(G.resize(out, options.upscale, options.interpolation, u8=True))
    if options.sharpen:
        out = settled(
            G.unsharp_radius(out, options.radius, options.percent, options.sharpen_threshold, u8=True)
        )
    if options.contrast == "clahe":
        out = settled(G.clahe(out, options.clip, options.tiles))
    elif options.contrast == "equalize":
        out = settled(G.equalize(out))
    if options.deskew:
        out = settled(deskewed(out, options))
    if options.trim:
        out = settled(trim_margins(
            out, margin_threshold=options.margin_threshold, kernel=options.trim_kernel, pad=options.trim_pad
        ))
    return G.binarize(out, options.binary) if options.binary else out


def filter_preset(grid: DataFrame, name: str) -> DataFrame:
    """``denoise``, ``sharpen`` or ``ocr``; an unknown name leaves the grid as it is."""
    if name == "denoise":
        return G.bilateral(grid, u8=True)
    if name == "sharpen":
        return G.sharpen(grid)
    if name == "ocr":
        return G.binarize(G.median(G.clahe(grid)), "otsu")
    return grid
