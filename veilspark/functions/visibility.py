"""What a reader sees of a span, as Column expressions. All limits are strict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..schema import INVISIBLE, SUSPICIOUS, UNKNOWN, VISIBLE
from .color import contrast_ratio, has_colors


def number(setting: float | Column) -> Column:
    """A setting as a column: settings may differ from row to row."""
    return setting if isinstance(setting, Column) else F.lit(float(setting))


def switched(condition: Column, setting: bool | Column) -> Column:
    """condition where the setting is on, false elsewhere."""
    return condition & setting if isinstance(setting, Column) else condition if setting else F.lit(False)


def larger(a: float | Column, b: float | Column) -> float | Column:
    return F.greatest(number(a), number(b)) if isinstance(a, Column) or isinstance(b, Column) else max(a, b)


def _graded(value: Column, limits: list[tuple[float | Column, str]], missing: str) -> Column:
    out = F.when(value.isNull(), missing)
    for limit, status in limits:
        out = out.when(value < number(limit), status)
    return out.otherwise(VISIBLE)


def contrast_status(contrast: Column, c: Config = DEFAULT) -> Column:
    return _graded(contrast, [(c.invisible_contrast, INVISIBLE), (c.suspicious_contrast, SUSPICIOUS), (c.min_contrast, SUSPICIOUS)], UNKNOWN)


def font_size_status(size: Column, c: Config = DEFAULT) -> Column:
    return _graded(size, [(c.invisible_size, INVISIBLE), (c.suspicious_size, SUSPICIOUS), (c.min_readable_size, SUSPICIOUS)], VISIBLE)


def _bbox_tests(box: Column, c: Config) -> tuple[Column, Column]:
    """Whether the box makes a span invisible, and whether it makes it suspicious if it doesn't."""
    wide, high = number(c.page_width), number(c.page_height)
    flat = (box["x1"] - box["x0"] <= 0) | (box["y1"] - box["y0"] <= 0)
    beyond = (box["x1"] < 0) | (box["y1"] < 0) | (box["x0"] > wide) | (box["y0"] > high)
    across = (box["x0"] < 0) | (box["y0"] < 0) | (box["x1"] > wide) | (box["y1"] > high)
    return switched(flat, c.check_zero_area) | switched(beyond, c.check_off_screen), switched(across, c.check_off_screen)


def bbox_status(box: Column, c: Config = DEFAULT) -> Column:
    gone, part = _bbox_tests(box, c)
    return F.when(gone, INVISIBLE).when(part, SUSPICIOUS).otherwise(VISIBLE)


def visibility_status(contrast: Column, size: Column, box: Column, known: Column, c: Config = DEFAULT) -> Column:
    """The worst of the three. Two limits of a kind give the same status, so the larger one decides, and each
    value is compared twice only."""
    gone, part = _bbox_tests(box, c)
    below = lambda x, limit: F.coalesce(x < number(limit), F.lit(False))
    gone = below(contrast, c.invisible_contrast) | below(size, c.invisible_size) | gone
    part = below(contrast, larger(c.suspicious_contrast, c.min_contrast)) | below(size, larger(c.suspicious_size, c.min_readable_size)) | part
    return F.when(~known | contrast.isNull(), UNKNOWN).when(gone, INVISIBLE).when(part, SUSPICIOUS).otherwise(VISIBLE)


def is_hidden(status: Column) -> Column:
    return status.isin(SUSPICIOUS, INVISIBLE)


def metadata_known(fg: Column, bg: Column) -> Column:
    return has_colors(fg, bg)


def status_of(fg: Column, bg: Column, size: Column, box: Column, c: Config = DEFAULT) -> Column:
    return visibility_status(contrast_ratio(fg, bg), size, box, metadata_known(fg, bg), c)
