"""Colours of the widget: luminance, contrast, and what can be read on an accent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accent where none is valid (as in the widget's defaults).
ACCENT = "#0f6b5c"


def luminance(color: Column) -> Column:
    """Relative luminance of ``#rrggbb``."""

    def channel(at: int) -> Column:
        s = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return channel(2) * 0.2126 + channel(4) * 0.7152 + channel(6) * 0.0722


def contrast_ratio(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def normalize_accent(value: Column, default: str = ACCENT) -> Column:
    """An opaque hex colour in full and lower case; anything else gives the default."""
    wide = F.regexp_replace(value, "([0-9A-Fa-f])", "$1$1")
    return F.when(F.rlike(value, F.lit("^#[0-9A-Fa-f]{6}$")), F.lower(value)).when(F.rlike(value, F.lit("^#[0-9A-Fa-f]{3}$")), F.lower(wide)).otherwise(default)


def contrast_on(accent: Column, light: str = "#ffffff", dark: str = "#000000") -> Column:
    """The better of two colours on an accent; black or white where neither reaches a ratio of 4.5."""
    ratio = lambda c: contrast_ratio(accent, F.lit(c))
    better = F.when(ratio(light) >= ratio(dark), light).otherwise(dark)
    plain = F.when(ratio("#ffffff") >= ratio("#000000"), "#ffffff").otherwise("#000000")
    return F.when(F.greatest(ratio(light), ratio(dark)) >= 4.5, better).otherwise(plain)


def page_theme(setting: Column, red: Column, green: Column, blue: Column) -> Column:
    """``light`` or ``dark`` as set, else by the brightness of the page's background."""
    return F.when(setting != "auto", setting).when((red * 299 + green * 587 + blue * 114) / 1000 < 128, "dark").otherwise("light")
