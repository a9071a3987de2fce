"""Text for reports: previews, reasons, numbers as printed, escaping, span descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the reasons, whatever the configuration.
NEARLY_INVISIBLE, LOW_CONTRAST, MICROSCOPIC, VERY_SMALL = 1.5, 3.0, 1.0, 4.0


def preview(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def fixed(x: Column, places: int) -> Column:
    """x with so many decimal places, halves to even on the exact binary value."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def reasons(contrast: Column, size: Column, places: int | None = None) -> Column:
    """Why a span is hidden; sizes with `places` decimals or, if None, as the shortest number."""
    ratio = fixed(contrast, 2)
    points = F.concat(fixed(size, places) if places is not None else size.cast("string"), F.lit("pt)"))
    by_contrast = F.when(contrast < NEARLY_INVISIBLE, F.concat(F.lit("nearly invisible (contrast: "), ratio, F.lit(":1)"))).when(contrast < LOW_CONTRAST, F.concat(F.lit("low contrast ("), ratio, F.lit(":1)")))
    by_size = F.when(size == 0, F.lit(None).cast("string")).when(size < MICROSCOPIC, F.concat(F.lit("microscopic ("), points)).when(size < VERY_SMALL, F.concat(F.lit("very small ("), points))
    return F.filter(F.array(by_contrast, by_size), lambda x: x.isNotNull())


def severity(status: Column) -> Column:
    return F.when(status == "invisible", "INVISIBLE").otherwise("SUSPICIOUS")


def escape_html(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (" ", "&nbsp;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def color_text(color: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", color["r"].cast("string"), color["g"].cast("string"), color["b"].cast("string")), F.lit(")"))


def span_repr(page: Column, text: Column, size: Column, fg: Column, bg: Column) -> Column:
    """A one-line description; a size of 0 and a missing colour are left out."""
    sized = F.when(size.isNotNull() & (size != 0), F.concat(F.lit(" size="), size.cast("string"), F.lit("pt"))).otherwise("")
    colored = F.when(fg.isNotNull() & bg.isNotNull(), F.concat(F.lit(" fg="), color_text(fg), F.lit(" bg="), color_text(bg))).otherwise("")
    return F.concat(F.lit("TextSpan(page="), page.cast("string"), F.lit(", text='"), preview(text, 50), F.lit("'"), sized, colored, F.lit(")"))
