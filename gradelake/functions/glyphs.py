"""Text measuring with the advance widths of the standard Helvetica font."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.coords import _c

# Helvetica advance widths in 1/1000 em for the printable ASCII characters.
HELVETICA_WIDTHS: dict[int, str] = {
    191: "'",
    222: "ijl",
    260: "|",
    278: " !,./:;I[\\]ft",
    333: "()-`r",
    334: "{}",
    355: '"',
    389: "*",
    469: "^",
    500: "Jcksvxyz",
    556: "#$0123456789?L_abdeghnopqu",
    584: "+<=>~",
    611: "FTZ",
    667: "&ABEKPSVXY",
    722: "CDHNRUw",
    778: "GOQ",
    833: "Mm",
    889: "%",
    944: "W",
    1015: "@",
}
OTHER_WIDTH = 650  # characters outside the table, 0.65 em


def width_units(text: Column) -> Column:
    """Sum of advance widths in 1/1000 em, as an exact integer.

    Counting per width class with translate() keeps this a flat expression,
    with no loop over characters.
    """
    size = F.length(text)
    known = sum((len_of(text, chars) for chars in HELVETICA_WIDTHS.values()), F.lit(0))
    total = sum((len_of(text, chars) * width for width, chars in HELVETICA_WIDTHS.items()), F.lit(0))
    return total + (size - known) * OTHER_WIDTH


def len_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_width(text, font_size) -> Column:
    return width_units(_c(text)) * _c(font_size) / 1000.0


def cells_needed(text, font_size, cell_size) -> Column:
    """Columns a text needs on one line; 0 when blank."""
    t = F.trim(F.coalesce(_c(text), F.lit("")))
    cells = F.ceil(text_width(t, font_size) / _c(cell_size)).cast("int")
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), cells))


_ADVANCE = np.full(128, OTHER_WIDTH, dtype=np.int64)
for _width, _chars in HELVETICA_WIDTHS.items():
    _ADVANCE[[ord(c) for c in _chars]] = _width


def word_units(text: str) -> list[int]:
    """Advance widths in 1/1000 em of the words of a text, which single blanks part."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    advance = np.where(codes < 128, _ADVANCE[np.minimum(codes, 127)], OTHER_WIDTH)
    blank = codes == 32
    advance[blank] = 0
    starts = np.concatenate(([0], np.flatnonzero(blank)))
    return np.add.reduceat(advance, starts).tolist()


def _wraps(text: str, size: float, width: float, height: float, line_h: float) -> bool:
    space, lines, cur = 278 * size / 1000.0, 1, 0.0
    for units in word_units(text):
        w = units * size / 1000.0
        if w > width:
            return False
        if cur == 0.0:
            cur = w
        elif cur + space + w <= width:
            cur = cur + space + w
        else:
            lines, cur = lines + 1, w
            if lines * line_h > height:  # more words need no fewer lines
                return False
    return lines * line_h <= height


def _wrapped(text: pd.Series, size: pd.Series, width: pd.Series, height: pd.Series, line_h: pd.Series) -> pd.Series:
    """Whether each text, wrapped at its blanks, stays within width and height; null where one of the numbers is null."""
    rows = zip(text, size, width, height, line_h)
    return pd.Series([None if any(pd.isna(x) for x in row) else row[0] == "" or _wraps(*row) for row in rows], dtype=object)


def comment_fits(comment, font_size, cols, rows, cell_size, margin: float = 0.05, line_mult: float = 1.4) -> Column:
    """Whether a word-wrapped comment fits its cell rectangle.

    Five percent of both sides stays free, lines are 1.4 font sizes high, and a
    single word wider than the box fails (no hyphenation). Each word of a text is looked at once.
    """
    size, cs = _c(font_size), _c(cell_size)
    avail_w = _c(cols) * cs * (1.0 - margin)
    avail_h = _c(rows) * cs * (1.0 - margin)
    line_h = size * line_mult
    text = F.trim(F.regexp_replace(F.coalesce(_c(comment), F.lit("")), r"\s+", " "))
    valid = (cs > 0) & (_c(cols) > 0) & (_c(rows) > 0) & (line_h <= avail_h)
    wraps = F.pandas_udf(_wrapped, "boolean")
    return F.when(~valid, False).when(text == "", True).otherwise(wraps(text, *[c.cast("double") for c in (size, avail_w, avail_h, line_h)]))
