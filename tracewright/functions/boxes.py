"""Picture regions, colours, times, cursors and canonical JSON."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
_PIXELS = r"^\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*$"
_SHARES = rf"^\s*[Pp][Cc][Tt]:\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*$"


def region_box(region: Column, width: Column, height: Column) -> Column:
    """x, y, w, h of a region 'x,y,w,h' or 'pct:x,y,w,h', each side rounded half to even; null if it is malformed, empty or not inside the picture."""
    pixel = lambda i: F.nullif(F.regexp_extract(region, _PIXELS, i), F.lit("")).try_cast("bigint")
    share = lambda i, of: F.bround(F.nullif(F.regexp_extract(region, _SHARES, i), F.lit("")).cast("double") / 100.0 * of, 0).cast("bigint")
    pct = region.rlike(_SHARES)
    x, y, w, h = (F.when(pct, share(i, of)).otherwise(pixel(i)) for i, of in ((1, width), (2, height), (3, width), (4, height)))
    return F.when((w > 0) & (h > 0) & (x + w <= width) & (y + h <= height), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def box_region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """'x,y,w,h' of a box; null if a side is negative."""
    return F.when(F.least(x, y, w, h) >= 0, F.concat_ws(",", *[c.cast("string") for c in (x, y, w, h)]))


def quantised(channel: Column) -> Column:
    """A colour channel with its upper five bits only."""
    return channel.bitwiseAND(0xF8)


def skin(r: Column, g: Column, b: Column) -> Column:
    """Whether a colour may be skin."""
    return (r > 60) & (r > g) & (g > b) & (r - b > 20)


def instant(text: Column) -> Column:
    """The time an ISO 8601 text names, with Z or an offset or, without one, in the session's zone; null if it is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def token_offset(text: Column, start: Column) -> Column:
    """How many words, cut at white space, stand before a position (from 0)."""
    before = F.regexp_replace(text.substr(F.lit(1), start), r"(?U)^\s+|\s+$", "")
    return F.when(before == "", 0).otherwise(F.size(F.split(before, r"(?U)\s+")))


def stable_json(values: dict[str, Column]) -> Column:
    """One JSON text for equal values: keys sorted, nulls kept."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"})


def cursor_for(offset: int) -> str:
    """An opaque mark of a place in a list."""
    return base64.urlsafe_b64encode(json.dumps({"o": offset}, separators=(",", ":")).encode()).decode()


def offset_from(cursor: str | None) -> int:
    """The place a mark names; 0 without one. A mark that is none is a ValueError."""
    if not cursor:
        return 0
    try:
        place = json.loads(base64.b64decode(cursor.encode("ascii"), b"-_", validate=True))
        return max(0, int(place.get("o", 0)))
    except (ValueError, TypeError, AttributeError) as e:
        raise ValueError(f"no cursor: {cursor!r}") from e


def cursors(offset: int, limit: int, total: int) -> tuple[str | None, str | None]:
    """The marks of the next and the previous page, None where there is none."""
    return cursor_for(offset + limit) if offset + limit < total else None, cursor_for(max(offset - limit, 0)) if offset > 0 else None
