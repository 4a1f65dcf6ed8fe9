"""Timestamp layouts as guarded parser cascades; ``{s}`` stands for the text.

The guards hold what Spark's parsers would take beyond a layout (lower-case pm, blanks around, and so on) out.
Zone-less texts mean UTC: the session's time zone must be UTC. ``\\z`` and not ``$`` ends a pattern, since
``$`` also matches before a last line feed.
"""

from __future__ import annotations

_ZONED = r"^\\d{4}-\\d{2}-\\d{2}T\\d{1,2}:\\d{2}:\\d{2}([.,]\\d+)?(Z|[+-]\\d{2}:\\d{2})\\z"
_PLAIN = r"^\\d{4}-\\d{2}-\\d{2}[T ]\\d{1,2}:\\d{2}:\\d{2}([.,]\\d+)?\\z"
_DATE = r"^\\d{4}-\\d{2}-\\d{2}\\z"
_CLOCK = r"^\\d{1,2}/\\d{1,2}/\\d{4} \\d{1,2}:\\d{2}:\\d{2}(\\.\\d+)? (AM|PM)\\z"
_MONTH_FIRST = r"^[A-Za-z]{3} \\d{1,2}, \\d{4}\\z"
_DAY_MONTH = r"^\\d{1,2} [A-Za-z]{3,9} \\d{4}\\z"
_DAY_CLOCK = r"^\\d{1,2}/\\d{1,2}/\\d{4} \\d{1,2}:\\d{2}:\\d{2}( [AP]M)?\\z"
_DAY = r"^\\d{1,2}/\\d{1,2}/\\d{4}\\z"

#: Wall-clock text of an ISO layout, without zone, with a point before the fraction.
_WALL = r"replace(regexp_replace({s}, '(Z|[+-]\\d{2}:\\d{2})\\z', ''), ',', '.')"

#: The instant of a text in any of the eight layouts, else NULL.
PARSE = (
    f"CASE WHEN {{s}} RLIKE '{_ZONED}' THEN try_cast(replace({{s}}, ',', '.') AS timestamp)"
    f" WHEN {{s}} RLIKE '{_PLAIN}' THEN try_cast(replace({{s}}, ',', '.') AS timestamp)"
    f" WHEN {{s}} RLIKE '{_DATE}' THEN try_cast({{s}} AS timestamp)"
    f" WHEN {{s}} RLIKE '{_CLOCK}' THEN try_to_timestamp({{s}}, 'M/d/yyyy h:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS] a')"
    f" WHEN {{s}} RLIKE '{_MONTH_FIRST}' THEN try_to_timestamp(initcap({{s}}), 'MMM d, yyyy')"
    f" WHEN {{s}} RLIKE '{_DAY_MONTH}' THEN try_to_timestamp(initcap({{s}}), 'd MMMM yyyy') END"
)
#: The calendar date as written, in the value's own zone.
WALL_DATE = f"CASE WHEN {{s}} RLIKE '{_ZONED}' OR {{s}} RLIKE '{_PLAIN}' OR {{s}} RLIKE '{_DATE}' THEN try_cast(left({{s}}, 10) AS date) ELSE to_date({PARSE}) END"
#: Whether the time of day as written is midnight.
WALL_MIDNIGHT = (
    f"CASE WHEN {{s}} RLIKE '{_ZONED}' OR {{s}} RLIKE '{_PLAIN}' THEN substr({_WALL}, 12) RLIKE '^0?0:00:00(\\\\.0*)?\\\\z'"
    f" WHEN {{s}} RLIKE '{_CLOCK}' THEN {{s}} RLIKE ' 12:00:00(\\\\.0*)? AM\\\\z' ELSE true END"
)
#: The instant of a text in one of the three day-first layouts, else NULL.
PARSE_DAY_FIRST = (
    f"CASE WHEN {{s}} RLIKE '{_DAY_CLOCK}' AND ({{s}} LIKE '%M') THEN try_to_timestamp({{s}}, 'd/M/yyyy h:mm:ss a')"
    f" WHEN {{s}} RLIKE '{_DAY_CLOCK}' THEN try_to_timestamp({{s}}, 'd/M/yyyy H:mm:ss')"
    f" WHEN {{s}} RLIKE '{_DAY}' THEN try_to_timestamp({{s}}, 'd/M/yyyy') END"
)
#: Eight digits that name a calendar date.
PARSE_YYYYMMDD = r"CASE WHEN {s} RLIKE '^[0-9]{8}\\z' THEN to_date(try_to_timestamp({s}, 'yyyyMMdd')) END"


def of(template: str, text: str) -> str:
    """A template over a text expression."""
    return template.replace("{s}", text)
