"""Names and units of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that are peeled off a name.
AXES = ("x", "y", "z", "w")
UNITS = ("s", "ms", "us", "ns", "m", "mm", "cm", "rad", "deg", "mrad", "hz", "n", "nm", "v", "a", "c", "pct")


#: A time unit at the end of a name.
UNIT_END = r"(?:_|_in_|\(|\[)(s|ms|us|ns|sec|msec|usec|nsec)[)\]]?$"


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def collapse(name: Column) -> Column:
    """Lower case; runs of anything else than a-z and 0-9 become one underscore, none at either end."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def normalised(name: str) -> str:
    """The last dotted segment, collapsed, without trailing axes and units; the whole if nothing would be left."""
    parts = re.sub("[^a-z0-9]+", "_", name.rsplit(".", 1)[-1].lower()).strip("_").split("_")
    while len(parts) > 1 and parts[-1] in AXES + UNITS:
        parts.pop()
    return "_".join(parts)


def tokens(name: Column) -> Column:
    """Parts of a camel- or snake-cased name, lower-cased."""
    return F.transform(F.regexp_extract_all(name, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), lambda x: F.lower(x))


def unit_of_name(name: Column) -> Column:
    """s, ms, us or ns, or sec, msec, usec or nsec, after an underscore, ``in`` or within brackets at the end of a name."""
    unit = F.regexp_extract(F.lower(name), UNIT_END, 1)
    return F.when(unit != "", F.regexp_replace(unit, "sec$", "s"))


def unit_of_magnitude(gap: Column) -> Column:
    """The unit in which a usual gap has this size; unknown for none."""
    return F.when(gap <= 0, F.lit(None).cast("string")).when(gap < 1, "s").when(gap < 1e3, "ms").when(gap < 1e6, "us").when(gap.isNotNull(), "ns")


def seconds_a_tick(unit: Column) -> Column:
    return F.when(unit == "s", 1.0).when(unit == "ms", 1e-3).when(unit == "us", 1e-6).when(unit == "ns", 1e-9)


def timestamp_of_key(key: Column) -> Column:
    """Epoch seconds of a trailing YYYY-MM-DD-HHh-MMm-SSs or YYYY-MM-DDTHH:MM:SS, UTC; null for none."""
    g = [F.regexp_extract(key, r"(\d{4})-(\d\d)-(\d\d)[-T](\d\d)(?:h-|:)(\d\d)(?:m-|:)(\d\d)s?$", k).try_cast("int") for k in range(1, 7)]
    days = F.unix_date(F.make_date(g[0], g[1], g[2]))
    return days * 86400 + g[3] * 3600 + g[4] * 60 + g[5]


def angle_period(unit: Column) -> Column:
    import math

    return F.when(unit == "rad", 2 * math.pi).when(unit == "deg", 360.0).when(unit == "mrad", 2000 * math.pi)


def split_range(index: Column, ranges: dict[str, str]) -> Column:
    """The one split whose ``a:b`` holds the index; null for none or for more than one."""
    inside = [F.when((index >= int(r.split(":")[0])) & (index < int(r.split(":")[1])), F.lit(name)) for name, r in sorted(ranges.items())]
    found = F.array_compact(F.array(*inside)) if inside else F.array().cast("array<string>")
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))
