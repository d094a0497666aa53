"""String columns: stripping, splitting, slugs, states and fixed-point formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends (Unicode's, unlike trim)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def before(c: Column, mark: str) -> Column:
    """The part before the first mark, null if there is none."""
    at = F.instr(c, mark)
    return F.when(at > 0, c.substr(F.lit(1), at - 1))


def after(c: Column, mark: str) -> Column:
    at = F.instr(c, mark)
    return F.when(at > 0, c.substr(at + len(mark), F.length(c)))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def title_of_id(c: Column) -> Column:
    """Last part of a path-like id with blanks for hyphens."""
    return F.replace(F.element_at(F.split(c, "/"), -1), F.lit("-"), F.lit(" "))


def owned_id(owner: Column, name: Column) -> Column:
    return F.concat(owner, F.lit("/"), slug(name))


def truth_text(c: Column) -> Column:
    return c.cast("string")


#: Words in a state text and the state they stand for; the first that occurs counts.
STATE_WORDS = (("complete", "complete"), ("error", "failed"), ("failed", "failed"), ("cancel", "cancelled"), ("running", "running"), ("queued", "queued"))


def state(c: Column) -> Column:
    text = F.lower(c)
    return F.coalesce(*(F.when(F.contains(text, F.lit(word)), name) for word, name in STATE_WORDS), F.lit("unknown"))


def shorten(c: Column, most: int = 50) -> Column:
    """Texts beyond `most` characters end in three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def two_decimals(c: Column) -> Column:
    """A number below 2^52 with two decimals, rounded as the double that it is, not as the decimal that is printed for it; a tie, which only a
    multiple of 1/8 can be, goes to the even digit."""
    x, one = c.cast("double"), 2.0**52
    whole = F.floor(F.abs(x)).cast("long")
    # the part behind the point in steps of 2^-52, and what is left below them
    part = (F.abs(x) - whole) * one
    steps = F.floor(part).cast("long")
    cents = F.shiftright(steps * 100, 52)
    over = (steps * 100 - cents * (1 << 52) - (1 << 51)).cast("double") + (part - steps) * 100
    up = (over > 0) | ((over == 0) & (cents % 2 == 1))
    total = whole * 100 + cents + F.when(up, 1).otherwise(0)
    digits = F.concat(F.call_function("div", total, F.lit(100)).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), digits)


def seconds_of(c: Column) -> Column:
    """A day-time interval as seconds."""
    return F.extract(F.lit("SECOND"), c).cast("double") + 60 * F.extract(F.lit("MINUTE"), c) + 3600 * F.extract(F.lit("HOUR"), c) + 86400 * F.extract(F.lit("DAY"), c)


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def new_job_id() -> Column:
    return F.concat(F.lit("job-"), F.replace(F.uuid(), F.lit("-"), F.lit("")).substr(1, 12))
