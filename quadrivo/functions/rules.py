"""Decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instants import DAY, as_column

SUBMITTED, CURRENT = "submitted", "inprogress"
NATIVE_CHARS = 50
#: Limits of what is decoded or unpacked.
IMAGE_PIXELS, RENDER_DPI = 50_000_000, 200
MEMBER_BYTES, TOTAL_BYTES, MEMBER_RATIO = 50 << 20, 200 << 20, 100
DEPTHS = ("basic", "deep")


def pending(due: Column | str, status: Column | str, now: int) -> Column:
    """A real due date that has not passed, and a known status other than submitted. Null where unknown: filter on it as it is, so that the optimizer can push it down."""
    due = as_column(due)
    return (due != 0) & (due >= now) & (as_column(status) != SUBMITTED)


def flag(condition: Column) -> Column:
    """A condition as a column that is never null."""
    return F.coalesce(condition, F.lit(False))


def upcoming(due: Column | str, now: int, days: int = 7) -> Column:
    due = as_column(due)
    return (due != 0) & due.between(now, now + days * DAY)


def current(classification: Column | str) -> Column:
    return as_column(classification) == CURRENT


def sufficient(page_lengths: Column | str, least: int = NATIVE_CHARS) -> Column:
    """Whether the upper median of page lengths reaches the least; false without pages."""
    c = as_column(page_lengths)
    return flag(F.get(F.sort_array(c), F.floor(F.size(c) / 2).cast("int")) >= least)


def render_scale(width: Column | str, height: Column | str, dpi: int = RENDER_DPI, pixels: int = IMAGE_PIXELS) -> Column:
    """Scale for a page in points (72 an inch): that of dpi, or less so that the picture stays within the pixels."""
    base = dpi / 72
    made = as_column(width) * base * as_column(height) * base
    return F.when(made > pixels, F.lit(base) * F.sqrt(F.lit(float(pixels)) / made)).otherwise(F.lit(base))


def image_allowed(width: Column | str, height: Column | str) -> Column:
    return as_column(width).cast("bigint") * as_column(height) <= IMAGE_PIXELS


def safe_members(members: Column | str) -> Column:
    """Which of an archive's members (array of struct<size, packed>) may be unpacked, in order. A refused one does not count towards the total."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, m: Column) -> Column:
        size, packed = m["size"].cast("bigint"), m["packed"].cast("bigint")
        fits = (size <= MEMBER_BYTES) & ((packed <= 0) | (size <= MEMBER_RATIO * packed)) & (acc["total"] + size <= TOTAL_BYTES)
        return F.struct((acc["total"] + F.when(fits, size).otherwise(F.lit(0))).cast("bigint").alias("total"), F.concat(acc["ok"], F.array(fits)).alias("ok"))

    return F.aggregate(as_column(members), start, step, lambda acc: acc["ok"])


def valid_depth(depth: Column | str) -> Column:
    return as_column(depth).isin(*DEPTHS)
