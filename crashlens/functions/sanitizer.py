"""Sanitizer details in crash logs and job types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of sanitizer logs, field names and the ordered rules of crash types.
ERROR = r"ERROR:\s+([^:]+):\s+([^\s]+)"
ACCESS = r"\b(READ|WRITE) of size (\d+)\b"
REGION = r"\bis located\s+(\d+)\s+bytes?\s+((?:to the )?(?:left|right)|inside)\s+of\s+(\d+)-byte region"
HEADER_CLASS = r"(?s)ERROR:\s*\w+Sanitizer:\s*([\w-]+)\s+on address.*?\n(READ|WRITE)\s+of\s+size"
SUMMARY_CLASS = r"SUMMARY:\s*\w+Sanitizer:\s*([\w-]+)"
DIRECTION = r"(READ|WRITE)\s+of\s+size"
ERROR_LINE = r"(?m)==ERROR:\s*AddressSanitizer:\s*(.+?)(?=\s+on|\s+address|\s*$)"
FIELDS = ("sanitizer", "error_type", "access_type", "access_size", "region_offset", "region_relation", "region_size")
CRASH_TYPES = (
    ("resource/oom", r"(?i)\b(out-of-memory|oom|Rss-limit)"),
    ("resource/timeout", r"(?i)\b(timeout|deadly\-signal\-abrt)"),
    ("abort/assert", r"(?i)\b(abrt|abort|assert|unreachable)"),
    ("stack-overflow", r"(?i)stack[- ]overflow"),
    ("stack-buffer", r"(?i)stack-buffer"),
    ("heap-overflow", r"(?i)heap-buffer"),
    ("heap-use-after-free", r"(?i)heap-use-after-free"),
    ("use-after-scope", r"(?i)(stack|heap)-use-after"),
    ("double-free", r"(?i)double-free"),
    ("null-deref", r"(?i)null-deref"),
    ("segv/unknown", r"(?i)\b(SEGV|UNKNOWN|deadlysignal)"),
    ("integer-overflow", r"(?i)integer-overflow"),
    ("undefined-behavior", r"(?i)undefined"),
)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def signature(text: Column) -> Column:
    """Seven fields, null where unknown (SCL-06)."""
    number = lambda p, g: _part(text, p, g).try_cast("int")
    parts = (_part(text, ERROR, 1), _part(text, ERROR, 2), _part(text, ACCESS, 1), number(ACCESS, 2), number(REGION, 1), F.replace(_part(text, REGION, 2), F.lit("to the "), F.lit("")), number(REGION, 3))
    return F.struct(*(p.alias(n) for p, n in zip(parts, FIELDS, strict=True)))


def score(crash: Column, reference: Column) -> Column:
    """Equal fields, or minus the fields that differ if any does; unknown ones don't count (DOM-01)."""
    total = lambda test: reduce(lambda a, b: a + b, (F.coalesce(test(crash[f], reference[f]).cast("int"), F.lit(0)) for f in FIELDS))
    differ = total(lambda a, b: a != b)
    return F.when(differ > 0, -differ).otherwise(total(lambda a, b: a == b))


def crash_class(text: Column) -> tuple[Column, Column]:
    """Error class and direction, from the header, else from the summary (SCL-07)."""
    kind = _part(text, HEADER_CLASS, 1)
    return F.coalesce(kind, _part(text, SUMMARY_CLASS, 1)), F.when(kind.isNotNull(), _part(text, HEADER_CLASS, 2)).otherwise(_part(text, DIRECTION, 1))


def error_class(text: Column) -> Column:
    """The error of the first ERROR line, `?` without one (SCL-07)."""
    return F.coalesce(F.trim(_part(text, ERROR_LINE, 1)), F.lit("?"))


def crash_type(kind: Column) -> Column:
    """First rule that holds, else `other` (SCL-12)."""
    text, out = F.coalesce(kind, F.lit("")), None
    for name, pattern in CRASH_TYPES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("other")


def architecture(job: Column) -> Column:
    """i386 or x86_64 (SCL-13)."""
    return F.when(F.coalesce(job, F.lit("")).contains("_i386"), "i386").otherwise("x86_64")


def sanitizer(job: Column) -> Column:
    """The sanitizer of a job type; an unknown one is an error (SCL-13)."""
    named = F.when(job.contains("_asan"), "address (ASAN)").when(job.contains("_msan"), "memory (MSAN)").when(job.contains("_ubsan"), "undefined (UBSAN)")
    return F.coalesce(named, F.raise_error(F.concat(F.lit("unknown sanitizer: "), F.coalesce(job, F.lit("null")))))
