"""Keys, locations, times, issue pages, usage numbers and diffs as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashlens.functions import bits

# Formats of usage summaries, issue pages and diffs.
NUMBER = r"\d[\d\s,]*"
USAGE = (
    (rf"(?i)Tokens:\s*({NUMBER})\s*input\b(?:.*?({NUMBER})\s*cached input\b)?.*?({NUMBER})\s*output\b", (1, 2, 3)),
    (rf"(?i)\binput:\s*({NUMBER})\b.*?\boutput:\s*({NUMBER})\b", (1, None, 2)),
    (rf"(?i)({NUMBER})\s*input\b.*?({NUMBER})\s*output\b", (1, None, 2)),
)
COST = r"\$\s*([\d.]+)"
ANSI = r"\x1b\[[0-9;?]*[A-Za-z]"
KEY_VALUE = r"^([A-Za-z ][A-Za-z 0-9/_-]*?):\s*(.*)$"
ESCAPES = ((r"\u003d", "="), (r"\u0026", "&"), (r"\u002F", "/"), (r"\u003c", "<"), (r"\u003e", ">"))
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
REDIRECT = r"(?i)https?://www\.google\.com/url\?q=(https?%3A%2F%2Foss-fuzz\.com%2F[^\"'\s<>]+)"
DIFF_FILE = r"(?m)^(?:---|\+\+\+) [ab]/(.+)$"
DIFF_FUNCTION = r"@@[^@]*@@\s*(?:\w+\s+)*(\w+)\s*\("
ARTIFACT = r"^diff --git a/(?:cups/|freetype/|zlib/|examples/|obj(?:[./-]|$)|obj\.stale-root-[^/]+/|tiff-config(?:[./-]|$)|tiff-config\.stale-root-[^/]+/|(?:.*/)?CMakeFiles/|.*\.o$|.*\.a$|.*\.so(?:\..*)?$)"


def normal_key(key: Column) -> Column:
    """Bars and white space as single spaces, trimmed (SCL-09)."""
    return F.trim(F.regexp_replace(F.coalesce(key, F.lit("")), r"[|\s]+", " "))


def state_top3(state: Column) -> Column:
    """The first three functions of a crash state (SCL-10)."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(state, F.lit("")), r"[|\n]"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)


def flat(text: Column) -> Column:
    """Lines joined by bars (SCL-11)."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" | "))


def first_segment(text: Column) -> Column:
    return F.split_part(flat(text), F.lit(" | "), F.lit(1))


def location(file: Column, line: Column) -> Column:
    """file:line, file, or `-` (SCL-15)."""
    return F.when(file.isNull() | (file == ""), "-").when(line.isNull(), file).otherwise(F.concat(file, F.lit(":"), line.cast("string")))


def right_cut(text: Column, width: int = 50) -> Column:
    """The last characters after `...`, if a text is wider (SCL-15)."""
    return F.when(F.char_length(text) > width, F.concat(F.lit("..."), F.right(text, F.lit(width - 3)))).otherwise(text)


def hours(seconds: Column) -> Column:
    """SCL-16."""
    return F.format_string("%.2f", seconds / 3600.0)


def relative_seconds(time: Column, start: Column, relative: Column) -> Column:
    """Seconds since the start; as they are where times are relative already; null without a start (SCL-16)."""
    return F.when(relative, time).when(start.isNotNull(), time - start)


def months_later(time: Column, months: int) -> Column:
    """A time and months of thirty days each (SCL-17)."""
    return time + F.make_dt_interval(F.lit(30 * months))


def next_midnight(time: Column) -> Column:
    """The day after (SCL-17)."""
    return F.date_add(F.to_date(time), 1)


def is_later_day(first: Column, second: Column) -> Column:
    """Whether the second time is on a later day than the first (SCL-17)."""
    return second >= next_midnight(first)


def number(text: Column) -> Column:
    """A number with thousands separators (SCL-25)."""
    return F.regexp_replace(text, r"[\s,]", "").try_cast("long")


def usage(text: Column) -> Column:
    """input, cached, output and cost from a usage summary: the first line that any of three forms fits (SRC-29)."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), ANSI, ""), "\n")

    def parse(line: Column) -> Column:
        found = None
        for pattern, groups in USAGE:
            a, b, c = (F.coalesce(number(F.regexp_extract(line, pattern, g)), F.lit(0)) if g else F.lit(0).cast("long") for g in groups)
            row = F.struct(a.alias("input"), b.alias("cached"), c.alias("output"))
            found = F.when(line.rlike(pattern), row) if found is None else found.when(line.rlike(pattern), row)
        return found

    rows = F.filter(F.transform(lines, parse), lambda x: x.isNotNull() & ((x["input"] > 0) | (x["output"] > 0) | (x["cached"] > 0)))
    first = F.get(rows, F.lit(0))
    part = lambda k: F.coalesce(first[k], F.lit(0))
    cost = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), COST, 1), F.lit("")).try_cast("double")
    return F.struct(part("input").alias("input"), part("cached").alias("cached"), part("output").alias("output"), F.coalesce(cost, F.lit(0.0)).alias("cost"))


def _each(text: Column, pattern: str, group: int, new: Callable[[Column], Column]) -> Column:
    """Each match of a pattern replaced by an expression of its group, in one pass."""
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(new(b), F.lit(""))))
    return F.array_join(parts, "")


def _entity(entity: Column) -> Column:
    """The character that an HTML entity stands for: those of the table by name, others by number; a number that is no character stays as it is."""
    digits = F.regexp_extract(entity, r"^&#([xX]?)([0-9a-fA-F]{1,8});$", 2)
    code = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
    legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    out = F.when(legal, F.decode(F.unhex(F.lpad(F.hex(F.when(legal, code).otherwise(F.lit(32))), 8, "0")), "UTF-32"))
    for name, character in reversed(ENTITIES):
        out = F.when(entity == name, character).otherwise(out)
    return F.coalesce(out, entity)


def unescaped(text: Column) -> Column:
    """JavaScript and HTML escapes of issue pages as characters: entities by a table of common names and by any number, each once (SCL-21)."""
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    names = "|".join(name[1:-1] for name, _ in ENTITIES)
    return _each(text, f"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|{names});", 0, _entity)


def direct_links(text: Column) -> Column:
    """Links that lead through a redirect as what they lead to, bytes after percent signs decoded; a sign without two hex digits stays (SCL-21)."""
    whole = lambda x: F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    return _each(text, REDIRECT, 1, lambda x: F.try_url_decode(whole(x)))


def issue_html(raw: Column) -> Column:
    """An issue page with its escapes and redirects resolved, so that links can be found in it (SCL-21)."""
    return direct_links(unescaped(raw))


def html_text(html: Column) -> Column:
    """Text of a page: breaks as lines, links as their text, no tags, single blank lines (SCL-22)."""
    text = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?is)<a\b[^>]*>(.*?)</a>", "$1")
    text = unescaped(F.regexp_replace(text, r"(?s)<[^>]+>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def quoted_block(text: Column, needle: str) -> Column:
    """The double-quoted string that holds a text, escapes kept (SCL-23)."""
    return F.nullif(F.regexp_extract(text, r'"((?:\\.|[^"\\])*' + needle + r'(?:\\.|[^"\\])*)"', 1), F.lit(""))


def key_values(block: Column) -> Column:
    """Map of a report's key lines; the last of equal keys counts (SCL-24)."""
    pairs = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(KEY_VALUE))
    parsed = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, KEY_VALUE, 1)).alias("k"), F.trim(F.regexp_extract(x, KEY_VALUE, 2)).alias("v")))

    def last(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda x: x["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(rows, lambda x: x["k"] == k), -1)["v"]))

    return bits.once(parsed, last)


def report_block(block: Column) -> Column:
    """A report's key lines, crash state and other lines, as struct (fields, crash_state, extra) (SCL-24).

    The lines after `Crash State:` that are no key lines are its frames, null if there are none; the first blank line after it
    ends the block. extra holds the lines before it that are no key lines. Each step's lines are computed once a row.
    """
    lines = F.transform(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.transform(lines, lambda x: F.struct(x.alias("x"), x.rlike(r"^Crash State:").alias("h"), x.rlike(KEY_VALUE).alias("k")))

    def kept(lines: Column) -> Column:
        """The lines up to the end of the block, and the place of the first heading, from 1."""
        head = F.array_position(F.transform(lines, lambda x: x["h"]), F.lit(True)).cast("int")
        return bits.once(F.struct(lines.alias("lines"), head.alias("head")), ended)

    def ended(s: Column) -> Column:
        end = F.array_position(F.transform(s["lines"], lambda x, i: (x["x"] == "") & (i >= s["head"]) & (s["head"] > 0)), F.lit(True)).cast("int")
        lines = F.when(end > 0, F.slice(s["lines"], F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(s["lines"])
        lines = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["x"].alias("x"), x["h"].alias("h"), x["k"].alias("k")))
        return bits.once(F.struct(lines.alias("lines"), s["head"].alias("head")), headed)

    def headed(s: Column) -> Column:
        # a second heading starts the frames anew
        last = F.coalesce(F.array_max(F.transform(F.filter(s["lines"], lambda x: x["h"]), lambda x: x["i"])), F.lit(-1))
        other = F.filter(s["lines"], lambda x: (x["x"] != "") & ~x["k"])
        return bits.once(F.struct(s["lines"].alias("lines"), s["head"].alias("head"), last.alias("last"), other.alias("other")), parts)

    def parts(s: Column) -> Column:
        state = F.transform(F.filter(s["other"], lambda x: (s["last"] >= 0) & (x["i"] > s["last"])), lambda x: x["x"])
        extra = F.transform(F.filter(s["other"], lambda x: (s["head"] <= 0) | (x["i"] < s["head"])), lambda x: x["x"])
        fields = key_values(F.array_join(F.transform(F.filter(s["lines"], lambda x: x["k"] & ~x["h"]), lambda x: x["x"]), "\n"))
        return F.struct(fields.alias("fields"), F.when(F.size(state) > 0, state).alias("crash_state"), F.nullif(F.array_join(extra, "\n"), F.lit("")).alias("extra"))

    return bits.once(lines, kept)


def json_pick(json: Column | str, paths: list[str], default: str) -> Column:
    """The first of several paths that a JSON text has, else a default (JSN-01, SCL-14)."""
    return F.coalesce(*(F.get_json_object(json, p) for p in paths), F.lit(default))


def first_url(text: Column) -> Column:
    """The first web address in a text, or null (SCL-14)."""
    return F.nullif(F.regexp_extract(text, r"https?://[^\s'\"<>]+", 0), F.lit(""))


def tail(text: Column, lines: int = 80, chars: int = 12000) -> Column:
    """The last lines, and of those the last characters (SCL-26)."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.right(F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(lines)), F.lit(lines)), "\n"), F.lit(chars))


def diff_files(diff: Column) -> Column:
    """Files that a unified diff touches (SRC-35)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(diff, F.lit(DIFF_FILE), 1)))


def diff_functions(diff: Column) -> Column:
    """Functions named by hunk headers (JOI-16)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(diff, F.lit(DIFF_FUNCTION), 1)))


def without_artifacts(diff: Column) -> Column:
    """A diff without the sections of build artifacts (FLT-07)."""
    return F.array_join(F.filter(F.split(diff, r"(?m)(?=^diff --git )"), lambda x: ~F.split_part(x, F.lit("\n"), F.lit(1)).rlike(ARTIFACT)), "")


def relative_location(path: Column, root: str) -> Column:
    """A trace location without its root (SCL-29)."""
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
