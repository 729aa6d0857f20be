"""Text functions of transcripts, as Catalyst expressions.

White space is what Unicode and the C0 separators make it; digits of times are
ASCII. Positions and lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that text is stripped of and split at, and a time of day.
WS = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: White space, and all else, as classes that settle most characters by their first range.
SPACE, INK = f"[[^!-~]&&[{WS}]]", f"[!-~[^{WS}]]"
TIME = "[0-9]{1,2}:[0-9]{2}:[0-9]{2}"


def strip(c: Column) -> Column:
    """Without white space at the ends; a run inside is tried once, from its first character."""
    return F.regexp_replace(c, f"^{SPACE}++|(?<!{SPACE}){SPACE}++\\z", "")


def normalize(c: Column) -> Column:
    """Lower case, white space as one space, stripped."""
    return _single_spaced(F.lower(c))


def _single_spaced(c: Column) -> Column:
    """White space as one space, none at the ends; what is one space already isn't touched."""
    return F.trim(F.regexp_replace(c, f"[[^ -~]&&[{WS}]]{SPACE}*| {SPACE}+", " "))


def words(c: Column) -> Column:
    """The words, split at white space; none for blank text."""
    return F.when(~c.rlike(INK), F.array().cast("array<string>")).otherwise(F.split(_single_spaced(c), " "))


def word_count(c: Column) -> Column:
    """How many words, without making them: one more than the spaces between them."""
    each = F.length(F.regexp_replace(_single_spaced(c), "[^ ]+", "")) + 1
    return F.when(c.rlike(INK), each).when(c.isNotNull(), F.lit(0))


def skip_words(c: Column, n: Column) -> Column:
    """The words after the first n, joined by spaces."""
    w = words(c)
    return F.array_join(F.slice(w, n + 1, F.greatest(F.size(w), F.lit(1))), " ")


def first_time(c: Column) -> Column:
    """The first time in the text, or ''."""
    return F.regexp_extract(c, f"({TIME})", 1)


def around_time(c: Column) -> tuple[Column, Column]:
    """Stripped text before and after the first time."""
    at = F.regexp_instr(c, F.lit(f"({TIME})"))
    return strip(F.substring(c, F.lit(1), at - 1)), strip(F.substring(c, at + F.length(first_time(c)), F.length(c)))


def time_seconds(c: Column) -> Column:
    """Seconds of H:M:S or M:S; 0 for any other number of parts. No range is checked."""
    p = F.split(c, ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    return F.coalesce(F.when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3)).when(F.size(p) == 2, part(1) * 60 + part(2)), F.lit(0))


def clock(seconds: Column) -> Column:
    """HH:MM:SS, parts floored."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def srt_clock(seconds: Column) -> Column:
    """HH:MM:SS,mmm with milliseconds cut off."""
    return F.concat(clock(seconds), F.format_string(",%03d", F.floor((seconds % 1) * 1000)))


def duration(seconds: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s`` or ``3s``."""
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    said = lambda n, u: F.concat(n.cast("string"), F.lit(u))
    return F.when(h > 0, F.concat_ws(" ", said(h, "h"), said(m, "m"), said(r, "s"))).when(m > 0, F.concat_ws(" ", said(m, "m"), said(r, "s"))).otherwise(said(r, "s"))


def is_initials(c: Column) -> Column:
    """Two or three letters, none of them small."""
    s = strip(c)
    return s.rlike(r"^[\p{Lu}\p{Lo}\p{Lm}]{2,3}$") & s.rlike(r"\p{Lu}")


def is_speaker(c: Column) -> Column:
    """Whether a line looks like a name: short, few words, no time, no sentence end, a capital first or an @."""
    s = strip(c)
    n = word_count(c)
    sentence = s.rlike("[.?!]$") & (n > 1)
    return F.length(s).between(2, 60) & ~s.rlike(TIME) & (n <= 6) & ~sentence & ~is_initials(c) & (s.rlike(r"^\p{Lu}") | s.contains("@"))


def clean_speaker(c: Column) -> Column:
    """A name without punctuation at its ends and without a bracketed mark before it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), "^[.,;:-]+|[.,;:-]+$", ""), f"^\\[.*?\\][{WS}]*", ""))
