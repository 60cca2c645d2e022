"""Text functions; positions are 1-based unless the name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column, null_as: str | None = None) -> Column:
    """Concatenation; NULL makes the result NULL unless ``null_as`` replaces it."""
    texts = [p.cast("string") for p in parts]
    if null_as is not None:
        texts = [F.coalesce(t, F.lit(null_as)) for t in texts]
    return F.concat(*texts)


def substr(c: Column, start: int, length: int | None = None) -> Column:
    """SUBSTR / Mid."""
    return F.substring(c, start, length if length is not None else 2_147_483_647)


def java_substring(c: Column, begin: int, end: int | None = None) -> Column:
    """``s.substring(begin, end)``: 0-based, end exclusive."""
    return substr(c, begin + 1, None if end is None else end - begin)


def instr(c: Column, part: str) -> Column:
    """Position of ``part``, 0 when absent."""
    return F.instr(c, part)


def length(c: Column) -> Column:
    return F.length(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def proper_case(c: Column) -> Column:
    return F.initcap(c)


def ltrim(c: Column) -> Column:
    return F.ltrim(c)


def rtrim(c: Column) -> Column:
    return F.rtrim(c)


def trim(c: Column) -> Column:
    return F.trim(c)


def left(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def right(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def change(c: Column, search: str, replacement: str) -> Column:
    """Literal replacement."""
    return F.replace(c, F.lit(search), F.lit(replacement))


def ereplace(c: Column, pattern: str, replacement: str) -> Column:
    """Regular-expression replacement."""
    return F.regexp_replace(c, pattern, replacement)


def equals(a: Column, b, ignore_case: bool = False) -> Column:
    """``a.equals(b)``: NULL equals nothing, so the answer is never NULL."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.coalesce(F.lower(a) == F.lower(b) if ignore_case else a == b, F.lit(False))


def contains(c: Column, part: str) -> Column:
    return F.coalesce(c.contains(part), F.lit(False))


def starts_with(c: Column, part: str) -> Column:
    return F.coalesce(c.startswith(part), F.lit(False))


def chr_(n: Column) -> Column:
    """Character of a code, beyond Latin-1 as well: the code as a big-endian 32-bit unit."""
    code = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.decode(F.unhex(code), "UTF-32")


def asc(c: Column) -> Column:
    return F.ascii(c)


def to_text(c: Column, decimals: int | None = None) -> Column:
    """ToText / TO_CHAR(n) / String.valueOf; ``decimals`` groups thousands as the report dialect does."""
    return c.cast("string") if decimals is None else F.format_number(c, decimals)


def message(template: str, *args: Column) -> Column:
    """``{0}``-style message text."""
    out, rest = [], template
    for i, a in enumerate(args):
        head, _, rest = rest.partition("{" + str(i) + "}")
        out += [F.lit(head), F.coalesce(a.cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


# fixed value: share of characters that must look byte-swapped before, and ordinary after, a repair
SWAP_SHARE = 0.6


def repair_byteswapped(c: Column) -> Column:
    """UTF-16 text that was read with the wrong byte order, put right.

    A swapped Latin letter has a zero low byte (U+4D00 for "M"). The repair runs only on a majority of such
    characters and is kept only if it yields a majority of ordinary characters.
    """
    units = F.length(c)
    suspects = F.length(F.regexp_replace(c, r"[^\x{0100}\x{0200}\x{0300}" + "".join(
        rf"\x{{{h:02X}00}}" for h in range(0x04, 0xD8)
    ) + r"]", ""))
    fixed = F.decode(F.encode(c, "UTF-16BE"), "UTF-16LE")
    ordinary = F.length(F.regexp_replace(fixed, r"[^\x{0000}-\x{04FF}]", ""))
    swapped = (units > 0) & (suspects >= units * F.lit(SWAP_SHARE)) & c.rlike(r"[\x{0100}-\x{FFFF}]")
    return F.when(swapped & (ordinary >= F.length(fixed) * F.lit(SWAP_SHARE)), fixed).otherwise(c)


# fixed value: whole month names and their usual abbreviations, shortened to three letters
MONTHS = (
    r"(?=[JFMASOND])\b(?:(Jan)(?:uary)?|(Feb)(?:ruary)?|(Mar)(?:ch)?|(Apr)(?:il)?|(May)|(Jun)e?|(Jul)y?|(Aug)(?:ust)?"
    r"|(Sep)(?:t|tember)?|(Oct)(?:ober)?|(Nov)(?:ember)?|(Dec)(?:ember)?)\b"
)
MIN_LINE = 6


def normal_line(c: Column) -> Column:
    """A line as it is compared: single blanks, three-letter months, ``#`` for numbers; '' below MIN_LINE characters."""
    line = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    line = F.regexp_replace(line, MONTHS, "$1$2$3$4$5$6$7$8$9$10$11$12")
    line = F.regexp_replace(line, r"[\d,.]+", "#")
    line = F.replace(line, F.lit("$ #"), F.lit("$#"))
    # one expression without a second mention of the line: a CASE would run all of the above twice
    return F.coalesce(F.regexp_replace(line, rf"(?s)\A.{{1,{MIN_LINE - 1}}}\z", ""), F.lit(""))
