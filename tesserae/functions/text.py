"""Column functions on text: normal forms, spans, keys and rendered lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's `\s` has it on str: Unicode white space and U+001C to U+001F.
SPACE_CLASS = r"[\t\n\x0B\f\r \x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

#: Its members but the plain space.
ODD_SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Curly quotes and their plain forms; characters without width, which go.
CURLY, PLAIN = "\u2018\u2019\u201c\u201d", "''\"\""
NO_WIDTH = "\u200b\u200c\u200d\ufeff"

# The words that count as a specific number in a summary.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
    "seventy", "eighty", "ninety", "hundred", "hundreds", "thousand", "thousands", "million", "millions", "billion",
    "billions", "dozen", "dozens", "couple", "pair", "brace", "trio", "quartet", "score",
)


def collapse(s: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return _single(F.translate(s, ODD_SPACE, " " * len(ODD_SPACE)))


def _single(s: Column) -> Column:
    """The same where all white space is plain spaces: the search for runs of these costs a fraction of one for the class."""
    return F.trim(F.regexp_replace(s, "  +", " "))


def normalize(s: Column) -> Column:
    """Straight quotes, no characters without width, collapsed white space; case stays. Null becomes ''."""
    plain = F.translate(s, CURLY + ODD_SPACE + NO_WIDTH, PLAIN + " " * len(ODD_SPACE))
    return F.coalesce(_single(plain), F.lit(""))


def alnum_key(s: Column) -> Column:
    """Lower-case letters a-z and digits only."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def slug(s: Column) -> Column:
    """Lower case, white space runs as hyphens."""
    return F.regexp_replace(F.lower(collapse(s)), " ", "-")


def span(text: Column, part: Column) -> Column:
    """struct<start, end>, from 0, half-open, in code points; null where the part does not occur."""
    at = F.instr(text, part)
    return F.when((at > 0) & (part != ""), F.struct((at - 1).cast("long").alias("start"), (at - 1 + F.length(part)).cast("long").alias("end")))


def is_verbatim(text: Column, part: Column) -> Column:
    """Whether the normalised part is not empty and occurs in the normalised text."""
    return occurs(normalize(text), part)


def occurs(normal: Column, part: Column) -> Column:
    """The same for a text that is normal already."""
    p = normalize(part)
    return (p != "") & F.contains(normal, p)


def clipped(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def job_key(*parts: Column | str) -> Column:
    """Parts joined by colons; a null part leaves its place empty."""
    return F.array_join(F.array(*[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts]), ":")


def attempt_key(key: Column, attempt: Column) -> Column:
    """The key itself for the first attempt, with `:a<n>` for later ones."""
    return F.when(attempt > 1, F.concat(key, F.lit(":a"), attempt.cast("string"))).otherwise(key)


def marked_segments(text: Column, n: int, marker: str = "VIDEO {}:", missing: str = "Analysis not found in batch response for video {}") -> Column:
    """The text after each of n numbered markers up to the next one; a fixed sentence where a marker is missing."""
    out = []
    for i in range(1, n + 1):
        at = F.instr(text, marker.format(i))
        rest = F.substring(text, at + len(marker.format(i)), F.length(text))
        following = F.instr(text, marker.format(i + 1)) if i < n else F.lit(0)
        size = following - at - len(marker.format(i))
        body = F.when(following > 0, F.when(size > 0, F.substring(rest, F.lit(1), size)).otherwise("")).otherwise(rest)
        out.append(F.when(at > 0, collapse_ends(body)).otherwise(missing.format(i)))
    return F.array(*out)


def collapse_ends(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def rendered(order: Column, line: Column, most: int | None = None, separator: str = "\n") -> Column:
    """Aggregate: the lines of a group in order, at most `most` of them, as one text."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    rows = F.slice(rows, 1, most) if most else rows
    return F.array_join(F.transform(rows, lambda r: r["l"]), separator)


def has_number(summary: Column) -> Column:
    """Whether a digit or a word for a specific number occurs."""
    words = F.split(F.regexp_replace(F.lower(summary), r"[^\p{L}]+", " "), " ")
    return F.coalesce(F.rlike(summary, F.lit(r"[\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089]")) | F.arrays_overlap(words, F.array(*map(F.lit, NUMBER_WORDS))), F.lit(False))


def joined_colours(colours: Column) -> Column:
    """Comma-joined, null where there are none."""
    return F.when(F.size(colours) > 0, F.array_join(colours, ","))


def joined_elements(elements: Column) -> Column:
    """All texts of a map of lists, in the order of its keys, joined by ` | `; null where there are none."""
    texts = F.flatten(F.map_values(elements))
    return F.when(F.size(texts) > 0, F.array_join(texts, " | "))
