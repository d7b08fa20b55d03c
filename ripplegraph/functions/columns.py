"""Column expressions used throughout: ids, slugs, sorted sets, folds, lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as Python's str.isspace() has it, for use in a character class; Java's \\s is ASCII only.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, digits and underscore as Python's \\w has them, and the edge between these and others.
WORD = r"\p{L}\p{N}_"
#: The edges before and after a character that is one of these itself: one look is enough.
START, END = rf"(?<![{WORD}])", rf"(?![{WORD}])"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def strip(value: Column) -> Column:
    """A text without white space at its ends, Unicode white space included."""
    return F.regexp_replace(value, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def short_hash(value: Column, length: int = 10) -> Column:
    """First hex digits of the sha1 of a text."""
    return F.substring(F.sha1(value.cast("binary")), 1, length)


def slug(value: Column) -> Column:
    """Lower-case ASCII words joined by underscores; texts without any are named by their hash."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", F.concat(F.lit("item_"), short_hash(value))).otherwise(plain)


def sorted_union(column: Column) -> Column:
    """Aggregate: the sorted set of all elements of an array column."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def set_of(*columns: Column) -> Column:
    """Sorted array of the distinct non-null, non-empty values."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != ""))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds_any(text: Column, tokens: tuple[str, ...] | list[str]) -> Column:
    return any_of([text.contains(t) for t in tokens])


def rank_in(value: Column, order: tuple[str, ...] | list[str], other: int | None = None) -> Column:
    """Place of a value in a list."""
    out = F.lit(len(order) if other is None else other)
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, i).otherwise(out)
    return out


def path_parts(path: Column) -> Column:
    """Named parts of a path: empty ones and single dots do not count."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def normal_path(path: Column) -> Column:
    """A path as posixpath.normpath gives it: no empty parts, no single dots, `x/..` taken out."""
    root = F.when(path.rlike("^//(?!/)"), "//").when(path.startswith("/"), "/").otherwise("")
    up = lambda acc, p: (p == "..") & F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1)) != "..").otherwise(path.startswith("/"))
    step = lambda acc, p: F.when(up(acc, p), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    full = F.concat(root, F.array_join(F.aggregate(path_parts(path), F.array().cast("array<string>"), step), "/"))
    return F.when(path.isNotNull(), F.when(full == "", ".").otherwise(full))


def lines_of(text: Column) -> Column:
    """Lines as str.splitlines() gives them: all line ends count, a last one opens no line."""
    ends = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, f"(?:{ends})\\z", ""), ends, -1))


def column_letter(number: Column) -> Column:
    """Spreadsheet name of a column number up to 18278 (ZZZ)."""
    n = number.cast("int")
    letter = lambda k: F.char(F.lit(65) + k)
    one = letter((n - 1) % 26)
    second = F.floor((n - 1) / 26)
    two = letter((second - 1) % 26)
    third = F.floor((second - 1) / 26)
    return F.when(n <= 26, one).when(n <= 702, F.concat(two, one)).otherwise(F.concat(letter((third - 1) % 26), two, one))
