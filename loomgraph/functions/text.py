"""Column expressions over strings and arrays; all are built in and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relation names that mean the same.
SAME_RELATION = {"王后": "配偶", "丈夫": "配偶", "继承者": "继承人"}


def strip_entity(c: Column) -> Column:
    """Without the ``e:`` prefix, quotation marks and the statement's closing dot."""
    return F.regexp_replace(F.replace(F.regexp_replace(c, "^e:", ""), F.lit('"'), F.lit("")), r"\s*\.$", "")


def strip_relation(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "^r:", ""))


def without_spaces(c: Column) -> Column:
    return F.rtrim(F.translate(c, "　  ", ""))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<(.*?)>", "")


def without_controls(c: Column) -> Column:
    return F.translate(c, "\r\n\t ", "")


def segments(c: Column, least: int = 5) -> Column:
    """Trimmed parts between line breaks and full-width semicolons, of ``least`` characters or more, each once."""
    parts = F.transform(F.split(c, "[\n；]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= least))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"[\s.,]+"), lambda x: x != "")


def char_offset(text: Column, part: Column) -> Column:
    """Zero-based, -1 where it isn't found."""
    return (F.instr(text, part) - 1).cast("bigint")


def item_offset(items: Column, item: Column) -> Column:
    return (F.array_position(items, item) - 1).cast("bigint")


def directed(r: Column, forward: bool) -> Column:
    return F.concat(r, F.lit("(e1,e2)" if forward else "(e2,e1)"))


def canonical_relation(c: Column, same: dict[str, str] = SAME_RELATION) -> Column:
    known = F.create_map(*(F.lit(x) for pair in same.items() for x in pair))
    return F.coalesce(known[c], c)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def common_substring_length(a: Column, b: Column) -> Column:
    """Of the longest one: every substring of ``a`` that ``b`` contains."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    lengths = F.flatten(F.transform(starts, lambda i: F.transform(starts, lambda n: F.when((n <= F.length(a) - i + 1) & F.contains(b, F.substring(a, i, n)), n).otherwise(F.lit(0)))))
    return F.coalesce(F.array_max(lengths), F.lit(0)).cast("bigint")


def similarity(a: Column, b: Column) -> Column:
    """Levenshtein ratio + longest common substring / (length + length), as one quotient of whole numbers."""
    longest, both = F.greatest(F.length(a), F.length(b), F.lit(1)), F.greatest(F.length(a) + F.length(b), F.lit(1))
    return ((longest - F.levenshtein(a, b)) * both + common_substring_length(a, b) * longest) / (longest * both)


def padded_ids(ids: Column, size: int = 90) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), size)), 1, size)


def fixed(x: Column, places: int = 6) -> Column:
    """Rounded the way that every SQL engine repeats."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def unit_span(at: Column) -> Column:
    """The half-open span of one item."""
    return F.array(at, at + 1)


def none_for_nan(line: Column) -> Column:
    """A JSON line whose bare NaN is the string none."""
    return F.regexp_replace(line, r"\bNaN\b", '"none"')


def path_leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_prefixes(path: Column) -> Column:
    """All prefixes of a hierarchical relation, itself included: to roll counts up."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def is_family(c: Column, suffix: str = "家族") -> Column:
    return F.endswith(c, F.lit(suffix))


def is_speech(c: Column, mark: str = "——", longer_than: int = 3) -> Column:
    return F.startswith(c, F.lit(mark)) & (F.length(c) > longer_than)


def learning_rate(start: Column, epoch: Column) -> Column:
    """Halved every second epoch."""
    return start * F.pow(F.lit(0.5), F.floor(epoch / 2))


def last_after(c: Column, mark: str = ">>") -> Column:
    return F.trim(F.element_at(F.split(c, mark), -1))
