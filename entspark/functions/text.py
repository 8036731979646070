"""Text functions as column expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import COMMON_NAMES, KEYWORDS

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_eol(text: ColumnOrName) -> Column:
    """CR LF and lone CR become LF."""
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def lines_of(text: ColumnOrName) -> Column:
    """The lines without their ends; a final empty line isn't one, a trailing CR is dropped."""
    parts = F.split(_c(text), "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda s: F.regexp_replace(s, "\r$", ""))


def first_line(text: ColumnOrName) -> Column:
    return F.regexp_replace(F.substring_index(_c(text), "\n", 1), "\r$", "")


def tokens(text: ColumnOrName) -> Column:
    """White-space tokens, Unicode blanks included."""
    return F.filter(F.split(_c(text), r"(?U)\s+"), lambda s: s != "")


def token_set(text: ColumnOrName) -> Column:
    return F.array_distinct(tokens(text))


def estimate_tokens(text: ColumnOrName) -> Column:
    """Thirteen tenths of the words, rounded down."""
    return F.floor(F.size(tokens(text)) * 13 / 10).cast("int")


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Of two token sets; two empty ones have 0."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def size_ratio_at_least(a: ColumnOrName, b: ColumnOrName, ratio: float) -> Column:
    """Smaller over larger count; true where both are zero."""
    a, b = _c(a), _c(b)
    return F.least(a, b) >= F.lit(ratio) * F.greatest(a, b)


def default_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Jaccard of the token sets, 0 where the token counts (with repeats) differ by more than 0.6."""
    ta, tb = tokens(a), tokens(b)
    return F.when(size_ratio_at_least(F.size(ta), F.size(tb), 0.6), jaccard(F.array_distinct(ta), F.array_distinct(tb))).otherwise(F.lit(0.0))


def entity_id(file_path: ColumnOrName, entity_type: ColumnOrName, name: ColumnOrName, parent_id: ColumnOrName | None = None) -> Column:
    middle = _c(entity_type) if parent_id is None else F.coalesce(_c(parent_id), _c(entity_type))
    return F.concat_ws("::", _c(file_path), middle, _c(name))


def truncated(text: ColumnOrName, most: int) -> Column:
    """At most so many code points, the last three of a cut text being dots."""
    text = _c(text)
    short = F.substring(text, 1, most) if most <= 3 else F.concat(F.substring(text, 1, most - 3), F.lit("..."))
    return F.when(F.length(text) <= most, text).otherwise(short)


def short_hash(digest: ColumnOrName, n: int) -> Column:
    return F.substring(_c(digest), 1, n)


def utc_date(seconds: ColumnOrName) -> Column:
    return F.date_format(F.timestamp_seconds(_c(seconds).cast("long")), "yyyy-MM-dd")


def strip_comments_and_strings(text: ColumnOrName) -> Column:
    """String literals and comments, of the families that share quotes, ``#``, ``//`` and ``/* */``, become a blank."""
    pattern = r'"""[\s\S]*?(?:"""|$)|' + r"'''[\s\S]*?(?:'''|$)|" + r'"(?:\\[\s\S]|[^"\\])*(?:"|$)|' + r"'(?:\\[\s\S]|[^'\\])*(?:'|$)|#[^\n]*|//[^\n]*|/\*[\s\S]*?(?:\*/|$)"
    return F.regexp_replace(_c(text), f"(?>{pattern})", " ")


def dot_chains(text: ColumnOrName) -> Column:
    """Distinct ``receiver.member`` texts in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\b(?!\d)\w+\.(?!\d)\w+"), F.lit(0)))


def identifier_words(text: ColumnOrName) -> Column:
    return F.filter(F.split(_c(text), r"[^\p{L}\p{N}_]+"), lambda s: s != "")


def references(text: ColumnOrName, own_name: ColumnOrName) -> Column:
    """Distinct names in a code text that may refer to other entities, in order of first sight."""
    own = _c(own_name)
    code = identifier_words(strip_comments_and_strings(text))
    stop = F.array(*(F.lit(w) for w in sorted(KEYWORDS | COMMON_NAMES)))

    def counts(w: Column) -> Column:
        low = F.rlike(w, F.lit(r"^\p{Ll}"))
        return (w != F.coalesce(own, F.lit(""))) & (F.length(w) >= F.when(low, 3).otherwise(2)) & F.rlike(w, F.lit(r"^[\p{L}_]"))

    return F.array_except(F.array_distinct(F.filter(code, counts)), stop)


def ref_type(text: ColumnOrName, name: ColumnOrName) -> Column:
    """``calls`` if the name stands before a parenthesis, ``imports`` if a line of an import has it, else ``typeref``."""
    text, name = _c(text), _c(name)
    called = F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E\(")))
    imported = F.exists(F.split(text, "\n"), lambda s: F.rlike(F.trim(s), F.lit(r"^(import |use |from |require\()")) & F.contains(s, name))
    return F.when(called, "calls").when(imported, "imports").otherwise("typeref")


def file_stem(path: ColumnOrName) -> Column:
    """The file's name up to its extension, for matching imports."""
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"\.(py|ts|tsx|js|jsx|rs|go|java|rb|cs|cpp|c|h)$", "")


def extensions(path: ColumnOrName) -> Column:
    """All suffixes of the file's name that begin with a dot, the longest first."""
    parts = F.split(F.lower(F.regexp_extract(_c(path), r"([^/]*)$", 1)), r"\.")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.concat(F.lit("."), F.array_join(F.slice(parts, k, F.size(parts)), "."))))


def base_type(text: ColumnOrName) -> Column:
    """A type's name without references, pointers, mutability, generics or a leading colon."""
    bare = F.regexp_replace(F.trim(_c(text)), r"^[:&*\s]+(mut\s+)?", "")
    return F.trim(F.regexp_replace(bare, r"[<\[(].*$", ""))


def is_test_entity(name: ColumnOrName, path: ColumnOrName, content: ColumnOrName) -> Column:
    """By the name, or by a marker in a file that is at a test's place."""
    name, path, content = _c(name), F.lower(_c(path)), _c(content)
    by_name = F.rlike(name, F.lit(r"^(test_|Test|it_|describe_|spec_)|(_test|Test)$"))
    place = F.rlike(path, F.lit(r"/tests?/|/spec/|[_.](test|spec)\."))
    marker = F.rlike(content, F.lit(r"#\[(test|cfg\(test\))\]|@Test|@pytest|@test|(describe|it|test)\("))
    return by_name | (place & marker)


def has_extension(path: ColumnOrName, wanted: list[str]) -> Column:
    """Whether the path ends in one of the extensions, written with or without their dot; none wanted are all."""
    out = F.lit(not wanted)
    for e in wanted:
        out = out | F.endswith(_c(path), F.lit(e if e.startswith(".") else "." + e))
    return out


def param_count(signature: ColumnOrName) -> Column:
    """Parameters of a signature's first parenthesis: commas outside any inner bracket, plus one; 0 if blank."""
    inner = F.regexp_extract(first_line(signature), r"\(((?:[^()]|\([^()]*\))*)\)", 1)
    flat = F.regexp_replace(F.regexp_replace(inner, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>", ""), "[^,]", "")
    return F.when(F.trim(inner) == "", 0).otherwise(F.length(flat) + 1).cast("int")
