"""String functions: each takes a column and gives a column."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from lagscope.session import as_col

# Characters cut off by a Unicode-aware trim.
WHITESPACE = (
    "\t\n\u000b\f\r \u0085             "
    "    　"
)

# Patterns of the load-balancer server list.
SERVER_BLOCK = r"(?is)mysql-ro(.+)MySQLClusterConfigEnd"
SERVER_LINE = r"(?i)^\s*server\s+\S+\s([\w.:]+:\d+)"
SERVER_ADDRESS = r"([\w.:]+:\d+)"

# The two passes that put spaces into a camel-case word.
CAMEL_WORD = r"(.)([A-Z][a-z]+)"
CAMEL_EDGE = r"([a-z0-9])([A-Z])"

# Short escapes inside a quoted string, besides quote, backslash and newline.
QUOTE_ESCAPES = {"\u0007": "\\a", "\b": "\\b", "\f": "\\f", "\r": "\\r", "\t": "\\t", "\u000b": "\\v"}

# Characters that do not print: all of Unicode's "other" and "separator" classes but the space.
_UNPRINTED = r"[\p{C}\p{Z}&&[^ \n]]"

MAX_STRING_BYTES = 64000


def trim_space(c: Column | str) -> Column:
    return F.trim(as_col(c), F.lit(WHITESPACE))


def escape_key(c: Column | str) -> Column:
    """Backslash before comma, equals sign and space; backslash itself is left alone."""
    out = as_col(c)
    for mark in (",", "=", " "):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def quote_text(c: Column | str) -> Column:
    """Double-quoted text with escapes; characters that do not print become code points."""
    col = as_col(c)
    plain = col
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        plain = F.replace(plain, F.lit(raw), F.lit(escaped))
    odd = col.rlike(r"[^ -~\n]") & col.rlike(_UNPRINTED)  # plain ASCII stops at the cheaper test

    def one(ch: Column) -> Column:
        code = F.lower(F.hex(F.ascii(ch)))
        out = F.when(~ch.rlike(_UNPRINTED), ch)
        for raw, escaped in QUOTE_ESCAPES.items():
            out = out.when(ch == raw, F.lit(escaped))
        return (
            out.when(F.ascii(ch) < 0x80, F.concat(F.lit("\\x"), F.lpad(code, 2, "0")))
            .when(F.ascii(ch) < 0x10000, F.concat(F.lit("\\u"), F.lpad(code, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(code, 8, "0")))
        )

    # Only the rare rows that hold such characters are walked character by character.
    walked = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), one), "")
    return F.concat(F.lit('"'), F.when(odd, walked).otherwise(plain), F.lit('"'))


def float_text(c: Column | str) -> Column:
    """Shortest ``%g`` text: plain between 1e-4 and 1e6 (exclusive), else ``d.ddde+XX``."""
    col = as_col(c)
    mag = F.abs(col)
    text = mag.cast("string")  # "123.5", or "1.235E7" outside 1e-3 .. 1e7
    before_e = F.regexp_replace(text, r"E.*$", "")
    digits = F.regexp_replace(F.replace(before_e, F.lit("."), F.lit("")), r"^0+|0+$", "")
    exponent = F.coalesce(
        F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"),
        F.length(F.substring_index(text, ".", 1)) - 1,
    )
    exp_digits = F.abs(exponent).cast("string")
    scientific = F.concat(
        F.substring(digits, 1, 1),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(F.lit("")),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(exp_digits) < 2, F.lit("0")).otherwise(F.lit("")),
        exp_digits,
    )
    body = (
        F.when(mag == 0, F.lit("0"))
        .when((mag >= 1e-3) & (mag < 1e6), F.when(text.endswith(".0"), F.substring_index(text, ".", 1)).otherwise(text))
        .when((mag >= 1e-4) & (mag < 1e-3), F.concat(F.lit("0.000"), digits))
        .otherwise(scientific)
    )
    sign = F.when(col.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(F.isnan(col), F.lit("NaN"))
        .when(mag == float("inf"), F.when(col > 0, F.lit("+Inf")).otherwise(F.lit("-Inf")))
        .otherwise(F.concat(sign, body))
    )


def field_literal(c: Column | str, dtype: T.DataType) -> Column | None:
    """Text of a field value by type; ``None`` where the type has no text form."""
    col = as_col(c)
    if isinstance(dtype, T.StringType):
        return quote_text(col)
    if isinstance(dtype, T.BinaryType):
        return quote_text(F.make_valid_utf8(col.cast("string")))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("string")
    if isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        return col.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float_text(col)
    if isinstance(dtype, T.BooleanType):
        return col.cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return (F.unix_micros(col.cast("timestamp")) * F.lit(1000)).cast("string")
    if isinstance(dtype, T.DayTimeIntervalType):
        seconds = col.cast(T.DayTimeIntervalType(3, 3)).cast("decimal(18,6)")
        return (seconds * F.lit(1000000000)).cast("decimal(38,0)").cast("string")
    return None


def snake(name: str) -> str:
    """``IncrID`` -> ``incr_id``, ``MyNote`` -> ``my_note``."""
    parts = re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z0-9]+", name)
    return "_".join(part.lower() for part in parts)


def capture_groups(pattern: str) -> int:
    """Number of capturing groups in a pattern, counted on the driver."""
    bare = re.sub(r"\\.", "", pattern, flags=re.S)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", bare)
    return len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", bare))


def _require_group(pattern: str) -> None:
    if capture_groups(pattern) < 1:
        raise ValueError(f"pattern {pattern!r} needs at least one capturing group")


def group1_all(c: Column | str, pattern: str) -> Column:
    """Group 1 of every match, in order."""
    _require_group(pattern)
    return F.regexp_extract_all(as_col(c), F.lit(pattern), F.lit(1))


def _around_group1(pattern: str) -> tuple[str, int, int, list[int]] | None:
    """The pattern with the texts before, in and after group 1 captured at every level around it.

    Also the number of levels, of groups in group 1 (itself included), and of groups in what follows on each level (likewise).

    None where that cannot be said: group 1 or a group around it is repeated, optional, one of several alternatives or part of
    a look-around, or the pattern refers back to groups or sets flags half-way.
    """
    flags = re.match(r"(\(\?[a-zA-Z]+\))*", pattern).group(0)
    rest = pattern[len(flags):]
    if re.search(r"\(\?[a-zA-Z]*-?[a-zA-Z]+\)", rest):
        return None  # a flag set half-way would end with the group around it
    openings: list[tuple[int, str]] = []  # groups open at this place: where, and the text that opens them
    around, start, end, in_class, i = None, -1, -1, False, 0
    ends: list[int] = []  # where the groups around group 1 close, inner ones first
    bars: list[int] = []  # levels still open that have had alternatives before group 1
    while i < len(rest):
        ch = rest[i]
        if ch == "\\":
            if i + 1 < len(rest) and (rest[i + 1].isdigit() or rest[i + 1] in "kQ"):
                return None
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            opening = re.match(r"\((\?(?:P?<(?![=!])[^>]*>|[a-zA-Z-]*:|[=!>]|<[=!]))?", rest[i:]).group(0)
            captures = opening == "(" or re.match(r"\(\?P?<(?![=!])", opening)
            if captures and start < 0:
                if opening != "(" or any(not o.endswith(":") for _, o in openings) or bars:
                    return None
                start, around = i, list(openings)
            openings.append((i, opening))
            i += len(opening)
            continue
        elif ch == ")":
            if not openings:
                return None
            at, _ = openings.pop()
            if at == start:
                end = i
            if start >= 0 and (at == start or any(at == o for o, _ in around)):
                if rest[i + 1 : i + 2] in ("*", "+", "?", "{"):
                    return None
                if at != start:
                    ends.append(i)
            bars = [level for level in bars if level <= len(openings)]
        elif ch == "|":
            if start < 0:
                bars.append(len(openings))
            elif end < 0 and len(openings) > len(around) or end >= 0 and len(openings) > len(around) - len(ends):
                pass  # inside group 1, or in a group beside it
            else:
                return None
        i += 1
    if end < 0:
        return None
    out, at = flags, 0
    for where, opening in around:
        out += f"({rest[at:where]}){opening}"
        at = where + len(opening)
    out += f"({rest[at:start]})({rest[start + 1 : end]})"
    at = end + 1
    for where in ends:
        out += f"({rest[at:where]}))"
        at = where + 1
    return out + f"({rest[at:]})", len(around) + 1, capture_groups(f"({rest[start + 1 : end]})"), [capture_groups(f"({p})") for p in _tails(rest, end, ends)]


def _tails(rest: str, end: int, ends: list[int]) -> list[str]:
    """The texts that follow group 1, one per level."""
    cuts = [end, *ends, len(rest)]
    return [rest[a + 1 : b] for a, b in zip(cuts, cuts[1:])]


def replace_group1(c: Column | str, pattern: str, repl: str) -> Column:
    """Put ``repl`` in place of group 1 of every match; NULL where nothing matches, or where a match has no group 1.

    A pattern in which every match has its group 1 is rewritten to capture what stands around it and stays in
    the JVM. Others, where group 1 is optional or one of several alternatives, go through an Arrow-batched helper that cuts at match
    spans; their syntax must be valid in both dialects, which is checked here.
    """
    _require_group(pattern)
    col = as_col(c)
    parts = _around_group1(pattern)
    if parts is None:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"pattern {pattern!r} has an optional or alternative group 1 and cannot be cut outside the JVM: {e}") from e
        return _replace_spans(pattern, repl)(col)
    wide, levels, inside, after = parts
    numbers, at = [], levels + inside + 1
    for groups in after:
        numbers.append(at)
        at += groups
    literal = repl.replace("\\", "\\\\").replace("$", "\\$")
    if literal[:1].isdigit():
        literal = "\\" + literal  # else it could be read as part of the number before it
    text = "".join(f"${n}" for n in range(1, levels + 1)) + literal + "".join(f"${n}" for n in numbers)
    return F.when(col.rlike(pattern), F.regexp_replace(col, F.lit(wide), F.lit(text)))


def _replace_spans(pattern: str, repl: str):
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        import re as regex

        compiled = regex.compile(pattern)

        def one(text):
            if text is None:
                return None
            out, at, matched = [], 0, False
            for match in compiled.finditer(text):
                if match.start(1) < 0:
                    return None
                out += [text[at : match.start(1)], repl]
                at, matched = match.end(1), True
            return "".join(out) + text[at:] if matched else None

        return values.map(one)

    return run


def search_blocks(c: Column | str, outer: str, inner: str) -> Column:
    """Group 1 of ``inner`` inside every group-1 block of ``outer``."""
    _require_group(inner)
    return F.flatten(F.transform(group1_all(c, outer), lambda block: F.regexp_extract_all(block, F.lit(inner), F.lit(1))))


def split_trim(c: Column | str, sep: str) -> Column:
    """Split at a literal separator, trim each part, drop empty ones."""
    parts = F.split(as_col(c), "\\Q" + sep + "\\E")
    return F.filter(F.transform(parts, trim_space), lambda x: x != "")


def server_list(c: Column | str, block: str = SERVER_BLOCK) -> Column:
    """Addresses of the server lines of the first block, in order.

    A trailing comment holding an address overrides the line's own; a trailing comment
    without one drops the line; a line that starts with ``#`` is a comment.
    """
    first = F.get(group1_all(c, block), F.lit(0))

    def address(line: Column) -> Column:
        own = F.regexp_extract(line, SERVER_LINE, 1)
        noted = F.regexp_extract(F.regexp_extract(line, r"(?s)#(.*)$", 1), SERVER_ADDRESS, 1)
        found = F.when(line.contains("#"), noted).otherwise(own)
        return F.when(drop_comments(line) & (own != "") & (found != ""), found)

    return F.array_compact(F.transform(split_trim(first, "\n"), address))


def split_address(c: Column | str) -> Column:
    """``host`` and ``port`` around the last colon; NULLs where there is none."""
    col = as_col(c)
    at = r"(?s)^(.*):([^:]*)$"
    whole = col.rlike(at)
    return F.struct(
        F.when(whole, F.regexp_extract(col, at, 1)).alias("host"),
        F.when(whole, F.regexp_extract(col, at, 2)).try_cast("int").alias("port"),
    )


def camel_to_words(c: Column | str) -> Column:
    spaced = F.regexp_replace(as_col(c), CAMEL_WORD, "$1 $2")
    return F.regexp_replace(spaced, CAMEL_EDGE, "$1 $2")


def camel_name_to_words(name: str) -> str:
    """The same two passes for a column name on the driver."""
    return re.sub(CAMEL_EDGE, r"\1 \2", re.sub(CAMEL_WORD, r"\1 \2", name))


def letters_digits(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"[^\p{L}\p{Nd}]", "")


def left_bytes(c: Column | str, n: int) -> Column:
    """The first ``n`` bytes; a character cut in two becomes the replacement character."""
    cut = F.substring(F.encode(as_col(c), "UTF-8"), 1, n)
    return F.make_valid_utf8(cut.cast("string"))


def equals_any_ci(c: Column | str, values) -> Column:
    return F.lower(as_col(c)).isin([v.lower() for v in values])


def contains_any(c: Column | str, subs) -> Column:
    out = F.lit(False)
    for sub in subs:
        out = out | as_col(c).contains(sub)
    return out


def drop_comments(c: Column | str, mark: str = "#") -> Column:
    """True for lines that are not comments."""
    return ~trim_space(c).startswith(mark)


def is_backup_name(c: Column | str, stem: str = "_bak") -> Column:
    """True for names holding the backup stem after at least one character."""
    return as_col(c).rlike(".+" + re.escape(stem) + r"\d*")
