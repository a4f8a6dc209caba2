"""One reading of a pattern on every engine: ASCII words and the white space that text is cleaned of."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# the JVM's \w and \d are ASCII, and one comparison each; a class spelt out is four, at each character of a text
_EDGE = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"
_S = r"\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}"


def java(pattern: str, ignore_case: bool = True) -> str:
    r"""\b, \w, \d count ASCII only and \s counts every Unicode space; $ is the very end."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\" and len(two) == 2:
            out.append({r"\b": two if inside else _EDGE, r"\s": _S if inside else f"[{_S}]"}.get(two, two))
            i += 2
            continue
        c = two[0]
        inside = (inside or c == "[") and c != "]"
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(text, F.lit("")).rlike(java(pattern, ignore_case))


def swap(text: Column, pattern: str, by: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(text, java(pattern, ignore_case), by)


def part(text: Column, pattern: str, group: int, ignore_case: bool = True) -> Column:
    """A group of the first match; empty if there is none."""
    return F.regexp_extract(text, java(pattern, ignore_case), group)
