"""Text functions with Python's notion of white space and line ends, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode-aware stripping removes.
WHITESPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"

SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{WHITESPACE}]", c))

#: Openings and closings that a model adds around a transcript, and the fences it wraps it in.
FENCE_OPEN = "^```markdown\\s*"
FENCE_LINE = "^```\\s*$"
LEAD_IN = "^(I'm unable to|However, I can|Please adjust|Here's a|Here is|這是一份).*?\\n+"
CLOSING = "\\n+(Please adjust|Hope this helps|如需修改|希望這對您有幫助).*?$"

#: What file names cannot have.
ILLEGAL_IN_NAMES = '[\\\\/*?:"<>|\\n\\r\\t]'


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """x without white space, of any script, at both ends. Reads the ends only."""
    return F.btrim(col(x), F.lit(SPACES))


def blank(x: Column | str) -> Column:
    """Whether x is null or holds white space only."""
    return F.coalesce(strip(x), F.lit("")) == ""


def clean_transcript(x: Column | str) -> Column:
    """Model output without fences, lead-in line and closing remark; null becomes ''."""
    out = F.coalesce(col(x), F.lit(""))
    for flags, pattern in (("(?dU)(?m)", FENCE_OPEN), ("(?dU)(?m)", FENCE_LINE), ("(?dU)(?im)", LEAD_IN), ("(?dU)(?im)", CLOSING)):
        out = F.regexp_replace(out, flags + pattern, "")
    return strip(out)


def safe_name(x: Column | str) -> Column:
    """x without the characters that file names cannot have."""
    return F.regexp_replace(col(x), ILLEGAL_IN_NAMES, "")


def without_number(x: Column | str) -> Column:
    """x without a leading enumerator such as '3.' or '１、'."""
    return F.regexp_replace(col(x), "(?U)^\\d+[\\.、\\s]*", "")


def without_extension(x: Column | str) -> Column:
    """x without one document suffix, in any case."""
    return F.regexp_replace(col(x), "(?dUi)\\.pdf$|\\.docx?$", "")


def lines(x: Column | str) -> Column:
    """The stripped, non-blank lines of x; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "\n"), strip), lambda s: s != "")


def first_line(x: Column | str) -> Column:
    """The first line of stripped x, stripped."""
    return strip(F.substring_index(strip(x), "\n", 1))


def quote_path(x: Column | str) -> Column:
    """x percent-encoded for the path of a url; '/' stays."""
    out = F.url_encode(col(x))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_html(x: Column | str) -> Column:
    out = F.coalesce(col(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def last_of(a: Column, n: int) -> Column:
    """The last n elements of an array; all of a shorter one."""
    return F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), n)


def chunks(a: Column, n: int) -> Column:
    """An array in runs of n elements; an empty one has no runs."""
    empty = F.array().cast("array<array<string>>")
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(n)), lambda i: F.slice(a, i + 1, n))).otherwise(empty)


def source_label(metadata: Column) -> Column:
    """'name' or 'name (第 n 頁)' from a metadata map."""
    name = F.coalesce(F.try_element_at(metadata, F.lit("file_name")), F.lit("未知文件"))
    page = F.coalesce(F.try_element_at(metadata, F.lit("page_label")), F.lit(""))
    return F.when(page != "", F.concat(name, F.lit(" (第 "), page, F.lit(" 頁)"))).otherwise(name)


def label_file(label: Column | str) -> Column:
    """The file name in a source label: what stands before the first ' ('."""
    return F.substring_index(col(label), " (", 1)


def data_url(image: Column, kind: str = "image/png") -> Column:
    """Bytes as a data url in base64."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(image), "\\s", ""))


def fill(template: str, **values: Column) -> Column:
    """A template with {name} places filled from columns; text inside a value is never taken for a place."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        parts.append(F.coalesce(values[piece], F.lit("")) if i % 2 else F.lit(piece))
    return F.concat(*parts)
