"""Column functions for exact text semantics: code points, Unicode white space, newline translation, content hashes.

Null input gives null throughout, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points that count as white space when stripping, as a regex class body.
WHITE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE_CHARS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` alone only removes U+0020); looks at the ends only."""
    return F.trim(c, F.lit(WHITE_CHARS))


def normalise_newlines(c: Column) -> Column:
    r"""``\r\n`` and lone ``\r`` as ``\n``, as a file opened in text mode gives them; a byte order mark stays."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def document_id(text: Column) -> Column:
    """Lower-case hex SHA-256 of the newline-normalised content in UTF-8."""
    return F.sha2(normalise_newlines(text), 256)


def chunk_key(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit("-"), index.cast("string"))


def preview(c: Column, n: int) -> Column:
    """The first n code points, always followed by three dots."""
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension; a name that only starts with dots has none."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def swap_extension(path: Column, old: str, new: str) -> Column:
    """``old`` at the end, in any case, replaced by ``new``."""
    return F.regexp_replace(path, rf"(?i)\.{old}$", f".{new}")


def has_extension(path: Column, extension: str, any_case: bool = False) -> Column:
    return (F.lower(path) if any_case else path).endswith(f".{extension}")


def json_string(c: Column) -> Column:
    """JSON string literal with non-ASCII characters as they are; null gives ``null``."""
    escaped = F.regexp_replace(c, r'(["\\])', r"\\$1")
    for raw, short in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        escaped = F.replace(escaped, F.lit(raw), F.lit("\\" + short))
    for code in [*range(8), 11, *range(14, 32)]:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def plain_spaces(c: Column) -> Column:
    """The ideographic space as a plain one, as a laid-out line has it."""
    return F.translate(c, "　", " ")
