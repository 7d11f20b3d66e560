"""Column expressions for addresses, names, numbers and CSV fields; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mime import DOMAIN_CHARS, LOCAL_CHARS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRINGS = "array<string>"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _clean(address: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(address, r"^\s+|\s+$", ""), r"^(?:mailto:)+", "")
    return ascii_lower(F.regexp_replace(bare, r"""^["'.\s]+|["'.\s]+$""", ""))


def extract_addrs(text: Column) -> Column:
    """Addresses of a header value: those in ``<...>``, or else every bare one; distinct, in order."""

    def found(pattern: str) -> Column:
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _clean)
        return F.array_distinct(F.filter(hits, lambda a: a.contains("@")))

    angle = found("<([^>]*)>")
    bare = found(rf"(?<![{LOCAL_CHARS}])(?=([{LOCAL_CHARS}]+@[{DOMAIN_CHARS}]+))")
    none = F.array().cast(_STRINGS)
    return F.when(text.isNull(), none).when(F.size(angle) > 0, angle).otherwise(bare)


def domain_of(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def domain_suffixes(domain: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``."""
    labels = F.split(domain, r"\.", -1)
    starts = F.sequence(F.lit(1), F.size(labels))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def glob_like(pattern: Column) -> Column:
    """A ``*`` glob as a LIKE pattern."""
    escaped = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    return F.replace(escaped, F.lit("*"), F.lit("%"))


def number(value: Column, pattern: str) -> Column:
    """Fixed decimals, ties to even on the exact binary value, no thousands separators."""
    return F.call_function("format_number", value, F.lit(pattern))


def human_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KB``, ... to base 1024."""
    out = F.concat(number(n / F.lit(1024.0**4), "0.0"), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        text = F.concat(number(n / F.lit(1024.0**power), "0.0"), F.lit(f" {unit}"))
        out = F.when(n < 1024 ** (power + 1), text).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def human_bytes_py(n: int) -> str:
    """The same for one number on the driver or in a task."""
    if n < 1024:
        return f"{n} B"
    size, unit = float(n), ""
    for unit in ("KB", "MB", "GB", "TB"):  # noqa: B007
        size /= 1024
        if size < 1024:
            break
    return f"{size:.1f} {unit}"


def mib(n: Column) -> Column:
    return number(n / F.lit(1048576.0), "0.000")


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    return number(F.lit(100.0) * part / F.greatest(total, F.lit(1)), "0." + "0" * digits)


def truncate(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def sanitize(name: Column) -> Column:
    """A name that any file system takes; over 100 characters it keeps 90 and its extension."""
    safe = F.regexp_replace(name, r'[\p{Cc}/\\:*?"<>|]', "_")
    safe = F.regexp_replace(F.regexp_replace(safe, r"(?U)^\s+|\s+$", ""), r"^\.+|\.+$", "")
    safe = F.when(safe == "", "unnamed").otherwise(safe)
    extension = F.substring(F.regexp_extract(safe, r"(?s)\.([^.]*)$", 1), 1, 10)
    stem = F.substring(safe, 1, 90)
    short = F.when(extension == "", stem).otherwise(F.concat(stem, F.lit("."), extension))
    return F.when(F.char_length(safe) > 100, short).otherwise(safe)


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text)
