"""Scalar conversions of catalog values as column expressions, and their driver-side text forms."""

from __future__ import annotations

import html
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_SECONDS = 365.25 * 86400
TAR_BLOCK = 512
HASH_BLOCK = 4 << 20


def epoch(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO-8601 UTC stamp; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(stamp, "Z$", "")))


def hash_bytes(hex_text: Column) -> Column:
    """The 32 bytes of a SHA-256 in hex; null if it is none."""
    return F.when(F.length(hex_text) == 64, F.try_to_binary(hex_text, F.lit("hex")))


def seconds(stamp: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, taken as UTC."""
    return F.unix_timestamp(stamp.cast("timestamp"))


def utc_year(epoch_seconds: Column) -> Column:
    return F.year(F.timestamp_seconds(epoch_seconds))


def utc_month(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM")


def iso(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_date(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd")


def older_than(epoch_seconds: Column, years: float, as_of: int) -> Column:
    """Strictly before ``years`` years of 365.25 days ago; a null date is never old."""
    return F.coalesce(epoch_seconds.cast("double") < F.lit(float(as_of - years * YEAR_SECONDS)), F.lit(False))


def octal_mode(mode: Column) -> Column:
    """Permission bits in octal, at least four digits."""
    digits = F.lower(F.conv(mode.cast("string"), 10, 8))
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def tar_padded(size: Column) -> Column:
    """Size rounded up to whole tar blocks."""
    return F.call_function("div", size + (TAR_BLOCK - 1), F.lit(TAR_BLOCK)) * TAR_BLOCK


def block_hash(content: Column, block: int = HASH_BLOCK) -> Column:
    """Content hash in hex: SHA-256 of the concatenated SHA-256 of each block of ``block`` bytes."""
    n = F.greatest(F.ceil(F.octet_length(content) / F.lit(block)).cast("int"), F.lit(1))
    piece = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.substring(content, i * block + 1, F.lit(block)), 256))
    joined = F.when(F.octet_length(content) == 0, F.lit("")).otherwise(F.array_join(piece, ""))
    return F.sha2(F.unhex(joined), 256)


def set_hash(ordered: Column) -> Column:
    """Identity of an ordered array of structs (content_hash, size): SHA-256 over "hash:size" lines."""
    return F.sha2(F.array_join(F.transform(ordered, lambda p: F.concat(p["content_hash"], F.lit(":"), p["size"].cast("string"), F.lit("\n"))), ""), 256)


def compression(head: Column) -> Column:
    """Name of the compression that a file's first bytes announce; null if none."""
    # fixed values: magic numbers
    magic = {"gzip": "1f8b", "bzip2": "425a68", "xz": "fd377a585a00", "zstd": "28b52ffd", "lz4": "04224d18", "zip": "504b0304"}
    text = F.lower(F.hex(head))
    out = F.lit(None).cast("string")
    for name, begin in magic.items():
        out = F.when(F.startswith(text, F.lit(begin)), name).otherwise(out)
    return out


UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def human_bytes(n: float) -> str:
    """1536 -> "1.5 KiB"."""
    step = 0
    while abs(n) >= 1024 and step < len(UNITS) - 1:
        n, step = n / 1024, step + 1
    return f"{int(n)} B" if step == 0 else f"{n:.1f} {UNITS[step]}"


def share(part: float, whole: float) -> str:
    """A share in whole per cent."""
    return f"{round(100 * part / whole)}%" if whole else "0%"


def human_bytes_column(n: Column) -> Column:
    """As :func:`human_bytes`, for a column."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for step in range(1, len(UNITS)):
        scale = 1024**step
        out = F.when(F.abs(n) >= scale, F.concat(F.format_string("%.1f", n.cast("double") / float(scale)), F.lit(f" {UNITS[step]}"))).otherwise(out)
    return out


def human_duration(seconds_: float) -> str:
    """3725 -> "1h 2m"; under a minute in seconds."""
    whole = int(seconds_)
    if whole < 60:
        return f"{whole}s"
    for size, big, small, unit in ((86400, "d", "h", 3600), (3600, "h", "m", 60), (60, "m", "s", 1)):
        if whole >= size:
            rest = whole % size // unit
            return f"{whole // size}{big} {rest}{small}" if rest else f"{whole // size}{big}"
    return f"{whole}s"


def parse_size(text: str) -> int:
    """"1.5G" -> bytes; units B, K, M, G, T, P, in powers of 1024, with or without "iB" or "B"."""
    t = text.strip().upper()
    for power, letter in reversed(list(enumerate("BKMGTP"))):
        for ending in ((f"{letter}IB", f"{letter}B", letter) if power else ("B",)):
            if t.endswith(ending):
                t = t[: -len(ending)]
                break
        else:
            continue
        break
    else:
        power = 0
    try:
        n = float(t)
    except ValueError:
        raise ValueError(f"{text!r} is not a size") from None
    if not 0 <= n < float("inf"):
        raise ValueError(f"{text!r} is not a size")
    return int(n * 1024**power)


def compact(n: int) -> str:
    """12345 -> "12k": at most four characters or so."""
    if n < 1000:
        return str(n)
    for scale, unit in ((1e9, "G"), (1e6, "M"), (1e3, "k")):
        if n >= scale:
            v = n / scale
            return (f"{v:.1f}" if v < 10 else f"{v:.0f}") + unit
    return str(n)


def plural(n: int, word: str) -> str:
    return f"{n:,} {word}" if n == 1 else f"{n:,} {word}s"


def day(t: int | None) -> str:
    return datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%d") if t else ""


def bar(share: float) -> str:
    """A share of a row's width as an inline style."""
    return f"width:{max(0.0, min(1.0, share)) * 100:.1f}%"


def escaped(text: object) -> str:
    return html.escape(str(text), quote=True)
