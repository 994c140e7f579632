"""Times and bytes as text."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import MAX_TS, MIN_TS, NANOS

#: Date, time, fraction and offset; an offset must be there.
RFC3339 = r"(\d{4}-\d{2}-\d{2})T([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(?:[.,](\d+))?(?:Z|([+-])([01]\d|2[0-3]):([0-5]\d))"
_RFC3339 = re.compile(RFC3339, re.ASCII)


def parse_rfc3339(text: Column) -> Column:
    """Unix nanoseconds; null if text is no RFC 3339 time with an offset, or beyond 64 bits. More than nine digits of a fraction are cut."""
    # once the pattern holds, all but the fraction has its place
    good = text.rlike(rf"\A{RFC3339}\z")
    whole = lambda first: F.substring(text, first, 2).try_cast("long")
    zulu = F.endswith(text, F.lit("Z"))
    offset = F.when(zulu, 0).otherwise((F.substring(text, -5, 2).try_cast("long") * 3600 + F.substring(text, -2, 2).try_cast("long") * 60) * F.when(F.substring(text, -6, 1) == "-", -1).otherwise(1))
    days = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("long")
    seconds = days * 86400 + whole(12) * 3600 + whole(15) * 60 + whole(18) - offset
    digits = F.greatest(F.lit(0), F.least(F.lit(9), F.length(text) - F.when(zulu, 21).otherwise(26)))
    fraction = F.rpad(F.substr(text, F.lit(21), digits), 9, "0").try_cast("long")
    limit = MAX_TS // NANOS
    # just inside the limits, so that the product never overflows
    fits = seconds.between(-limit, limit - 1)
    return F.when(good & days.isNotNull() & fits, F.when(fits, seconds).otherwise(0) * F.lit(NANOS) + fraction)


def format_rfc3339(ts: Column) -> Column:
    """UTC with as many digits of a fraction as are not zero at its end."""
    nanos = F.pmod(ts, F.lit(NANOS).cast("long"))
    seconds = (ts - nanos).cast("long")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))  # noqa: E731  whole numbers only
    whole = div(seconds, NANOS)
    second = F.pmod(whole, F.lit(86400).cast("long"))
    day = F.date_from_unix_date(div(whole - second, 86400).cast("int"))
    clock = F.format_string("%02d:%02d:%02d", div(second, 3600), F.pmod(div(second, 60), F.lit(60)), F.pmod(second, F.lit(60)))
    fraction = F.regexp_replace(F.concat(F.lit("."), F.lpad(nanos.cast("string"), 9, "0")), r"\.?0+$", "")
    return F.concat(day.cast("string"), F.lit("T"), clock, fraction, F.lit("Z"))


def strict_base64(text: Column) -> Column:
    """Bytes of padded standard base64; null for anything else (also unpadded). An empty text is no bytes."""
    good = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(good, F.unbase64(F.when(good, text).otherwise("")))


def rfc3339(text: str) -> int:
    """Unix nanoseconds of one time, as parse_rfc3339."""
    m = _RFC3339.fullmatch(text)
    if not m:
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    days = date.fromisoformat(m[1]).toordinal() - date(1970, 1, 1).toordinal()
    offset = (int(m[7]) * 3600 + int(m[8]) * 60) * (-1 if m[6] == "-" else 1) if m[6] else 0
    found = (days * 86400 + int(m[2]) * 3600 + int(m[3]) * 60 + int(m[4]) - offset) * NANOS + int((m[5] or "")[:9].ljust(9, "0"))
    if not MIN_TS <= found <= MAX_TS:
        raise ValueError(f"beyond 64 bits: {text!r}")
    return found


def to_rfc3339(ts: int) -> str:
    seconds, nanos = divmod(ts, NANOS)
    days, second = divmod(seconds, 86400)
    fraction = f".{nanos:09d}".rstrip("0") if nanos else ""
    return f"{date.fromordinal(date(1970, 1, 1).toordinal() + days)}T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}{fraction}Z"


def format_bytes(n: int) -> str:
    """With one digit after the point in GiB, MiB or KiB; below that in bytes."""
    for unit, size in (("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10)):
        if n >= size:
            return f"{n / size:.1f} {unit}"
    return f"{n} B"
