"""Address columns: extraction from text and repair of broken dotted quads."""

from pyspark.sql import Column, functions as F

from idsignal import fixed_values as fv
from idsignal.functions.text import strip

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_STRICT_IPV4 = f"^({_OCTET}[.]){{3}}{_OCTET}$"


def extract_ip(text: Column) -> Column:
    """First dotted-quad token of `text` if it is a valid address, else "unknown".

    Only the first token is tried; `(?U)` gives word boundaries over all of Unicode.
    """
    token = F.regexp_extract(text, "(?U)" + fv.IPV4_TOKEN, 0)
    return F.when(token.rlike(_STRICT_IPV4), token).otherwise(F.lit(fv.UNKNOWN))


def is_blank_ip(ip: Column) -> Column:
    return ip.isNull() | F.lower(strip(ip)).isin(fv.BLANK_IPS)


def repair_ip(ip: Column) -> Column:
    """Four octets from whatever digits the text has: pad with 0, cut at 4, cap at 255."""
    trimmed = strip(ip)
    octets = F.filter(F.split(trimmed, "[.]"), lambda part: part.rlike("^[0-9]+$"))
    padded = F.slice(F.concat(octets, F.array_repeat(F.lit("0"), 4)), 1, 4)

    def capped(part):
        digits = F.regexp_replace(part, "^0+(?=.)", "")
        return (
            F.when(F.length(digits) > 3, F.lit("255"))
            .otherwise(F.least(digits.cast("int"), F.lit(255)).cast("string"))
        )

    # Most addresses are whole already and skip the array work.
    return (
        F.when(trimmed.rlike(_STRICT_IPV4), trimmed)
        .when(~is_blank_ip(ip), F.array_join(F.transform(padded, capped), "."))
    )


def is_internal(ip: Column, rfc1918: bool = False) -> Column:
    """Whether the address counts as inside; by default all of 172/8 does."""
    if rfc1918:
        return ip.rlike(r"^(10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])")
    inside = F.lit(False)
    for prefix in fv.INTERNAL_PREFIXES:
        inside = inside | ip.startswith(prefix)
    return inside
