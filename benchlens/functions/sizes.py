"""Size expressions (binary units: k/m/g are powers of 1024)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

_MULT = {"k": 1024, "m": 1024 ** 2, "g": 1024 ** 3}


def parse_size(c) -> Column:
    """'64k' -> 65536, '4M' -> 4194304, '512' -> 512; anything else -> NULL.

    Case-insensitive single-letter suffix k/m/g on a whole number.  Decimals
    ('1.5m'), two-letter units ('4mb'), empty strings and sizes beyond a bigint
    give NULL.
    """
    s = F.lower(col(c))
    ok = s.rlike(r"^[0-9]+[kmg]?$")
    digits = F.regexp_extract(s, r"^([0-9]+)", 1).try_cast("bigint")
    unit = F.regexp_extract(s, r"([kmg]?)$", 1)
    mult = (F.when(unit == "k", F.lit(_MULT["k"]))
            .when(unit == "m", F.lit(_MULT["m"]))
            .when(unit == "g", F.lit(_MULT["g"]))
            .otherwise(F.lit(1)).cast("bigint"))
    return F.when(ok, F.try_multiply(digits, mult))


def _div(b: Column, unit: int) -> Column:
    return F.call_function("div", b, F.lit(unit).cast("bigint")).cast("string")


def format_size(c) -> Column:
    """bytes -> fio label: whole MiB as '<n>m', otherwise '<n>k' (floor)."""
    b = col(c).cast("bigint")
    return (F.when(b >= _MULT["m"], F.concat(_div(b, _MULT["m"]), F.lit("m")))
            .otherwise(F.concat(_div(b, _MULT["k"]), F.lit("k"))))


def test_file_size(c, multiplier: int = 4, floor_bytes: int = 64 * 1024 ** 2) -> Column:
    """bytes written per job = max(multiplier x block size, 64 MiB)."""
    return F.greatest(col(c).cast("bigint") * F.lit(multiplier), F.lit(floor_bytes).cast("bigint"))


def geometric_series(start, factor, end) -> Column:
    """start, start*factor, ... up to and including end (array of bigint).

    Built with ``sequence`` of exponents, so it is one row-local expression.
    """
    s, f, e = col(start).cast("double"), col(factor).cast("double"), col(end).cast("double")
    k = F.floor(F.log(e / s) / F.log(f) + F.lit(1e-9)).cast("int")
    return F.transform(F.sequence(F.lit(0), k), lambda i: (s * F.pow(f, i)).cast("bigint"))
