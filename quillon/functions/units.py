"""Unit conversion, SI prefixes and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# display = base * factor + shift, by quantity and unit.
UNITS: dict[str, dict[str, tuple[float, float, str]]] = {
    "temperature": {"kelvin": (1.0, 0.0, "K"), "celsius": (1.0, -273.15, "°C"), "fahrenheit": (1.8, -459.67, "°F")},
    "pressure": {"pascal": (1.0, 0.0, "Pa"), "bar": (1 / 100000.0, 0.0, "bar"), "atmosphere": (1 / 101300.0, 0.0, "atm"), "psi": (1 / 6895.0, 0.0, "psi")},
    "irradiation": {"becquerel": (1e6, 0.0, "Bq"), "curie": (1 / 37e9, 0.0, "Ci"), "gray_per_second": (1.602e-13, 0.0, "Gy/s"), "rad_per_second": (1.602e-11, 0.0, "rad/s"), "sievert_per_second": (1.602e-13, 0.0, "Sv/s")},
}

# Exponents of ten and their prefixes.
PREFIXES = ((-18, "a"), (-15, "f"), (-12, "p"), (-9, "n"), (-6, "µ"), (-3, "m"), (0, ""), (3, "k"), (6, "M"), (9, "G"), (12, "T"), (15, "P"), (18, "E"))


def convert(value: Column, quantity: str, unit: str) -> Column:
    """A value in the quantity's base unit, as ``unit``: value * factor + shift."""
    factor, shift, _ = UNITS[quantity][unit]
    out = value * F.lit(factor)
    return out + F.lit(shift) if shift else out


def prefix(value: Column, *, abs_value: bool = False) -> tuple[Column, Column]:
    """(scaled value, prefix) for the greatest power of 1000 that is not above the value.

    Nothing fits 0 and negatives, which then take the smallest prefix; ``abs_value`` looks at the size only.
    """
    measure = F.abs(value) if abs_value else value
    power, name = F.lit(PREFIXES[0][0]), F.lit(PREFIXES[0][1])
    for exponent, sign in PREFIXES[1:]:
        power = F.when(measure >= F.lit(10.0**exponent), F.lit(exponent)).otherwise(power)
        name = F.when(measure >= F.lit(10.0**exponent), F.lit(sign)).otherwise(name)
    return value / F.pow(F.lit(10.0), power.cast("double")), name


def quantity_text(value: Column, quantity: str, unit: str, label: str = "", decimals: int = 2) -> Column:
    """Label, converted value and symbol, as in ``'Pressure: 1.02 atm'``."""
    shown = F.concat(F.format_string(f"%.{decimals}f", convert(value, quantity, unit)), F.lit(" " + UNITS[quantity][unit][2]))
    return F.concat(F.lit(f"{label}: "), shown) if label else shown


def to_fixed_point(value: Column, decimals: int) -> Column:
    """Whole steps of 10**-decimals, rounded half up."""
    return F.floor(value * F.lit(10.0**decimals) + 0.5).cast("long")


def from_fixed_point(state: Column, decimals: int) -> Column:
    return state.cast("double") / F.lit(10.0**decimals)


def axis_number(value: Column) -> Column:
    """Scientific from 1e4 on and below 1e-2, no decimals from 10 on, else three."""
    size = F.abs(value)
    return F.when((size >= 1e4) | (size < 1e-2), F.format_string("%.1e", value)).when(size >= 10, F.format_string("%.0f", value)).otherwise(F.format_string("%.3f", value))
