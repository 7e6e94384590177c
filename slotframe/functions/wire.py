"""Little-endian reads from BINARY columns, as built-in expressions.

A slice is turned into hex text and reversed, which puts the bytes in order but
swaps the two digits of each byte; the digits are swapped back with a mask. This
stays inside generated code and never applies ``reverse`` to BINARY itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_DIGITS = 0x0F0F0F0F0F0F0F0F
TWO_64 = "CAST(18446744073709551616 AS DECIMAL(21,0))"


def piece(data: Column, at: Column, size: Column | int) -> Column:
    """``size`` bytes from the zero-based offset ``at``."""
    return F.substring(data, at + 1, F.lit(size) if isinstance(size, int) else size)


def word(data: Column, at: Column, size: int) -> Column:
    """The unsigned value of up to 7 bytes, or the signed value of 8, as BIGINT."""
    digits = F.hex(piece(data, at, size))
    if size == 1:
        return F.conv(digits, 16, 10).cast("bigint")
    swapped = F.conv(F.reverse(digits), 16, -10).cast("bigint")  # hex text, so characters are digits
    mask = F.lit(LOW_DIGITS)
    return F.shiftleft(swapped.bitwiseAND(mask), 4).bitwiseOR(
        F.shiftrightunsigned(swapped, 4).bitwiseAND(mask))


def _unsigned_decimal(bits: Column) -> Column:
    """The 64 bits of a BIGINT as an unsigned number."""
    plain = bits.cast("decimal(20,0)")
    return F.when(bits < 0, (plain + F.expr(TWO_64)).cast("decimal(20,0)")).otherwise(plain)


def _signed(bits: Column, size: int) -> Column:
    span = 1 << (8 * size)
    return F.when(bits >= span // 2, bits - span).otherwise(bits)


def _long_text(high: Column, low: Column, plus: int) -> Column:
    """Decimal text of ``high * 2**64 + low + plus`` by long division in base 10**19.

    No intermediate value leaves 38 digits, although the result may have 39.
    """
    base = F.expr("CAST(10000000000000000000 AS DECIMAL(20,0))")
    rest = F.expr("CAST(8446744073709551616 AS DECIMAL(19,0))")  # 2**64 - 10**19
    top = F.when(high >= base, 1).otherwise(0)
    low_of_high = (high - base * top).cast("decimal(19,0)")
    units = (low_of_high * rest).cast("decimal(38,0)") + low + plus
    units_digits = units % base
    carry = ((units - units_digits) / base).cast("decimal(20,0)")
    middle = (rest * top + low_of_high + carry).cast("decimal(38,0)")
    middle_digits = middle % base
    upper = ((middle - middle_digits) / base).cast("decimal(20,0)") + top

    def digits(value: Column) -> Column:
        return F.lpad(value.cast("decimal(20,0)").cast("string"), 19, "0")

    text = F.concat(upper.cast("decimal(20,0)").cast("string"), digits(middle_digits), digits(units_digits))
    return F.regexp_replace(text, "^0+(?=.)", "")


def _u128(low: Column, high: Column) -> Column:
    return _long_text(_unsigned_decimal(high), _unsigned_decimal(low), 0)


def _i128(low: Column, high: Column) -> Column:
    flipped = _long_text(_unsigned_decimal(F.bitwise_not(high)), _unsigned_decimal(F.bitwise_not(low)), 1)
    return F.when(high < 0, F.concat(F.lit("-"), flipped)).otherwise(_u128(low, high))


def _float(negative: Column, exponent: Column, mantissa: Column, exponent_max: int,
           mantissa_bits: int, bias: int) -> Column:
    """IEEE 754 value as DOUBLE from its three bit fields."""
    scale = bias + mantissa_bits
    two = F.lit(2.0)
    size = (
        F.when(exponent == exponent_max,
               F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(exponent == 0, mantissa.cast("double") * F.pow(two, F.lit(float(1 - scale))))
        .otherwise((mantissa + (1 << mantissa_bits)).cast("double")
                   * F.pow(two, (exponent - scale).cast("double"))))
    return F.when(negative, -size).otherwise(size)


def _f64(bits: Column) -> Column:
    return _float(bits < 0, F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF)),
                  bits.bitwiseAND(F.lit((1 << 52) - 1)), 0x7FF, 52, 1023)


def _f32(bits: Column) -> Column:
    return _float(bits >= (1 << 31), F.shiftrightunsigned(bits, 23).bitwiseAND(F.lit(0xFF)),
                  bits.bitwiseAND(F.lit((1 << 23) - 1)), 0xFF, 23, 127).cast("float")


def read_bool(data: Column, at: Column) -> Column:
    return piece(data, at, 1) != F.lit(b"\x00")


def utf8_text(raw: Column) -> Column:
    """BINARY as text; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def base64_bytes(text: Column) -> Column:
    """Decoded bytes, NULL on bad input so that it can be flagged."""
    return F.try_to_binary(text, F.lit("base64"))


# Numbers: byte widths of the words to read, and the value made from those words.
NUMBERS = {
    "u8": ((1,), lambda w: w.cast("smallint")),
    "i8": ((1,), lambda w: _signed(w, 1).cast("tinyint")),
    "u16": ((2,), lambda w: w.cast("int")),
    "i16": ((2,), lambda w: _signed(w, 2).cast("smallint")),
    "u32": ((4,), lambda w: w),
    "i32": ((4,), lambda w: _signed(w, 4).cast("int")),
    "u64": ((8,), _unsigned_decimal),
    "i64": ((8,), lambda w: w),
    "u128": ((8, 8), _u128),
    "i128": ((8, 8), _i128),
    "f32": ((4,), _f32),
    "f64": ((8,), _f64),
}
FIXED_SIZES = {"bool": 1, "pubkey": 32, "publicKey": 32, **{n: sum(w) for n, (w, _) in NUMBERS.items()}}


def words(data: Column, at: Column, type_name: str) -> list[Column]:
    """The words behind a number, in order."""
    out, shift = [], 0
    for size in NUMBERS[type_name][0]:
        out.append(word(data, at + shift, size))
        shift += size
    return out


def read_fixed(data: Column, at: Column, type_name: str) -> Column:
    """One fixed-size primitive, without a bounds check."""
    if type_name in NUMBERS:
        return NUMBERS[type_name][1](*words(data, at, type_name))
    return read_bool(data, at) if type_name == "bool" else piece(data, at, 32)


def read_le(data: Column, at: Column | int, type_name: str) -> Column:
    """One fixed-size primitive at a zero-based offset; NULL when the bytes do not reach that far."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.length(data) >= at + FIXED_SIZES[type_name], read_fixed(data, at, type_name))
