"""Column expressions on names, paths and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import dims

CUT = " [truncated]"


def fits(text: Column, limit: int) -> Column:
    """The text, or as much as the limit allows with a marker saying it was cut."""
    short = F.concat(F.substring(text, 1, limit - len(CUT)), F.lit(CUT))
    return F.when(F.length(text) > limit, short).otherwise(text)


def long_fits(text: Column, limit: int) -> Column:
    """``fits`` for text that is often cut: one byte a character, it is cut as bytes, along which nothing has to walk."""

    def cut(whole: Column) -> Column:
        most = limit - len(CUT)
        plain = F.octet_length(whole) == F.length(whole)
        head = F.when(plain, F.substring(whole.cast("binary"), 1, most).cast("string")).otherwise(F.substring(whole, 1, most))
        return F.when(F.length(whole) > limit, F.concat(head, F.lit(CUT))).otherwise(whole)

    return F.get(F.transform(F.array(text), cut), F.lit(0))


def blank_to(text: Column, default: str) -> Column:
    return F.when(text != "", text).otherwise(F.lit(default))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot, as a path library reads it (``.env`` has none)."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def without_extension(path: Column) -> Column:
    """The whole path with its last extension removed."""
    return F.regexp_replace(path, r"\.[^.]*$", "")


def is_live_secret(name: Column) -> Column:
    """Whole-filename rule for source trees: dotenv files except the committed templates."""
    return ~name.isin(*dims.ENV_TEMPLATES) & (
        name.isin(*dims.SECRET_FILENAMES) | name.startswith(".env.") | name.endswith(".env")
    )


def is_live_credential(name: Column) -> Column:
    """The stricter artefact twin: anything starting ``.env`` unless it is on the safe list."""
    low = F.lower(name)
    return ~low.isin(*dims.SAFE_ENV_NAMES) & low.startswith(".env")


def is_test_path(path: Column) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    inside = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in dims.TEST_DIRS]))
    named = F.lit(False)
    base = stem(path)
    for prefix in dims.TEST_PREFIXES:
        named = named | base.startswith(prefix)
    for ending in dims.TEST_SUFFIXES:
        named = named | base.endswith(ending)
    return F.coalesce(inside, F.lit(False)) | named


def redact(text: Column) -> Column:
    return F.regexp_replace(text, dims.SECRET_SHAPES, "REDACTED")


def plain_words(sentence: Column) -> Column:
    """The text of ``mechanism_shape``, read in one walk over the sentence."""
    found = F.regexp_extract_all(F.lower(sentence), F.lit(dims.SPECIFICS_OR_WORDS), 1)
    return F.array_join(F.array_remove(found, ""), " ")


def mechanism_shape(sentence: Column) -> Column:
    """What a sentence says once quoted text, names, paths and numbers are taken out."""
    plain = F.regexp_replace(F.lower(sentence), dims.SPECIFICS, " ")
    return F.array_join(F.regexp_extract_all(plain, F.lit("([a-z]+)"), 1), " ")


def word_count(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))


def short_number(value: Column) -> Column:
    """Six significant digits, no trailing zeros: 8 -> ``8``, 0.25 -> ``0.25``, 1e9 -> ``1e+09``."""
    size = F.abs(value)
    power = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.log10(size))).cast("int")
    digits = F.greatest(F.lit(5) - power, F.lit(0))
    scale = F.pow(F.lit(10.0), digits)
    kept = F.round(value * scale, 0) / scale
    plain = F.regexp_replace(
        F.regexp_replace(F.format_string("%.10f", kept), r"(\.\d*?)0+$", "$1"), r"\.$", ""
    )
    mantissa = F.regexp_replace(
        F.regexp_replace(
            F.format_string("%.5f", value / F.pow(F.lit(10.0), power.cast("double"))), r"(\.\d*?)0+$", "$1"
        ),
        r"\.$",
        "",
    )
    exponent = F.format_string(
        "%s%02d", F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(power)
    )
    return F.when((power >= 6) | (power < -4), F.concat(mantissa, F.lit("e"), exponent)).otherwise(plain)
