"""Scalar column expressions used by reports."""

from pyspark.sql import functions as F


def clean_number(x):
    """Text or number to double; bad text, NaN and infinities become missing."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def squeeze_blanks(x):
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def temperature_label(temp, known=None):
    """44.3 -> temp44p3; ``known`` maps temperatures to labels of their own."""
    out = F.replace(F.format_string("temp%.1f", temp), F.lit("."), F.lit("p"))
    for value, label in (known or {}).items():
        out = F.when(temp == float(value), F.lit(label)).otherwise(out)
    return out


def logratio_to_percent(x):
    return (F.pow(F.lit(10.0), x) - 1) * 100


def percent_to_logratio(x):
    return F.log10(F.greatest(1 + x / 100, F.lit(1e-20)))


def canonical_channel(name):
    """Channel name without the amplifier prefix, anything after ``-`` or ``/``, blanks and a reference token."""
    # The prefix and the reference tokens.
    prefix, references = r"(?i)^EEG[ \-_]*", r"(?i)(Ref|LE|RE|M1|M2|A1|A2|AVG|AVE)$"
    bare = F.regexp_extract(F.regexp_replace(F.trim(name), prefix, ""), r"^([^\-/]*)", 1)
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", ""), references, "")


def edge_name(prefix, a, b):
    return F.concat_ws("_", prefix, F.concat_ws("__", a, b))


def joined(parts, sep="; "):
    """Texts that are present, joined."""
    return F.array_join(F.array_compact(F.array(*parts)), sep)
