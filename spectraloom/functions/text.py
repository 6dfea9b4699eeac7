"""Number and peptide texts of the reports."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _shown(x: float) -> str:
    size = abs(x)
    if x != x or size in (0.0, float("inf")):
        return "0"
    if not 1e-4 <= size < 1e6:
        digits, _, exponent = f"{x:.5e}".partition("e")
        return f"{digits.rstrip('0').rstrip('.')}e{exponent}"
    out = f"{x:.{max(5 - math.floor(math.log10(size)), 0)}f}"
    return out.rstrip("0").rstrip(".") if "." in out else out


@F.pandas_udf(T.StringType())
def report_number(value: pd.Series) -> pd.Series:
    """Six significant digits without trailing zeros; 0 for null, NaN and infinities; an exponent outside [1e-4, 1e6).

    Halves are those of the binary value, which the JVM's formats do not see: they round its shortest decimal form.
    """
    return pd.Series([_shown(x) for x in value.astype(float).tolist()], dtype=object)


def peptide_text(pre: Column, residues: Column, post: Column) -> Column:
    """pre.SEQUENCE.post with a signed delta of five decimals after each modified residue."""
    shown = F.transform(residues, lambda r: F.concat(r["residue"], F.when(r["mod_delta"].isNotNull(), F.format_string("%+.5f", r["mod_delta"])).otherwise("")))
    return F.concat(pre, F.lit("."), F.array_join(shown, ""), F.lit("."), post)


def parse_peptide(text: Column) -> Column:
    """STRUCT(pre, post, residues ARRAY<STRUCT<residue, mod_delta>>) of a peptide text; null if it is none."""
    form = r"^(.)\.((?:[A-Z](?:[+-][0-9]+(?:\.[0-9]+)?)*)+)\.(.)$"
    parts = F.regexp_extract_all(F.regexp_extract(text, form, 2), F.lit(r"([A-Z](?:[+-][0-9]+(?:\.[0-9]+)?)*)"), F.lit(1))
    deltas = lambda p: F.regexp_extract_all(p, F.lit(r"([+-][0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    one = lambda p: F.struct(
        F.substring(p, 1, 1).alias("residue"),
        F.when(F.size(deltas(p)) > 0, F.aggregate(deltas(p), F.lit(0.0), lambda a, d: a + d.cast("double"))).alias("mod_delta"),
    )
    whole = F.struct(F.regexp_extract(text, form, 1).alias("pre"), F.regexp_extract(text, form, 3).alias("post"), F.transform(parts, one).alias("residues"))
    return F.when(text.rlike(form), whole)
