"""Scalar column expressions used by the operators."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from recordrisk.functions import tables as R

# Text a number parser accepts: sign, digits, exponent, or an infinity.
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
# Everything that counts as white space at the ends of a text.
_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
HASH_BITS = 60


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_lower(c) -> Column:
    """Lower case with leading and trailing white space of every kind removed."""
    return F.btrim(F.lower(as_col(c)), F.lit(_SPACE))


def keyword_rules(c, rules, default, strip=True) -> Column:
    """Result of the first rule that has a keyword contained in the text.

    A missing text matches nothing and gets the default. The repeated normalised text is
    one common subexpression of the generated code.
    """
    text = F.coalesce(strip_lower(c) if strip else F.lower(as_col(c)), F.lit(""))
    expr = F
    for result, words in distinct_keywords(rules):
        expr = expr.when(reduce(or_, [text.contains(w) for w in words]), F.lit(result))
    return expr.otherwise(F.lit(default))


def distinct_keywords(rules):
    """The rules without keywords that change nothing.

    A keyword that contains another one of its own rule, or of an earlier rule, only matches
    texts which that one has decided already.
    """
    kept, earlier = [], []
    for result, words in rules:
        own = [w for w in words if not any(o in w for o in earlier)
               and not any(o in w for o in words if o != w)]
        earlier += own
        if own:
            kept.append((result, own))
    return kept


def stage_code(c, rules="train") -> Column:
    """Stage text to 1..9; unknown and missing text counts as seed level."""
    if rules == "train":
        return keyword_rules(c, R.STAGE_RULES_TRAIN, R.STAGE_DEFAULT).cast("int")
    return keyword_rules(c, R.STAGE_RULES_SERVE, R.STAGE_DEFAULT, strip=False).cast("int")


def industry_class(c, rules="train") -> Column:
    """Free industry text to one of the industry classes."""
    if rules == "train":
        return keyword_rules(c, R.INDUSTRY_RULES_TRAIN, R.INDUSTRY_DEFAULT_TRAIN)
    return keyword_rules(c, R.INDUSTRY_RULES_SERVE, R.INDUSTRY_DEFAULT_SERVE, strip=False)


def membership_flag(c, values) -> Column:
    """1 if the value is in the list, else 0; missing is 0."""
    return F.when(as_col(c).isin(list(values)), 1).otherwise(0)


def band(c, edges=R.FUNDING_BAND_EDGES) -> Column:
    """0 for exactly zero, then the number of the first upper edge above the value.

    Missing and very large values fall through to the last band, negative ones into band 1.
    """
    c = as_col(c)
    expr = F.when(c == 0, 0)
    for i, edge in enumerate(edges, 1):
        expr = expr.when(c < edge, i)
    return expr.otherwise(len(edges) + 1)


def map_literal(c, mapping) -> Column:
    """Small dictionary lookup; unmapped and missing keys give NULL."""
    c = as_col(c)
    expr = F.lit(None)
    for key, value in reversed(list(mapping.items())):
        expr = F.when(c == F.lit(key), F.lit(value)).otherwise(expr)
    return expr


def decode_label(c, mapping) -> Column:
    """Display label of a code; an unknown code is shown as its own text."""
    return F.coalesce(map_literal(c, mapping), as_col(c).cast("string"))


def money(c, errors="raise") -> Column:
    """``"-"`` is zero, commas are dropped, the rest must be a number.

    ``errors="raise"`` fails on other text (under ANSI mode), ``"null"`` gives NULL.
    """
    c = as_col(c)
    text = F.regexp_replace(F.when(c == "-", "0").otherwise(c), ",", "")
    return number(text) if errors == "null" else _nan_to_null(text.cast("double"))


def number(c) -> Column:
    """Text to double; text that is not a whole number literal gives NULL."""
    text = as_col(c).cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number_or(c, default=0.0) -> Column:
    return F.coalesce(number(c), F.lit(float(default)))


def _nan_to_null(c) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def zero_filled(c) -> Column:
    """A model input as double, missing and NaN as zero."""
    return F.coalesce(_nan_to_null(as_col(c).cast("double")), F.lit(0.0))


def stringify(c, null_label="nan") -> Column:
    """Text of a category, with a label of its own for missing."""
    return F.coalesce(as_col(c).cast("string"), F.lit(null_label))


def binary_target(c, positive=1) -> Column:
    """1 where the value equals ``positive``; everything else, missing included, is 0."""
    return F.when(as_col(c) == F.lit(positive), 1).otherwise(0)


def cap_at(c, cap) -> Column:
    """Upper clip that keeps missing values missing (``least`` would not)."""
    c = as_col(c)
    return F.when(c > cap, cap).otherwise(c)


def floor_fill(c, floor=1) -> Column:
    """Missing and anything below the floor become the floor."""
    return F.greatest(F.coalesce(as_col(c), F.lit(floor)), F.lit(floor))


def safe_ratio(num, den) -> Column:
    """Division that gives NULL for a zero denominator."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def log1p(c) -> Column:
    """ln(1 + x), NULL where it is undefined."""
    c = as_col(c)
    return F.when(c > -1, F.log1p(c))


def rate_tier(c, high, low) -> Column:
    return F.when(as_col(c) > high, "high").when(as_col(c) > low, "middle").otherwise("low")


def outcome_label(c, safe_code=1) -> Column:
    """Code to Safe or Failed; ``safe_code`` is the label polarity (1 now, 0 in old models)."""
    return F.when(as_col(c) == safe_code, "Safe").otherwise("Failed")


def finite(c) -> Column:
    """The number as double; NaN and the infinities count as missing."""
    c = as_col(c).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def fixed_text(c, digits) -> Column:
    """Text with one or two decimals, rounded half-even on the exact binary value.

    ``format_string`` and ``round`` start from the shortest decimal text of a double and so round 1.15 up although the
    stored number lies below it. Here the fraction is split into two parts whose products with the power of ten are
    exact, so the distance from a tie has the right sign. Beyond 2**52 a double has no fraction, and beyond 38 digits there is
    no text; missing, NaN and infinite values have none either.
    """
    x, scale = finite(c), float(10**digits)
    size = F.abs(x)
    part = size % F.lit(1.0)
    high = F.floor(part * float(2**27)) / F.lit(float(2**27))
    steps = F.floor(part * scale)
    past_tie = (high * scale - steps - F.lit(0.5)) + (part - high) * scale
    up = (past_tie > 0) | ((past_tie == 0) & (steps % 2 == 1))
    units = steps + F.when(up, 1).otherwise(0)
    carry = F.when(units >= int(scale), 1).otherwise(0)
    whole = F.floor(F.when(size < float(2**52), size)).cast("long") + carry
    small = F.concat(whole.cast("string"), F.lit("."), F.lpad((units - carry * int(scale)).cast("string"), digits, "0"))
    large = F.concat(size.try_cast("decimal(38,0)").cast("string"), F.lit("." + "0" * digits))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.coalesce(small, large))


def percent_text(share) -> Column:
    """A share as ``"xx.x%"``."""
    return F.concat(fixed_text(as_col(share) * 100, 1), F.lit("%"))


def hash60(*parts) -> Column:
    """First 60 bits of md5 over the parts joined by ``:``.

    The same number can be computed in any SQL engine, and it depends on the row's key
    only, so every choice made by it survives repartitioning and task retries.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
