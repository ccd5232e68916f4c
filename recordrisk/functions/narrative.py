"""Reason and advice texts as column expressions."""

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from recordrisk.functions import tables as R
from recordrisk.functions.columns import as_col, finite, fixed_text

MILLION = 1_000_000


def _fill(template, **slots) -> Column:
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{"):
            parts.append(slots[piece[1:-1]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _mentions(stage, words) -> Column:
    if not words:
        return F.lit(False)
    text = F.lower(stage)
    return reduce(or_, [text.contains(w) for w in words])


def _yes(condition) -> Column:
    return F.coalesce(condition, F.lit(False))


def _is_major(city) -> Column:
    return _yes(city.isin(R.MAJOR_CITIES))


def _sentence(prefix, parts, joiner) -> Column:
    """The first few texts whose condition holds, in order.

    ``parts`` are (condition, text). A part is dropped once enough earlier ones hold, which
    keeps the whole sentence in generated code, without arrays.
    """
    seen, kept = F.lit(0), []
    for place, (condition, text) in enumerate(parts):
        room = condition if place < R.REASON_LIMIT else condition & (seen < R.REASON_LIMIT)
        kept.append(F.when(room, text))
        seen = seen + F.when(condition, 1).otherwise(0)
    body = F.when(seen == 0, R.REASON_FALLBACK).otherwise(F.concat_ws(joiner, *kept))
    return F.concat(F.lit(prefix), body, F.lit(R.REASON_SUFFIX))


def with_amounts(df, funding):
    """Adds the amounts that ``reason_text`` shows, as columns of their own.

    A sentence names an amount in several branches. Made beforehand it is computed once, and the sentence stays small enough
    for generated code.
    """
    millions = finite(funding) / MILLION
    return df.withColumns({"_tenths": fixed_text(millions, 1), "_hundredths": fixed_text(millions, 2)})


def reason_text(prediction, funding, rounds, city, industry, stage, style="service", symbol="$") -> Column:
    """Up to three reasons in rule order, worded for the predicted outcome.

    Needs the columns of ``with_amounts``. An amount that is missing, NaN or infinite is treated as missing.
    """
    prediction, rounds = as_col(prediction), as_col(rounds)
    city, industry, stage = as_col(city), as_col(industry), as_col(stage)
    m = finite(funding) / MILLION
    sign, count = F.lit(symbol), rounds.cast("string")
    major, tech = _is_major(city), _yes(industry.isin(R.TECH_INDUSTRIES))

    good, bad = R.SAFE_REASONS, {**R.FAILED_REASONS, **R.FAILED_REASONS_BY_STYLE[style]}
    tenths = F.coalesce("_tenths", F.lit("?"))
    safe = _sentence(R.SAFE_PREFIX, [
        (F.lit(True), F.when(m >= 10, _fill(good["strong"], symbol=sign, amount=tenths))
            .when(m >= 1, _fill(good["solid"], symbol=sign, amount=tenths)).otherwise(good["early"])),
        (_yes(rounds >= 2), F.when(rounds >= 3, _fill(good["many_rounds"], rounds=count))
            .otherwise(_fill(good["some_rounds"], rounds=count))),
        (major, _fill(good["city"], city=city)),
        (tech, _fill(good["tech"], industry=industry)),
        (_yes(_mentions(stage, R.LATE_STAGE_WORDS[style])), F.lit(good["late"])),
    ], R.SAFE_JOIN)
    failed = _sentence(R.FAILED_PREFIX, [
        (_yes(m < 0.5), F.when(m < 0.1, bad["none"])
            .otherwise(_fill(bad["little"], symbol=sign, amount=F.coalesce("_hundredths", F.lit("?"))))),
        (_yes(rounds <= 1), F.lit(bad["rounds"])),
        (~major & city.isNotNull(), _fill(bad["city"], city=city)),
        (~tech & industry.isNotNull(), _fill(bad["industry"], industry=industry)),
        (_yes(_mentions(stage, R.STRESS_STAGE_WORDS[style])), F.lit(bad["debt"])),
    ], R.FAILED_JOIN)
    return F.when(prediction == "Safe", safe).otherwise(failed)


def advice_text(prediction, funding, rounds, city, style="service") -> Column:
    """The first advice whose condition holds, by outcome."""
    m = finite(funding) / MILLION
    rounds = as_col(rounds)
    good, bad = R.SAFE_ADVICE[style], R.FAILED_ADVICE[style]
    safe = F.when(m < 1, good[0]).when(m < 5, good[1]).when(rounds < 3, good[2]).otherwise(good[3])
    failed = (
        F.when(m < 0.5, bad[0]).when(rounds <= 1, bad[1])
        .when(~_is_major(as_col(city)), bad[2]).otherwise(bad[3])
    )
    return F.when(as_col(prediction) == "Safe", safe).otherwise(failed)
