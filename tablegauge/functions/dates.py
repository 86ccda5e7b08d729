"""Date forms: how a text column writes its dates, found by a vote of its values.

A form is a field order with its separators; a column has one form, and values of
another are no dates there. Fixed-width ISO is a form of its own, whose values also fit
the wider year-first form (unpadded, slashed, zoned) where that has more of them. The vote is a count per form, so neither the order of the
rows nor their layout plays a part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tablegauge.functions.scalars import aggregate, is_text, lit, q, types_of

#: The forms that fixed-width ISO values need, parsed without groups.
ISO_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_NAMES = ("jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
          "sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?")
# A time of day and a zone may follow; the date is the one written.
_TAIL = (r"(?:(?:T| +)(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.][0-9]+)?)?(?: ?[AaPp][Mm])?"
         r"(?: ?(?:Z|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?))?)?$")
_ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.][0-9]+)?)?$"
_YEAR = r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})" + _TAIL
_NUMERIC = r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})" + _TAIL
_NAMED_MONTH = rf"^(?i)({_NAMES})[.]? +([0-9]{{1,2}})(?:st|nd|rd|th)?,? +([0-9]{{4}})" + _TAIL
_NAMED_DAY = rf"^(?i)([0-9]{{1,2}})(?:st|nd|rd|th)?(?: +|-)({_NAMES})[.]?,?(?: +|-)([0-9]{{4}})" + _TAIL

#: Form: its shape, and the groups of year, month and day. Equal votes go to ISO, then
#: to the form named first: a column whose days and months could be swapped everywhere is
#: month-first.
FORMS: dict[str, tuple[str, int, int, int]] = {
    "year-first": (_YEAR, 1, 3, 4),
    "month-first": (_NUMERIC, 4, 1, 3),
    "day-first": (_NUMERIC, 4, 3, 1),
    "named month": (_NAMED_MONTH, 3, 1, 2),
    "named day": (_NAMED_DAY, 3, 2, 1),
}


def parse_form(e: str, form: str) -> str:
    """SQL for the date in text ``e`` if it is written in ``form``, else null."""
    shape, year, month, day = FORMS[form]
    return f"CASE WHEN {e} RLIKE {lit(shape)} THEN {_cut(e, shape, year, month, day)} END"


def _cut(e: str, shape: str, year: int, month: int, day: int) -> str:
    def group(n: int) -> str:
        return f"regexp_extract({e}, {lit(shape)}, {n})"

    number = group(month)
    if shape in (_NAMED_MONTH, _NAMED_DAY):
        number = f"CAST(1 + (locate(lower(left({number}, 3)), {lit(MONTHS)}) - 1) / 3 AS INT)"
    return f"try_cast(concat({group(year)}, '-', {number}, '-', {group(day)}) AS DATE)"


def form_bits(e: str) -> str:
    """SQL for the forms in which text ``e`` is a date, as bits in the order of
    ``FORMS``; fixed-width ISO has the bit after them instead. Shapes exclude one
    another, so a value is matched against few expressions: ten bytes that cast to a
    date need none, and a few characters tell which of the others may fit."""
    def valid(form: str) -> str:
        return f"CAST({_cut(e, *FORMS[form])} IS NOT NULL AS INT)"

    def separator(place: int) -> str:
        return f"substr({e}, {place}, 1) IN ('-', '/', '.')"

    def digit(place: int) -> str:
        return f"ascii(substr({e}, {place}, 1)) BETWEEN 48 AND 57"

    plain = (f"octet_length({e}) = 10 AND substr({e}, 5, 1) = '-' AND substr({e}, 8, 1) = '-' AND {digit(10)} "
             f"AND try_cast({e} AS DATE) IS NOT NULL")
    named = f"instr('jfmasondJFMASOND', left({e}, 1)) > 0"
    return f"""CASE
        WHEN {plain} THEN 32
        WHEN {separator(5)} AND {e} RLIKE {lit(_YEAR)}
            THEN {valid('year-first')} * CASE WHEN {e} RLIKE {lit(_ISO)} THEN 32 ELSE 1 END
        WHEN ({separator(2)} OR {separator(3)}) AND {e} RLIKE {lit(_NUMERIC)}
            THEN 2 * {valid('month-first')} + 4 * {valid('day-first')}
        WHEN {named} AND {e} RLIKE {lit(_NAMED_MONTH)} THEN 8 * {valid('named month')}
        WHEN {digit(1)} AND NOT {digit(3)} AND {e} RLIKE {lit(_NAMED_DAY)} THEN 16 * {valid('named day')}
        ELSE 0 END"""


def all_form_bits(names: Sequence[str]) -> str:
    """SQL for the form bits of several text columns, as an array in their order.

    One lambda serves all columns. Written out for each, the expressions fill a
    generated method that is too large for the JVM to compile, and run several times
    slower.
    """
    return f"transform(array({', '.join(q(c) for c in names)}), value -> {form_bits('value')})"


def vote_exprs(column: str, bits: str) -> dict[str, str]:
    """Aggregates that count the votes of a column whose form bits are ``bits``."""
    return {f"form{i}_{column}": f"count_if(({bits} & {1 << i}) != 0)" for i in range(len(FORMS) + 1)}


def winner(column: str, row: Mapping[str, int]) -> tuple[tuple[str, ...], int]:
    """The patterns of a column by its votes, and how many values fit them. A column
    without any date keeps the ISO patterns."""
    *votes, iso = [row[f"form{i}_{column}"] or 0 for i in range(len(FORMS) + 1)]
    most = max(votes)
    if iso >= most:
        return ISO_FORMATS, iso
    form = list(FORMS)[votes.index(most)]
    return (form,), most + (iso if form == "year-first" else 0)


def date_patterns(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Patterns of each column of ``names``, from one scan of the text ones.

    Every non-null row votes, repeated rows each time. Ties go to ISO, then by ``FORMS``; columns
    that are absent, not text, empty or without dates get the ISO patterns.
    """
    kinds = types_of(df)
    texts = [c for c in names if c in kinds and is_text(kinds[c])]
    out = {c: ISO_FORMATS for c in names}
    if texts:
        bits = df.selectExpr(f"{all_form_bits(texts)} AS bits")
        row = aggregate(bits, {
            n: e for i, c in enumerate(texts) for n, e in vote_exprs(c, f"bits[{i}]").items()}).first().asDict()
        out |= {c: winner(c, row)[0] for c in texts}
    return out
