"""Times as people and registries write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first letters of the months, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLOCK = r"(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?)?)"
_ZONE = r"(?: ?(Z|z|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|(?:UTC|GMT)?[+-]\d{1,2}|UTC|GMT|UT))?(?: ?\([A-Za-z ]*\))?"
_DAY = r"(?:[A-Za-z]{3,9}\.?,? )?"
#: Each form and, as they are numbered in it: day order, year, month, day, hour, minute, second, fraction, half of the day, zone.
FORMS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:[Tt]| |, ){_CLOCK})?{_ZONE}$", "|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DAY}(\d{{1,2}})(?:st|nd|rd|th)?[ -]([A-Za-z]{{3,9}})\.?,?[ -](\d{{4}})(?:(?: |, ){_CLOCK})?{_ZONE}$", "|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^{_DAY}([A-Za-z]{{3,9}})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:(?: |, | at ){_CLOCK})?{_ZONE}$", "|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Za-z]{{3,9}}\.?,? )([A-Za-z]{{3,9}}) (\d{{1,2}}) {_CLOCK}{_ZONE} (\d{{4}})$", "|$9|$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:(?: |, ){_CLOCK})?{_ZONE}$", "either|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{4})(\d{2})(\d{2})(?:[Tt ]?(\d{2})(\d{2})(\d{2})?)?(Z|z|[+-]\d{2}:?\d{2})?$", "|$1|$2|$3|$4|$5|$6|||$7"),
)


def parsed_time(text: Column) -> Column:
    """The time that a text tells, null if it has none of ``FORMS`` or no such day.

    ISO dates with and without clock, fraction and zone; days and months by
    name in either order, as in mail headers and scripts; numbers between
    slashes. A time without a zone is taken as UTC; of two numbers before a
    year the first is the month unless it is over 12; GMT+02 is two hours east.
    Parts of a microsecond are cut off.
    """
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    joined = F.coalesce(*(F.when(plain.rlike(form), F.regexp_replace(plain, form, order)) for form, order in FORMS))
    two = lambda c: F.lpad(c, 2, "0")
    filled = lambda c: F.when(c == "", "00").otherwise(two(c))

    def made(p: Column) -> Column:
        either, year, a, b, hour, minute, second, fraction, half, zone = (F.get(p, F.lit(i)) for i in range(10))
        swap = (either != "") & (F.length(a) == 2) & (a > "12")
        month, day = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(month, 1, 3)))
        month = F.when(month.rlike(r"^\d+$"), two(month)).when(named > 0, two(named.cast("string")))
        late = (F.lower(half) == "p") & (two(hour) < "12")
        hour = F.when((F.lower(half) == "a") & (two(hour) == "12"), "00").when(late, (hour.try_cast("int") + 12).cast("string")).otherwise(filled(hour))
        zone = F.regexp_replace(F.upper(zone), "^(UTC|GMT|UT)(?=[+-])", "")
        away = F.concat(F.substring(zone, 1, 1), two(F.regexp_extract(zone, r"^[+-](\d{1,2})", 1)), F.lit(":"), filled(F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1)))
        zone = F.when(zone.isin("", "Z", "UTC", "GMT", "UT"), "+00:00").otherwise(away)
        parts = [year, F.lit("-"), month, F.lit("-"), two(day), F.lit(" "), hour, F.lit(":"), filled(minute), F.lit(":"), filled(second), F.lit("."), F.substring(F.rpad(fraction, 6, "0"), 1, 6), zone]
        return F.concat(*parts)

    # each step is named by a lambda, so that it is written once in the plan
    found = F.transform(F.transform(F.array(joined), lambda j: F.split(j, r"\|")), made)
    return F.try_to_timestamp(F.get(found, F.lit(0)))
