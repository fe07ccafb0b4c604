"""Numbers in texts: thousands groups, English words for digits, and digits for English words.

Digits are 0 to 9. Null texts give nulls. Whole numbers of more than 18 digits are not spelt: they give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English names of numbers.
SMALL = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
#: Numbers joined by commas, those of them that are thousands groups, and plain numbers.
COMMAS = r"(?<![\d.])\d+(?:,[ \t]*\d+)+(?:\.\d+)?"
THOUSANDS = r"\d{1,3}(?:,[ \t]*\d{3})+(?:\.\d+)?"
NUMBER = r"\d+(?:\.\d+)?"
#: Years that are read as two halves, and the ending that adds a half.
YEARS, HALF = (1900, 2099), " and a half"
#: The most digits of a whole number that is spelt.
DIGITS = 18


def plain_groups(text: Column) -> Column:
    """``text`` without the commas of thousands groups; a run of numbers that isn't one group stays as it is."""
    runs = F.regexp_extract_all(text, F.lit(COMMAS), 0)
    plain = F.transform(runs, lambda r: F.when(r.rlike(f"^(?:{THOUSANDS})$"), F.regexp_replace(r, r"[, \t]", "")).otherwise(r))
    return F.array_join(F.zip_with(F.split(text, COMMAS, -1), plain, lambda between, run: F.concat(between, F.coalesce(run, F.lit("")))), "")


def numbers(text: Column) -> Column:
    """The numbers of a text in order, without thousands groups, leading zeros and zeros at the end of a fraction."""
    found = F.regexp_extract_all(plain_groups(text), F.lit(NUMBER), 0)
    bare = lambda n: F.regexp_replace(F.regexp_replace(n, r"^0+(?=\d)", ""), r"\.0+$|(\.\d*[1-9])0+$", "$1")
    return F.transform(found, bare)


def named(names: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)


def hundreds(n: int) -> str:
    """Words of a number from 0 to 999; none for 0."""
    rest = n % 100
    tens = [TENS[rest // 10], *SMALL[rest % 10 : rest % 10 + 1] * (rest % 10 > 0)] if rest >= 20 else [SMALL[rest]] * (rest > 0)
    return " ".join([f"{SMALL[n // 100]} hundred"] * (n >= 100) + tens)


#: The words of 0 to 999, so that a group of three digits is looked up and not put together for each row.
BELOW_THOUSAND = tuple(map(hundreds, range(1000)))


def below_thousand(n: Column) -> Column:
    """Words of a number from 0 to 999; none for 0."""
    return F.element_at(F.split(F.lit("|".join(BELOW_THOUSAND)), r"\|"), n.cast("int") + 1)


def spelled(digits: Column) -> Column:
    """A string of digits in English words: thousands and millions, and all above as so many billions.

    Groups of three digits are elements of an array, so that the words of a group are one expression, whatever its place.
    """
    padded = F.lpad(digits, DIGITS, "0")
    billions = F.substring(padded, 1, 9) != "0" * 9
    groups = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(padded, 3 * i + 1, F.lit(3)).cast("int"))
    scale = lambda n, i: F.when((n > 0) & (i % 3 == 0), "million").when((n > 0) & (i % 3 == 1), "thousand").when((i == 2) & billions, "billion")
    words = F.transform(groups, lambda n, i: F.concat_ws(" ", F.nullif(below_thousand(n), F.lit("")), scale(n, i)))
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.when(F.length(bare) <= DIGITS, F.when(bare == "0", F.lit(SMALL[0])).otherwise(F.array_join(F.filter(words, lambda w: w != ""), " ")))


def number_words(value: Column, years: bool = True) -> Column:
    """English words of a number as it is written, commas left out; null if it isn't a number.

    Fractions are read digit by digit. With ``years``, four digits from 1900 to 2099 are read as a year.
    """
    def read(compact: Column) -> Column:
        whole, fraction = F.split_part(compact, F.lit("."), F.lit(1)), F.split_part(compact, F.lit("."), F.lit(2))
        first, second = F.substring(compact, 1, 2), F.substring(compact, 3, 2)
        year = compact.rlike(r"^\d{4}$") & compact.between(*map(str, YEARS)) & F.lit(years)
        hundred, thousand = year & (second == "00"), year & (second != "00") & compact.startswith("200")
        parts = F.when(hundred, F.array(first)).when(thousand, F.array(second)).when(year, F.array(first, second)).otherwise(F.array(whole))
        words = F.array_join(F.transform(parts, spelled), " ", "\0")
        digit_words = F.array_join(F.transform(F.filter(F.split(fraction, ""), lambda d: d != ""), lambda d: named(SMALL, d)), " ")

        def told(words: Column) -> Column:
            whole_or_year = F.when(hundred, F.concat(words, F.lit(" hundred"))).when(thousand, F.concat(F.lit("two thousand "), words))
            said = whole_or_year.when(fraction != "", F.concat(words, F.lit(" point "), digit_words)).otherwise(words)
            return F.when(~words.contains("\0"), said)

        return F.transform(F.array(F.when(compact.rlike(rf"^{NUMBER}$"), words)), told)[0]  # bound once: a lambda's expressions are evaluated wherever they are named

    return F.transform(F.array(F.replace(value, F.lit(","), F.lit(""))), read)[0]


def small_number(text: Column) -> Column:
    """The number that a text is: digits, or English words from one to twenty, with or without a half; else null."""
    bare = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    base = F.regexp_replace(bare, f"{HALF}$", "")
    names = (*SMALL[1:], TENS[2])
    at = F.array_position(F.array(*map(F.lit, names)), base)
    return F.coalesce(bare.try_cast("double"), F.when(at > 0, at + F.when(bare.endswith(HALF), 0.5).otherwise(0.0)))
