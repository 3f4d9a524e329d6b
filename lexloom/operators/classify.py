"""Document types by ordered rules, amendment numbers and issue dates, all as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.operators.text import DASH_DATE, MONTH_DATE, SLASH_DATE


@dataclass(frozen=True)
class Rule:
    doc_type: str
    file_types: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()


#: The rules in order, the opening that counts as title, and the numbers' patterns.
RULES = [
    Rule("bid_page", file_types=("html",)),
    Rule("addendum", names=("addendum", "amendment"), titles=(r"addendum\s*(no\.?|number|#)?\s*\d+", r"amendment\s*(no\.?|#)?\s*\d+")),
    Rule("affidavit", names=("affidavit",), titles=("affidavit",)),
    Rule("specs", names=("spec",), titles=("technical specifications?", "product specifications?")),
    Rule("rfp", names=("rfp", "rfq", "ifb", "solicitation"), titles=("request for proposals?", "request for quot", "invitation (for|to) bid", "solicitation")),
]
TITLE_CHARS = 400
NUMBER_PATTERNS = [r"addendum\s*(?:no\.?|number|#)?\s*(\d+)", r"amendment\s*(?:no\.?|number|#)?\s*(\d+)"]
DATE_KEYWORD = r"(?i)\b(?:issued?|dated?|publication|published)\b"
OTHER_DATE = r"(?i)\b(due|deadline|closing|expir\w*|opening)\b"
BEFORE_CHARS, AFTER_CHARS = 15, 40


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def doc_type(file_name: Column, file_type: Column, head: Column, rules: list[Rule] = RULES, default: str = "other") -> Column:
    """The first rule whose file type or name fits; if none does, the first whose title pattern is in the opening."""
    by_file, by_title = [], []
    for rule in rules:
        fits = F.lit(False)
        if rule.file_types:
            fits = fits | F.coalesce(file_type.isin(*rule.file_types), F.lit(False))
        if rule.names:
            fits = fits | F.coalesce(_any(file_name, rule.names), F.lit(False))
        by_file.append(F.when(fits, rule.doc_type))
        if rule.titles:
            by_title.append(F.when(_any(F.substring(head, 1, TITLE_CHARS), rule.titles), rule.doc_type))
    return F.coalesce(*by_file, *by_title, F.lit(default))


def addendum_number(file_name: Column, head: Column, kind: Column) -> Column:
    """The number of an amendment, from its name before its opening; null for other types."""
    found = [F.get(F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1), F.lit(0)).try_cast("int") for text in (file_name, F.substring(head, 1, TITLE_CHARS)) for p in NUMBER_PATTERNS]
    return F.when(kind == "addendum", F.coalesce(*found))


def _first_date(window: Column) -> Column:
    """The date that stands first in a window, unless a word of another kind of date stands before it."""
    either = f"(?i)(?:{MONTH_DATE}|{SLASH_DATE}|{DASH_DATE})"
    found = F.regexp_substr(window, F.lit(either))
    lead = F.get(F.split(window, either, 2), F.lit(0))
    part = lambda p, i: F.regexp_extract(found, f"(?i){p}", i)
    named = F.concat_ws(" ", part(MONTH_DATE, 2), F.initcap(part(MONTH_DATE, 1)), part(MONTH_DATE, 3))
    dashed = F.concat_ws(" ", part(DASH_DATE, 1), F.initcap(part(DASH_DATE, 2)), part(DASH_DATE, 3))
    slashed = part(SLASH_DATE, 1)
    parsed = F.coalesce(F.try_to_date(slashed, "M/d/yyyy"), F.try_to_date(slashed, "d/M/yyyy"), F.try_to_date(named, "d MMM yyyy"), F.try_to_date(dashed, "d MMM yyyy"))
    return F.when(found.isNotNull() & ~lead.rlike(OTHER_DATE), parsed)


def doc_date(text: Column) -> Column:
    """The first date soon after an issue word in its line; a due or closing word before either of them rules it out.

    Where an issue word stands comes from the lengths of the pieces between such words, so no offsets are searched for.
    """

    def of_line(line: Column) -> Column:
        words, pieces = F.regexp_extract_all(line, F.lit(f"({DATE_KEYWORD})"), 1), F.split(line, DATE_KEYWORD, -1)

        def of_word(word: Column, i: Column) -> Column:
            earlier = F.aggregate(F.zip_with(F.slice(pieces, 1, i + 1), F.slice(words, 1, i), lambda p, w: F.length(p) + F.coalesce(F.length(w), F.lit(0))), F.lit(0), lambda a, n: a + n)
            begin = F.greatest(earlier - BEFORE_CHARS, F.lit(0))
            before, after = F.substr(line, begin + 1, earlier - begin), F.substr(line, earlier + F.length(word) + 1, F.lit(AFTER_CHARS))
            return F.when(~before.rlike(OTHER_DATE), _first_date(after))

        return F.transform(words, of_word)

    dates = F.flatten(F.transform(F.filter(F.split(text, r"\R"), lambda x: x.rlike(DATE_KEYWORD)), of_line))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def title(headings: Column) -> Column:
    """A document's title: the first heading over its pages (an array of arrays), or null."""
    return F.get(F.flatten(headings), F.lit(0))


def head(texts: Column) -> Column:
    """A document's opening: its first two pages."""
    return F.array_join(F.slice(texts, 1, 2), "\n")
