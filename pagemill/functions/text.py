"""Text rules as Column builders: white space, normal form, tokens, lines and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space (as str.strip does), in Java's pattern syntax.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Where a line ends (as str.splitlines does).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Words that carry no search meaning.
STOP_WORDS = (
    "a an and are as at be by can could do does for from how i in is it me my of on or please tell that the this to was what when "
    "where which who why will with would you your"
).split()
TOKEN = "[a-z0-9]{2,}"
URL_LINE = r"(?i)^(?:https?://|www\.)\S+$"
URL_TAIL = r"[.,;:)\]}]+\z"
CITATION = r"\[S(\d+)\]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def is_blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def normalize(text: Column) -> Column:
    """One kind of line break, single blanks, at most one empty line; null is empty."""
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for pattern, by in (("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more ASCII letters and digits that aren't stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_END)


def is_url_line(line: Column) -> Column:
    """A line that is one address, closing punctuation aside."""
    return F.regexp_replace(line, URL_TAIL, "").rlike(URL_LINE)


def letters_and_marks(text: Column) -> tuple[Column, Column]:
    """(letters, characters that aren't white space) of the normal form."""
    normal = normalize(text)
    return F.length(F.regexp_replace(normal, r"[^\p{L}]", "")), F.length(F.regexp_replace(normal, SPACE, ""))


def printed_is_usable(text: Column, least: int = 20) -> Column:
    letters, marks = letters_and_marks(text)
    return (F.length(normalize(text)) >= least) & (letters * 2 >= marks)


def clean_line(text: Column) -> Column:
    """A recognised line without leading number signs."""
    return strip(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), f"^(?:#{SPACE}*)+", ""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for names without one or that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def document_key(name: Column) -> Column:
    return F.lower(strip(F.coalesce(name, F.lit(""))))


def labels(text: Column) -> Column:
    """Distinct citation numbers, ascending."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))
