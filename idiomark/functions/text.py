"""Normalisation, the bounded scan window and address stripping, as columns.

Lengths and offsets count code points. Only NFC and NFD need Python; texts whose
code points are all below U+0300 are NFC already and reach it as nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The window's halves, how much raw text is normalised for them, and the wide form of that.
HEAD, TAIL, NARROW, WIDE = 3000, 3000, 2, 8

#: Letters as the tokeniser groups them; letters and what glues identifiers; white space; line ends.
L = r"\p{L}\p{Nl}\p{No}"
GLUE = r"0-9_/+"
WORD = r"\p{L}\p{N}_"
WS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
NL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: White space that is neither a single space between visible characters nor a line feed without spaces around it.
IRREGULAR = rf"[{WS}&&[^ \n]]|  | \n|\n |\A |[ \n]\z"
ADDRESS = r"://|@|-.*\p{Nd}|[\p{L}\p{N}]\.[\p{L}\p{N}]"
#: What composition may change; and all that it can merge into the character before: marks, Hangul and Kirat Rai vowels, and what Java's tables may not know.
COMPOSING, MERGING = r"[^\x00-\x{2FF}]", r"[\p{M}\p{Cn}\x{1100}-\x{11FF}\x{16D40}-\x{16D7F}]"


def _normal(form: str):
    """Unicode normalisation of the texts that are not null."""

    @F.arrow_udf(T.StringType())
    def normal(texts):
        import unicodedata

        import pyarrow as pa

        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return normal


_nfc, _nfd = _normal("NFC"), _normal("NFD")


def nfc(c: Column) -> Column:
    """Composed form; only texts that may need it reach Python."""
    return F.coalesce(_nfc(F.when(c.rlike(COMPOSING), c)), c)


def nfd(c: Column) -> Column:
    return F.coalesce(_nfd(F.when(c.rlike(r"[^\x00-\x{BF}]"), c)), c)


def ends(c: Column, head: int, tail: int) -> Column:
    """First and last characters, a line feed between them; the whole text where it is no longer than both."""
    return F.when(F.length(c) > head + tail, F.concat(F.substring(c, 1, head), F.lit("\n"), F.substring(c, -tail, tail))).otherwise(c)


def unescape(c: Column) -> Column:
    r"""Literal \n, \r and \t, a backslash and a letter, become a space."""
    return F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"\\[nrt]", " ")).otherwise(c)


def elide(c: Column) -> Column:
    """Apostrophes between two word characters go."""
    some = F.contains(c, F.lit("'")) | F.contains(c, F.lit("’"))
    return F.when(some, F.regexp_replace(c, f"(?<=[{WORD}])['’](?=[{WORD}])", "")).otherwise(c)


def cut(c: Column) -> Column:
    """Head and tail without the partial words at the cut."""
    head = F.regexp_replace(F.substring(c, 1, HEAD), rf"(?<![{L}])[{L}]++\z", "")
    tail = F.regexp_replace(F.substring(c, -TAIL, TAIL), rf"\A[{L}]++", "")
    return F.when(F.length(c) > HEAD + TAIL, F.concat(head, F.lit("\n"), tail)).otherwise(c)


def is_address(chunk: Column) -> Column:
    """Whether a run of visible characters is an address: a scheme, an at sign, a digit after the first hyphen, or a dot
    between two letters or digits."""
    return chunk.rlike(ADDRESS)


def strip_addresses(c: Column) -> Column:
    """Blanks every address; runs of white space become one space, line ends one line feed.

    Texts where no line can hold an address take a path without a loop over chunks, and those whose white space is regular
    already are left as they are."""
    lines = F.split(F.regexp_replace(c, rf"(?:{NL})\z", ""), NL, -1)

    def per_line(line):
        chunks = F.filter(F.split(line, f"[{WS}]+", -1), lambda x: x != "")
        return F.array_join(F.transform(chunks, lambda x: F.when(is_address(x), F.lit("")).otherwise(x)), " ")

    slow = F.array_join(F.transform(lines, per_line), "\n")
    one = F.regexp_replace(F.regexp_replace(c, rf"(?:{NL})\z", ""), NL, "\n")
    fast = F.regexp_replace(F.regexp_replace(F.regexp_replace(one, rf"[{WS}&&[^\n]]+", " "), " ?\n ?", "\n"), r"\A +| +\z", "")
    return F.when(c.rlike(ADDRESS), slow).when(c.rlike(IRREGULAR), fast).otherwise(c)


def bounded(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds the composed text that the window is cut from, without escapes, elisions and partial words.

    Composition shrinks a text to a third at most, so a second, wider cut is taken
    only where the narrow one came back shorter than the window. It is made where the
    narrow one, without all that can merge, is that short, so that other rows hold no
    second cut and both are composed in one step. Each step is a column of its own, so
    that none is computed twice."""
    size, n = HEAD + TAIL, lambda x: f"_{out}_{x}"
    narrow, wide = F.col(n("narrow")), F.col(n("wide"))
    d = df.withColumn(n("narrow"), ends(text, NARROW * HEAD, NARROW * TAIL))
    short = narrow.rlike(COMPOSING) & (F.length(F.regexp_replace(narrow, MERGING, "")) < size)
    d = d.withColumn(n("wide"), F.when(short & (F.length(narrow) > NARROW * size), ends(text, WIDE * HEAD, WIDE * TAIL)))
    d = d.withColumns({n("narrow"): nfc(narrow), n("wide"): nfc(wide)})
    d = d.withColumn(out, F.coalesce(F.when(F.length(narrow) < size, wide), narrow)).drop(n("narrow"), n("wide"))
    d = d.withColumn(out, elide(unescape(F.col(out))))
    return d.withColumn(out, cut(F.col(out)))


def windowed(df: DataFrame, text: Column, out: str = "window") -> DataFrame:
    """Adds the part of a text that is looked at: composed, without escapes, elisions, partial words and addresses."""
    d = bounded(df, text, out)
    return d.withColumn(out, strip_addresses(F.col(out)))


def session_key(c: Column) -> Column:
    """Session ids as state keys: 128 characters at most, others than ASCII letters, digits, _ and - replaced."""
    return F.when(F.length(c) > 0, F.regexp_replace(F.substring(c, 1, 128), "[^A-Za-z0-9_-]", "_"))


def is_rulebook(body: Column) -> Column:
    """Not blank, and less than one replacement character in twenty."""
    bad = F.length(body) - F.length(F.replace(body, F.lit("�"), F.lit("")))
    return F.coalesce((F.regexp_replace(body, f"[{WS}]+", "") != "") & (bad * 20 < F.length(body)), F.lit(False))


def slug(title: Column, default: str = "artikel") -> Column:
    """A file name: runs of other characters than word characters and hyphens become _, edges are stripped."""
    s = F.regexp_replace(F.regexp_replace(title, rf"[^{WORD}\-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)
