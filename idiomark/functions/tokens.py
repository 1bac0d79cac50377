"""Tokens with their place in the sentence, without look-around.

A text is cut into runs of letters and glue characters, each with the gap before
it. A run with a glue character in it came out of an identifier and is no word.
Whether a word begins a sentence follows from its gap alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from idiomark.functions.lexicon import Lexicon, any_of, is_decisive, is_marker
from idiomark.functions.text import GLUE, WS, L

# Fixed value: the characters after which a sentence can begin.
SENTENCE_END = r"""[.!?:;"'»«„“”‹›()\[\]…\-*>•–—]"""
RUN = f"{L}{GLUE}"
#: Position codes: within a sentence, after a line end only, at the start of a sentence.
INSIDE, LINE, START = 0, 1, 2


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{RUN}]+"), F.lit(0))


def gaps(text: Column) -> Column:
    """What stands before each run."""
    return F.regexp_extract_all(text, F.lit(f"([^{RUN}]*)([{RUN}]+)"), F.lit(1))


def words(text: Column) -> Column:
    """Maximal runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{L}]+"), F.lit(0))


def is_word(run: Column) -> Column:
    return ~run.rlike(f"[{GLUE}]")


def word_tokens(text: Column) -> Column:
    """Runs of letters that do not touch a digit, an underscore, a slash or a plus."""
    return F.filter(runs(text), is_word)


def position(gap: Column, index: Column) -> Column:
    """INSIDE, LINE or START, from the gap before a run and the run's index."""
    start = gap.rlike(rf"{SENTENCE_END}[{WS}]*\z") | ((index == 0) & gap.rlike(rf"\A[{WS}]*\z"))
    return F.when(start, START).when(gap.rlike(rf"[\n\r][{WS}]*\z"), LINE).otherwise(INSIDE)


def tokens(text: Column, lex: Lexicon | None = None) -> Column:
    """Array of (w: as written, k: lower case, si: position code) of the words; of a lexicon's markers alone, if it is given."""
    both = F.arrays_zip(runs(text).alias("w"), gaps(text).alias("g"))

    def placed(x, i):
        wanted = is_word(x["w"]) if lex is None else is_marker(F.lower(x["w"]), lex) & is_word(x["w"])
        return F.when(wanted, F.struct(x["w"].alias("w"), F.lower(x["w"]).alias("k"), position(x["g"], i).alias("si")))

    return F.array_compact(F.transform(both, placed))


def capitalised(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))


def needs_no_excuse(t: Column, lex: Lexicon) -> Column:
    """Whether a token is written as its marker is."""
    return ~any_of(t["k"], lex.cased) | (t["w"] == t["k"])


def counts(t: Column, lex: Lexicon) -> Column:
    """START if a token counts, INSIDE if not, LINE if only where the text has other proof."""
    return F.when(needs_no_excuse(t, lex), START).when(t["w"] != capitalised(t["w"]), INSIDE).otherwise(t["si"])


def candidates(text: Column, lex: Lexicon) -> Column:
    """Whether any run can be a marker; most texts stop here.

    The productive ending is looked for in the text at once, not run by run: it is enough that it stands somewhere."""
    low = F.lower(text)
    listed = F.exists(F.regexp_extract_all(low, F.lit(f"[{RUN}]+"), F.lit(0)), lambda k: any_of(k, lex.decisive | lex.compounds | lex.supporting))
    return (low.rlike(lex.suffix) | listed) if lex.suffix else listed


def marked(toks: Column, lex: Lexicon) -> Column:
    return F.filter(toks, lambda t: is_marker(t["k"], lex))


def grounded(marks: Column, lex: Lexicon) -> Column:
    """Whether some marker needs no excuse."""
    return F.exists(marks, lambda t: needs_no_excuse(t, lex))


def accepted(marks: Column, ground: Column, lex: Lexicon) -> Column:
    def ok(t):
        c = counts(t, lex)
        return (c == START) | ((c == LINE) & ground)

    return F.filter(marks, ok)


def certain(marks: Column, lex: Lexicon) -> Column:
    """Whether an accepted marker decides."""
    return F.exists(marks, lambda t: is_decisive(t["k"], lex))


def supporting(marks: Column, lex: Lexicon) -> Column:
    """Distinct accepted supporting markers."""
    return F.array_distinct(F.transform(F.filter(marks, lambda t: any_of(t["k"], lex.supporting)), lambda t: t["k"]))


def enough(found: Column, lex: Lexicon) -> Column:
    """Whether so many supporting markers fire; more are needed where all are weak."""
    need = F.when(F.forall(found, lambda k: any_of(k, lex.weak)), lex.least_weak).otherwise(lex.least_supporting)
    return F.size(found) >= need
