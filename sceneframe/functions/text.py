"""Column functions over words, sentences and paragraphs.

All of these work inside one row, so a corpus is cut without moving it: no explode, no
shuffle. Sentence marks are put in as newlines after whitespace has been collapsed, when no
newline can be left in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneframe.constants import ABBREVIATIONS, CLAUSE_OPENERS, DANGLING_WORDS

# Unicode white space, as the inside of a Java character class.
SPACES = r"\s\x0B\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LETTER_OR_DIGIT = r"\p{IsAlphabetic}\p{N}"
CLOSERS = r"""["')\]»”’*_]"""
SENTENCE_ENDERS = "[.!?…।॥。！？]"

_ABBREVIATION = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
_NOT_AN_END = (
    rf"(?![^ {LETTER_OR_DIGIT}]*(?i:{_ABBREVIATION})\.{CLOSERS}*(?: |$))"
    rf"(?![^ {LETTER_OR_DIGIT}]*\p{{Lu}}\.{CLOSERS}*(?: |$))"
)
# At the start of a word: the whole word when it ends a sentence.
_ENDING_WORD = rf"(?<![^ ]){_NOT_AN_END}([^ ]*{SENTENCE_ENDERS}{CLOSERS}*)"


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at either end."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def clean_cell(cell: Column) -> Column:
    """White space off both ends; a blank cell is null."""
    bare = F.regexp_replace(cell, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(bare != "", bare)


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACES}]")


def paragraphs(text: Column) -> Column:
    """Collapsed runs of lines between blank lines; marks with no letter or digit go."""
    runs = F.split(text, rf"\n[{SPACES}]*\n")
    return F.filter(F.transform(runs, collapse), lambda p: p.rlike(f"[{LETTER_OR_DIGIT}]"))


def mark_sentences(collapsed: Column) -> Column:
    """A newline in place of the space after every word that ends a sentence."""
    return F.regexp_replace(collapsed, _ENDING_WORD + " ", "$1\n")


def sentences(collapsed: Column) -> Column:
    return F.split(mark_sentences(collapsed), "\n")


def ends_plainly(word: Column) -> Column:
    """A word that ends in a small Latin letter ends no sentence, clause or quotation.

    Most words do; a comparison tells it, where the expressions below search the word.
    """
    return F.substring(word, -1, 1).between("a", "z")


def ends_sentence(word: Column) -> Column:
    return word.rlike(f"^{_NOT_AN_END}[^ ]*{SENTENCE_ENDERS}{CLOSERS}*$")


def ends_clause(word: Column) -> Column:
    return word.rlike(rf"[,;:—–]{CLOSERS}*$|^-{CLOSERS}*$|--{CLOSERS}*$")


def ends_with_comma(word: Column) -> Column:
    return word.rlike(f",{CLOSERS}*$")


def opens_clause(word: Column) -> Column:
    first = F.lower(F.substring(word, 1, 1))
    bare = F.when(first.between("a", "z"), word).otherwise(F.regexp_replace(word, f"^[^{LETTER_OR_DIGIT}]+", ""))
    return F.lower(bare).isin(CLAUSE_OPENERS)


def dangles(word: Column) -> Column:
    return F.lower(word).isin(DANGLING_WORDS)


def opens_quote(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(*'"“«‘')


def closes_quote(word: Column) -> Column:
    return F.substring(word, -1, 1).isin(*'"”»’')
