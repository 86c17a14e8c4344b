"""Normalisation and text predicates: column expressions, with Arrow-batched Python where Spark has no function."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .grams import bound

#: The punctuation that is deleted.
PUNCTUATION = "[‘’“”'\"!?;/⧸⁄‹›«»`ʿ,.\\-]"
#: Latin letters without a decomposition, Greek and Cyrillic, as ASCII.
LETTERS = dict(
    zip("ßæœøłđðþħıŋ", ("ss", "ae", "oe", "o", "l", "d", "d", "th", "h", "i", "ng"), strict=True)
) | dict(
    zip("αβγδεζηθικλμνξοπρσςτυφχψω", ("a", "b", "g", "d", "e", "z", "e", "th", "i", "k", "l", "m", "n", "x", "o", "p", "r", "s", "s", "t", "u", "ph", "kh", "ps", "o"), strict=True)
) | dict(
    zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґ", ("a", "b", "v", "g", "d", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "iu", "ia", "i", "i", "ie", "g"), strict=True)
)


class _Unmarked(dict):
    """Code points of marks as nothing, others as they are, found when first met."""

    def __missing__(self, code: int) -> int | None:
        found = self[code] = None if unicodedata.category(chr(code)) == "Mn" else code
        return found


_unmarked = _Unmarked()


def without_accents(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFD", s).translate(_unmarked)


#: Hangul initials, vowels and finals, in the order of their code points.
INITIALS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
VOWELS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
FINALS = ("g", "kk", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng", "j", "ch", "k", "t", "p", "h")
#: Alphabets whose letters sound as their names begin, and the sounds of two letters that names begin with.
NAMED = ("HEBREW", "ARABIC", "SYRIAC", "ARMENIAN", "GEORGIAN", "COPTIC", "GOTHIC", "THAANA")
SOUNDS = ("SH", "CH", "TS", "TH", "DH", "KH", "GH", "ZH", "JH", "PH")


def _by_name(c: str) -> str:
    """Letters of other scripts by their Unicode names: syllables are their names, letters of alphabets the first sound of theirs."""
    words = unicodedata.name(c, "").split(" ")
    if words[0] == "KATAKANA-HIRAGANA" or "LETTER" not in words or len(words) < 3:
        return c
    script, name = words[0], words[-1]
    if script in ("HIRAGANA", "KATAKANA"):
        return "n" if name == "N" else name.lower()
    if script in NAMED:
        own = next((w for w in words[words.index("LETTER") + 1 :] if w != "FINAL"), "")
        return next((x for x in SOUNDS if own.startswith(x)), own[:1]).lower()
    return name.lower() if name.isalpha() and script in ("DEVANAGARI", "BENGALI", "GUJARATI", "GURMUKHI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM") else c


def _romanised(c: str) -> str:
    """A character in ASCII letters and digits, so far as rules give them; else itself."""
    if c in LETTERS or c.isascii():
        return LETTERS.get(c, c)
    if unicodedata.category(c) == "Mn":
        return ""
    if (found := _by_name(c)) != c:
        return found
    for first, sounds in ((0x1100, INITIALS), (0x1161, VOWELS), (0x11A8, FINALS)):
        if 0 <= ord(c) - first < len(sounds):
            return sounds[ord(c) - first]
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    parts = unicodedata.normalize("NFD", c)
    return c if parts == c else "".join(map(_romanised, parts))


class _Letters(dict):
    """What stands for a code point, found when first met."""

    def __missing__(self, code: int) -> str:
        found = self[code] = _romanised(chr(code))
        return found


_letters = _Letters()


def transliterated(s: str) -> str:
    s = s.lower()
    return s if s.isascii() else unicodedata.normalize("NFC", s).translate(_letters)


# Texts may be long: rows go to Python a hundred at a time, where an Arrow batch would hold thousands of whole texts.
@F.udf(StringType(), useArrow=False)
def strip_accents(s: str | None) -> str | None:
    return s if s is None else without_accents(s)


@F.udf(StringType(), useArrow=False)
def _transliterate(s: str | None) -> str | None:
    return s if s is None else transliterated(s)


_punctuation = re.compile(PUNCTUATION)


def made_canonical(s: str) -> str:
    """canonical of one string."""
    return _punctuation.sub("", transliterated(s))


def canonical(s: Column) -> Column:
    """Lower case, ASCII letters, punctuation deleted (not replaced by spaces)."""
    return F.regexp_replace(_transliterate(s), PUNCTUATION, "")


def split_spaces(s: Column) -> Column:
    """Tokens between single spaces; empty ones stay."""
    return F.split(s, " ", -1)


def tokens(s: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(s, "(?U)\\s+"), lambda t: t != "")


def natural_key(t: Column) -> Column:
    """An array that compares as t does in natural order: runs of digits, of any length, as numbers and before all else."""

    def part(run: Column) -> Column:
        number = run.rlike("^[0-9]")
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.struct((~number).alias("text"), F.when(number, F.length(digits)).otherwise(0).alias("digits"), F.when(number, digits).otherwise(run).alias("run"))

    return F.transform(F.regexp_extract_all(t, F.lit("[0-9]+|[^0-9]+"), 0), part)


#: What a token must hold to be sorted by a form of its own: digits, or characters that such forms are made of.
_FORMED = "[0-9\\x00-\\x02]"


def _sortable(t: Column) -> Column:
    """A string that compares as natural_key(t) and then t do, and ends in t behind the first U+0000: runs of digits are U+0001,
    their length and themselves; U+0000 to U+0002 in text are U+0002 and a letter. Other tokens compare so as they are."""

    def part(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        escaped = F.replace(F.replace(F.replace(run, F.lit("\x02"), F.lit("\x02c")), F.lit("\x01"), F.lit("\x02b")), F.lit("\x00"), F.lit("\x02a"))
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit("\x01"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(escaped)

    formed = F.concat(F.array_join(F.transform(F.regexp_extract_all(t, F.lit("[0-9]+|[^0-9]+"), 0), part), ""), F.lit("\x00"), t)
    return F.when(t.rlike(_FORMED), formed).otherwise(t)


def natural_sorted(ts: Column) -> Column:
    """Tokens by natural_key, then as they are: one sort of strings, of the tokens themselves where none has a digit."""
    shown = lambda x: F.when(F.contains(x, F.lit("\x00")), F.substring(x, F.instr(x, "\x00") + 1, F.length(x))).otherwise(x)
    formed = lambda ts: F.transform(F.sort_array(F.transform(ts, _sortable)), shown)
    return bound(lambda v: F.when(F.array_join(v["ts"], " ").rlike(_FORMED), formed(v["ts"])).otherwise(F.sort_array(v["ts"])), ts=ts)


_runs = re.compile("[0-9]+|[^0-9]+")


@lru_cache(100_000)
def _order(t: str) -> tuple:
    """natural_key of one token, and the token."""
    return [(False, len(d := run.lstrip("0") or "0"), d) if "0" <= run[0] <= "9" else (True, 0, run) for run in _runs.findall(t)], t


def naturally_sorted(s: str) -> str:
    """sorted_text of one string."""
    return " ".join(sorted(s.split(" "), key=_order))


def sorted_text(s: Column) -> Column:
    return F.array_join(natural_sorted(split_spaces(s)), " ")


def wordpunct_words(s: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased alphabetic tokens that are no stop-words."""
    words = F.transform(F.filter(F.regexp_extract_all(s, F.lit("(?U)\\w+|[^\\w\\s]+"), 0), lambda t: t.rlike("^\\p{L}+$")), F.lower)
    return F.filter(words, lambda t: ~t.isin(stop_words)) if stop_words else words


def stopped_words(s: Column, stop_words: list[str], sort: bool = False) -> Column:
    """The words that wordpunct_words leaves out: the second half of a normalised string."""
    words = F.filter(wordpunct_words(s), lambda t: t.isin(stop_words))
    return natural_sorted(words) if sort else words


def language(s: Column, stop_words: dict[str, list[str]] | None = None, default: str = "english") -> Column:
    """The language whose stop-words occur most often in s, ties to the first by name; the default without lists or without any."""
    if not stop_words:
        return F.lit(default)
    words = wordpunct_words(s)

    def vote(name: str, own: list[str]) -> Column:
        return F.struct((-F.size(F.filter(words, lambda t: t.isin(own)))).alias("n"), F.lit(name).alias("name"))

    votes = F.array(*(vote(name, own) for name, own in stop_words.items()))
    first = F.array_min(votes)
    return F.when(first["n"] < 0, first["name"]).otherwise(F.lit(default))


def normalized(s: Column, stop_words: dict[str, list[str]] | list[str] | None = None, sort: bool = False, default: str = "english") -> Column:
    """kept and stopped words of s. stop_words by language are those of the language that s is in, as its stop-words tell."""
    if not isinstance(stop_words, dict):
        own = list(stop_words or ())
        kept, stopped = wordpunct_words(s, own), stopped_words(s, own) if own else F.array().cast("array<string>")
    else:
        lists = F.create_map(*(x for name, ws in stop_words.items() for x in (F.lit(name), F.array(*map(F.lit, ws)).cast("array<string>")))) if stop_words else F.create_map().cast("map<string, array<string>>")
        own = F.coalesce(F.try_element_at(lists, language(s, stop_words, default)), F.array().cast("array<string>"))
        parts = lambda v: F.struct(F.filter(v["words"], lambda t: ~F.array_contains(v["own"], t)).alias("kept"), F.filter(v["words"], lambda t: F.array_contains(v["own"], t)).alias("stopped"))
        both = bound(parts, words=wordpunct_words(s), own=own)
        kept, stopped = both["kept"], both["stopped"]
    shape = natural_sorted if sort else (lambda ws: ws)
    return F.struct(shape(kept).alias("kept"), shape(stopped).alias("stopped"))


def distinct_in_order(ts: Column) -> Column:
    """The distinct tokens, each where it stood first."""
    return F.array_distinct(ts)


def stem(s: Column) -> Column:
    """Stemming is accepted and changes nothing."""
    return s


def in_alphabet(s: Column, script: str, only: bool = True) -> Column:
    """Whether all letters, or any, are of a script (as Java names it: Latin, Cyrillic, ...)."""
    return s.rlike(f"^[\\p{{Is{script}}}\\P{{L}}]*$") if only else s.rlike(f"\\p{{Is{script}}}")


SCRIPTS = ("Cyrillic", "Latin", "Greek", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Devanagari", "Armenian", "Georgian")


def detect_alphabet(s: Column) -> Column:
    """The first script of SCRIPTS with a letter in s, else UND."""
    return F.coalesce(*(F.when(s.rlike(f"\\p{{Is{x}}}"), x.upper()) for x in SCRIPTS), F.lit("UND"))


def contains_tokens(a: Column, b: Column) -> Column:
    return F.forall(tokens(a), lambda t: F.contains(b, t))


def balanced_brackets(s: Column) -> Column:
    """Whether round, square and curly brackets close in order: one pass, with the brackets that are open on a stack."""
    kept = F.regexp_extract_all(s, F.lit("[(){}\\[\\]]"), 0)
    closes = lambda top, c: ((top == "(") & (c == ")")) | ((top == "[") & (c == "]")) | ((top == "{") & (c == "}"))
    # A bracket that closes nothing stays on the stack for good.
    step = lambda stack, c: F.when(closes(F.substring(stack, 1, 1), c), F.substring(stack, 2, 2**30)).otherwise(F.concat(c, stack))
    return F.aggregate(kept, F.lit(""), step) == ""


def abbreviation(s: Column) -> Column:
    found = F.regexp_extract(s, r"\b[A-Z]([A-Z\.]{1,}|[sr\.]{1,2})\b", 0)
    return F.when(found == "", "-").otherwise(found)


def has_parenthesis(s: Column) -> Column:
    return s.rlike("[{\\[(]")


def has_dashed_words(s: Column) -> Column:
    return s.rlike("(?U)\\w+(?:-\\w+)+")


def n_tokens(s: Column) -> Column:
    return F.size(F.array_distinct(tokens(s)))


def has_frequent(s: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(tokens(s), F.array(*map(F.lit, terms))) if terms else F.lit(False)


def frequent_flags(s: Column, terms: list[str], n: int = 20) -> Column:
    """Which of the first n terms s has as tokens; missing terms count as absent."""
    ts = tokens(s)
    return F.array(*(F.array_contains(ts, t) if t is not None else F.lit(False) for t in [*terms[:n], *[None] * (n - len(terms[:n]))]))


def token_ngrams(ts: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(ts) >= n, F.transform(F.sequence(F.lit(1), F.size(ts) - (n - 1)), lambda i: F.array_join(F.slice(ts, i, n), " "))).otherwise(none)


def thirds(s: Column) -> Column:
    """First, middle and last third of s."""
    k = F.bround(F.length(s) / 3).cast("int")
    return F.array(F.substring(s, F.lit(1), k), F.substring(s, k + 1, k), F.substring(s, 2 * k + 1, F.length(s)))
