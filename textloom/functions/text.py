"""Tokens, Russian stems, snippets and clean-up of text, as native expressions.

The patterns are plain texts that Java, Python and RE2 read alike, so the driver normalises query terms
by the same patterns that the executors apply to documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the tokenizer: the letters of a token and its least length.
TOKEN = "[A-Za-z0-9А-Яа-яЁё]{3,}"

#: Fixed values of the stemmer: vowels and the endings of each class.
VOWELS = "аеиоуыэюя"
GERUND_AFTER_A = "в вши вшись"
GERUND = "ив ивши ившись ыв ывши ывшись"
REFLEXIVE = "ся сь"
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE_AFTER_A = "ем нн вш ющ щ"
PARTICIPLE = "ивш ывш ующ"
VERB_AFTER_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
NOUN = "иями ями ами ией ее ев ов ие ье е еи ии и ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я а"
SUPERLATIVE = "ейш ейше"
DERIVATIONAL = "ост ость"

_NOT = f"[^{VOWELS}]"
_ANY = f"[{VOWELS}]"
#: What precedes an ending that lies behind the first vowel, or in the second region.
_IN_RV = f"{_NOT}*{_ANY}.*?"
_IN_R2 = f"{_NOT}*{_ANY}+{_NOT}+{_ANY}+{_NOT}.*?"


def _ending(endings: str, before: str = _IN_RV, after_a: bool = False) -> str:
    """A pattern that takes the longest of the endings off: the lazy start leaves it the most."""
    return f"^({before}{'[ая]' if after_a else ''})(?:{'|'.join(endings.split())})$"


STEPS = {
    "gerund_after_a": _ending(GERUND_AFTER_A, after_a=True),
    "gerund": _ending(GERUND),
    "reflexive": _ending(REFLEXIVE),
    "adjective": _ending(ADJECTIVE),
    "participle": _ending(PARTICIPLE),
    "participle_after_a": _ending(PARTICIPLE_AFTER_A, after_a=True),
    "verb_after_a": _ending(VERB_AFTER_A, after_a=True),
    "verb": _ending(VERB),
    "noun": _ending(NOUN),
    "final_i": _ending("и"),
    "derivational": _ending(DERIVATIONAL, _IN_R2),
    "double_n": f"^({_IN_RV}н)н$",  # both lie behind the first vowel
    "superlative": _ending(SUPERLATIVE),
    "soft": _ending("ь"),
}


def raw_tokens(text: Column) -> Column:
    """The tokens of a text as they stand; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def folded(token: Column) -> Column:
    """A token in lower case, ё as е. On exploded rows this is generated code, on arrays it is not."""
    return F.translate(F.lower(token), "ё", "е")


def tokens(text: Column) -> Column:
    """The folded tokens of a text."""
    return F.transform(raw_tokens(text), folded)


def tokens_of(text: str) -> list[str]:
    """tokens() on the driver."""
    return [t.lower().replace("ё", "е") for t in re.findall(TOKEN, text)]


def stem_of(word: str) -> str:
    """stem() for one word on the driver."""
    if not word or word[0] < "\x80":
        return word

    def cut(step: str, w: str) -> str:
        return re.sub(STEPS[step], r"\1", w, count=1)

    def first(w: str, *steps: str) -> str:
        return next((c for s in steps if (c := cut(s, w)) != w), w)

    out = first(word, "gerund_after_a", "gerund")
    if out == word:
        bare = cut("reflexive", word)
        out = cut("adjective", bare)
        out = first(out, "participle", "participle_after_a") if out != bare else first(bare, "verb_after_a", "verb", "noun")
    out = cut("derivational", cut("final_i", out))
    single = cut("double_n", out)
    if single != out:
        return single
    plain = cut("superlative", out)
    return cut("double_n", plain) if plain != out else cut("soft", out)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def stem(token: Column) -> Column:
    """The stem of a token; tokens that begin with an ASCII character are their own, and cost one comparison."""

    def cut(step: str, w: Column) -> Column:
        return F.regexp_replace(w, STEPS[step], "$1")

    def first(w: Column, steps: tuple[str, ...], otherwise: Column) -> Column:
        """w after the first step that changes it."""
        if not steps:
            return otherwise
        return _bound(cut(steps[0], w), lambda c: F.when(c != w, c).otherwise(first(w, steps[1:], otherwise)))

    def ending(w: Column) -> Column:
        return _bound(
            cut("reflexive", w),
            lambda bare: _bound(
                cut("adjective", bare),
                lambda adjective: F.when(adjective != bare, first(adjective, ("participle", "participle_after_a"), adjective)).otherwise(
                    first(bare, ("verb_after_a", "verb", "noun"), bare)
                ),
            ),
        )

    def tidied(w: Column) -> Column:
        plain = _bound(cut("superlative", w), lambda c: F.when(c != w, cut("double_n", c)).otherwise(cut("soft", w)))
        return _bound(cut("double_n", w), lambda c: F.when(c != w, c).otherwise(plain))

    def whole(w: Column) -> Column:
        return _bound(cut("derivational", cut("final_i", first(w, ("gerund_after_a", "gerund"), ending(w)))), tidied)

    return F.when(token < "\x80", token).otherwise(_bound(token, whole))


def snippet(text: Column, n: int = 100) -> Column:
    """The first n characters, and dots if there are more; null gives an empty one."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) > n, F.concat(F.substring(whole, 1, n), F.lit("..."))).otherwise(whole)


#: White space as Python's \s has it, which differs from Java's, and control characters.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
CONTROL = r"[\x00-\x1f\x7f]+"


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalised(text: Column) -> Column:
    """As squeezed(), control characters counting as white space; null gives an empty text."""
    return squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, " "))


def without_footnotes(text: Column) -> Column:
    """Without numbers in square brackets."""
    return squeezed(F.regexp_replace(text, r"\[[\s\p{Z}]*\p{Nd}+[\s\p{Z}]*\]", " "))


def decoded(data: Column) -> Column:
    """Bytes as text, what is not UTF-8 as U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def preview(data: Column, n: int = 32) -> Column:
    """Bytes as text if they are UTF-8 without control characters below U+0009, else the first n in hex and their number."""
    text = data.cast("string")
    readable = F.is_valid_utf8(text) & ~F.coalesce(text.rlike(r"[\x00-\x08]"), F.lit(False))
    raw = F.concat(F.lit("0x"), F.lower(F.hex(F.substring(data, 1, n))), F.when(F.octet_length(data) > n, F.lit("...")).otherwise(F.lit("")), F.lit(" ("), F.octet_length(data).cast("string"), F.lit(" bytes)"))
    return F.when(readable, text).otherwise(raw)


def content_hash(data: Column) -> Column:
    """Lower-case hex SHA-256 of bytes or text."""
    return F.sha2(data.cast("binary"), 256)
