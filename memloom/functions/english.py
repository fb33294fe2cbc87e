"""English words by their stems, after the published Porter2 rules, and words that aren't indexed."""

from __future__ import annotations

import re

#: Words without meaning of their own, which full-text search leaves out.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
    did doing a an the and but if or because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

#: Words whose stems follow no rule, and those that are their own stem, before any rule and after plurals.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SINGULAR = frozenset("inning outing canning herring earring proceed exceed succeed".split())

#: Endings and what replaces them, within the first region after a consonant (R1); those marked * need R2.
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
REDUCED = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": "*",
}
DROPPED = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_VOWEL = "[aeiouy]"
_REGION = re.compile(f"{_VOWEL}[^aeiouy]")
_SHORT = re.compile(f"(?:^{_VOWEL}[^aeiouy]|[^aeiouy]{_VOWEL}[^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    fixed = re.match("gener|commun|arsen", word)
    found = fixed or _REGION.search(word)
    first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-cased word of letters and digits."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A y that stands for a consonant is written Y.
    word = re.sub("(?<=[aeiouy])y", "Y", re.sub("^y", "Y", word))
    r1, r2 = _regions(word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(_VOWEL, word[:-2]):
        word = word[:-1]
    if word in SINGULAR:
        return word

    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: len(word) - len(ending)] + "ee"
    elif ending and re.search(_VOWEL, word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            word = word[:-1]
        elif len(word) <= r1 and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and re.search("[^aeiouy][yY]$", word):
        word = word[:-1] + "i"

    ending = _longest(word, DERIVED)
    if ending and len(word) - len(ending) >= r1:
        rest = word[: len(word) - len(ending)]
        if (ending != "li" or rest.endswith(tuple("cdeghkmnrt"))) and (ending != "ogi" or rest.endswith("l")):
            word = rest + DERIVED[ending]
    ending = _longest(word, REDUCED)
    if ending and len(word) - len(ending) >= r1:
        to = REDUCED[ending]
        if to != "*" or len(word) - len(ending) >= r2:
            word = word[: len(word) - len(ending)] + to.replace("*", "")
    ending = _longest(word, DROPPED)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: len(word) - len(ending)]

    if word.endswith("e"):
        if len(word) > r2 or len(word) > r1 and not _SHORT.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")
