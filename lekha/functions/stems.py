"""Stems of English words by Porter's published algorithm, with the usual extensions."""

from __future__ import annotations

#: Irregular words and their stems.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
#: Endings of the second, third and fourth step, and what they become.
SECOND = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """Consonants as c, vowels as v; a y after a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How many times a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y; or is a vowel and a
    consonant."""
    s = _shape(word)
    return s[-3:] == "cvc" and word[-1] not in "wxy" or s == "vc"


def _first(w: str) -> str:
    """Plurals, past tenses and y."""
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _double(cut):
            w = cut if cut[-1] in "lsz" else cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    return w


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]):
        return _second(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) else w
    for end, new in SECOND:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) else w
    return w


def _fourth(w: str) -> str:
    for end in FOURTH:
        if w.endswith(end):
            base = w[: -len(end)]
            return base if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")) else w
    return w


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _second(_first(word))
    for end, new in THIRD:
        if w.endswith(end):
            w = w[: -len(end)] + new if _measure(w[: -len(end)]) else w
            break
    w = _fourth(w)
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or m == 1 and not _short(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
