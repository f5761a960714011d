"""Stemmers for English and Russian, after the published descriptions of the Snowball algorithms."""

from __future__ import annotations

import re

# The suffixes, and the words that the rules treat apart, as published.
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_AFTER = "cdeghkmnrt"
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_FINAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(word: str, vowels: str, start: int = 0) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and the same once more."""
    found = re.compile(f"[{vowels}][^{vowels}]")
    first = found.search(word, start)
    if not first:
        return len(word), len(word)
    second = found.search(word, first.end())
    return first.end(), second.end() if second else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(rf"(^[{_VOWELS}][^{_VOWELS}]|[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY])$", word))


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(rf"(^|(?<=[{_VOWELS}]))y", "Y", word)
    head = re.match("gener|commun|arsen", word)
    if head:
        r1 = head.end()
        again = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(word, r1)
        r2 = again.end() if again else len(word)
    else:
        r1, r2 = _regions(word, _VOWELS)
    for s in ("'s'", "'s", "'"):
        if word.endswith(s):
            word = word[: -len(s)]
            break
    # plurals
    s = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        word = word[:-2]
    elif s in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif s == "s" and re.search(f"[{_VOWELS}].", word[:-1]):
        word = word[:-1]
    if word in _FINAL:
        return word
    # past and participles
    s = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(word) - len(s) >= r1:
            word = word[: -len(s)] + "ee"
    elif s and re.search(f"[{_VOWELS}]", word[: -len(s)]):
        word = word[: -len(s)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # derivational endings
    s = _longest(word, _STEP2)
    if s and len(word) - len(s) >= r1:
        before = word[: -len(s)]
        if s == "ogi":
            word = before + "og" if before.endswith("l") else word
        elif s == "li":
            word = before if before[-1:] and before[-1] in _LI_AFTER else word
        else:
            word = before + _STEP2[s]
    s = _longest(word, _STEP3)
    if s and len(word) - len(s) >= r1 and (s != "ative" or len(word) - len(s) >= r2):
        word = word[: -len(s)] + _STEP3[s]
    s = _longest(word, _STEP4)
    if s and len(word) - len(s) >= r2 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


# Russian endings. Those after а or я come first in each pair.
_RU_VOWELS = "аеиоуыэюя"
_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_REFLEXIVE = ("ся", "сь")
_ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_VERB = (
    ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно"),
    ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю"),
)
_NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
)


def _drop(part: str, pair: tuple[tuple[str, ...], tuple[str, ...]]) -> str | None:
    """``part`` without the longest ending of the pair; one of the first group must follow а or я."""
    s = _longest(part, (*pair[0], *pair[1]))
    if s is None:
        return None
    if s in pair[0] and not part[: -len(s)].endswith(("а", "я")):
        return None
    return part[: -len(s)]


def russian(word: str) -> str:
    word = word.replace("ё", "е")
    vowel = re.search(f"[{_RU_VOWELS}]", word)
    if not vowel:
        return word
    rv = vowel.end()
    r2 = _regions(word, _RU_VOWELS)[1]
    head, part = word[:rv], word[rv:]
    cut = _drop(part, _GERUND)
    if cut is None:
        s = _longest(part, _REFLEXIVE)
        part = part[: -len(s)] if s else part
        s = _longest(part, _ADJECTIVE)
        if s:
            cut = part[: -len(s)]
            more = _drop(cut, _PARTICIPLE)
            cut = cut if more is None else more
        else:
            cut = _drop(part, _VERB)
            if cut is None:
                s = _longest(part, _NOUN)
                cut = part[: -len(s)] if s else part
    part = cut.removesuffix("и")
    s = _longest(part, ("ост", "ость"))
    if s and len(head) + len(part) - len(s) >= r2:
        part = part[: -len(s)]
    s = _longest(part, ("ейш", "ейше"))
    if s:
        part = part[: -len(s)]
    if part.endswith("нн"):
        part = part[:-1]
    elif not s:
        part = part.removesuffix("ь")
    return head + part
