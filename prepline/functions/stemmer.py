"""The English (Porter2) stemmer, from its published definition."""

from __future__ import annotations

import functools
import re

# Whole words with their own stems, and words that are left alone after the first step.
EXCEPTIONS = dict(
    skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl",
    sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes",
)
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Suffix and replacement of steps 2 to 4.
STEP_2 = dict(
    tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al",
    fulness="ful", fulli="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", lessli="less", li="",
)
STEP_3 = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VALID_LI = "cdeghkmnrt"
V, C = "[aeiouy]", "[^aeiouy]"
# Fixed value: English stopwords.
STOPWORDS = frozenset(
    """a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by can couldn couldn't d did
    didn didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has hasn hasn't have haven haven't having he her here hers
    herself him himself his how i if in into is isn isn't it it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now
    o of off on once only or other our ours ourselves out over own re s same shan shan't she she's should should've shouldn shouldn't so some such t than that that'll the
    their theirs them themselves then there these they this those through to too under until up ve very was wasn wasn't we were weren weren't what when where which while
    who whom why will with won't wouldn wouldn't y you you'd you'll you're you've your yours yourself yourselves""".split()
)


def _region(w: str, start: int) -> int:
    m = re.compile(V + C).search(w, start)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    """The word ends in a short syllable."""
    return bool(re.search(rf"{C}{V}[^aeiouywxY]$", w) or re.fullmatch(rf"{V}{C}", w))


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@functools.lru_cache(maxsize=1 << 16)
def stem_word(word: str) -> str:
    """The stem of a word; it isn't made lower case."""
    if len(word) < 3:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.removeprefix("'")
    w = re.sub(rf"^y|(?<={V})y", "Y", w)
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else _region(w, 0)
    r2 = _region(w, r1)
    # endings of possession and plural
    w = w[: -len(s)] if (s := _longest(w, ("'s'", "'s", "'"))) else w
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search(V, w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.replace("Y", "y")
    # endings of verbs
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    elif s and re.search(V, w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and re.match(C, w[-2]):
        w = w[:-1] + "i"
    # endings of derivation
    if (s := _longest(w, STEP_2)) and len(w) - len(s) >= r1:
        stem = w[: -len(s)]
        if (s not in ("ogi", "li")) or (s == "ogi" and stem.endswith("l")) or (s == "li" and stem[-1:] and stem[-1] in VALID_LI):
            w = stem + STEP_2[s]
    if (s := _longest(w, STEP_3)) and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP_3[s]
    if (s := _longest(w, STEP_4)) and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
