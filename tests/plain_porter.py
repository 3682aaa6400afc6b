"""The steps of the paper word by word, to hold the column expressions against."""

from askgrid.functions.stem import STEP2, STEP3, STEP4


def _shape(word: str) -> str:
    """The word as a string of c and v; y after a consonant is a vowel."""
    shape = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _ends_cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replace_longest(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    hits = [r for r in rules if word.endswith(r[0])]
    if hits:
        suffix, new = max(hits, key=lambda r: len(r[0]))
        base = word[: -len(suffix)]
        if _measure(base) > 0:
            return base + new
    return word


def porter_stem(word: str) -> str:
    """Stem of one lower-case word; words of one or two letters stay as they are."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _ends_cvc(word)):
                    word += "e"
                elif _double_consonant(word) and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(word, STEP2)
    word = _replace_longest(word, STEP3)
    hits = [s for s in STEP4 if word.endswith(s)]
    if hits:
        base = word[: -len(max(hits, key=len))]
        if _measure(base) > 1 and (not word.endswith("ion") or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
