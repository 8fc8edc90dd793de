"""Parts of names typed by people: normal form, words, abbreviations, initials.

The tables below are general knowledge about names (fixed values), none is taken from data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Mapping
from functools import lru_cache

#: Spellings of legal forms and the form they stand for.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd",
    "llc": "llc", "lc": "llc", "liability": "llc", "llp": "llp", "lp": "lp", "plc": "plc", "pllc": "llc", "gmbh": "gmbh", "ag": "ag", "sa": "sa", "srl": "srl", "bv": "bv", "nv": "nv", "pty": "ltd",
}
#: Words that say nothing about who is meant.
NOISE = {"the", "and", "of", "a", "an", "hq", "headquarters", "site", "plant", "branch", "attn", "accounts", "contractor", "self", "sole", "proprietor", "employed", "dba", "fka", "jr", "sr", "esq"}
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir"}
PLACEHOLDERS = {
    "", "unknown", "none", "na", "null", "nil", "tbd", "tba", "not available", "not applicable", "not provided", "unspecified", "undisclosed", "missing", "various",
    "multiple", "multiple recipients", "misc", "miscellaneous", "redacted", "see above", "see below", "same", "same as above", "test", "xxx", "no name", "not known", "n a",
    "to be determined", "pending", "unnamed", "anonymous", "other", "blank", "see remarks", "see notes", "vendor", "no data",
}
#: Given names, each with its usual short forms.
GIVEN = {
    "alexander": "alex al sandy xander sasha lex", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benny", "catherine": "cathy cath kate", "charles": "charlie chuck chas chaz",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "donald": "don donny", "dorothy": "dot dottie dolly",
    "edward": "ed eddie ted ned eddy", "eleanor": "ellie nell nora", "elizabeth": "liz beth betty eliza lisa libby bess lizzie betsy", "frances": "fran fanny frankie", "francis": "frank fran",
    "frederick": "fred freddy fritz rick freddie", "george": "georgie", "gregory": "greg", "harold": "harry hal", "henry": "hank harry hal", "james": "jim jimmy jas jamie jem", "jennifer": "jen jenny",
    "john": "jack johnny jon", "jonathan": "jon jonny", "joseph": "joe joey jos", "josephine": "jo josie posy josey", "katherine": "kate kathy kath kit katie kay kitty", "kenneth": "ken kenny",
    "lawrence": "larry", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge greta rita madge peg", "martha": "patty", "mary": "polly molly", "matthew": "matt",
    "michael": "mike mick mikey micky mickey", "nathaniel": "nate nat", "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat patty tricia trish", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "rebecca": "becky becca beck", "richard": "dick rick rich richie ricky dickie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie",
    "samuel": "sam", "sandra": "sandy", "stephen": "steve", "steven": "steve", "susan": "sue susie", "susannah": "sue susie sukie suzy susan susanna zanna", "theodore": "ted teddy theo",
    "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky tori vic vickie torie", "virginia": "ginny", "walter": "walt wally", "william": "bill will billy liam willy wm",
    "zachary": "zach zack",
}
SHORT: dict[str, tuple[str, ...]] = {}
for _full, _shorts in GIVEN.items():
    for _s in _shorts.split():
        SHORT[_s] = (*SHORT.get(_s, ()), _full)

_OCR = str.maketrans("01345", "oleas")
_PHRASES = re.compile(
    r"\bc/o\b.*$|\(?\bsole\s+prop(rietor(ship)?)?\b\.?\)?|\bself[\s-]*employed\b|\bt/a\b|\bd/b/a\b|[-,(]?\s*\b(site|plant|unit|bldg|branch)\s+\d+\)?|#\s*\d+|\blimited\s+liability\s+company\b"
)
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}(?:[a-z]\b)?|\b[a-z](?:\.[a-z]\b)+")


def plain(name: str) -> str:
    """Lower case without accents, apostrophes and underscores."""
    s = unicodedata.normalize("NFKD", name)
    s = " ".join("".join(c for c in s if not unicodedata.combining(c)).replace("_", " ").split())
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    return re.sub(r"['’`]", "", s.lower())


def tokens(name: str) -> list[str]:
    """Words of a name in their order, legal forms and titles included."""
    s = _PHRASES.sub(lambda m: " llc " if "liab" in m.group() else " ", plain(name))
    s = _DOTTED.sub(lambda m: f" {m.group().replace('.', '')} ", s)
    s = re.sub(r"(?<=\w)-(?=\w)", "", s)
    out = []
    for w in re.findall(r"[^\W_]+", s):
        if not w.isdigit():
            out.append(w.translate(_OCR) if any(c.isdigit() for c in w) else w)
    return out


def is_placeholder(name: str | None) -> bool:
    return name is None or " ".join(re.findall(r"[^\W_]+", plain(name))) in PLACEHOLDERS


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` keeps the first letter of ``word`` and some later letters in order."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    letters = iter(word)
    return all(c in letters for c in short)


def common_words(counts: Mapping[str, int], ordinary: Collection[str], least: float) -> dict[str, int]:
    """Words that many names share: those in at least ``least`` names, and ordinary words of the language in at least three.

    Legal forms, noise, and abbreviations of a much more frequent common word are left out.
    """
    some = {w: n for w, n in counts.items() if len(w) > 3 and (n >= least or (n >= 3 and w in ordinary)) and w not in LEGAL and w not in NOISE and w not in SHORT}
    return {w: n for w, n in some.items() if not any(k > 2 * n and abbreviates(w, c) for c, k in some.items())}


def split_joined(token: str, common: Collection[str], least: int = 5) -> list[str]:
    """A distinctive word written together with a following common word, parted."""
    longest = max(map(len, common), default=0)
    for size in range(min(longest, len(token) - least), 3, -1):
        if token[-size:] in common:
            return [token[:-size], token[-size:]]
    return [token]


class Vocabulary:
    """General words by first letter; what a short word abbreviates is looked up once per distinct word."""

    def __init__(self, common: Collection[str]) -> None:
        self.words = set(common)
        self._by_letter: dict[str, list[str]] = {}
        for w in sorted(self.words):
            self._by_letter.setdefault(w[0], []).append(w)
        self.longer = lru_cache(maxsize=200_000)(self._longer)

    def __contains__(self, word: str) -> bool:
        return word in self.words

    def _longer(self, short: str) -> tuple[str, ...]:
        return tuple(c for c in self._by_letter.get(short[0], ()) if abbreviates(short, c))


def profile(words: list[str], common: Vocabulary) -> tuple[str, list[str], list[str], str]:
    """(distinctive part, full words, open items, legal form) of one name.

    ``words`` are tokens whose typing errors in common words are already mended. An open
    item is an abbreviation that may stand for several words, or ``=x`` for an initial, or
    ``a|b`` for given names of which one is meant. A given name comes as a full word, its
    middle initial as ``x.``. Without a distinctive word the whole name is the part.
    """
    legal, rest = "", []
    for i, w in enumerate(words):
        if w in LEGAL:
            legal = legal or LEGAL[w]
        elif w in NOISE and len(w) > 1 or (i == 0 and w in TITLES):
            continue
        else:
            rest.append(w)
    given = [w for w in rest if w in GIVEN or w in SHORT]
    known = lambda w: w in common or w in GIVEN or w in SHORT
    unknown = [w for w in rest if not known(w) and len(w) > 5 and not any(len(c) > len(w) + 1 for c in common.longer(w))]
    if not unknown:
        unknown = sorted((w for w in rest if not known(w) and len(w) > 3), key=len)[-1:]
    if not unknown:
        return "=" + " ".join(sorted(rest)), [], [], legal
    stem = max(unknown, key=lambda w: (len(w), w))
    full, items = [], []
    person = bool(given) and not legal and len(rest) <= 4
    for w in rest:
        if w == stem:
            continue
        if w in GIVEN:
            full.append(w)
        elif w in SHORT and person:
            may = sorted({*SHORT[w], *(c for c in common.longer(w) if len(c) > 3)})
            items.append("|".join(may)) if len(may) > 1 else full.append(may[0])
        elif len(w) == 1:
            full.append(w + ".") if person else items.append("=" + w)
        elif w in common:
            full.append(w)
        else:
            long = [c for c in common.longer(w) if len(c) > 3]
            if len(w) == 2 and not any(w[0] == c[0] and w[-1] == c[-1] and len(c) < 6 for c in long):
                items.extend("=" + c for c in w)
            elif len(long) == 1:
                full.append(long[0])
            elif long:
                items.append("|".join(sorted(long)))
            elif len(w) > 3:
                full.append(w)
            elif len(w) == 3:
                items.extend("=" + c for c in w)
    return stem, sorted(set(full)), sorted(items), legal


def joined_items(rest: str, target: list[str]) -> list[str] | None:
    """The open item for letters that were written together with a distinctive part, if they abbreviate a target word."""
    hit = [w for w in target if len(rest) > 1 and (abbreviates(rest, w) or rest == w)]
    return ["|".join(hit)] if hit else None


def fits(full: list[str], items: list[str], target: list[str]) -> bool:
    """Whether every full word and every open item finds a word of its own in ``target``."""
    left = list(target)
    for w in full:
        if w in left:
            left.remove(w)
        elif len(w) == 2 and w[1] == "." and any(x[0] == w[0] for x in left):
            left.remove(next(x for x in left if x[0] == w[0]))
        else:
            return False

    def place(k: int, left: list[str]) -> bool:
        if k == len(items):
            return True
        it = items[k]
        hit = (lambda x: x[0] == it[1]) if it[0] == "=" else (lambda x: x in it.split("|"))
        return any(hit(x) and place(k + 1, left[:i] + left[i + 1 :]) for i, x in enumerate(left))

    return place(0, left)
