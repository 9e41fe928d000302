"""Counts over one whole text that the quality operators share."""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import repeat

import numpy as np

#: Frequent short words of the languages that references are kept for.
COMMON_WORDS = {
    "de": "der die das und in zu den mit von für ist im ein eine auf dem nicht sich des auch es an als bei nach wie aus oder",
    "en": "the of and to in a is that for it as was with on at by this are from be or an have not which his they you",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le",
    "fr": "de la le et les des en un une du que est pour qui dans par sur au plus pas ne se ce il son avec ou",
}
LANGUAGES = sorted(COMMON_WORDS)

#: Classes of characters: letters by case and without case, marks, digits, white space, stops and quotes, SYMBOLS, other signs, the rest.
CLASSES = ["lower", "upper", "letter", "mark", "digit", "space", "break", "stop", "symbol", "sign", "control"]
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Classes of Unicode's general categories, by their first letter where all of them go together.
_CATEGORIES = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "L": "letter", "M": "mark", "N": "digit", "Z": "space", "P": "stop", "S": "sign", "C": "control"}


def _class_of(char: str) -> int:
    if char in "\t\n\x0b\x0c\r":
        return CLASSES.index("break")
    if ord(char) < 128 and char.encode() in SYMBOLS:
        return CLASSES.index("symbol")
    if char in "@/\\_[]{}":
        return CLASSES.index("sign")
    category = unicodedata.category(char)
    return CLASSES.index(_CATEGORIES.get(category) or _CATEGORIES[category[0]])


CLASS_TABLE = np.array([_class_of(chr(b)) for b in range(128)])


@cache
def _unicode() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each code point its class and the number of its script (0: no letter), and the scripts' names: the first word of their letters' names."""
    kinds, scripts, names = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8), [""]
    places: dict[str, int] = {}
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        kinds[code] = _class_of(char)
        if kinds[code] <= 2:
            name = unicodedata.name(char, "").split("-")[0].split(" ")[0]
            name = "CJK" if name in ("HIRAGANA", "KATAKANA") else name
            if name and name not in places and len(names) < 256:
                places[name] = len(names)
                names.append(name)
            scripts[code] = places.get(name, 0)
    return kinds, scripts, names


def _beyond_ascii(text: bytes, counts: np.ndarray) -> np.ndarray:
    """Code points of the characters that aren't ASCII."""
    if not counts[0x80:].any():
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
    return codes[codes >= 128]


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def class_counts(text: bytes, counts: np.ndarray) -> np.ndarray:
    """Characters of each class; ``counts`` are those of the text's bytes."""
    own = np.bincount(CLASS_TABLE, weights=counts[:128], minlength=len(CLASSES)).astype(np.int64)
    codes = _beyond_ascii(text, counts)
    return own + np.bincount(_unicode()[0][codes], minlength=len(CLASSES)) if len(codes) else own


def script(text: bytes, counts: np.ndarray) -> str:
    """The script of most letters ('LATIN', 'CYRILLIC', ...); of equals the first by name, '' without letters."""
    latin = int(counts[65:91].sum() + counts[97:123].sum())
    codes = _beyond_ascii(text, counts)
    if not len(codes):
        return "LATIN" if latin else ""
    _, scripts, names = _unicode()
    seen = np.bincount(scripts[codes], minlength=len(names))
    seen[0] = 0
    seen[names.index("LATIN")] += latin
    return min((-n, name) for n, name in zip(seen.tolist(), names, strict=True))[1] if seen.any() else ""


#: Makes words comparable: punctuation and symbols part words, letters A-Z are lower-cased.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def n_chars(counts: np.ndarray) -> int:
    return int(counts.sum() - counts[0x80:0xC0].sum())


def symbols(counts: np.ndarray) -> int:
    return int(counts[list(SYMBOLS)].sum())


def spaces(counts: np.ndarray) -> int:
    return int(counts[list(SPACES)].sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def codes(words: list[bytes]) -> np.ndarray:
    """Numbers that are equal where words are."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    code = codes(words)
    window = code[:n]
    for k in range(1, width):
        window = np.unique(window * len(words) + code[k : n + k], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(window)[window] > 1)
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return int((np.cumsum(edges) > 0).sum())


class CommonWords:
    """Counts of each language's common words and, last, of all other words."""

    def __init__(self, lists: dict[str, str] = COMMON_WORDS):
        self.languages = sorted(lists)
        split = {lang: lists[lang].encode().split() for lang in self.languages}
        self.place = {w: i for i, w in enumerate(sorted({w for ws in split.values() for w in ws}))}
        self.of = [np.array([self.place[w] for w in split[lang]]) for lang in self.languages]
        self.size = len(self.place)

    def counts(self, text: bytes) -> np.ndarray:
        """All languages' common words in one vector; the last place holds the other words."""
        words = text.translate(PLAIN).lower().split()
        return np.bincount(np.fromiter(map(self.place.get, words, repeat(self.size)), np.int64, len(words)), minlength=self.size + 1)

    def of_language(self, counts: np.ndarray, k: int) -> np.ndarray:
        """The language's own words and one place for the rest; counts may have rows."""
        own = counts[..., self.of[k]]
        return np.concatenate([own, (counts.sum(-1) - own.sum(-1))[..., None]], -1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (0 to 1) of each row of counts to the counts q; 1 where either has none."""
    p, q = np.atleast_2d(p).astype(float), q.astype(float)
    full = (p.sum(1) > 0) & (q.sum() > 0)
    p, q = p / np.maximum(p.sum(1, keepdims=True), 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(1)
        found = np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    return np.where(full, found, 1.0)
