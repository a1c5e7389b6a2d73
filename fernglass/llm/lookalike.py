"""One form for characters that look alike.

``fold`` is the table: invisible characters go, compatibility forms and
composition follow Unicode, every kind of blank becomes a space and every kind
of hyphen a hyphen, and letters of other scripts that look like a Latin letter
become that letter. Case, accents and other punctuation stay.
"""

from __future__ import annotations

import re
import unicodedata

# Letters and the Latin letters they look like, by script.
LOOKALIKE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "Һ": "H", "Ӏ": "I",
    # Greek
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian
    "օ": "o", "ո": "n", "հ": "h", "ս": "u", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin letters outside the alphabet
    "ɑ": "a", "ɡ": "g", "ı": "i",
}
# Hyphens that look like the ASCII one: hyphen, non-breaking hyphen, figure dash, minus sign.
HYPHENS = "\u2010\u2011\u2012\u2212"
# Characters without a shape that aren't in category Cf.
SHAPELESS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))

_WORD = re.compile(r"[^\W_]+")


def ignorable(ch: str) -> bool:
    return ch in SHAPELESS or unicodedata.category(ch) == "Cf"


class _Table(dict):
    """For str.translate: characters are looked up by rule as they are met, and kept."""

    def __missing__(self, code: int):
        ch = chr(code)
        if ignorable(ch):
            out: str | None = None
        elif unicodedata.category(ch) == "Zs":
            out = " "
        else:
            out = "-" if ch in HYPHENS else LOOKALIKE.get(ch, ch)
        if len(self) < 1 << 16:
            self[code] = out
        return out


_FOLD = _Table()


def fold(text: str) -> str:
    """``text`` with everything that looks alike brought to one form."""
    if text.isascii():
        return text
    # invisible characters go before marks are composed, since they may stand between a letter and its mark
    text = unicodedata.normalize("NFKD", text.translate(_FOLD)).translate(_FOLD)
    return unicodedata.normalize("NFC", text)


def words(text: str) -> list[str]:
    """The words of ``text``: folded, without case; whatever is neither letter nor digit separates."""
    return _WORD.findall(fold(text).casefold())
