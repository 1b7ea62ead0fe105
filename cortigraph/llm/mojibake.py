"""Repair of UTF-8 text that was decoded as a one-byte charset."""

from __future__ import annotations

import re

# Characters of windows-1252 at the bytes 0x80 to 0x9F that have one.
_WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BYTE = {c: c.encode("cp1252")[0] for c in _WINDOWS} | {chr(i): i for i in range(0x80, 0x100)}
_TAIL = "[\x80-\xbf" + _WINDOWS + "]"
_SEQUENCE = re.compile(f"[\xc2-\xdf]{_TAIL}|[\xe0-\xef]{_TAIL}{{2}}|[\xf0-\xf4]{_TAIL}{{3}}")
#: What a repaired character may be: letters of the common scripts, punctuation, symbols, emoji.
_LIKELY = re.compile("[\xa0-ɏͰ-ԯ֐-ۿऀ-෿฀-໿Ḁ-῿‐-⁄₠-₿℀-™　-ヿ㐀-鿿가-힣＀-￯﻿​-‏⁠\U0001f000-\U0001faff]")


def _fixed(sequence: str) -> str | None:
    try:
        c = bytes(_BYTE[x] for x in sequence).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return c if _LIKELY.match(c) else None


def repair(text: str) -> tuple[str, list[int] | None]:
    """The text with such sequences decoded, and the place of each of its characters.

    The second value is None if nothing changed; otherwise entry i is the place of
    character i in `text`, with the length of `text` at the end.
    """
    if not _SEQUENCE.search(text):
        return text, None
    out, places, at = [], [], 0
    for m in _SEQUENCE.finditer(text):
        c = _fixed(m.group())
        if c is None:
            continue
        out.append(text[at : m.start()])
        places.extend(range(at, m.start() + 1))
        out.append(c)
        at = m.end()
    if not at:
        return text, None
    out.append(text[at:])
    places.extend(range(at, len(text) + 1))
    return "".join(out), places
