"""Keyword lists used by the registered queries on the driver tables.

The analysed pipeline reads its two lists from files (see
``flockscope.sources.keywords.read_keywords``); those lists are a parameter of
the library. The registered queries run on invented prose, so they use two
short lists of fragments that occur in it. They exercise every rule of the
list format: '#'/'@' stripping, duplicates after stripping, multi-word and
regex fragments, an escaped fragment and one fragment that must be rejected.
"""

from __future__ import annotations

from ..sources.keywords import KeywordList, keyword_list

# Fixed test fragments, one list line per entry, in file order.
POL_LINES = ["thon", "#thre", "erin", "@thha", "thre", "th\\w*ble", "of the", "*role=\"textbox\""]
BLM_LINES = ["anea", "thor\tcomment", "eron", "thble", "a\\.c\\.a\\.b\\.", "ntly", "#wh"]


def pol() -> KeywordList:
    return keyword_list("pol", POL_LINES)


def blm() -> KeywordList:
    return keyword_list("blm", BLM_LINES)


def patterns(boundary: str = "java") -> dict[str, str]:
    return {"pol": pol().regex(boundary), "blm": blm().regex(boundary)}
