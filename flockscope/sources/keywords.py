"""Keyword lists (S4) and the list regex.

The first TAB field of a line is a piece of a pattern, not a literal, so it is
never quoted. It is stripped of blanks and of all ``#`` and ``@``: tags, mentions
and bare words match alike. A list becomes one alternation between word
boundaries.

Departures from the analysed pipeline, on purpose:

* blank lines are dropped (an empty alternative would match any boundary);
* duplicates after stripping are removed (order of first appearance kept);
* fragments that do not compile are rejected and reported instead of making
  the whole pattern fail at run time.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# ASCII word boundary written with look-arounds; equals RE2's ``\b``.
_ASCII_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


@dataclass
class KeywordList:
    name: str
    fragments: list[str]
    rejected: list[str] = field(default_factory=list)

    def regex(self, boundary: str = "java") -> str:
        return keyword_regex(self.fragments, boundary=boundary)


def clean_fragment(line: str) -> str:
    """First TAB field, stripped, with every '#' and '@' removed."""
    return line.split("\t")[0].strip().replace("#", "").replace("@", "")


def compiles(fragment: str) -> bool:
    """Whether Python's engine accepts the fragment (lists written in code, without a session)."""
    try:
        re.compile(f"({fragment})")
    except re.error:
        return False
    return True


def java_compiles(spark: SparkSession) -> Callable[[str], bool]:
    """The check by the engine that runs the pattern (``rlike``, Java): for lists read from files."""
    def judge(fragment: str) -> bool:
        try:
            spark._jvm.java.util.regex.Pattern.compile(f"({fragment})")
        except IllegalArgumentException:
            return False
        return True
    return judge


def validate_fragments(fragments: list[str], judge: Callable[[str], bool] = compiles) -> tuple[list[str], list[str]]:
    """Split into (usable, rejected by ``judge``); blanks and duplicates are dropped."""
    good: list[str] = []
    bad: list[str] = []
    seen: set[str] = set()
    for frag in fragments:
        if not frag or frag in seen:
            continue
        seen.add(frag)
        if not judge(frag):
            bad.append(frag)
            continue
        good.append(frag)
    if bad:
        log.warning("rejected %d keyword fragment(s): %r", len(bad), bad)
    return good, bad


def keyword_regex(fragments: list[str], boundary: str = "java") -> str:
    """``\\b(f1|f2|...)\\b``.

    ``boundary="java"`` keeps Java's ``\\b`` (non-ASCII letters count as word
    characters); ``"ascii"`` uses an ASCII-only boundary, equal to RE2's.
    """
    if not fragments:
        raise ValueError("keyword list is empty")
    body = "|".join(fragments)
    if boundary == "java":
        return rf"\b({body})\b"
    if boundary == "ascii":
        return f"{_ASCII_B}({body}){_ASCII_B}"
    raise ValueError(f"unknown boundary {boundary!r}")


def keyword_list(name: str, lines: list[str], judge: Callable[[str], bool] = compiles) -> KeywordList:
    good, bad = validate_fragments([clean_fragment(x) for x in lines], judge)
    return KeywordList(name, good, bad)


def read_keywords(spark: SparkSession, path: str, name: str) -> KeywordList:
    """Read one list file with Spark; only the (small) fragment list is collected."""
    df = (spark.read.text(path)
          .select(F.monotonically_increasing_id().alias("pos"), F.col("value"))
          .select("pos", F.trim(F.split("value", "\t").getItem(0)).alias("frag"))
          .select("pos", F.translate("frag", "#@", "").alias("frag")))
    rows = df.orderBy("pos").select("frag").collect()
    return keyword_list(name, [r.frag for r in rows], java_compiles(spark))
