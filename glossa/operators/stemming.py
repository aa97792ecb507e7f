"""Action stems as one column expression: a table of endings, applied until nothing changes.

Each row of the table is a pattern with its replacement and the tidying of what is left; the first row that
leaves ``LEAST`` letters wins. The fold takes as many rounds as a word has letters, as every round that changes
a word shortens it or drops an ending for good. All of it runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 4
_SINGLE = (r"([^aeiou])\1$", "$1")
_SILENT_E = (r"(ag|dg|c|v|u|[bdgkpstz]l)$", "$1e")
#: Pattern, replacement, tidying; in order of precedence.
ENDINGS: list[tuple[str, str, list[tuple[str, str]]]] = [
    (r"(?<=...)ing$", "", [_SINGLE, _SILENT_E]),
    (r"ification$", "if", []),
    (r"i[zs]ation$", "iz", []),
    (r"ation$", "at", []),
    (r"lution$", "lv", []),
    (r"ction$", "c", []),
    (r"(?<=[aeiou])sion$", "s", []),
    (r"tion$", "t", []),
    (r"ment$", "", []),
    (r"[ae]nce$", "", [_SINGLE]),
    (r"ure$", "", []),
    (r"al$", "", []),
    (r"((?<!u)i|u)de$", "$1s", []),
    (r"ct$", "c", []),
    (r"(?<=[^aeiou])y$", "", []),
    (r"e$", "", []),
]


def _shorter(word: Column) -> Column:
    """The first row's result that is long enough, else the word."""
    options = []
    for pattern, replacement, tidying in ENDINGS:
        left = F.regexp_replace(word, pattern, replacement)
        for again, by in tidying:
            left = F.regexp_replace(left, again, by)
        options.append(F.when(word.rlike(pattern) & (F.length(left) >= LEAST), left))
    return F.coalesce(*options, word)


def stem(word: Column) -> Column:
    """The fixed point of the table on the word in lower case; null stays null."""
    low = F.lower(word)
    return F.when(low.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), low, lambda w, _: _shorter(w)))
