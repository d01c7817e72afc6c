"""The English Snowball stemmer's published steps as SQL, to check the library's against.

Each step is one table of ``(term, w, r1, r2)``: the word as it was, as it is now,
and how many characters lie before its two regions.  Terms have no apostrophes.
"""

from __future__ import annotations

from lexigrove.functions import stemmer


def _word(text: str) -> str:
    return f"'{text}'"


def _ends(endings: object) -> str:
    return f"regexp_matches(w, '(?:{'|'.join(endings)})$')"


_SHORT = "(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def _suffixes(name: str, before: str, cases: list[tuple[str, str]]) -> str:
    """A step that looks at the longest of some endings only: ``cases`` say, by ending, what becomes of the word."""
    longest = sorted(cases, key=lambda c: -len(c[0]))
    arms = " ".join(f"WHEN w LIKE '%{ending}' THEN {then}" for ending, then in longest)
    return f"{name} AS (SELECT term, CASE {arms} ELSE w END AS w, r1, r2 FROM {before})"


def _swap(ending: str, put: str, region: str, also: str = "true") -> tuple[str, str]:
    at = f"length(w) - {len(ending)}"
    return ending, f"CASE WHEN {at} >= {region} AND {also} THEN left(w, {at}) || '{put}' ELSE w END"


def _before(ending: str, letters: str) -> str:
    return f"regexp_matches(w, '[{letters}]{ending}$')"


_IRREGULAR = " ".join(f"WHEN {_word(w)} THEN {_word(s)}" for w, s in stemmer._IRREGULAR.items())
_PAST = " ".join(f"WHEN w LIKE '%{e}' THEN left(w, length(w) - {len(e)})" for e in ("ingly", "edly", "ing", "ed"))

#: Tables to follow a table ``raw(term)`` of distinct terms; the last one is ``stems(term, stem)``.
TABLES = ",\n".join(
    [
        r"marked AS (SELECT term, regexp_replace(term, '(^|[aeiouy])y', '\1Y', 'g') AS w FROM raw)",
        """first_region AS (SELECT term, w, CASE WHEN regexp_matches(w, '^(?:gener|commun|arsen)') THEN length(regexp_extract(w, '^(?:gener|commun|arsen)'))
            WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN length(regexp_extract(w, '(?s)^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS r1 FROM marked)""",
        """regions AS (SELECT term, w, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '(?s)^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS r2 FROM first_region)""",
        """step_1a AS (SELECT term, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
            WHEN regexp_matches(w, '[us]s$') OR w NOT LIKE '%s' THEN w WHEN regexp_matches(w, '[aeiouy](?s:.)+s$') THEN left(w, length(w) - 1) ELSE w END AS w, r1, r2 FROM regions)""",
        f"cut AS (SELECT *, CASE {_PAST} END AS s FROM step_1a)",
        f"""step_1b AS (SELECT term, CASE WHEN w LIKE '%eedly' THEN CASE WHEN length(w) - 5 >= r1 THEN left(w, length(w) - 3) ELSE w END WHEN w LIKE '%eed' THEN CASE WHEN length(w) - 3 >= r1 THEN left(w, length(w) - 1) ELSE w END
            WHEN s IS NULL OR NOT regexp_matches(s, '[aeiouy]') THEN w WHEN regexp_matches(s, '(?:at|bl|iz)$') THEN s || 'e' WHEN regexp_matches(s, '(?:{"|".join(stemmer._DOUBLES)})$') THEN left(s, length(s) - 1)
            WHEN r1 >= length(s) AND regexp_matches(s, '{_SHORT}') THEN s || 'e' ELSE s END AS w, r1, r2 FROM cut)""",
        "step_1c AS (SELECT term, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w, r1, r2 FROM step_1b)",
        _suffixes("step_2", "step_1c", [*(_swap(e, p, "r1") for e, p in stemmer._STEP_2.items()), _swap("ogi", "og", "r1", _before("ogi", "l")), _swap("li", "", "r1", _before("li", "cdeghkmnrt"))]),
        _suffixes("step_3", "step_2", [*(_swap(e, p, "r1") for e, p in stemmer._STEP_3.items()), _swap("ative", "", "r2")]),
        _suffixes("step_4", "step_3", [*(_swap(e, "", "r2") for e in stemmer._STEP_4), _swap("ion", "", "r2", _before("ion", "st"))]),
        f"""step_5 AS (SELECT term, CASE WHEN w LIKE '%e' THEN CASE WHEN length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{_SHORT}') THEN left(w, length(w) - 1) ELSE w END
            WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM step_4)""",
        f"""stems AS (SELECT term, CASE WHEN length(term) <= 2 THEN term ELSE CASE term {_IRREGULAR} ELSE CASE WHEN a.w IN ({", ".join(map(_word, sorted(stemmer._KEPT_AFTER_1A)))}) THEN a.w ELSE lower(z.w) END END END AS stem
            FROM step_5 z JOIN step_1a a USING (term))""",
    ]
)
