"""The stemmer as SQL over a vocabulary, for the oracle only."""

from __future__ import annotations

from feedloom.functions import stemming as P


def _cases(table) -> str:
    return "CASE " + " ".join(f"WHEN suffix(w, '{s}') THEN {r}" for s, r in table) + " ELSE w END"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def stem_ctes(source: str, name: str) -> str:
    """CTEs that read ``source(word)`` and end in ``name(word, stem)``."""
    short = P.SHORT_SYLLABLE
    region = P.REGION_WITH_EXCEPTIONS
    quoted = ", ".join(f"'{w}'" for w in P.INVARIANT_AFTER_PLURALS)
    exceptions = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.EXCEPTIONS.items())

    def step2():
        for suffix, new, before in P.STEP_2:
            fits = f"length(w) - {len(suffix)} >= r1"
            if before:
                fits += f" AND regexp_matches(w, '[{before}]{suffix}$')"
            yield suffix, f"(CASE WHEN {fits} THEN {_cut(len(suffix))} || '{new}' ELSE w END)"

    def step3():
        for suffix, new, deep in P.STEP_3:
            fits = f"length(w) - {len(suffix)} >= " + ("greatest(r1, r2)" if deep else "r1")
            yield suffix, f"(CASE WHEN {fits} THEN {_cut(len(suffix))} || '{new}' ELSE w END)"

    def step4():
        for suffix in P.STEP_4:
            yield suffix, f"(CASE WHEN length(w) - {len(suffix)} >= r2 THEN {_cut(len(suffix))} ELSE w END)"
        for suffix in ("sion", "tion"):
            yield suffix, f"(CASE WHEN length(w) - 3 >= r2 THEN {_cut(3)} ELSE w END)"

    ies = f"(CASE WHEN length(w) > 4 THEN {_cut(3)} || 'i' ELSE {_cut(3)} || 'ie' END)"
    plural = f"(CASE WHEN regexp_matches({_cut(1)}, '[aeiouy].') THEN {_cut(1)} ELSE w END)"
    step1a = _cases((("sses", _cut(2)), ("ied", ies), ("ies", ies), ("us", "w"), ("ss", "w"), ("s", plural)))
    ed = "regexp_extract(w, '^(.*[aeiouy].*?)(?:ingly|edly|ing|ed)$', 1)"
    return f"""
    {name}_0 AS (SELECT word, CASE WHEN prefix(word, '''') THEN substr(word, 2) ELSE word END AS bare FROM {source}),
    {name}_1 AS (SELECT word, bare,
      regexp_replace(regexp_replace(bare, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {name}_0),
    {name}_2 AS (SELECT *, CASE WHEN regexp_extract(w, '{region}') = '' THEN length(w)
      ELSE length(regexp_extract(w, '{region}')) END AS r1 FROM {name}_1),
    {name}_3 AS (SELECT *, CASE WHEN regexp_extract(substr(w, r1 + 1), '{P.REGION}') = '' THEN length(w)
      ELSE r1 + length(regexp_extract(substr(w, r1 + 1), '{P.REGION}')) END AS r2 FROM {name}_2),
    {name}_4 AS (SELECT * REPLACE (regexp_replace(w, '''(?:s''?)?$', '') AS w) FROM {name}_3),
    {name}_5 AS (SELECT * REPLACE ({step1a} AS w) FROM {name}_4),
    {name}_6 AS (SELECT *, w AS plain, CASE WHEN regexp_matches(w, 'eed(?:ly)?$') THEN NULL
      ELSE nullif({ed}, '') END AS cut FROM {name}_5),
    {name}_7 AS (SELECT * REPLACE (CASE
      WHEN suffix(w, 'eedly') THEN CASE WHEN length(w) - 5 >= r1 THEN {_cut(3)} ELSE w END
      WHEN suffix(w, 'eed') THEN CASE WHEN length(w) - 3 >= r1 THEN {_cut(1)} ELSE w END
      WHEN cut IS NULL THEN w
      WHEN regexp_matches(cut, '(?:at|bl|iz)$') THEN cut || 'e'
      WHEN regexp_matches(cut, '{P.DOUBLE}') THEN left(cut, length(cut) - 1)
      WHEN regexp_matches(cut, '{short}') AND (regexp_extract(cut, '{region}') = ''
        OR length(regexp_extract(cut, '{region}')) = length(cut)) THEN cut || 'e'
      ELSE cut END AS w) FROM {name}_6),
    {name}_8 AS (SELECT * REPLACE (regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w) FROM {name}_7),
    {name}_9 AS (SELECT * REPLACE ({_cases(step2())} AS w) FROM {name}_8),
    {name}_10 AS (SELECT * REPLACE ({_cases(step3())} AS w) FROM {name}_9),
    {name}_11 AS (SELECT * REPLACE ({_cases(step4())} AS w) FROM {name}_10),
    {name}_12 AS (SELECT * REPLACE (CASE
      WHEN suffix(w, 'l') THEN CASE WHEN length(w) - 1 >= r2 AND suffix(w, 'll') THEN {_cut(1)} ELSE w END
      WHEN suffix(w, 'e') THEN CASE WHEN length(w) - 1 >= r2
        OR (length(w) - 1 >= r1 AND NOT regexp_matches({_cut(1)}, '{short}')) THEN {_cut(1)} ELSE w END
      ELSE w END AS w) FROM {name}_11),
    {name} AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE coalesce(
      CASE bare {exceptions} END, CASE WHEN plain IN ({quoted}) THEN plain END, replace(w, 'Y', 'y')) END AS stem
      FROM {name}_12)"""
