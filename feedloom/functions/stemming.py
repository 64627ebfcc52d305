"""The published Porter2 (Snowball English) stemmer as Spark expressions.

No Python process sees the words. Callers stem a *distinct vocabulary* and
join back, or those words of a text that can have a stem they look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.binding import let
from feedloom.functions.text import words

# --- fixed values -----------------------------------------------------------
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
INVARIANT_AFTER_PLURALS = (
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
)
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
REGION_WITH_EXCEPTIONS = "^(?:gener|arsen|commun|[^aeiouy]*[aeiouy]+[^aeiouy])"
SHORT_SYLLABLE = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
#: suffix, replacement, letters one of which must come before (step 2)
STEP_2 = (
    ("ization", "ize", ""), ("ational", "ate", ""), ("fulness", "ful", ""), ("ousness", "ous", ""),
    ("iveness", "ive", ""), ("tional", "tion", ""), ("biliti", "ble", ""), ("lessli", "less", ""),
    ("entli", "ent", ""), ("ation", "ate", ""), ("alism", "al", ""), ("aliti", "al", ""),
    ("ousli", "ous", ""), ("iviti", "ive", ""), ("fulli", "ful", ""), ("enci", "ence", ""),
    ("anci", "ance", ""), ("abli", "able", ""), ("izer", "ize", ""), ("ator", "ate", ""),
    ("alli", "al", ""), ("bli", "ble", ""), ("ogi", "og", "l"), ("li", "", "cdeghkmnrt"),
)
#: suffix, replacement, True if it must also lie in the second region (step 3)
STEP_3 = (
    ("ational", "ate", False), ("tional", "tion", False), ("alize", "al", False),
    ("icate", "ic", False), ("iciti", "ic", False), ("ative", "", True), ("ical", "ic", False),
    ("ness", "", False), ("ful", "", False),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize",
)
# ----------------------------------------------------------------------------


def _chop(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _first_suffix(word: Column, table) -> Column:
    """``table`` yields (suffix, result); the first suffix that fits decides."""
    out = None
    for suffix, result in table:
        test = word.endswith(suffix)
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(word)


def _region(word: Column, pattern: str, start: Column) -> Column:
    """Where the region after ``pattern`` begins, counted from ``start``; the end if nowhere."""
    head = F.regexp_extract(F.substring(word, start + 1, F.length(word)), pattern, 0)
    return F.when(head == "", F.length(word)).otherwise(start + F.length(head))


def _plural(w: Column) -> Column:
    ies = F.concat(_chop(w, 3), F.when(F.length(w) > 4, "i").otherwise("ie"))
    s = F.when(_chop(w, 1).rlike("[aeiouy]."), _chop(w, 1)).otherwise(w)
    return _first_suffix(w, (
        ("sses", _chop(w, 2)), ("ied", ies), ("ies", ies), ("us", w), ("ss", w), ("s", s),
    ))


def _past(w: Column, r1: Column) -> Column:
    """Take off -ed and -ing where a vowel is left, and repair what remains."""
    def repaired(cut: Column) -> Column:
        head = F.length(F.regexp_extract(cut, REGION_WITH_EXCEPTIONS, 0))
        short = cut.rlike(SHORT_SYLLABLE) & ((head == 0) | (head == F.length(cut)))
        return (
            F.when(cut == "", w)
            .when(cut.rlike("(?:at|bl|iz)$") | (~cut.rlike(DOUBLE) & short), F.concat(cut, F.lit("e")))
            .when(cut.rlike(DOUBLE), _chop(cut, 1))
            .otherwise(cut)
        )

    return (
        F.when(w.endswith("eedly"), F.when(F.length(w) - 5 >= r1, _chop(w, 3)).otherwise(w))
        .when(w.endswith("eed"), F.when(F.length(w) - 3 >= r1, _chop(w, 1)).otherwise(w))
        .otherwise(let(F.regexp_extract(w, "^(.*[aeiouy].*?)(?:ingly|edly|ing|ed)$", 1), repaired))
    )


def _swap(w: Column, suffix: str, new: str, fits: Column) -> Column:
    return F.when(fits, F.concat(_chop(w, len(suffix)), F.lit(new))).otherwise(w)


def _derived(w: Column, r1: Column) -> Column:
    def rows():
        for suffix, new, before in STEP_2:
            fits = F.length(w) - len(suffix) >= r1
            yield suffix, _swap(w, suffix, new, fits & w.rlike(f"[{before}]{suffix}$") if before else fits)

    return _first_suffix(w, rows())


def _inflected(w: Column, r1: Column, r2: Column) -> Column:
    def rows():
        for suffix, new, deep in STEP_3:
            yield suffix, _swap(w, suffix, new, F.length(w) - len(suffix) >= (F.greatest(r1, r2) if deep else r1))

    return _first_suffix(w, rows())


def _residual(w: Column, r2: Column) -> Column:
    def rows():
        for suffix in STEP_4:
            yield suffix, _swap(w, suffix, "", F.length(w) - len(suffix) >= r2)
        for suffix in ("sion", "tion"):
            yield suffix, _swap(w, "ion", "", F.length(w) - 3 >= r2)

    return _first_suffix(w, rows())


def _final(w: Column, r1: Column, r2: Column) -> Column:
    left = F.length(w) - 1
    drop_e = (left >= r2) | ((left >= r1) & ~_chop(w, 1).rlike(SHORT_SYLLABLE))
    gone = (w.endswith("ll") & (left >= r2)) | (w.endswith("e") & drop_e)
    return F.when(gone, _chop(w, 1)).otherwise(w)


def _regular(bare: Column) -> Column:
    """Stem of a word that is no exception."""
    marked = F.regexp_replace(F.regexp_replace(bare, "^y", "Y"), "([aeiouy])y", "$1Y")

    def measured(word: Column) -> Column:
        # Both regions are measured once, before any suffix goes.
        return let(_region(word, REGION_WITH_EXCEPTIONS, F.lit(0)), lambda r1: let(
            _region(word, REGION, r1), lambda r2: let(
                _plural(F.regexp_replace(word, "'(?:s'?)?$", "")), lambda w: shortened(w, r1, r2))))

    def shortened(plain: Column, r1: Column, r2: Column) -> Column:
        steps = (
            lambda w: _past(w, r1),
            lambda w: F.regexp_replace(w, "(?<=.[^aeiouy])[yY]$", "i"),
            lambda w: _derived(w, r1),
            lambda w: _inflected(w, r1, r2),
            lambda w: _residual(w, r2),
            lambda w: _final(w, r1, r2),
        )
        out = plain
        for step in steps:
            out = let(out, step)
        return F.when(plain.isin(*INVARIANT_AFTER_PLURALS), plain).otherwise(F.translate(out, "Y", "y"))

    return let(marked, measured)


def stem(word: Column) -> Column:
    """Stem of a lower-case word; one or two letters are left as they are."""
    bare = F.regexp_replace(word, "^'", "")
    listed = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
    return F.when(F.length(word) <= 2, word).otherwise(
        let(bare, lambda b: F.coalesce(F.try_element_at(listed, b), _regular(b)))
    )


def stem_start(word: Column) -> Column:
    """The first two letters of the stem of ``word``, or more than the stem if it has one letter.

    Every suffix rule leaves two letters in place, save that -ed, -ing and
    -'s may leave one; only the listed exceptions change a letter there.
    """
    bare = F.regexp_replace(word, "^'", "")
    listed = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
    return F.substring(F.when(F.length(word) <= 2, word).otherwise(
        F.coalesce(F.try_element_at(listed, bare), bare)), 1, 2)


def any_stem(words: Column, wanted: list[str]) -> Column:
    """Whether one of the lower-case ``words`` has one of the stems ``wanted``. Only words that begin like one are stemmed.

    What a word begins with is as in :func:`stem_start`: two letters of the stem, or its single one.
    """
    keys = {stem_[:2] for stem_ in wanted}
    keys |= {word[:2] for word, stem_ in EXCEPTIONS.items() if stem_[:2] in keys}
    if not keys:
        return F.lit(False)
    near = F.lit("^'?(?:" + "|".join("".join(f"\\x{{{ord(c):x}}}" for c in key) for key in sorted(keys)) + ")")
    return F.exists(F.filter(words, lambda word: F.rlike(word, near)), lambda word: stem(word).isin(*wanted))


_COLUMNS: dict[tuple[str, str], Column] = {}


def with_stem(df: DataFrame, word: str = "word", name: str = "stem") -> DataFrame:
    """Add the stem of a column. The long expression is built once per session and column."""
    key = (df.sparkSession.sparkContext.applicationId, word)
    if key not in _COLUMNS:
        _COLUMNS[key] = stem(F.col(word))
    return df.withColumn(name, _COLUMNS[key])


def stem_phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stems): the sorted distinct stems of each text, joined by spaces.

    The vocabulary is stemmed once and joined back to narrow (key, word) rows.
    """
    tokens = df.select(key, F.explode(words(F.col(text))).alias("word"))
    stems = with_stem(tokens.select("word").distinct())
    return tokens.join(stems, "word").groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("stem")), " ").alias("stems")
    )
