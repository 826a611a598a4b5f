"""Text scalar functions as pure ``Column -> Column`` expressions.

Syllabification runs over a whole text in one go: every run of non-word characters becomes one
space, consonant digraphs become single private-use characters, then two look-around regexes put
``|`` at the syllable breaks. The result, e.g. ``ca|sa do|lo``, is called a *syllable line*: words
are separated by a space and syllables by ``|``. No per-word lambda and no Python UDF is involved,
so the hot path stays inside code generation.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the syllable grammar.
WORD_CHARS = "a-zàáâãäçéêèíïóôõòúûü"
STRONG_VOWELS = "aàáâãeéêoóôõü"
WEAK_VOWELS = "iu"
ACCENTED_WEAK = "íú"
VOWELS = STRONG_VOWELS + WEAK_VOWELS + ACCENTED_WEAK

# Accent table of the canonical (normalized) form.
ACCENTED = "áàâãäåéêèëíîìïóôõòöúûùüçñ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucn"

# Consonant digraphs that count as one unit ("gu" only before a front vowel).
DIGRAPHS = {"qu": "\ue000", "ch": "\ue001", "lh": "\ue002", "nh": "\ue003"}
GU_UNIT = "\ue004"

CONSONANT = f"[^{VOWELS}| ]"
HIATUS = (
    f"([{STRONG_VOWELS}](?=[{STRONG_VOWELS}{ACCENTED_WEAK}])"
    f"|[{ACCENTED_WEAK}](?=[{VOWELS}])"
    f"|[{WEAK_VOWELS}](?=[{ACCENTED_WEAK}]))"
)
ONSET = f"([{VOWELS}])({CONSONANT}*?)([bcdfgptv][lr]|{CONSONANT})(?=[{VOWELS}])"

KEY_SYLLABLES = 2
KEY_SEPARATOR = "\u0001"


def words(text: Column) -> Column:
    """Maximal runs of word characters over the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD_CHARS}]+)"), F.lit(1))


def normalize(text: Column) -> Column:
    """Lower case without accents; keeps the number of characters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def _with_units(line: Column) -> Column:
    for pair, unit in DIGRAPHS.items():
        line = F.replace(line, F.lit(pair), F.lit(unit))
    return F.regexp_replace(line, "gu(?=[eéêií])", GU_UNIT)


def _without_units(line: Column) -> Column:
    for pair, unit in DIGRAPHS.items():
        line = F.replace(line, F.lit(unit), F.lit(pair))
    return F.replace(line, F.lit(GU_UNIT), F.lit("gu"))


def word_line(text: Column) -> Column:
    """Lower-cased words with a space between them."""
    return F.trim(F.regexp_replace(F.lower(text), f"[^{WORD_CHARS}]+", " "))


def accented_line(text: Column) -> Column:
    """Syllable line that keeps accents."""
    line = F.regexp_replace(_with_units(word_line(text)), HIATUS, "$1|")
    return _without_units(F.regexp_replace(line, ONSET, "$1$2|$3"))


def syllable_line(text: Column) -> Column:
    """Normalized syllable line of a text."""
    return F.translate(accented_line(text), ACCENTED, PLAIN)


def line_words(line: Column) -> Column:
    """Words of a syllable line, each still holding its ``|`` marks."""
    return F.array_remove(F.split(line, " "), "")


def line_syllables(line: Column) -> Column:
    """All syllables of a syllable line in reading order."""
    return F.array_remove(F.split(F.translate(line, "|", " "), " "), "")


def syllabify(word: Column) -> Column:
    """Syllables of one word, accents kept."""
    return F.array_remove(F.split(F.translate(accented_line(word), " ", ""), "\\|"), "")


def syllable_seq(text: Column) -> Column:
    """Ordered normalized syllables of a text."""
    return line_syllables(syllable_line(text))


def chunk_words(text: Column) -> Column:
    """Normalized syllables grouped by word: ``array<array<string>>``."""
    return F.transform(line_words(syllable_line(text)), lambda w: F.split(w, "\\|"))


term_syllables = syllable_seq


def soundex(word: Column) -> Column:
    """Phonetic code over the ASCII letters of the normalized word, empty without letters."""
    return F.soundex(F.regexp_replace(normalize(word), "[^a-z]", ""))


def edit_distance(left: Column, right: Column) -> Column:
    return F.levenshtein(left, right)


def word_key(line_word: Column) -> Column:
    """Prefix key of a syllable-line word: its first two syllables."""
    return F.translate(F.substring_index(line_word, "|", KEY_SYLLABLES), "|", KEY_SEPARATOR)


def alnum_needles(text: Column) -> Column:
    """Distinct lower-case identifiers that hold at least one digit, in first-seen order."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_-]{2,})"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(runs, lambda r: r.rlike("[0-9]")), F.lower))


def normalize_query(text: Column) -> Column:
    """Cache key of a query: lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "(?U)\\s+", " "))


def clean_term(text: Column) -> Column:
    """Readable thesaurus term: lower case, single spaces, accents kept."""
    return normalize_query(text)


def norm_key(text: Column) -> Column:
    """Thesaurus lookup key: trimmed, lower case, no accents."""
    return normalize(F.regexp_replace(text, "(?U)^\\s+|\\s+$", ""))


def strip(text: Column) -> Column:
    """Trim every Unicode white space, not only blanks."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


# a capital that can't be a word of its own: neither vowel nor semivowel
CONSONANT = "(?U)[\\p{Upper}&&[A-Z]&&[^AEIOUWY]]"


def join_drop_caps(text: Column) -> Column:
    """Glue a lone consonant capital to the lower-case word that follows it."""
    return F.regexp_replace(text, f"\\b({CONSONANT}) (?=\\p{{Ll}})", "$1")


def join_hyphens(text: Column) -> Column:
    """Undo hyphenation at a line break."""
    return F.regexp_replace(text, "-\\n(?=\\p{Ll})", "")


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def compatibility_form(text: Column) -> Column:
    """NFKC: Spark has no built-in for Unicode compatibility normalization."""
    return F.pandas_udf(_nfkc, "string")(text)


def clean_corpus(text: Column) -> Column:
    """Ligatures and other compatibility forms, drop caps, line-break hyphens."""
    return join_hyphens(join_drop_caps(compatibility_form(text)))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def derive_base_name(path: Column) -> Column:
    """``./a/b/file.ext`` -> ``a__b__file_ext``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    joined = F.array_join(parts, "__")
    return F.regexp_replace(joined, "^(.+)\\.([^.]*)$", "$1_$2")


def safe_name(name: Column) -> Column:
    """No leading dots or blanks; ``base`` when nothing is left."""
    kept = F.regexp_replace(name, "^[. ]+", "")
    return F.when(kept == "", F.lit("base")).otherwise(kept)


def file_extension(path: Column) -> Column:
    """Lower-case suffix with its dot; null without one or for a dot file."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(name, "^.+(\\.[^.]*)$", 1)
    return F.when(found != "", F.lower(found))


def hit_path(base: Column, corpus: Column) -> Column:
    """Relative path rebuilt from a flattened base name and the corpus file name."""
    folder = F.regexp_extract(base, "^(.*)__", 1)
    return F.when(
        base.contains("__"), F.concat(F.replace(folder, F.lit("__"), F.lit("/")), F.lit("/"), corpus)
    ).otherwise(corpus)


def driver_language(file_name: Column) -> Column:
    """``tokens_<Lang>_PTBR.drv`` -> ``<Lang>``."""
    stem = F.regexp_replace(F.regexp_replace(file_name, "\\.drv$", ""), "^tokens_", "")
    return F.regexp_replace(stem, "_PTBR$", "")


def percent_decode(text: Column) -> Column:
    return F.try_url_decode(text)


def parse_str_array(text: Column) -> Column:
    """String array found between the first ``[`` and the last ``]``; empty when there is none."""
    body = F.regexp_extract(text, "(?s)(\\[.*\\])", 1)
    items = F.transform(F.from_json(body, "array<string>"), strip)
    kept = F.filter(items, lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def mask_key(key: Column) -> Column:
    """First six and last four characters of a secret, or only bullets when it is short."""
    size = F.length(key)
    return F.when(size <= 10, F.repeat(F.lit("•"), size)).otherwise(
        F.concat(F.left(key, F.lit(6)), F.lit("…"), F.right(key, F.lit(4)))
    )


def histogram(syllables: Column) -> Column:
    """Counts per distinct syllable as ``array<struct<token,tf>>``.

    Sorting the syllables makes equal ones adjacent, and a back-reference picks each run, so the
    histogram of a row needs neither ``explode`` nor a shuffle.
    """
    ordered = F.array_join(F.sort_array(syllables), " ")
    runs = F.regexp_extract_all(ordered, F.lit("(?<!\\S)(\\S+)(?: \\1(?!\\S))*+"), F.lit(0))

    def entry(run: Column) -> Column:
        token = F.substring_index(run, " ", 1)
        tf = ((F.length(run) + 1) / (F.length(token) + 1)).cast("int")
        return F.struct(token.alias("token"), tf.alias("tf"))

    return F.transform(runs, entry)
