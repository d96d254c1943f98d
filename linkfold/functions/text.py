"""Text normal forms and tokens, as expressions over columns.

Four normal forms are kept apart: ``canonical`` (homoglyphs, lower case, one blank); ``pair_form``, for comparing labels; ``entity_form``, for
names in recognised text, and ``soft_form``, for the soft score, both without phrases that any label may hold.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters and digits, and whole-token aliases.
LATIN = "ABCEHKLMOPRSTXY"
CYRILLIC = "АВСЕНКЛМОРРБТХУ"
DIGITS = "02345678"
DIGIT_LETTERS = "оззчсбтв"
ALIASES = {"mepro": "мерло"}
# Accented letters and what is left of them without combining marks.
ACCENTED = "àáâãäåāăąçćčèéêëēĕėęěìíîïīĭįñńňòóôõöøōŏőùúûüūŭůűýÿžźżšśёй"
PLAIN = "aaaaaaaaaccceeeeeeeeeiiiiiiinnnooooooooouuuuuuuuyyzzzssеи"
# Words that say nothing of an item, for soft scores and for names of entities.
SOFT_STOPWORDS = ("вино", "wine", "wines", "top", "100", "белое", "красное", "розовое", "сухое", "полусухое", "полусладкое", "сладкое", "брют", "extra", "brut", "года", "год", "year", "the", "and", "для", "из", "или", "vol")
NAME_STOPWORDS = (*SOFT_STOPWORDS, "senoabr", "фермерское", "сделано", "деревне", "винной", "россии", "кубань")
# Words of producers' names that don't tell one from another, and lines that don't tell labels apart.
GENERIC_WORDS = (
    "семейная", "семеиная", "семейныи", "семеиныи", "винодельня", "винодельни", "винодельныи", "winery", "wineries", "chateau", "шато", "дом", "хозяйство", "vineyards", "vineyard",
    "estate", "agricole", "production", "premium", "премиум", "виннои", "винныи", "деревне", "деревня",
)
GENERIC_LINES = ("винодельня", "винодельни", "вино", "wine", "winery", "этикетка")
# Fixed value: phrases of recognised text that any label may hold.
NOISE = (
    r"(?iuU)\b(contains?\s+sulph?ites?|сульфит\w*|алк(?:оголь)?|alcohol|\d+[.,]\d+\s*%|\d+\s*%|750\s*ml|0[,.]75\s*л|75\s*cl|объ[её]м|volume|produced|изготов\w*|розлив\w*|bottled|"
    r"wine\s+of|table\s+wine|столов\w*\s+вин\w*|mis\s+en\s+bouteille|au\s+chateau|выдержан\w*|top\s*100\s*wines?|винодельн\w*\s+года|winery\s+of\s+the\s+year)\b"
)
# Folding of Cyrillic to Latin look-alikes; letters that become several, then single ones.
FOLD_MULTI = (("щ", "sch"), ("ж", "zh"), ("ч", "ch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya"), ("ъ", ""), ("ь", ""))
FOLD_CYRILLIC, FOLD_LATIN = "абвгдеёзийклмнопрстуфхцыэ", "abbgdeeziiklmhoppctyfxcye"
# Transliteration from Cyrillic; letters of several come first.
CYRILLIC_MULTI = (("щ", "shch"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("ю", "yu"), ("я", "ya"), ("ъ", ""), ("ь", ""))
CYRILLIC_SINGLE = "абвгдезийклмнопрстуфыэё"
LATIN_SINGLE = "abvgdeziyklmnoprstufyee"
# Transliteration from Latin; the first that fits of those of several letters, then single ones.
LATIN_MULTI = (
    ("shch", "щ"), ("kh", "х"), ("zh", "ж"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"), ("yo", "ё"), ("ye", "е"), ("iy", "ий"), ("yy", "ый"),
)
LATIN_LETTERS, LATIN_AS_CYRILLIC = "abvgdeziyklmnoprstufhjwcq", "абвгдезийклмнопрстуфхйвкк"


def _digits_as_letters(t: Column) -> Column:
    """A token's digits as letters, where they are glued to letters and no more than those; years, decimals and percentages stay."""
    letters, digits = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"[^0-9]", ""))
    number = t.rlike(r"^(19|20)\d{2}$") | t.rlike(r"\d+[.,]\d+") | t.contains("%")
    return F.when(t.rlike(r"\p{L}[0-9]|[0-9]\p{L}") & ~number & (digits <= letters), F.translate(t, DIGITS, DIGIT_LETTERS)).otherwise(t)


def _latin_as_cyrillic(t: Column) -> Column:
    """A token's look-alikes in Cyrillic, where it mixes scripts or all its Latin letters are look-alikes."""
    alike = t.rlike(r"[А-Яа-яЁё]") | ~t.rlike(rf"[A-Za-z&&[^{LATIN}{LATIN.lower()}]]")
    return F.when(t.rlike(r"[A-Za-z]") & alike, F.translate(t, LATIN + LATIN.lower(), CYRILLIC + CYRILLIC.lower())).otherwise(t)


def _alias(t: Column) -> Column:
    """What a token in lower case stands for."""
    out = t
    for alias, target in ALIASES.items():
        out = F.when(t == alias, F.lit(target)).otherwise(out)
    return out


#: Letters that are those of an alias in lower case, and "е" for "ё"; of a single word they are found faster than all of its lower case.
_CASES = {x: low for x in map(chr, range(0x10000)) if (low := x.lower().replace("ё", "е")) != x and low in "".join(ALIASES)}


def _any_alias(t: Column) -> Column:
    """What a token in any case stands for; most have another length than an alias, and stay as they are."""
    key = F.translate(t, "".join(_CASES), "".join(_CASES.values()))
    return F.when(F.length(t).isin(sorted({len(alias) for alias in ALIASES})) & key.isin(list(ALIASES)), _alias(key)).otherwise(t)


def words(text: Column) -> Column:
    """Runs without white space; none of a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s ]+"), lambda x: x != "")


def canonical(text: Column) -> Column:
    """Lower case with look-alikes in Cyrillic and one blank between words; empty for null.  Each step is a pass over the words, but lower case, which is dear word by word, one over all."""
    out = words(text)
    for step in (_digits_as_letters, _any_alias, _latin_as_cyrillic):
        out = F.transform(out, step)
    low = F.split(F.translate(F.lower(F.array_join(out, " ")), "ё", "е"), " ")
    return F.array_join(F.transform(low, _alias), " ")


def unicode_form(text: Column, form: str) -> Column:
    """A Unicode normal form (NFC, NFD, NFKC or NFKD), for which Spark has no function; null stays null."""

    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    normal.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(normal, "string")(text)


def pair_form(text: Column) -> Column:
    """The form in which labels are compared word by word: NFKC, then canonical."""
    return canonical(unicode_form(F.coalesce(text, F.lit("")), "NFKC"))


def _tidied(text: Column) -> Column:
    """Phrases that any label may hold, percentages and punctuation as blanks; letters that stand for digits within years as digits."""
    t = F.regexp_replace(F.translate(text, "\rёЁ", "\nее"), NOISE, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?iuU)\b\d+[.,]?\d*\s*%(\s*vol\.?)?\b", " "), r"(?uU)[^\w\s\-]+", " ")
    year = lambda w: F.when(w.rlike(r"(?i)^(19|20)[\doil]{2}$"), F.translate(w, "OoIlL", "00111")).otherwise(w)
    return F.array_join(F.transform(words(t), year), " ")


def entity_form(text: Column) -> Column:
    """The form in which names are looked for in recognised text: NFKD without marks, tidied, canonical."""
    t = F.regexp_replace(unicode_form(F.coalesce(text, F.lit("")), "NFKD"), r"\p{Mn}", "")
    return canonical(F.regexp_replace(_tidied(t), r"(?iuU)\b\d+[.,]?\d*\s*vol\.?\b", " "))


def entity_lines(text: Column, least: int = 3) -> Column:
    """The lines of a recognised label in ``entity_form``, without short ones and those that any label may hold."""
    t = F.regexp_replace(unicode_form(F.coalesce(text, F.lit("")), "NFKD"), r"\p{Mn}", "")
    lines = F.transform(F.split(F.translate(t, "\r", "\n"), "\n"), lambda x: canonical(F.regexp_replace(_tidied(x), r"(?iuU)\b\d+[.,]?\d*\s*vol\.?\b", " ")))
    return F.filter(lines, lambda x: (F.length(x) >= least) & ~x.isin(*GENERIC_LINES))


def soft_form(text: Column) -> Column:
    """The form of the soft score: NFKC, torn words joined line by line, tidied, canonical."""
    t = F.translate(unicode_form(F.coalesce(text, F.lit("")), "NFKC"), "\rёЁ", "\nее")
    lines = F.transform(F.split(t, "\n"), collapse_spaced)
    return canonical(_tidied(F.array_join(lines, "\n")))


def fold_to_latin(token: Column) -> Column:
    """A token in lower case with Cyrillic letters as the Latin ones they resemble; anything but letters and digits goes."""
    t = canonical(token)
    for source, target in FOLD_MULTI:
        t = F.replace(t, F.lit(source), F.lit(target))
    return F.regexp_replace(F.translate(t, FOLD_CYRILLIC, FOLD_LATIN), "[^a-z0-9]+", "")


def soft_terms(form: Column) -> Column:
    """Distinct folded tokens of a text in ``soft_form``, with three characters or more, without stop words and numbers that aren't years."""
    is_year = lambda t: t.rlike(r"^(19|20)\d{2}$")
    kept = F.filter(F.split(form, " "), lambda t: is_year(t) | ((F.length(t) >= 3) & ~t.isin(*SOFT_STOPWORDS) & ~t.rlike(r"^\d+$")))
    folded = F.transform(kept, lambda t: F.when(is_year(t), t).otherwise(fold_to_latin(t)))
    return F.array_distinct(F.filter(folded, lambda t: F.length(t) >= 3))


def name_tokens(form: Column) -> Column:
    """Distinct tokens of a text in ``entity_form`` that may tell names apart: three letters or more, no stop words, no numbers."""
    return F.array_distinct(F.filter(F.split(form, " "), lambda t: (F.length(t) >= 3) & ~t.isin(*NAME_STOPWORDS) & ~t.rlike(r"^\d+$")))


def distinctive_tokens(form: Column) -> Column:
    """Those name tokens that aren't common to producers, with four letters or more."""
    return F.filter(name_tokens(form), lambda t: ~t.isin(*GENERIC_WORDS) & (F.length(t) >= 4))


def is_bad_producer(form: Column) -> Column:
    """Whether a name in ``entity_form`` is no producer's: too short, a bare word for winery with a number, or an award."""
    bare = form.rlike(r"(?iuU)^(?:винодельн\w*|winery|chateau|шато|дом)\s*\d*$")
    return F.coalesce((F.length(form) < 3) | bare | (form.contains("винодельн") & form.contains("год")), F.lit(True))


def stop_key(name: Column, stop: tuple[str, ...], protected: tuple[str, ...] = ()) -> Column:
    """A canonical name without stop words; protected words stay, and so does all of a name that is nothing but stop words."""
    every = F.split(canonical(name), " ")
    kept = F.filter(every, lambda t: ~t.isin(*stop) | t.isin(*protected)) if stop else every
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(every), " ")


def without_stopwords(name: Column, stop: tuple[str, ...], protected: tuple[str, ...] = ()) -> Column:
    """A name as it is written, without the words whose canonical form is that of a stop word; protected words stay.  Empty if nothing else is left."""
    keys = lambda words_: F.array(*[canonical(F.lit(w)) for w in words_]) if words_ else F.array().cast("array<string>")
    gone = lambda w: F.array_contains(keys(stop), canonical(w)) & ~F.array_contains(keys(protected), canonical(w))
    return F.array_join(F.filter(words(name), lambda w: ~gone(w)), " ")


def distinct_words(text: Column) -> Column:
    """A name with each word once, whatever its case, in the order of their first occurrence."""
    w = words(text)
    low = F.transform(w, lambda x: F.lower(x))
    return F.array_join(F.filter(w, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), " ")


def distinct_lines(*texts: Column) -> Column:
    """The lines of several texts, trimmed, without empty ones, each once whatever its case, in order, joined again."""
    lines = F.concat(*[F.split(F.coalesce(t, F.lit("")), "\n") for t in texts])
    lines = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(lines, lambda x: F.lower(x))
    return F.array_join(F.filter(lines, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), "\n")


def lines_to_text(lines: Column) -> Column:
    """Lines, trimmed, without empty ones, as one text."""
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def joined_lines(text: Column) -> Column:
    """A text's lines with bars between them, as a scorer of pairs reads it."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), " | ")


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column, least: int = 2) -> Column:
    """Letters-and-digits tokens of ``least`` characters, or any digit, of a text in lower case."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= least) | t.rlike(r"^\d$"))


def ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams of a text; none of a shorter one.  The text is cut into its characters once, as finding a place in it takes longer the further it is."""
    grams = lambda c: F.array_distinct(F.transform(F.slice(c, 1, F.size(c) - n + 1), lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, n)])))
    return F.when(F.length(text) >= n, F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), grams)[0]).otherwise(F.array().cast("array<string>"))


def transliterate(text: Column) -> Column:
    """Cyrillic in Latin letters."""
    t = F.lower(text)
    for source, target in CYRILLIC_MULTI:
        t = F.replace(t, F.lit(source), F.lit(target))
    return F.translate(t, CYRILLIC_SINGLE, LATIN_SINGLE)


def latin_to_cyrillic(text: Column) -> Column:
    """Latin in Cyrillic letters, in lower case, groups of letters first."""
    t = F.lower(text)
    # groups are marked first, so that letters which replace one aren't taken for part of another
    for k, (source, _) in enumerate(LATIN_MULTI):
        t = F.replace(t, F.lit(source), F.lit(chr(0xE000 + k)))
    t = F.replace(F.translate(t, LATIN_LETTERS, LATIN_AS_CYRILLIC), F.lit("x"), F.lit("кс"))
    for k, (_, target) in enumerate(LATIN_MULTI):
        t = F.replace(t, F.lit(chr(0xE000 + k)), F.lit(target))
    return t


def script_variants(text: Column) -> Column:
    """A name in canonical form as it stands, in Latin and in Cyrillic, each once."""
    t = canonical(text)
    return F.array_distinct(F.array(t, canonical(transliterate(t)), canonical(latin_to_cyrillic(t))))


def expanded(text: Column) -> Column:
    """A text in canonical form followed by its two transliterations, on lines of their own."""
    return F.array_join(script_variants(text), "\n")


def form_pattern(form: Column, spaced: bool = True) -> Column:
    """The regular expression of a form in a text: whole words, with blanks or hyphens between them and, if ``spaced``, up to two between letters."""
    between = r"[\s\-]{0,2}" if spaced else ""
    letters = lambda w: F.array_join(F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), c).otherwise(F.concat(F.lit("\\"), c))), between)
    body = F.array_join(F.transform(F.filter(F.split(form, r"[\s\-]+"), lambda w: w != ""), letters), r"[\s\-]+")
    return F.concat(F.lit(r"(?iuU)(?<!\w)"), body, F.lit(r"(?!\w)"))


def form_matches(form: Column, text: Column, transliterated: bool = True, spaced: bool = True) -> Column:
    """Whether a form, or with ``transliterated`` one of its variants, stands in a text as whole words; both in any case and script."""
    held = expanded(text) if transliterated else canonical(text)
    variants = script_variants(form) if transliterated else F.array(canonical(form))
    return F.exists(variants, lambda v: v.rlike(r"[^\s\-]") & F.regexp_like(held, form_pattern(v, spaced)))


def first_word(form: Column) -> Column:
    """The first word of a form, by blanks and hyphens."""
    return F.coalesce(F.get(F.filter(F.split(F.trim(form), r"[\s\-]+"), lambda w: w != ""), F.lit(0)), F.lit(""))


def word_start(text: Column, q: str) -> Column:
    """Whether a word of the text starts with ``q``, in any case and script."""
    return text.rlike(rf"(?iu)(^|[^0-9A-Za-zА-Яа-яЁё])\Q{q}\E")


def like_substring(text: Column, q: str) -> Column:
    """ILIKE with the pattern characters of ``q`` taken as they are."""
    escaped = q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.ilike(f"%{escaped}%")


def looks_spaced(text: Column) -> Column:
    """Whether recognised text is torn into single letters: of four tokens or more, 35 % at least."""
    w = words(text)
    return (F.size(w) >= 4) & (F.size(F.filter(w, lambda t: t.rlike(r"^\p{L}$"))) >= 0.35 * F.size(w))


def collapse_spaced(text: Column) -> Column:
    """Three or more letters with single blanks between them become a word."""
    return F.regexp_replace(text, r"(?<=(?:^|\s)\p{L}) (?=\p{L}(?:\s|$))", "")


def significant_lines(text: Column, least: int = 3) -> Column:
    """A label's lines in canonical form, without short ones and those that any label may hold."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical)
    return F.filter(lines, lambda x: (F.length(x) >= least) & ~x.isin(*GENERIC_LINES))


def line_count(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""))


def text_counts(text: Column) -> Column:
    """A struct of the numbers of lines that aren't blank, of characters and of words."""
    return F.struct(line_count(text).alias("lines"), F.length(F.coalesce(text, F.lit(""))).alias("chars"), F.size(words(text)).alias("words"))


def first_numbers(text: Column) -> Column:
    """Numbers as doubles, a comma read as a point."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.translate(x, ",", ".").try_cast("double"))


def years(text: Column, as_of_year: int) -> Column:
    """Distinct years from 1950 to the year after ``as_of_year``."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)(?:19|20)\d{2}(?!\d)"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda y: y.between(1950, as_of_year + 1)))
