"""Language identification by shares of frequent words, in two variants, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiremill.functions.text import count_of, letters, once, words

# Frequent words of each language; the order decides ties.
STOPWORDS = {
    "tr": ("ve", "bir", "bu", "ile", "için", "olan", "olarak", "da", "de", "ki", "gibi", "daha", "çok", "ise", "değil", "kadar", "sonra", "onun", "bütün", "her"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "with", "as", "his", "which", "by"),
    "fr": ("le", "la", "les", "et", "des", "du", "un", "une", "est", "que", "dans", "pour", "qui", "pas", "au"),
}
#: Added for corpora in more languages.
MORE = {
    "de": ("der", "die", "und", "das", "den", "ist", "nicht", "mit", "von", "für", "auf", "ein", "im", "sich", "zu"),
    "es": ("el", "los", "las", "del", "por", "con", "para", "una", "se", "no", "es", "su", "como", "y", "lo"),
}
# The blocks of Arabic letters.
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


def _among(known: tuple[str, ...]):
    return lambda w: w.isin(*known)


def measure(text: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """A struct: letters, arabic (share of the letters), n_words, and for each list s_<lang>, the share of the words that it
    holds; Turkish adds half its special letters per word."""

    def scored(found: Column) -> Column:
        total = F.greatest(F.size(found), F.lit(1))
        out = [F.size(found).cast("long").alias("n_words")]
        for lang, known in lists.items():
            share = F.size(F.filter(found, _among(known))) / total
            out.append((share + 0.5 * count_of(F.lower(text), "[çğışöü]") / total if lang == "tr" else share).alias(f"s_{lang}"))
        n = letters(text)
        return F.struct(n.alias("letters"), (count_of(text, ARABIC) / F.greatest(n, F.lit(1))).alias("arabic"), *out)

    return once(words(text), scored)


def _best(m: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    top = F.greatest(*(m[f"s_{x}"] for x in lists))
    out = F.lit(None).cast("string")
    for lang in reversed(lists):
        out = F.when(m[f"s_{lang}"] == top, F.lit(lang)).otherwise(out)
    return out


def pick_strict(m: Column, lists: dict[str, tuple[str, ...]] = STOPWORDS) -> Column:
    """From a measure: null under 40 letters; ar if over 0.3 of the letters are Arabic; else the best score."""
    return F.when(m["letters"] < 40, None).when(m["arabic"] > 0.3, "ar").otherwise(_best(m, lists))


def pick_default(m: Column, lists: dict[str, tuple[str, ...]] = STOPWORDS, default: str = "tr", floor: float = 0.02) -> Column:
    """From a measure: the default under 40 letters or where no score is over the floor; ar if over half the letters are Arabic."""
    top = F.greatest(*(m[f"s_{x}"] for x in lists))
    return F.when(m["letters"] < 40, default).when(m["arabic"] > 0.5, "ar").when(top <= floor, default).otherwise(_best(m, lists))


def detect_strict(text: Column, lists: dict[str, tuple[str, ...]] = STOPWORDS) -> Column:
    return once(measure(text, lists), lambda m: pick_strict(m, lists))


def detect_default(text: Column, lists: dict[str, tuple[str, ...]] = STOPWORDS, default: str = "tr", floor: float = 0.02) -> Column:
    return once(measure(text, lists), lambda m: pick_default(m, lists, default, floor))
