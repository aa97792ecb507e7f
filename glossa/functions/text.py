"""Column expressions over prose: sentences, words, syllables, grades, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a full stop ends no sentence (without their last stop).
ABBREVIATIONS = ["dr", "e.g", "etc", "fig", "i.e", "mr", "mrs", "ms", "no", "prof", "vs"]
#: A word is letters and digits, joined inside by one mark.
WORD = r"[\p{L}\p{N}]+(?:['’\-.,:/][\p{L}\p{N}]+)*"
FIGURE_CHARACTERS = 3
FIGURE_SYLLABLES = 1
_CUT, _STOP = "\x01", "\x02"
#: White space as SQL's patterns have it: no vertical tab. The end is ``\\z``, as Java's ``$`` is also before a last line break.
_BLANK = r"[\t\n\f\r ]"


def abbreviation_pattern() -> str:
    return "(?i)(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + rf")\.({_BLANK}|\z)"


def sentence_array(text: Column) -> Column:
    """Sentences: cut after ``.!?`` before white space or the end, unless an abbreviation ends there."""
    masked = F.regexp_replace(text, abbreviation_pattern(), f"$1{_STOP}$2")
    marked = F.regexp_replace(masked, rf"([.!?])({_BLANK}|\z)", f"$1{_CUT}")
    parts = F.transform(F.split(marked, _CUT), lambda s: F.trim(F.regexp_replace(F.translate(s, _STOP, "."), f"{_BLANK}+", " ")))
    return F.filter(parts, lambda s: s != "")


def sentences(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row a sentence: ``keep`` columns, sentence_index from 0, sentence."""
    return docs.select(*keep, F.posexplode(sentence_array(F.col("text"))).alias("sentence_index", "sentence"))


def among(word: Column, listed: list[str]) -> Column:
    """Whether a word is in a list, as one literal; null for a null word."""
    return F.array_contains(F.split(F.lit("\t".join(listed)), "\t"), word)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


_VOWELS, _CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"


def _spelled(word: Column) -> Column:
    """Syllables of one part by spelling; what stands before an apostrophe counts.

    Letters become their shape, vowel or consonant; a syllable is a run of vowels. A leading y joins the vowel
    after it or stands alone, so it needs no case of its own.
    """
    base = F.substring_index(F.translate(F.lower(word), "’", "'"), "'", 1)
    letters = F.regexp_replace(base, "[^a-z]", "")
    shape = F.concat(F.lit("c"), F.translate(letters, _VOWELS + _CONSONANTS, "v" * len(_VOWELS) + "c" * len(_CONSONANTS)))
    runs = ((F.length(shape) - F.length(F.replace(shape, F.lit("cv"), F.lit("")))) / 2).cast("int")
    silent_e = letters.endswith("e") & (runs > 1) & ~(letters.endswith("le") & shape.endswith("ccv") & (F.length(letters) > 2))
    less_e = runs - F.when(silent_e, 1).otherwise(0)
    silent_ed = (less_e > 1) & letters.endswith("ed") & ~letters.endswith("ted") & ~letters.endswith("ded")
    return F.greatest(F.lit(1), less_e - F.when(silent_ed, 1).otherwise(0))


def syllables(word: Column) -> Column:
    """Syllables by spelling; words joined by ``-./,:`` are the sum of their parts."""
    parts = F.regexp_extract_all(word, F.lit(r"[^\-./,:]+"), F.lit(0))
    summed = F.aggregate(F.transform(parts, _spelled), F.lit(0), lambda a, x: a + x)
    return F.when(word.rlike(r"[\-./,:]") & word.rlike(r"\p{L}"), summed).otherwise(_spelled(word))


COUNTS = ["words", "syllables", "characters", "polysyllables", "figures"]


def word_counts(words_: Column, normalize: bool = True) -> Column:
    """struct of ``COUNTS`` (long) over an array of words.

    A figure (a word with a digit) counts one syllable and three characters when normalised.
    """

    def measured(w: Column) -> Column:
        figure = w.rlike(r"\p{Nd}") if normalize else F.lit(False)
        n = F.when(figure, FIGURE_SYLLABLES).otherwise(syllables(w))
        chars = F.when(figure, FIGURE_CHARACTERS).otherwise(F.length(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
        return F.struct(n.cast("long").alias("n"), chars.cast("long").alias("c"), figure.alias("f"))

    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    one = lambda test: F.when(test, 1).otherwise(0).cast("long")

    def added(a: Column, x: Column) -> Column:
        return F.struct(
            (a["words"] + 1).alias("words"), (a["syllables"] + x["n"]).alias("syllables"), (a["characters"] + x["c"]).alias("characters"),
            (a["polysyllables"] + one(~x["f"] & (x["n"] >= 3))).alias("polysyllables"), (a["figures"] + one(x["f"])).alias("figures"),
        )

    return F.aggregate(F.transform(words_, measured), zero, added)


def grades(words_: str = "words", sentences_: str = "sentences") -> dict[str, Column]:
    """The six estimates, half-up to hundredths; null without words or sentences."""
    w, s, syl, c, p = (F.col(x).cast("double") for x in (words_, sentences_, "syllables", "characters", "polysyllables"))
    out = {
        "flesch_kincaid": 0.39 * w / s + 11.8 * syl / w - 15.59,
        "flesch_ease": 206.835 - 1.015 * w / s - 84.6 * syl / w,
        "coleman_liau": 0.0588 * (100 * c / w) - 0.296 * (100 * s / w) - 15.8,
        "smog": 1.0430 * F.sqrt(p * 30 / s) + 3.1291,
        "fog": 0.4 * (w / s + 100 * p / w),
        "ari": 4.71 * c / w + 0.5 * w / s - 21.43,
    }
    fine = (F.col(words_) > 0) & (F.col(sentences_) > 0)
    return {k: F.when(fine, F.round(v, 2)) for k, v in out.items()}


def line_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of a 0-based code point offset."""
    before = F.substring(text, 1, offset) if isinstance(offset, int) else F.substr(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1, F.length(F.substring_index(before, "\n", -1)) + 1


def severity(observed: Column, threshold: Column) -> Column:
    """By the ratio to the threshold (to one where it is 0): 2 and more is high, 1.35 and more medium."""
    ratio = F.when(threshold == 0, observed.cast("double")).otherwise(observed / threshold)
    return F.when(ratio >= 2, "high").when(ratio >= 1.35, "medium").otherwise("low")
