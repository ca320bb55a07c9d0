"""Text as columns: tokens, words, sentences, readability, labels. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists.
ABSTRACT_STOPS = "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should this that these those we our study studies research method methods analysis using used".split()
TITLE_STOPS = "the a an and or but in on at to for of with".split()
BIGRAM_STOPS = "this that with from they were have been".split()
COOCCURRENCE_STOPS = [*BIGRAM_STOPS, *"using used study method analysis".split()]
CLOUD_STOPS = [*COOCCURRENCE_STOPS, "research"]


def letter_words(text: Column, least: int = 3) -> Column:
    """Lower-case words of ``least`` or more ASCII letters; a word with any other letter, digit or underscore is none."""
    whole = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(whole, lambda w: w.rlike(f"^[a-z]{{{least},}}$"))


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def filled(text: Column) -> Column:
    """Not null and not only white space."""
    return F.coalesce(F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0, F.lit(False))


def normalized(text: Column) -> Column:
    """Symbols to spaces, white space to one space, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")))


def readability(text: Column) -> Column:
    """206.835 - 1.015 words a sentence, held between 0 and 100; 50 without words or sentences. Sentences end at full stops."""
    n = word_count(text)
    parts = F.size(F.filter(F.split(text, r"\."), lambda s: F.length(F.trim(F.regexp_replace(s, r"\s+", " "))) > 0))
    score = F.lit(206.835) - F.lit(1.015) * n / parts
    return F.when((n == 0) | (parts == 0), F.lit(50.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def flesch(text: Column) -> Column:
    """Flesch reading ease with vowel groups as syllables (at least one a word) and sentences by .!?"""
    lower = F.lower(F.coalesce(text, F.lit("")))
    n, syllables = F.regexp_count(lower, F.lit(r"[\p{L}\p{N}']+")), F.regexp_count(lower, F.lit(r"[aeiouyàâäáéèêëíîïóôöúûüùœæ]+"))
    parts = F.greatest(F.regexp_count(lower, F.lit(r"[.!?]+")), F.lit(1))
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(206.835 - 1.015 * n / parts - 84.6 * F.greatest(syllables, n) / n)


def shortened(text: Column, most: int) -> Column:
    """Labels: cut at ``most`` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def bigrams(tokens: Column, stops: list[str]) -> Column:
    """Neighbouring tokens of one text, unless the first is a stop word. tokens must be a named column."""
    pairs = F.transform(tokens, lambda w, i: F.when(~w.isin(stops), F.concat_ws(" ", w, F.get(tokens, i + 1))))
    return F.filter(F.slice(pairs, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda b: b.isNotNull())


def sentence_lengths(text: Column, longer_than: int = 3) -> Column:
    """Word counts of the parts between .!? that have more than ``longer_than`` words."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: F.regexp_count(s, F.lit(r"\S+"))), lambda n: n > longer_than)


def clean_pmid(pmid: Column) -> Column:
    return F.replace(F.replace(pmid, F.lit("PMID:"), F.lit("")), F.lit("pmid:"), F.lit(""))


def with_pmid_prefix(pmid: Column) -> Column:
    return F.when(pmid.startswith("PMID:") | pmid.startswith("pmid:"), pmid).otherwise(F.concat(F.lit("PMID:"), pmid))


def with_pmc_prefix(pmcid: Column) -> Column:
    return F.when(pmcid.startswith("PMC") | pmcid.startswith("pmc"), pmcid).otherwise(F.concat(F.lit("PMC"), pmcid))
