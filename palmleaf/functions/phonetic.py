"""How words sound: keys by which loan words in Telugu script are matched with English spellings.

Both sides are brought to one rough notation by chains of replacements inside the JVM. Words with
the same consonants are candidates (an equi-join on the outline, never all pairs), and a
distance that is mild on vowels picks among them. Lower case marks consonants and short vowels; while the
rules run, capitals I U O E mark long vowels, Q is a long a, A the a of "fan", @ a neutral vowel.

Nulls: a NULL word has a NULL sound and no candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English spelling to sound, in this order.
ENGLISH_RULES = (
    ("^kn", "n"), ("^wr", "r"), ("^ps", "s"), ("mb$", "m"), ("tion|ssion|sion", "sh@n"), ("ture", "ch@r"),
    ("ai(?=l)", "EyI"), ("ai(?=[^n])", "E"), ("ay$", "E"), ("igh", "aI"), ("gh", ""), ("oa", "O"), ("ph", "f"), ("ck", "k"),
    ("sch", "sk"), ("chr", "kr"), ("^ch(?=r|l)", "k"), ("qu", "kv"), ("q", "k"), ("x", "ks"),
    ("tch", "ch"), ("c(?=[eiy])", "s"), ("c(?!h)", "k"), ("dge", "j"), ("g(?=[eiy])", "j"),
    ("ou|ow(?=[nl])", "aU"), ("ow$", "O"), ("th", "t"), ("wh", "v"), ("w", "v"), ("z", "j"),
    ("ee|ea|ie", "I"), ("oo", "U"), ("y$", "I"), ("ar(?=[^aeiouIUOE]|$)", "Qr"), ("[eoiu]r(?=[^aeiouIUOE]|$)", "@r"),
    ("a([^aeiou@IUOE])e$", "E$1"), ("i([^aeiou@IUOE])e$", "aI$1"), ("o([^aeiou@IUOE])e$", "O$1"), ("u([^aeiou@IUOE])e$", "yU$1"),
    ("(?<=[^aeiouIUOE])e$", ""), ("(?<=[^aeiou])a(?=(?:sh|ch|[^aeiouyAQ@IUOE])[aeiou@IUOE])", "E"),
    ("a(?=[^aeiouyAQ@IUOEr](?:[^aeiouyAQ@IUOE]|$))", "A"), ("o(?=[^aeiouyAQ@IUOE](?:[^aeiouyAQ@IUOE]|$))", "Q"),
    ("u(?=[^aeiouyAQ@IUOE](?:[^aeiouyAQ@IUOE]|$))", "a"),
)
# Telugu in Latin letters to sound, in this order.
TELUGU_RULES = (
    ("(?<=[^aeiou])yaa", "A"), ("(?<=[^aeiou])y(?=oo|u)", ""), ("aa", "Q"), ("ee", "i"), ("oo", "u"), ("chh", "ch"),
    ("kh", "k"), ("gh", "g"), ("jh", "j"), ("th", "t"), ("dh", "d"), ("ph", "f"), ("bh", "b"), ("ar(?=[^aeiouAQ]|$)", "@r"),
)
# Vowels, and what it costs to take one for another; 0.5 for any other pair.
VOWELS = "aeiouAQ@"
CLOSE = {"au": 0.25, "ao": 0.35, "Qo": 0.5, "Qa": 0.35, "QA": 0.25, "aA": 0.35, "a@": 0.0, "ae": 0.4, "ie": 0.4}
# Cost of a consonant, of a vowel beside another one, and of any other vowel that only one word has.
CONSONANT, BESIDE, ALONE = 1.0, 0.3, 0.8
#: A guess is accepted up to this distance, or this share of the length; a word of rank r costs r / RANKS more than the first.
LIMIT, LIMIT_SHARE, RANKS = 0.5, 0.08, 25_000


def _chain(word: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, sound in rules:
        word = F.regexp_replace(word, pattern, sound)
    return word


def _single(word: Column) -> Column:
    return F.regexp_replace(word, r"(.)\1+", "$1")


def english_sound(word: Column) -> Column:
    """The sound of an English spelling."""
    return _single(F.translate(_chain(F.lower(word), ENGLISH_RULES), "IUOE", "iuoe"))


def telugu_sound(latin: Column) -> Column:
    """The sound of a Telugu word in Latin letters."""
    return _single(_chain(F.lower(latin), TELUGU_RULES))


def outline(sound: Column) -> Column:
    """The consonants of a sound; ``sh`` and ``ch`` are one each."""
    return F.regexp_replace(F.replace(F.replace(sound, F.lit("sh"), F.lit("S")), F.lit("ch"), F.lit("C")), f"[{VOWELS}y]", "")


def _costs(word: str) -> np.ndarray:
    vowel = np.array([c in VOWELS for c in word], bool)
    beside = np.zeros(len(word), bool)
    beside[1:] |= vowel[:-1]
    beside[:-1] |= vowel[1:]
    return np.where(vowel, np.where(beside, BESIDE, ALONE), CONSONANT)


_SWAP = {frozenset(k): v for k, v in CLOSE.items()}


def distance(a: str, b: str) -> float:
    """Weighted edit distance of two sounds: the cheapest path through the table of their prefixes."""
    drop, add = _costs(a), _costs(b)
    table = np.zeros((len(a) + 1, len(b) + 1))
    table[1:, 0], table[0, 1:] = np.cumsum(drop), np.cumsum(add)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            swap = 0.0 if x == y else _SWAP.get(frozenset((x, y)), 0.5) if x in VOWELS and y in VOWELS else 1.0
            table[i + 1, j + 1] = min(table[i, j] + swap, table[i, j + 1] + drop[i], table[i + 1, j] + add[j])
    return float(table[-1, -1])


def guesses(words: DataFrame, english: DataFrame) -> DataFrame:
    """(word, guess, distance) of the words (word, latin) whose sound an English word (english, rank) has.

    Only outlines of at least two consonants are matched. The best score, distance and rank, wins, ties by
    the smaller rank and the spelling. Both tables are small next to the texts: distinct words and a ranked list.
    """
    left = words.select("word", telugu_sound(F.col("latin")).alias("a")).withColumn("_k", outline(F.col("a"))).where(F.length("_k") >= 2).distinct()
    right = english.where("english is not null").groupBy(F.lower("english").alias("english")).agg(F.min("rank").alias("rank"))
    right = right.withColumn("b", english_sound(F.col("english"))).withColumn("_k", outline(F.col("b")))
    pairs = left.join(right, "_k").select("word", "a", "english", "b", "rank")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield f.assign(distance=[distance(x, y) for x, y in zip(f["a"], f["b"])])[["word", "a", "english", "rank", "distance"]]

    found = pairs.mapInPandas(measure, "word string, a string, english string, rank long, distance double")
    score = F.struct((F.col("distance") + F.col("rank") / RANKS).alias("s"), F.col("rank").alias("r"), F.col("english").alias("e"))
    best = found.groupBy("word", "a").agg(F.min_by(F.struct("english", "distance"), score).alias("_b"))
    return best.where(F.col("_b.distance") <= F.greatest(F.lit(LIMIT), LIMIT_SHARE * F.length("a"))).select("word", F.col("_b.english").alias("guess"), F.round("_b.distance", 6).alias("distance"))


def gated(corpus: DataFrame, words: DataFrame, guessed: DataFrame) -> DataFrame:
    """(word, latin) of a corpus of spellings that can be trusted: equal to the letter rules (word, latin), or to the guess of the word."""
    df = corpus.select("word", F.col("latin").alias("_c")).join(words.select("word", F.col("latin").alias("_r")).distinct(), "word").join(guessed.select("word", "guess"), "word", "left")
    same = (F.lower("_c") == F.lower("_r")) | F.coalesce(F.lower("_c") == F.lower("guess"), F.lit(False))
    return df.where(same).select("word", F.col("_c").alias("latin"))
