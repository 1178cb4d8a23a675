"""Telugu script in Latin letters: letter rules, maps of words, case endings.

The vocabulary is transliterated, not the text: distinct words are converted once and put back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The letters of the script. Independent vowels, vowel signs, consonants.
VOWELS = dict(zip("అఆఇఈఉఊఋఎఏఐఒఓఔ", "a aa i ee u oo ru e e ai o o au".split()))
SIGNS = dict(zip("ాిీుూృెేైొోౌ", "aa i ee u oo ru e e ai o o au".split()))
CONSONANTS = dict(zip("కఖగఘఙచఛజఝఞటఠడఢణతథదధనపఫబభమయరఱలళవశషసహ", "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n p ph b bh m y r r l l v sh sh s h".split()))
VIRAMA, ANUSVARA, VISARGA = "్", "ం", "ః"
LABIAL = frozenset("పఫబభమ")
_TOKEN = re.compile("[ఀ-౿‌‍]+")
_MARKUP = re.compile(r"(<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>)", re.S | re.I)


def letters(word: str, style: str = "casual") -> str:
    """A word by letter rules. A consonant has an ``a`` unless a sign or virama follows; anusvara is
    ``m`` before a labial or at the end, else ``n``. The style ``simple`` writes long vowels short."""
    out, n = [], len(word)
    for i, c in enumerate(word):
        nxt = word[i + 1] if i + 1 < n else ""
        if c in CONSONANTS:
            out.append(CONSONANTS[c] + ("" if nxt in SIGNS or nxt == VIRAMA else "a"))
        elif c in SIGNS:
            out.append(SIGNS[c])
        elif c in VOWELS:
            out.append(VOWELS[c])
        elif c == ANUSVARA:
            out.append("n" if nxt in CONSONANTS and nxt not in LABIAL else "m")
        elif c == VISARGA:
            out.append("h")
        elif "౦" <= c <= "౯":
            out.append(str(ord(c) - ord("౦")))
    text = "".join(out)
    if style == "simple":
        for a, b in (("aa", "a"), ("ee", "i"), ("oo", "u")):
            text = text.replace(a, b)
    return text


# Case endings that keep their spelling after a mapped stem.
ENDINGS = {"లో": "lo", "కి": "ki", "కు": "ku", "ని": "ni", "ను": "nu", "తో": "tho", "లు": "s", "ల": "la", "గా": "gaa", "కోసం": "kosam", "నుండి": "nundi"}


def word(w: str, lexicon: dict[str, str], style: str = "casual") -> str:
    """The lexicon first, then a lexicon stem with a case ending, then letter rules; ``-`` asks for the rules."""
    w = w.replace("‌", "").replace("‍", "")
    hit = lexicon.get(w)
    if hit is not None:
        return letters(w, style) if hit == "-" else hit
    for ending in sorted(ENDINGS, key=len, reverse=True):
        stem = w[: -len(ending)] if w.endswith(ending) else ""
        if stem and lexicon.get(stem, "-") != "-":
            return lexicon[stem] + ENDINGS[ending]
    return letters(w, style)


def text(t: str, lexicon: dict[str, str], style: str = "casual", both: bool = False) -> str:
    """A text with every Telugu word transliterated; with ``both`` the word stays and its spelling follows."""
    return _TOKEN.sub(lambda m: f"{m.group(0)} ({word(m.group(0), lexicon, style)})" if both else word(m.group(0), lexicon, style), t)


def markup(t: str, lexicon: dict[str, str], style: str = "casual") -> str:
    """The same for the text between tags only; scripts, styles and comments stay."""
    parts = _MARKUP.split(t)
    return "".join(p if i % 2 else text(p, lexicon, style) for i, p in enumerate(parts))


def vocabulary(stories: DataFrame, col: str = "original_text") -> DataFrame:
    """(word, n): the Telugu words of all texts and how often they occur."""
    found = F.explode(F.regexp_extract_all(F.col(col), F.lit(r"[\x{0C00}-\x{0C7F}\x{200C}\x{200D}]+"), F.lit(0)))
    return stories.where(F.col(col).isNotNull()).select(found.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def transliterated(words: DataFrame, lexicon: dict[str, str] | None = None, style: str = "casual") -> DataFrame:
    """(word, n, latin): each distinct word once."""
    known = dict(lexicon or {})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(latin=[word(w, known, style) for w in b["word"]])

    return words.select("word", "n").mapInPandas(work, "word string, n long, latin string")


def romanized(stories: DataFrame, lexicon: dict[str, str] | None = None) -> DataFrame:
    """(story_id, romanized): the transliteration of every text with Telugu letters."""
    known = dict(lexicon or {})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, str] = {}

        def once(m):
            w = m.group(0)
            if w not in memo:
                if len(memo) > 500_000:
                    memo.clear()
                memo[w] = word(w, known)
            return memo[w]

        for b in batches:
            yield pd.DataFrame({"story_id": b["story_id"], "romanized": [_TOKEN.sub(once, t) for t in b["original_text"]]})

    rows = stories.where(F.col("original_text").rlike(r"[\x{0C00}-\x{0C7F}]")).select("story_id", "original_text")
    return rows.mapInPandas(work, "story_id long, romanized string")


def lexicon_votes(stories: DataFrame, min_votes: int = 2) -> DataFrame:
    """(word, latin, votes): the most common spelling of each word among rows whose text and
    transliteration have equally many words; ties go to the spelling that comes first."""
    a, b = F.split(F.trim(F.regexp_replace("original_text", r"\s+", " ")), " "), F.split(F.trim(F.regexp_replace("romanized_text", r"\s+", " ")), " ")
    rows = stories.where("original_text <> '' and romanized_text <> ''").select(a.alias("_a"), b.alias("_b")).where("size(_a) = size(_b)")
    pairs = rows.select(F.inline(F.arrays_zip("_a", "_b"))).where(F.col("_a").rlike(r"^[\x{0C00}-\x{0C7F}]+$") & F.col("_b").rlike("^[A-Za-z]+$"))
    votes = pairs.groupBy(F.col("_a").alias("word"), F.lower("_b").alias("latin")).agg(F.count(F.lit(1)).alias("votes"))
    # the most votes, then the smallest spelling
    best = votes.groupBy("word").agg(F.min_by(F.struct("latin", "votes"), F.struct((-F.col("votes")).alias("v"), F.col("latin").alias("l"))).alias("_x"))
    return best.select("word", "_x.latin", "_x.votes").where(F.col("votes") >= min_votes)
