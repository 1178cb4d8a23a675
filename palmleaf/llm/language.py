"""Language labels for documents and for the lines of mixed documents.

Method: compression classification. Every language has a raw-content zstandard dictionary; a text belongs to the
language whose dictionary encodes it in the fewest bytes. A piece whose margin is narrow is rejected: it is
cut into sentences that decide by themselves, and what stays narrow is encoded once more as one
text, among the languages of its script only. It keeps the smallest encoding there (a tie goes with the row's
language of that script), but counts as rejected: its confidence is under one half.

A line that holds several scripts is cut where the script changes; every piece is classified by itself, and the
line's language is the one of most letters. Confidence is the mean over the letters of the line, or row, of
margin / (margin + MARGIN) where they are of its language and of 0 where they aren't, so it is one half at the margin that
rejects, and ``rejected`` tells the lines below.

The dictionaries are fitted on about ``sample_rows`` rows of documents that carry a language label, never more (the documented
bound), of whole texts, and on the lines that recur most over all rows of the stories, which the labelled texts don't have. The flag of a story can't serve for that: it is 0 on most romanised rows, so it doesn't tell en from te_latn;
``documents.lang`` does. Labels are wrong at times, so the fit first cleans the sample in rounds by the odds of its
words. Everything else covers all rows and whole texts. Each row is independent: no shuffle, no hot group.

Nulls: a NULL or empty text, or one without a line of ``min_letters`` letters, gets no language. A NULL
label counts as missing. Without any labelled row every text gets the language of its script.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.lines import line_key, numbered_lines
from palmleaf.llm.words import NOT_LETTER, words
from palmleaf.session import spread

#: The languages, and the scripts that they are written in.
LANGUAGES = ("en", "te", "te_latn", "hi")
SCRIPT_OF = {"en": "latin", "te_latn": "latin", "te": "telugu", "hi": "devanagari"}

SAMPLE_ROWS = 1_500
DICTIONARY_BYTES = 48_000
ROUNDS = 3
MARGIN = 0.04
MIN_LETTERS = 40
#: Lines that stand in so many rows may enter the dictionaries, the most frequent first; at most so many fit into them.
MIN_ROWS, RECURRING_LINES = 4, 4_000
#: Log odds of its trigrams from which a recurring line is clear.
CLEAR_ODDS = 4.0
_LEVEL = 3

_TELUGU = re.compile("[ఀ-౿]")
_DEVANAGARI = re.compile("[ऀ-ॣ०-ॿ]")
_PIECE = re.compile("[ఀ-౿](?:[^A-Za-zÀ-ɏऀ-ॣ०-ॿ]*[ఀ-౿])*|[ऀ-ॣ०-ॿ](?:[^A-Za-zÀ-ɏఀ-౿]*[ऀ-ॣ०-ॿ])*|[A-Za-zÀ-ɏ](?:[^ऀ-ॣ०-ॿఀ-౿]*[A-Za-zÀ-ɏ])*")
_SENTENCES = re.compile(r"(?<=[.!?…।;])\s+")


def n_letters(text: str) -> int:
    """Unicode letters and combining marks."""
    return len(NOT_LETTER.sub("", text))


class Classifier:
    """Sizes of a text under the dictionary of each language."""

    def __init__(self, contents: dict):
        self.encoders = {}
        params = zstandard.ZstdCompressionParameters.from_level(_LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        for name in LANGUAGES:
            # a language without a sample has its script's letters only
            d = zstandard.ZstdCompressionDict(contents.get(name) or _ALPHABET[SCRIPT_OF[name]], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.encoders[name] = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress

    def __call__(self, text: str, names: tuple[str, ...] = LANGUAGES) -> tuple[str, float]:
        """(language, margin): the smallest encoding, and by what share the next one is larger."""
        raw = prepared(text).encode("utf-8", "surrogatepass")
        sizes = [len(self.encoders[x](raw)) for x in names]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return names[best], (rest - sizes[best]) / max(1, sizes[best])

    def line(self, text: str) -> list[tuple[str, float, float]]:
        """(language or ``?script`` for a tie, letters, margin) of the pieces of a line."""
        out, narrow = [], {}
        pieces = _PIECE.findall(text) or [text]
        for piece in pieces if len(pieces) > 1 else [text]:
            lang, margin = self(piece)
            if margin >= MARGIN:
                out.append((lang, n_letters(piece), margin))
                continue
            for part in _SENTENCES.split(piece):
                n = n_letters(part)
                if n:
                    lang, margin = self(part)
                    if margin >= MARGIN:
                        out.append((lang, n, margin))
                    else:
                        narrow.setdefault(_script(part), []).append(part)
        for script, rest in narrow.items():
            rivals = tuple(x for x in LANGUAGES if SCRIPT_OF[x] == script)
            whole = " ".join(rest)
            lang, margin = self(whole, rivals) if len(rivals) > 1 else (rivals[0], MARGIN / 2)
            out.append((lang if margin > 0 else "?" + script, n_letters(whole), min(margin, 0.99 * MARGIN)))
        return out


#: The letters of each script, for languages without a sample.
_ALPHABET = {"latin": bytes(range(97, 123)), "telugu": "".join(map(chr, range(0x0C05, 0x0C4E))).encode(), "devanagari": "".join(map(chr, range(0x0904, 0x094E))).encode()}


def _script(text: str) -> str:
    n = len(NOT_LETTER.sub("", text))
    te, hi = len(_TELUGU.findall(text)), len(_DEVANAGARI.findall(text))
    return "telugu" if 2 * te > n else "devanagari" if 2 * hi > n else "latin"


def fit(documents: DataFrame, stories: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES, rounds: int = ROUNDS) -> dict:
    """The dictionary of each language, from at most ``sample_rows`` labelled rows (doc_id, lang, text), whole texts, and the lines that recur most over all ``stories``.

    The labels are counted first; then one scan takes the rows of the smallest hashes, as many of each language, so the
    sample is the same at every run.
    """
    labelled = documents.where(F.col("lang").isin(*LANGUAGES) & F.col("doc_id").isNotNull())
    each = max(1, sample_rows // len(LANGUAGES))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # at most one row per language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    bound = F.lit(0)
    for name, n in sorted(sizes.items()):
        bound = F.when(F.col("lang") == name, F.lit(int(min(1.0, each / n) * (1 << 40)))).otherwise(bound)
    rows = labelled.where((place < bound) & F.col("text").isNotNull()).select("lang", place.alias("_p"), "doc_id", "text").collect() if sizes else []
    lines: list[tuple[str, str]] = []
    for name in LANGUAGES:
        for lang, _p, _id, text in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2]))[:each]:
            for line in text.split("\n"):
                if n_letters(line) >= MIN_LETTERS:
                    script = _script(line)
                    label = {"telugu": "te", "devanagari": "hi"}.get(script, lang if SCRIPT_OF[lang] == "latin" else None)
                    if label:
                        lines.append((label, line.strip()))
    return dictionaries(lines, recurring_lines(stories), dictionary_bytes, rounds)


def recurring_lines(stories: DataFrame, most: int = RECURRING_LINES) -> list[str]:
    """The lines that recur most over all rows of the stories, at least MIN_ROWS times, letters alone compared.

    Every row counts; ``most`` is how many can have a place in the dictionaries at all. Hashes are counted first, so no text is shuffled.
    """
    rows = stories.where("story_id is not null and original_text is not null and original_text <> ''")
    lines = numbered_lines(rows, "original_text", "story_id").select("line", line_key(F.col("line")).alias("key")).where("key <> ''").select("line", F.xxhash64("key").alias("h"))
    top = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS).orderBy(F.desc("n"), "h").limit(most)
    top = lines.sparkSession.createDataFrame([(r[0], r[1]) for r in top.collect()], "h long, n long")  # at most ``most`` rows of two numbers
    found = lines.join(F.broadcast(top), "h").groupBy("h").agg(F.max("n").alias("n"), F.min("line").alias("line")).collect()
    return [r[2] for r in sorted(found, key=lambda r: (-r[1], r[0]))]


def dictionaries(lines: list[tuple[str, str]], recurring: list[str], dictionary_bytes: int = DICTIONARY_BYTES, rounds: int = ROUNDS) -> dict:
    """Half of each dictionary from the labelled lines, half from recurring lines that the letters of the labelled ones assign clearly."""
    clean = _cleaned(lines, rounds)
    half = dictionary_bytes // 2
    first = _contents(clean, half)
    rivals = [x for x in first if SCRIPT_OF[x] == "latin"]
    odds = _trigram_odds(clean, rivals)
    more = []
    for line in dict.fromkeys(map(prepared, recurring)):
        script = _script(line)
        if script != "latin":
            more.append(({"telugu": "te", "devanagari": "hi"}[script], line))
        elif rivals:
            scores = sorted(((odds(x, line), x) for x in rivals), reverse=True)
            if len(scores) < 2 or scores[0][0] - scores[1][0] > CLEAR_ODDS:
                more.append((scores[0][1], line))
    second = _contents(more, half)
    return {x: second.get(x, b"") + b"\n" + first.get(x, b"") for x in {**first, **second}}


class _Trigrams:
    """Log likelihood of a line's letter trigrams in a language; for the fit only."""

    def __init__(self, tables: dict[str, dict[str, float]]):
        self.tables = tables

    def __call__(self, lang: str, line: str) -> float:
        t = self.tables[lang]
        return sum(t.get(g, t[""]) for g in _trigrams(line))


def _trigram_odds(lines: list[tuple[str, str]], rivals: list[str]) -> _Trigrams:
    counts: dict[str, dict[str, int]] = {x: {} for x in rivals}
    for label, line in lines:
        if label in counts:
            c = counts[label]
            for g in _trigrams(line):
                c[g] = c.get(g, 0) + 1
    tables = {}
    for x, c in counts.items():
        total = sum(c.values()) + 10_000
        tables[x] = {g: math.log((n + 0.5) / total) for g, n in c.items() if n > 1} | {"": math.log(0.5 / total)}
    return _Trigrams(tables)


def _trigrams(line: str) -> list[str]:
    t = " " + " ".join(words(line)) + " "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def prepared(text: str) -> str:
    """What is encoded: lower case, single blanks."""
    return " ".join(text.lower().split())


def _cleaned(lines: list[tuple[str, str]], rounds: int) -> list[tuple[str, str]]:
    """Lines whose words agree with their label. Row labels are wrong at times and mixed
    texts have one label for two languages, so the log odds of the words, counted over
    the whole sample, move or drop a line; a script has few languages, and each round
    counts the words anew."""
    for _ in range(rounds):
        counts: dict[str, dict[str, int]] = {}
        sums: dict[str, int] = {}
        cut = [(label, line, set(words(line))) for label, line in lines]
        for label, _line, ws in cut:
            for w in ws:
                c = counts.setdefault(w, {})
                c[label] = c.get(label, 0) + 1
            sums[label] = sums.get(label, 0) + len(ws)
        kept = []
        for label, line, ws in cut:
            rivals = [x for x in sums if SCRIPT_OF[x] == SCRIPT_OF[label]]
            odds = {x: sum(math.log((counts[w].get(x, 0) + 0.5) / (sums[x] + 1)) for w in ws) for x in rivals}
            best = max(odds, key=lambda x: (odds[x], x))
            second = max((v for x, v in odds.items() if x != best), default=-math.inf)
            if odds[best] - second > 2.0:
                kept.append((best, line))
        lines = kept
    return lines


def _contents(lines: list[tuple[str, str]], limit: int) -> dict[str, bytes]:
    out = {}
    for name in LANGUAGES:
        texts, size = [], 0
        for line in dict.fromkeys(prepared(x) for label, x in lines if label == name):
            raw = line.encode("utf-8", "surrogatepass")
            if size + len(raw) > limit:
                break
            texts.append(raw)
            size += len(raw) + 1
        if texts:
            out[name] = b"\n".join(texts)
    return out


def label_text(text: str, classify: Classifier, min_letters: int = MIN_LETTERS) -> tuple[str, float, list[tuple[int, str, float]]] | None:
    """(language, confidence, [(line_no, language, confidence)]) over the counted lines, or None."""
    counted, clear, number = [], {}, 0
    for line in text.split("\n"):
        if not line.strip():
            continue
        number += 1
        if len(line) < min_letters or n_letters(line) < min_letters:
            continue
        found = classify.line(line)
        counted.append((number, found))
        for lang, n, _ in found:
            if lang[0] != "?":
                clear[lang] = clear.get(lang, 0) + n
    if not counted:
        return None
    out, all_, sure = [], {}, {}
    for no, found in counted:
        sums: dict[str, int] = {}
        weight: dict[str, float] = {}
        for lang, n, margin in found:
            if lang[0] == "?":
                same = [x for x in LANGUAGES if SCRIPT_OF[x] == lang[1:]]
                lang = max(same, key=lambda x: (clear.get(x, 0), -same.index(x)))
            sums[lang] = sums.get(lang, 0) + n
            weight[lang] = weight.get(lang, 0.0) + n * margin / (margin + MARGIN)
        lang = max(sums, key=lambda k: (sums[k], k))
        out.append((no, lang, round(weight[lang] / max(1, sum(sums.values())), 4)))
        for k, v in sums.items():
            all_[k] = all_.get(k, 0) + v
            sure[k] = sure.get(k, 0.0) + weight[k]
    lang = max(all_, key=lambda k: (all_[k], k))
    return lang, round(sure[lang] / max(1, sum(all_.values())), 4), out


def languages(stories: DataFrame, contents: dict, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(story_id, telugu, line_no, lang, confidence, rejected): line_no 0 is the row, the others its counted lines."""
    shared = stories.sparkSession.sparkContext.broadcast(contents)  # at most 4 x dictionary_bytes

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = Classifier(shared.value)
        for b in batches:
            rows = []
            for i, telugu, text in zip(b["story_id"], b["telugu"], b["original_text"]):
                found = label_text(text, classify, min_letters)
                if found:
                    lang, sure, lines = found
                    flag = None if pd.isna(telugu) else int(telugu)
                    rows.append((i, flag, 0, lang, sure))
                    rows += [(i, flag, no, x, c) for no, x, c in lines]
            out = pd.DataFrame(rows, columns=["story_id", "telugu", "line_no", "lang", "confidence"])
            out["telugu"] = out["telugu"].astype("Int64")
            yield out

    rows = stories.select("story_id", F.col("telugu").cast("long").alias("telugu"), "original_text").where("story_id is not null and original_text is not null and original_text <> ''")
    return spread(rows).mapInPandas(label, "story_id long, telugu long, line_no long, lang string, confidence double").withColumn("rejected", F.col("confidence") < 0.5)


def relabel(labelled: DataFrame) -> DataFrame:
    """What a corrected table needs: (story_id, line_no, lang, confidence) of the rows whose
    label is missing or wrong (line_no 0), and of every counted line of a row with several languages."""
    wrong = F.col("telugu").isNull() | (F.col("telugu") != F.col("lang").isin("te", "te_latn").cast("long"))
    rows = labelled.where((F.col("line_no") == 0) & wrong)
    lines = labelled.where("line_no > 0")
    mixed = lines.groupBy("story_id").agg(F.countDistinct("lang").alias("_n")).where("_n > 1").select("story_id")
    return rows.unionByName(lines.join(mixed, "story_id", "left_semi")).select("story_id", "line_no", "lang", "confidence")
