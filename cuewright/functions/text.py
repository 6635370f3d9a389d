"""Column functions on dialogue text. All are built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# fixed values: apostrophes that vanish, phrases of credits, words of music descriptions, sentence ends
APOSTROPHES = "['’‘´]"
CREDITS = [
    "opensubtitles", "subscene", "addic7ed", "yify", "subtitles by",
    "subtitled by", "sync by", "synced by", "corrected by", "resync",
    "translated by", "www.", "http://", "https://", "@gmail", "subs by",
    "encoded by", "ripped by", "explosiveskull",
]
MUSIC = ["music", "theme", "song plays", "instrumental", "singing", "humming"]
SENTENCE_END = "[.!?。！？]$"
# fixed values: white space, and what is cut from a line: markup, annotations in brackets, the speaker, leading dashes
SPACE = r"[\t-\r\x{85}\p{Z}]"
MARKUP = ["<[^>]*>", r"\{[^}]*\}", r"[\[(][^\])]*[\])]"]
SPEAKER = r"^" + SPACE + r"*[-–—]?" + SPACE + r"*[\p{Lu}][\p{Lu}\p{Nd} .'#\-]{1,24}:" + SPACE + "*"
DASHES = "^[-–— ]+"
#: Longest music description; longest cue text.
MUSIC_CHARS, CUE_CHARS = 40, 84


def _fold_table() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character and marks, with their bases."""
    source, target = [], []
    for point in [*range(0xC0, 0xAC00), *range(0xF900, 0x30000)]:  # Hangul syllables have more than one base
        parts = [c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn"]
        if len(parts) == 1 and parts[0] != chr(point):
            source.append(chr(point))
            target.append(parts[0])
    return "".join(source), "".join(target)


_FOLD = _fold_table()
_PLAIN = dict(zip(*_FOLD, strict=True))


def folded(text: Column) -> Column:
    """Lower case without accents; loose marks are dropped."""
    # text of ASCII alone, as much is, has nothing to fold
    return once(F.lower(text), lambda low: F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(low, *_FOLD), r"\p{Mn}+", "")).otherwise(low))


def words(text: Column) -> Column:
    """Runs of letters and digits, folded; apostrophes vanish, all else splits. Null gives no words."""
    bare = F.regexp_replace(folded(F.coalesce(text, F.lit(""))), APOSTROPHES, "")
    return F.filter(F.split(bare, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """``words`` of a text that is at hand."""
    kind = unicodedata.category
    bare = "".join(_PLAIN.get(c, c) for c in text.lower() if kind(c) != "Mn" and c not in APOSTROPHES[1:-1])
    return "".join(c if kind(c)[0] == "L" or kind(c) == "Nd" else " " for c in bare).split()


def collapsed(text: Column) -> Column:
    """Blanks, tabs and line ends as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+", " "), F.lit(" "))


def once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_credits(text: Column) -> Column:
    return F.lower(text).rlike("|".join(m.replace(".", "\\.") for m in CREDITS))


def is_music(text: Column) -> Column:
    """Whether a short line names music; a note sign is not asked for, so "Turn the music off." counts."""
    inner = trimmed(F.translate(text, "♪♫", "  "))
    return F.length(inner).between(1, MUSIC_CHARS) & F.lower(inner).rlike("|".join(MUSIC))


def clean_line(text: Column) -> Column:
    """What is spoken in a line: without markup, annotations, notes and speaker; '' for credits, music and lines without a letter."""
    raw = F.coalesce(text, F.lit(""))
    bare = raw
    for pattern in MARKUP:
        bare = F.regexp_replace(bare, pattern, " ")

    def spoken(t: Column) -> Column:
        said = F.regexp_replace(F.regexp_replace(F.translate(t, "♪♫", "  "), SPEAKER, ""), DASHES, "")
        return trimmed(F.regexp_replace(said, SPACE + "{2,}", " "))

    def kept(t: Column, said: Column) -> Column:
        return F.when(~said.rlike(r"\p{L}") | is_music(t) | is_credits(raw), "").otherwise(said)

    return once(F.when(raw.rlike(r"[<{\[(]"), bare).otherwise(raw), lambda t: once(spoken(t), lambda said: kept(t, said)))


def wrapped(text: Column) -> Column:
    """A line of more than half a cue's characters broken at the blank nearest its middle, the earlier one of two."""

    def broken(line: Column, chars: Column) -> Column:
        middle = F.floor(F.length(line) / 2).cast("int")
        far = F.transform(chars, lambda c, i: F.when(c == " ", F.struct(F.abs(i - middle).alias("far"), i.alias("at"))))
        cut = lambda best: F.when(best.isNotNull(), F.concat(F.substr(line, F.lit(1), best["at"]), F.lit("\n"), F.substr(line, best["at"] + 2, F.length(line)))).otherwise(line)
        return once(F.array_min(far), cut)

    return once(collapsed(text), lambda line: F.when(F.length(line) > CUE_CHARS // 2, once(F.split(line, ""), lambda chars: broken(line, chars))).otherwise(line))


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def stamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm; hours as many as there are, milliseconds cut off."""
    ms = F.floor(F.round(seconds * 1000, 3)).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(ms / 3600000).cast("long")
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def number_text(value: Column) -> Column:
    """A number with at most three decimals, half to even, no trailing zeros."""
    fixed = F.format_string("%.3f", F.bround(value, 3))
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "\\.$", "")
