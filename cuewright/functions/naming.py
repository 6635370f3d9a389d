"""Column functions on the names of subtitle files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cuewright.functions.language import language_name, normalized

# fixed values: extensions of sidecar files
EXTENSIONS = [".srt", ".ass", ".ssa", ".vtt", ".sub", ".sup", ".idx", ".smi"]


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def has_token(name: Column, marker: str) -> Column:
    """Whether one of the parts between dots is the marker."""
    bare = marker.strip().strip(".").lower()
    return F.lit(False) if not bare else F.array_contains(F.split(F.lower(stem(name)), r"\."), bare)


def classify(name: Column, repaired: str, heard: str) -> Column:
    """Heard, Repaired or External; the marker of a transcript is tried first."""
    return F.when(has_token(name, heard), "Heard").when(has_token(name, repaired), "Repaired").otherwise("External")


def is_ours(name: Column, repaired: str, heard: str) -> Column:
    return classify(name, repaired, heard) != "External"


def belongs_to(name: Column, media: Column) -> Column:
    own, base = F.lower(stem(name)), F.lower(stem(media))
    return F.lower(extension(name)).isin(EXTENSIONS) & (base != "") & ((own == base) | F.startswith(own, F.concat(base, F.lit("."))))


def language_of(name: Column, media: Column) -> Column:
    """The first part after the media's stem as a language code; '' if there is none."""
    own, base = stem(name), stem(media)
    rest = F.substr(own, F.length(base) + 2, F.length(own))
    parts = F.filter(F.transform(F.split(rest, r"\."), normalized), lambda x: x != "")
    inside = F.startswith(F.lower(own), F.concat(F.lower(base), F.lit(".")))
    return F.when(inside, F.coalesce(F.get(parts, F.lit(0)), F.lit(""))).otherwise("")


def file_token(path: Column) -> Column:
    return F.concat(F.lit("file_"), F.substring(F.sha2(F.encode(path, "UTF-8"), 256), 1, 16))


def sidecar_name(media: Column, language: Column, impaired: Column, marker: str) -> Column:
    """stem[.language][.sdh].marker.srt"""
    return F.concat_ws(".", stem(media), F.when(language != "", language), F.when(impaired, "sdh"), F.lit(marker.strip().strip(".")), F.lit("srt"))


# fixed values: extensions of files that hold text
EDITABLE = [".srt", ".ass", ".ssa", ".vtt"]


def source_label(language: Column, forced: Column, impaired: Column, is_text: Column, default: Column) -> Column:
    """``English (forced, SDH)``."""
    flags = F.concat_ws(", ", F.when(forced, "forced"), F.when(impaired, "SDH"), F.when(~is_text, "image"), F.when(default, "default"))
    return F.concat(language_name(language), F.when(flags == "", "").otherwise(F.concat(F.lit(" ("), flags, F.lit(")"))))


def track_label(index: Column, language: Column, external: Column, forced: Column, impaired: Column, is_text: Column) -> Column:
    """``#2 English (embedded, SDH)``."""
    inner = F.concat_ws(", ", F.when(external, "external").otherwise("embedded"), F.when(forced, "forced"), F.when(impaired, "SDH"), F.when(~is_text, "image"))
    return F.concat(F.lit("#"), index.cast("string"), F.lit(" "), language_name(language), F.lit(" ("), inner, F.lit(")"))


def file_size(size: Column) -> Column:
    """Bytes, or KB or MB with at most one decimal."""
    short = lambda x: F.regexp_replace(F.format_string("%.1f", F.round(x, 1)), r"\.0$", "")
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(short(size / 1024.0), F.lit(" KB"))).otherwise(F.concat(short(size / 1048576.0), F.lit(" MB")))
