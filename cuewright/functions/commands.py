"""Column functions that build audio commands and prices."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cuewright.functions.text import number_text

#: Seconds decoded before a clip; noise floor in dB; shortest silence in seconds.
PREROLL, NOISE_DB, SILENCE_S = 2.0, -30.0, 0.3
# fixed values: codec options by format
CODECS = {"opus": "-c:a libopus -b:a 16k -f ogg", "mp3": "-c:a libmp3lame -b:a 48k -f mp3", "wav": "-c:a pcm_s16le -f wav"}


def quoted(path: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('\\"')), F.lit('"'))


def clip_arguments(path: Column, start: Column, duration: Column, stream: Column, form: str = "opus") -> Column:
    """A clip of one stream: a coarse seek, then an exact one of at most the preroll."""
    pre = F.least(F.lit(PREROLL), F.greatest(start, F.lit(0.0)))
    parts = [F.lit("-nostdin -hide_banner -loglevel error -accurate_seek -ss"), number_text(F.greatest(start - pre, F.lit(0.0))), F.lit("-i"), quoted(path), F.lit("-ss"), number_text(pre), F.lit("-t"), number_text(duration)]
    return F.concat_ws(" ", *parts, F.concat(F.lit("-map 0:"), stream.cast("string")), F.lit(f"-vn -sn -dn -ac 1 -ar 16000 {CODECS[form]} pipe:1"))


def detect_arguments(path: Column, stream: Column, noise_db: float = NOISE_DB, silence_s: float = SILENCE_S) -> Column:
    """A silence log of one stream."""
    chain = f'"highpass=f=200,lowpass=f=3000,silencedetect=noise={noise_db:.10g}dB:d={silence_s:.10g}"'
    return F.concat_ws(" ", F.lit("-nostdin -hide_banner -nostats -loglevel info -i"), quoted(path), F.concat(F.lit("-map 0:"), stream.cast("string")), F.lit(f"-vn -sn -dn -ac 1 -ar 16000 -af {chain} -f null -"))


def price(per_minute: Column, seconds: Column) -> Column:
    """Exact decimal cost; null without a price."""
    cost = per_minute.cast("decimal(18,6)") * (seconds / 60).cast("decimal(18,6)")
    return F.when(per_minute > 0, cost.cast("decimal(18,6)"))


def audio_minutes(seconds: Column) -> Column:
    return F.sum(seconds) / 60.0


def media_version(size: Column, modified: Column) -> Column:
    return F.concat_ws("-", size.cast("string"), modified.cast("string"))
