"""A transcription service as a table function, for lateral joins.

``provide(spark, "heard", connect)`` registers a function of a clip's bytes and
its length in seconds::

    SELECT c.clip_id, h.* FROM clips c, LATERAL heard(c.audio, c.duration_s) h

It gives the segments of each clip as rows, or one row with the ``error`` that
the service raised or the response is. ``connect`` makes a client, a function
from bytes to a response body; a worker connects once, and its clips follow each
other, so a service sees as many calls at once as there are tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cuewright.sources.files import stripped
from cuewright.sources.transcripts import EMPTY, NO_CANDIDATES, NO_SEGMENTS, NOTHING, UNREADABLE

ROWS = "seg_idx int, start_s double, end_s double, text string, language string, timed boolean, error string"
#: Clients of this worker, by the registration that made them.
_clients: dict[str, Callable[[bytes], str]] = {}


def _number(x) -> float:
    """A number, or a text that is one; 0 for anything else."""
    try:
        return float(x) if not isinstance(x, bool) else 0.0
    except (TypeError, ValueError):
        return 0.0


def _object(body: str) -> dict | None:
    try:
        found = json.loads(body)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _segments(listed) -> list[tuple[float, float, str]]:
    rows = [s for s in listed if isinstance(s, dict)]
    cut = [(_number(s.get("start")), _number(s.get("end")), stripped(str(s.get("text") or ""))) for s in rows]
    return [(a, max(a, b), t) for a, b, t in cut if t]


def verbose(body: str | None, duration: float) -> tuple[str | None, bool, list[tuple[float, float, str]], str | None]:
    """(language, timed, segments, error) of a response with ``language``, ``text`` and ``segments``."""
    if not stripped(body or ""):
        return None, True, [], EMPTY
    found = _object(body)
    if found is None:
        return None, True, [], UNREADABLE
    listed = found.get("segments") if isinstance(found.get("segments"), list) else []
    if listed:
        cut = _segments(listed)
        return found.get("language"), True, cut, None if cut else NOTHING
    said = stripped(str(found.get("text") or ""))
    return found.get("language"), False, [(0.0, duration, said)] if said else [], None if said else NOTHING


def candidates(body: str | None, duration: float) -> tuple[str | None, bool, list[tuple[float, float, str]], str | None]:
    """The same of a response whose first candidate's parts hold the JSON of ``segments``; times are kept inside the clip."""
    if not stripped(body or ""):
        return None, True, [], EMPTY
    outer = _object(body)
    if outer is None:
        return None, True, [], UNREADABLE
    listed = outer.get("candidates") if isinstance(outer.get("candidates"), list) else []
    if not listed:
        return None, True, [], NO_CANDIDATES
    first = listed[0] if isinstance(listed[0], dict) else {}
    parts = ((first.get("content") or {}).get("parts") or []) if isinstance(first.get("content") or {}, dict) else []
    inner = "".join(str(p.get("text") or "") for p in parts if isinstance(p, dict))
    if not stripped(inner):
        return None, True, [], NOTHING
    found = _object(inner)
    if found is None or not isinstance(found.get("segments"), list):
        return None, True, [], NO_SEGMENTS
    inside = lambda x: min(max(x, 0.0), duration)
    cut = [(inside(a), max(inside(a), inside(b)), t) for a, b, t in _segments(found["segments"])]
    return None, True, cut, None if cut else NOTHING


def provide(spark: SparkSession, name: str, connect: Callable[[], Callable[[bytes], str]], parse: Callable = verbose) -> None:
    """Register the table function ``name`` (audio, duration_s) of a service; ``parse`` reads its responses."""
    token = f"{name}-{uuid.uuid4().hex}"

    class Provider:
        def eval(self, audio: bytes, duration_s: float) -> Iterator[tuple]:
            try:
                client = _clients.get(token)
                if client is None:
                    client = _clients[token] = connect()
                body = client(bytes(audio) if audio is not None else b"")
            except Exception as e:  # whatever a service raises is the clip's error, not the job's
                yield None, None, None, None, None, None, f"{type(e).__name__}: {e}"
                return
            language, timed, segments, error = parse(body, float(duration_s or 0.0))
            if error:
                yield None, None, None, None, language, None, error
            for k, (start, end, text) in enumerate(segments):
                yield k, start, end, text, language, timed, None

    spark.udtf.register(name, udtf(Provider, returnType=ROWS))
