"""Secret scan: known forms by pattern, random strings by token efficiency.

A vocabulary learned from text covers words with few tokens and random strings
with many, so a low count of characters per token exposes a random string. Runs
of letters, digits and ``+ / = _ -`` are cut at these signs, and each piece is
measured by itself: a span is the smallest stretch that begins and ends with
random pieces and has no ordinary one between, so that a path or a name around a
key is not part of it. Short pieces and numbers tell nothing, which leaves dates,
versions and triples of platforms alone; digests of known sizes and UUIDs are
left out, as are names after an ``@``; letters of one case that can be spoken
count as a word. A word in capitals, or with one at its start, is measured in
lower case. Spans are in code points, end exclusive.

Defined cases: a null or empty text has no spans (redacted, null stays null);
whole texts are scanned, in time that grows with their length; repeated rows
and null keys stay; a candidate that overlaps a span of a known form is not
reported again; columns of the names of ``ADDED`` are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cuewright.llm.kernels import released, text_slices

# fixed values: the known forms
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=@.-])[A-Za-z0-9+/_=.-]{16,}", re.ASCII)
PART = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.ASCII)
KNOWN = re.compile(
    r"[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128}"  # digests
    r"|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # UUIDs
    r"|[0-9_=+/-]+"  # numbers and rules
)
INSIDE = re.compile(rf"(?<![A-Za-z0-9])(?:{KNOWN.pattern.rpartition('|')[0]})(?![A-Za-z0-9])")  # digests and UUIDs in a longer run
PIECE = re.compile(r"[A-Za-z0-9]+", re.ASCII)
WORD = re.compile(r"[A-Z]*[^A-Z]*")
#: More consonants in a row than a word has, but for few.
UNSPOKEN = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|^[^aeiouy]*$")
#: Characters per token below which a string counts as random. English prose has about 4, camel-case names about 3.
LEAST_RATIO = 2.2
#: The same for letters of one case, as long words of other languages come near the bound above.
LEAST_WORD_RATIO = 2.0
#: The same for letters of one case that can be spoken.
LEAST_SPOKEN_RATIO = 1.6
#: Fewest characters of the random pieces of a span together, and of a piece that tells anything.
LEAST_LENGTH, LEAST_PIECE = 16, 6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the known forms, leftmost and not overlapping for each kind; too short ones dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted spans, those that overlap as one of the first one's kind."""
    out: list[tuple[int, int, int]] = []
    for a, kind, b in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]))
        else:
            out.append((a, kind, b))
    return out


def _is_random(piece: str, count_tokens, least_ratio: float) -> bool | None:
    """Whether a piece is a random string; None where it tells nothing."""
    if len(piece) < LEAST_PIECE or piece.isdigit():
        return None
    # capitals at the start or throughout tell nothing
    word = piece.isalpha() and WORD.fullmatch(piece)
    own = piece.lower() if word else piece
    ratio = len(own) / count_tokens(own)
    if not word:
        return ratio < least_ratio
    return ratio < min(least_ratio, LEAST_WORD_RATIO if UNSPOKEN.search(own) else LEAST_SPOKEN_RATIO)


def _stretches(text: str, start: int, end: int, count_tokens, least_ratio: float) -> Iterator[tuple[int, int]]:
    """The spans of a part of a run, from a random piece to the last one that no ordinary piece separates from it."""
    first = last = random = 0
    for m in PIECE.finditer(text, start, end):
        told = _is_random(m[0], count_tokens, least_ratio)
        if told:
            first = m.start() if not random else first
            last, random = m.end(), random + len(m[0])
        elif told is False:
            if random >= LEAST_LENGTH:
                yield first, last
            random = 0
    if random >= LEAST_LENGTH:
        yield first, last


def random_spans(text: str, base: list[tuple[int, int, int]], count_tokens, least_ratio: float = LEAST_RATIO) -> list[tuple[int, int, int]]:
    """Stretches of a low count of characters per token that no known form overlaps; ``base`` is sorted."""
    found, taken = [], _united(base)
    begins = [a for a, _, _ in taken]
    for run in RUN.finditer(text):
        for m in PART.finditer(text, run.start(), run.end()):
            # digests and UUIDs within cut a part in two
            cuts = [(k.start(), k.end()) for k in INSIDE.finditer(text, m.start(), m.end())]
            parts = zip([m.start(), *(b for _, b in cuts)], [*(a for a, _ in cuts), m.end()], strict=True)
            for start, end in (x for part in parts for x in _stretches(text, *part, count_tokens, least_ratio)):
                near = bisect_right(begins, end - 1)  # the last known span that starts before the end
                if not KNOWN.fullmatch(text[start:end]) and not (near and taken[near - 1][2] > start):
                    found.append((start, 3, end))
    return found


def token_counter(ranks_file: str):
    """Counts a string's tokens under a tiktoken vocabulary."""
    import public_tokenizers
    import tiktoken

    from cuewright.llm.byte_bpe import read_ranks

    own = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks_file), special_tokens={})
    return lambda text: len(own.encode_ordinary(text))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


ADDED = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]


def _scanned(batches: Iterable[pa.RecordBatch], at: int, ranks_file: str, redact: bool) -> Iterator[pa.RecordBatch]:
    count = token_counter(ranks_file)
    for batch in batches:
        for held, first in text_slices(batch.column(at)):
            found, texts = [], []
            for text in held:
                base = base_spans(text)
                every = sorted(base + random_spans(text, base, count))
                found.append((*(sum(x[1] == k for x in every) for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
                if redact:
                    texts.append(_redacted(text, every))
            own = [c.slice(first, len(held)) for c in batch.columns]
            if redact:  # a null text stays null
                own[at] = pa.array(texts, pa.string(), mask=own[at].is_null().to_numpy(zero_copy_only=False))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(own + arrays, names=[*batch.schema.names, *ADDED])


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans, those that overlap as one, replaced by a mark of the first one's kind."""
    if not spans:
        return text
    out, at = [], 0
    for a, kind, b in _united(spans):
        out += [text[at:a], f"[{KINDS[kind]} removed]"]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, ranks_file: str, text: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` with the counts by kind, the digest of the known forms and all spans; no shuffle.

    Columns of ``docs`` that clash with the added ones are replaced. With
    ``redact`` the spans in ``text`` are replaced by marks.
    """
    rows = docs.drop(*ADDED)
    at = rows.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda b: released(_scanned(b, at, ranks_file, redact)), f"{schema}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
