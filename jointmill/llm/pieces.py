"""Pieces of oversized texts, cut at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jointmill.llm.tokens import Encoder, encoder, sent, texts_of
from jointmill.session import spread

#: Strength of a cut: between paragraphs, lines, sentences, clauses, words, at other white space or a mark without a blank after it, or at any character.
NAMES = ("character", "weak", "word", "clause", "sentence", "line", "paragraph")
_AFTER = np.full(256, 2, np.int8)
_AFTER[list(b",;:")] = 3
_AFTER[list(b".!?")] = 4
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_WIDE = {4: "。！？…", 3: "、，；："}
#: White space outside ASCII, and marks outside ASCII that a blank may or may not follow.
_SPACES = "\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_MARKS = "،؛؟।॥．｡"


def _found(b: np.ndarray, char: str) -> np.ndarray:
    """Byte offsets of a character outside ASCII."""
    code = char.encode("utf-8")
    if len(b) < len(code):
        return np.zeros(0, np.int64)
    hit = np.ones(len(b) - len(code) + 1, bool)
    for i, x in enumerate(code):
        hit &= b[i : len(b) - len(code) + 1 + i] == x
    return np.flatnonzero(hit)


def boundaries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets before which a text can be cut naturally, rising, and their strengths.

    White space stays with the piece that follows it; wide punctuation, which no blank follows, ends the piece before, as
    does, weakly, any other mark without a blank after it. White space outside ASCII is a weak boundary.
    """
    b = np.frombuffer(raw, np.uint8)
    blank = _BLANK[b]
    starts = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    follows = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.append(follows, len(b))[np.searchsorted(follows, starts, "right")]
    lines = np.concatenate([[0], np.cumsum(b == 10)])
    breaks = lines[ends] - lines[starts]
    strength = np.where(breaks > 1, 6, np.where(breaks == 1, 5, _AFTER[b[starts - 1]]))
    at, how = [starts], [strength]
    for s, chars in _WIDE.items():
        for c in chars:
            hit = _found(b, c) + len(c.encode("utf-8"))
            at.append(hit)
            how.append(np.full(len(hit), s))
    marks = _AFTER[b] > 2
    weak = [np.flatnonzero(marks[:-1] & ~marks[1:] & ~blank[1:]) + 1]
    if len(b) and b.max() > 127:
        weak += [_found(b, c) + len(c.encode("utf-8")) for c in _MARKS]
        spaces = np.zeros(len(b), bool)
        for c in _SPACES:
            for k in range(len(c.encode("utf-8"))):
                spaces[_found(b, c) + k] = True
        weak.append(np.flatnonzero(spaces[1:] & ~spaces[:-1] & ~blank[:-1]) + 1)
    for hit in weak:
        at.append(hit)
        how.append(np.ones(len(hit), np.int64))
    at, how = np.concatenate(at), np.concatenate(how)
    order = np.lexsort((-how, at))
    at, how = at[order], how[order]
    first = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
    return at[first], how[first]


def bisected(total: int, limit: int, places: np.ndarray, strengths: np.ndarray, whole: np.ndarray) -> list[tuple[int, int]]:
    """(first token, strength of the cut before it) of each core piece of at most `limit` tokens.

    A span over the limit is cut at the strongest boundary in its middle half, of equal ones the nearest to the
    midpoint; without one there, at the boundary nearest to the midpoint, first of those that leave both parts within the
    limit, then of all in the span; without any, nearest to the midpoint among the token ends that end a character
    (`whole`), else at the midpoint. Both parts are treated likewise.
    """

    def nearest(lo: int, hi: int, mid: int) -> int | None:
        i, j = np.searchsorted(places, lo, "left"), np.searchsorted(places, hi, "right")
        k = int(np.searchsorted(places, mid, "left"))
        best = [x for x in (k - 1, k) if i <= x < j]
        return min(best, key=lambda x: (abs(int(places[x]) - mid), -int(strengths[x]))) if best else (int(j) - 1 if k >= j else int(i)) if j > i else None

    out, todo = [], [(0, total, len(NAMES) - 1)]
    while todo:
        s, e, how = todo.pop()
        if e - s <= limit:
            out.append((s, how))
            continue
        mid, quarter = (s + e) // 2, max(1, (e - s) // 4)
        lo, hi = max(s + 1, mid - quarter), min(e - 1, mid + quarter)
        i, j = np.searchsorted(places, lo, "left"), np.searchsorted(places, hi, "right")
        cut, kind = mid, 0
        if j > i:
            near = strengths[i:j].astype(np.int64) * (total + 1) - np.abs(places[i:j] - mid)
            k = i + int(np.argmax(near))
            cut, kind = int(places[k]), int(strengths[k])
        elif (k := next((x for x in (nearest(max(s + 1, e - limit), min(e - 1, s + limit), mid), nearest(s + 1, e - 1, mid)) if x is not None), None)) is not None:
            cut, kind = int(places[k]), int(strengths[k])
        else:
            i, j = np.searchsorted(whole, lo, "left"), np.searchsorted(whole, hi, "right")
            if j > i:
                cut = int(whole[i + int(np.argmin(np.abs(whole[i:j] - mid)))])
        todo.append((cut, e, kind))
        todo.append((s, cut, how))
    return out


def pieces_of(text: str | None, own: Encoder, most: int | None, overlap: int | None) -> list[tuple]:
    """(token_start, token_end, byte_start, byte_end, boundary) of each piece of one text."""
    if not text:
        return [(0, 0, 0, 0, "paragraph")]
    raw = text.encode("utf-8")
    if most is None or most < 1:
        return [(0, own.count(text), 0, len(raw), "paragraph")]
    ids = own.encode(text)
    n = len(ids)
    if n <= most:
        return [(0, n, 0, len(raw), "paragraph")]
    shared = min(max(0, overlap or 0), most - 1)
    ends = np.cumsum(own.token_bytes[ids])  # byte offset at the end of each token
    b = np.frombuffer(raw, np.uint8)
    starts_char = np.append((b & 0xC0) != 0x80, True)
    whole = np.flatnonzero(starts_char[ends]) + 1
    at, how = boundaries(raw)
    token = np.searchsorted(ends, at)  # the boundary counts only where a token ends
    fits = (token < n) & (ends[np.minimum(token, n - 1)] == at)
    cuts = bisected(n, most - shared, token[fits] + 1, how[fits], whole)
    out = []
    for k, (first, kind) in enumerate(cuts):
        last = cuts[k + 1][0] if k + 1 < len(cuts) else n
        begin = max(0, first - shared) if k else 0
        byte = int(ends[begin - 1]) if begin else 0
        while not starts_char[byte]:
            byte -= 1
        end = int(ends[last - 1])
        while not starts_char[end]:
            end += 1
        out.append((begin, last, byte, end, NAMES[kind]))
    return out


def pieces(rows: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "kind", path: str | None = None, with_text: bool = True) -> DataFrame:
    """(key, piece, token_start, token_end, n_tokens, boundary, text) of every text, cut to the limits of its kind.

    limits: kind, max_tokens, overlap_tokens; a table someone wrote by hand, one row a kind (of several, the smallest
    limit holds). A piece is a run of the text's own tokens, of at most max_tokens; each but the first starts with the last
    overlap_tokens tokens of the one before. Cuts are made by bisection: at the strongest natural boundary near the middle
    (paragraph, line, sentence, clause, word, weak), else at the nearest one in the span, on and on until cores fit the limit
    less the overlap. `boundary` names the kind of cut in front of the core; only spans without any boundary are cut between
    characters.

    Defined results: a text within its limit, and one whose kind is null or has no limit, is one piece; so is a null or
    empty text, with 0 tokens. An overlap that leaves no room is lowered to the limit less one. A piece whose first
    token starts, or last ends, inside a character has the whole character in its text. Texts of any length are cut whole.
    """
    vocabulary = sent(rows.sparkSession, path)
    one = limits.where(F.col("kind").isNotNull()).groupBy("kind").agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("l"))
    one = one.select(F.col("kind").alias(kind), F.col("l.max_tokens").cast("int").alias("_most"), F.col("l.overlap_tokens").cast("int").alias("_shared"))
    joined = rows.select(key, text, kind).join(F.broadcast(one), kind, "left").select(key, text, "_most", "_shared")
    schema = f"`{key}` {dict(rows.dtypes)[key]}, piece int, token_start int, token_end int, n_tokens int, boundary string" + (", text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary.value)
        for batch in batches:
            took: list[int] = []
            out: list[tuple] = []
            cut: list[str | None] = []
            for i, (t, most, shared) in enumerate(zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                found = pieces_of(t, own, most, shared)
                took += [i] * len(found)
                out += [(k, *p) for k, p in enumerate(found)]
                if with_text:
                    raw = t.encode("utf-8") if t and len(found) > 1 else None
                    cut += [t] if raw is None else [raw[p[2] : p[3]].decode("utf-8") for p in found]
            number = lambda j: np.array([o[j] for o in out], np.int32)  # noqa: E731, B023
            columns = [batch.column(0).take(pa.array(took, pa.int64())), pa.array(number(0)), pa.array(number(1)), pa.array(number(2)), pa.array(number(2) - number(1)), pa.array([o[5] for o in out], pa.string())]
            if with_text:
                columns.append(pa.array(cut, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [key, "piece", "token_start", "token_end", "n_tokens", "boundary", *(["text"] if with_text else [])])

    return spread(joined).mapInArrow(run, schema)
