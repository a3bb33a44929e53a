"""Token counts of sections: a document is encoded once, tokens are placed by offsets.

Spans of tokens and of sections are both in characters of the whole text. The join
is an interval join inside a document: both lists are in order, so two binary
searches per token find the sections it overlaps. A token that crosses a boundary
goes by an explicit rule:

``first``  to the section that holds its first character
``most``   to the section with most of its characters, the earlier on a tie
``split``  to every section it overlaps, in proportion to the characters there

Characters outside all sections belong to the rest (section null), so the shares of
a document always add up to its tokens.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes, wordbpe

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES = ("first", "most", "split")

OUT = "doc_id long, section string, from_char long, to_char long, tokens double, crossing long"


def quarters(text: Column) -> Column:
    """Four sections of equal length in characters."""
    size = F.length(F.coalesce(text, F.lit("")))
    edge = [F.floor(size * k / 4).cast("long") for k in range(5)]
    return F.array(*[
        F.struct(F.lit(f"quarter_{k + 1}").alias("section"), edge[k].alias("from_char"), edge[k + 1].alias("to_char"))
        for k in range(4)
    ])


def with_sections(docs: DataFrame, sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the rows of ``sections`` (``id, section, from_char, to_char``) of each as an array.

    The array is as long as the document has sections.
    """
    lists = sections.groupBy(id_col).agg(F.collect_list(F.struct("section", "from_char", "to_char")).alias("sections"))
    return docs.join(lists, id_col, "left")


def token_spans(encoder: wordbpe.Encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, ends)`` in characters of the tokens of one text."""
    found = encoder.whole.encode(text, add_special_tokens=False).offsets
    spans = np.array(found, np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


def latin_spans(encoder: wordbpe.Encoder, data: np.ndarray, offsets: np.ndarray):
    """``(starts, ends, tokens per text)`` for a run of Latin-1 texts, counted from the run's start.

    A token of a word begins after the tokens before it. Its size is in bytes of
    UTF-8; a character cut between two tokens belongs to both.
    """
    ids, words, count, per_text = encoder.latin(data, offsets)
    sizes = encoder.size_of[ids]
    wide = np.concatenate(([0], np.cumsum(data >= 128)))
    byte_of = np.arange(len(data) + 1) + wide
    last = np.cumsum(sizes)
    before = last - sizes
    first_of_word = np.repeat(before[np.minimum(np.cumsum(count) - count, max(len(before) - 1, 0))], count) if len(before) else before
    begin = np.repeat(byte_of[words], count) + before - first_of_word
    end = begin + sizes
    starts = np.searchsorted(byte_of, begin, side="right") - 1
    ends = np.searchsorted(byte_of, end, side="left")
    return starts, ends, per_text


def allocate(starts, ends, low, high, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """``(share per section and the rest, crossing tokens per section and the rest)``.

    ``low, high`` are sections in order of ``low`` that do not overlap.
    """
    n = len(low)
    tokens, crossing = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    if not len(starts):
        return tokens, crossing
    # Sections that end after the token begins and begin before it ends.
    first = np.searchsorted(high, starts, side="right")
    last = np.searchsorted(low, ends, side="left") - 1
    inside = first < n
    safe = np.minimum(first, max(n - 1, 0))
    whole = inside & (low[safe] <= starts) & (ends <= high[safe]) if n else np.zeros(len(starts), bool)
    np.add.at(tokens, safe[whole], 1.0)
    outside = ~whole & (last < first)
    tokens[n] += outside.sum()
    for t in np.flatnonzero(~whole & ~outside).tolist():
        touched = np.arange(first[t], last[t] + 1)
        part = np.minimum(high[touched], ends[t]) - np.maximum(low[touched], starts[t])
        touched, part = touched[part > 0], part[part > 0]
        rest = (ends[t] - starts[t]) - part.sum()
        place, size = (np.append(touched, n), np.append(part, rest)) if rest > 0 else (touched, part)
        if not len(place):
            tokens[n] += 1
            continue
        if rule == "split":
            tokens[place] += size / size.sum()
            crossing[place] += 1
            continue
        if rule == "most":
            best = place[np.argmax(size)]
        else:
            holder = touched[(low[touched] <= starts[t])]
            best = holder[0] if len(holder) else n
        tokens[best] += 1
        crossing[best] += 1
    return tokens, crossing


def attribute(
    docs: DataFrame, sections: Column, rule: str = "most", tokenizer: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, section, from_char, to_char, tokens, crossing`` of every document.

    ``sections`` is an array of ``(section, from_char, to_char)`` that do not
    overlap. ``crossing`` counts the tokens among ``tokens`` that overlap a
    boundary. The rest of a document is a row with a null section, there only if
    tokens fall outside. A null or empty text has its sections with no token;
    sections of a null array are none; an empty section gets nothing. Repeated
    rows are counted each; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    vocabulary = tokenizer or wordbpe.default_path()

    def run(batches):
        for batch in batches:
            encoder = wordbpe.Encoder.at(vocabulary)
            keys, lists, column = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
            rows = []

            def place(i, starts, ends):
                own = sorted(lists[i] or [], key=lambda s: (s["from_char"], s["to_char"]))
                low = np.array([s["from_char"] for s in own], np.int64)
                high = np.array([s["to_char"] for s in own], np.int64)
                tokens, crossing = allocate(starts, ends, low, high, rule)
                for s, t, c in zip(own, tokens.tolist(), crossing.tolist()):
                    rows.append((keys[i], s["section"], s["from_char"], s["to_char"], t, c))
                if tokens[len(own)]:
                    rows.append((keys[i], None, None, None, float(tokens[-1]), int(crossing[-1])))

            for first, _, data, offsets in textbytes.pieces(column):
                for a, b, latin in encoder._runs(data, offsets):
                    if latin is None:
                        place(first + a, *token_spans(encoder, data[offsets[a] : offsets[b]].tobytes().decode()))
                        continue
                    starts, ends, counts = latin_spans(encoder, *latin)
                    at = 0
                    for k, (base, n) in enumerate(zip(latin[1].tolist(), counts.tolist())):
                        place(first + a + k, starts[at : at + n] - base, ends[at : at + n] - base)
                        at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(
                    zip(*rows) if rows else [[]] * 6,
                    [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()],
                )],
                names=[c.split()[0] for c in OUT.split(", ")],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), sections.alias("sections"))
    return rows.mapInArrow(run, OUT)
