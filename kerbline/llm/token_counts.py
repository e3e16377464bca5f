"""Token counts of sections: whole documents are encoded once and tokens are attributed by their character spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbline.llm.byte_bpe import _texts, codec

#: How a token that crosses a boundary is allocated.
RULES = ("most", "first", "last")


def line_ends(text: str) -> np.ndarray:
    """Ends of the sections of a text: a section is a line with its line feed. An empty text is one empty section."""
    units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(units == 10) + 1
    return ends if len(ends) and ends[-1] == len(units) else np.append(ends, len(units))


def attribute(starts: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str = "most"):
    """Tokens and crossing tokens of each section, by an interval join of sorted spans.

    A token within one section counts there. One that crosses a boundary counts once, by `rule`: `first` or `last`
    section that it touches, or the section with `most` of its characters (the earliest of equals).
    """
    low = np.searchsorted(section_ends, starts, side="right")
    high = np.searchsorted(section_ends, ends - 1, side="right")
    own = high.copy() if rule == "last" else low.copy()
    if rule == "most":
        for i in np.flatnonzero(high > low):
            inner = section_ends[low[i]:high[i]]
            own[i] = low[i] + np.argmax(np.diff(np.concatenate(([starts[i]], inner, [ends[i]]))))
    n = len(section_ends)
    return np.bincount(own, minlength=n), np.bincount(own[high > low], minlength=n)


def section_tokens(docs: DataFrame, definition: str, pattern: str, key: str = "doc_id",
                   text: str = "text", rule: str = "most") -> DataFrame:
    """Per section of each row: key, section (from 0), start, end, n_tokens, n_crossing.

    Sections are lines with their line feed and cover the whole text; the sums over a document are its token count. A
    null or empty text has one empty section without tokens. Repeated rows give repeated sections; an empty table none.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is not one of {RULES}")
    shipped = docs.sparkSession.sparkContext.broadcast(definition)

    def work(batches):
        own = codec(shipped.value, pattern)
        for batch in batches:
            keys = batch.column(0)
            texts = _texts(batch.column(1))
            row, section, start, end, n_tokens, n_crossing = [], [], [], [], [], []
            for i, (t, ids) in enumerate(zip(texts, own.encode(texts))):
                ends = line_ends(t)
                tokens, crossing = attribute(*own.spans(t, ids), ends, rule)
                row.append(np.full(len(ends), i))
                section.append(np.arange(len(ends)))
                start.append(np.append(0, ends[:-1]))
                end.append(ends)
                n_tokens.append(tokens)
                n_crossing.append(crossing)
            if row:
                numbers = [pa.array(np.concatenate(x), pa.int64()) for x in (section, start, end, n_tokens, n_crossing)]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(np.concatenate(row))), *numbers],
                    names=[key, "section", "start", "end", "n_tokens", "n_crossing"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        work, f"`{key}` {kind}, section long, start long, end long, n_tokens long, n_crossing long")
