"""Token counts by section: documents are encoded once, whole, and tokens are given to sections by their character spans."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.llm.bpe import PieceEncoder

RULES = ("start", "majority")
COLUMNS = (("section", T.IntegerType()), ("char_start", T.LongType()), ("char_end", T.LongType()), ("n_tokens", T.LongType()), ("n_crossing", T.LongType()), ("doc_tokens", T.LongType()))


def section_edges(text: str, boundary: re.Pattern) -> np.ndarray:
    """Starts of the sections: 0, and the end of every match of ``boundary`` within the text."""
    return np.array([0, *sorted({m.end() for m in boundary.finditer(text)} - {0, len(text)})], np.int64)


def allocate(begins: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span, and which spans reach into another section.

    'start': the section of the first character.  'majority': the section with most of the
    token's characters, the earliest of equals.
    """
    home = np.searchsorted(edges, begins, "right") - 1
    last = np.searchsorted(edges, np.maximum(ends - 1, begins), "right") - 1
    crossing = last > home
    if rule == "majority":
        for i in np.flatnonzero(crossing):
            cuts = np.clip(np.append(edges[home[i] : last[i] + 1], ends[i]), begins[i], ends[i])
            home[i] += int(np.argmax(np.diff(cuts)))
    return home, crossing


def count_tokens(docs: DataFrame, tokenizer_path: str, boundary: str = r"\n+", rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each section of each document.

    Sections are the parts of a text after each match of ``boundary``; a boundary belongs to
    the section before it.  A row for each: doc_id, section (from 0), char_start, char_end
    (code points), n_tokens, n_crossing (of these, tokens that reach into another section),
    doc_tokens (tokens of the whole text; the sum of its sections' n_tokens).

    Null and empty texts have one section without tokens.  Very long texts and words are encoded
    whole.  Null ids and repeated rows are counted each for itself; an empty table gives no
    rows; further columns, of any name, are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in COLUMNS)])

    def count(batches):
        encoder, pattern = PieceEncoder.shared(tokenizer_path, offsets=True), re.compile(boundary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            owner, parts = [], []
            for k, (text, (ids, begins, ends)) in enumerate(zip(texts, encoder.encode(texts))):
                edges = section_edges(text, pattern)
                home, crossing = allocate(begins, ends, edges, rule)
                n = len(edges)
                owner.append(np.full(n, k))
                parts.append(np.stack([np.arange(n), edges, np.append(edges[1:], len(text)), np.bincount(home, minlength=n), np.bincount(home[crossing], minlength=n), np.full(n, len(ids))]))
            if owner:
                rows = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(rows[0].astype(np.int32)), *(pa.array(rows[i]) for i in range(1, 6))],
                    names=schema.names,
                )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, schema)
