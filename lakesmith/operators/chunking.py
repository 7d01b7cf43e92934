"""Document chunking.

* :func:`chunk_fixed` — fixed stride windows, pure expressions (explode of a
  ``sequence``), no shuffle.
* :func:`chunk_recursive` — separator-aware recursive splitting; the split
  of one document is inherently sequential, so it runs per document inside
  ``mapInPandas`` (a partition of documents per task, no shuffle).
* :func:`chunk_semantic` — breakpoints where the distance between
  neighbouring sentence vectors exceeds a per-document percentile; built
  from the skew-safe neighbour / percentile / running-sum operators.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.functions.vectors import cosine
from lakesmith.operators.parallel import spread
from lakesmith.operators.sequence import cumulative_sum_within, group_percentile, neighbour

# The reference's current and first chunk sizes (characters).
CHUNK_SIZE, CHUNK_OVERLAP = 1200, 350
FIRST_CHUNK_SIZE, FIRST_CHUNK_OVERLAP = 1000, 150
SEPARATORS = ("\n\n", "\n", " ", "")


def chunk_fixed(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; the
    last window is the first that reaches the end of the text."""
    step = size - overlap
    n = F.length(text_col)
    count = F.when(n <= size, F.lit(1)).otherwise(F.lit(1) + F.ceil((n - size) / F.lit(step)).cast("int"))
    # a substring walks from the start of its text, so a long text is cut into stretches of about the root of its
    # number of windows first, and the windows are cut from these
    per = F.ceil(F.sqrt("__n")).cast("int")
    stretch = lambda b: F.struct((b * per).cast("int").alias("__from"), F.least(per, F.col("__n") - b * per).cast("int").alias("__k"),
                                 F.substring(text_col, (b * per * step + 1).cast("int"), ((per - 1) * step + size).cast("int")).alias("__part"))
    window = lambda i: F.struct((F.col("__from") + i).cast("long").alias("chunk_no"), ((F.col("__from") + i) * step).cast("long").alias("chunk_start"),
                                F.substring("__part", i * step + 1, F.lit(size)).alias("chunk_text"))
    # the windows are cut inside one projection, so only pieces (never the whole text) are exploded
    return (docs.where(F.col(text_col).isNotNull() & (n > 0)).select(*keep, text_col, count.alias("__n"))
            .select(*keep, F.inline(F.transform(F.sequence(F.lit(0), F.ceil(F.col("__n") / per).cast("int") - 1), stretch)))
            .select(*keep, F.inline(F.transform(F.sequence(F.lit(0), F.col("__k") - 1), window))))


# ----------------------------------------------------------------------------- recursive

def _split_keep(text: str, sep: str) -> list[str]:
    if sep == "":
        return list(text)
    parts = text.split(sep)
    # the separator stays attached to the start of the following piece
    return [p for p in [parts[0]] + [sep + p for p in parts[1:]] if p != ""]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: list[str] = []
    total = 0
    for piece in pieces:
        n = len(piece)
        if total + n > size and window:
            joined = "".join(window).strip()
            if joined:
                out.append(joined)
            while total > overlap or (total + n > size and total > 0):
                total -= len(window[0])
                window.pop(0)
        window.append(piece)
        total += n
    joined = "".join(window).strip()
    if joined:
        out.append(joined)
    return out


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Split on the first separator present; pieces still longer than
    ``size`` are split again with the remaining separators; neighbouring
    small pieces are merged into windows of at most ``size`` characters that
    overlap by up to ``overlap`` characters."""
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, list(separators[i + 1:])
            break
    good: list[str] = []
    out: list[str] = []
    for piece in _split_keep(text, sep):
        if len(piece) < size:
            good.append(piece)
            continue
        if good:
            out.extend(_merge(good, size, overlap))
            good = []
        out.extend(split_recursive(piece, size, overlap, rest) if rest else [piece])
    if good:
        out.extend(_merge(good, size, overlap))
    return out


def chunk_recursive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Separator-aware chunks, one ``mapInPandas`` pass (no shuffle)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, nos, texts = [], [], []
            for doc_id, text in zip(pdf[id_col], pdf[text_col]):
                if not isinstance(text, str) or not text:
                    continue
                for i, chunk in enumerate(split_recursive(text, size, overlap)):
                    ids.append(doc_id)
                    nos.append(i)
                    texts.append(chunk)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype="int64"),
                                "chunk_no": pd.Series(nos, dtype="int64"),
                                "chunk_text": pd.Series(texts, dtype="object")})

    return spread(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col).mapInPandas(
        split, f"{id_col} long, chunk_no long, chunk_text string")


# ----------------------------------------------------------------------------- semantic

def chunk_semantic(sentences: DataFrame, doc_col: str, order_col: str, vec_col: str,
                   percentile: float = 0.95, digits: int = 9) -> DataFrame:
    """Distance to the previous sentence = ``1 - cosine``; a sentence
    whose distance exceeds the document's ``percentile`` of distances starts
    a new chunk; ``chunk_no`` = running count of breaks."""
    with_prev = neighbour(sentences.select(doc_col, order_col, vec_col), [doc_col], [order_col], [vec_col],
                          offset=-1, prefix="prev_")
    dist = with_prev.withColumn(
        "distance", F.round(F.lit(1.0) - cosine(F.col(f"prev_{vec_col}"), F.col(vec_col)), digits)
    ).drop(f"prev_{vec_col}", vec_col)
    thr = group_percentile(dist, [doc_col], "distance", percentile, "threshold")
    flagged = dist.join(thr, doc_col, "left").withColumn(
        "is_break", F.when(F.col("distance") > F.col("threshold"), F.lit(1)).otherwise(F.lit(0)))
    out = cumulative_sum_within(flagged, [doc_col], [order_col], "is_break", "chunk_no")
    return out.select(doc_col, order_col, F.col("chunk_no").cast("long"), "distance")
