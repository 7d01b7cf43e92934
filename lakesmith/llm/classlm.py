"""Language-model scores by Brown class bigrams.

``log10 P(text) = sum over tokens of log10 P(class | context class of the previous token) + log10 P(token | class)``.

*Context classes* are known without a look-up.  The ``vocabulary`` commonest words are clustered by the exchange
algorithm: each word in turn moves to the class that raises the class-bigram likelihood most, until no word moves
or a round gains next to nothing.  As a context every other word belongs to one of ``tail_classes`` classes by its ending; the end of a text is a class
of its own.  What reaches the driver is a matrix bounded by ``(vocabulary + tail_classes + 1) ** 2``, whatever the
size of the corpus.

*Classes.*  Every other training word, however rare, is clustered as well, by all the contexts it was met in
(:func:`word_contexts`): from the class of its ending it moves, in rounds over all words on Spark, to the class under
whose contexts its own are likeliest, which raises the same likelihood; a round's class matrix is all that is
collected.  Rounds go on until one raises it by less than ``TOLERANCE`` a token (:func:`cluster_rest`).  Only words
that no training text holds go by their ending: to the class of most known words of that ending.

*Emission.*  A vocabulary word has its share of its class.  The other words of a class are discounted by ``D`` (from
the counts of counts) and the freed mass goes to the unknown word, so that the model sums to one over the known
words, the end and the unknown.

*Scoring.*  The ``head_words`` commonest words, a bounded table, travel with the tasks; the rest of
the words of a text are looked up with their context by an equi-join on the word, pre-aggregated per document.  Word
counts themselves are never collected.

Defined results: a null text is an empty one: its only token is the end; documents of null id count
as training texts; repeated rows are scored alike; without training texts every word is unknown; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.llm.common import materialise

FLUSH_WORDS = 300_000  # distinct words that a counting task holds before it passes them on
FLUSH_CONTEXTS = 2_000_000  # contexts that it holds at most
SLICE_TOKENS = 200_000  # tokens that a scoring task handles at a time
SLICE_CELLS = 1 << 20  # cells of word times context that a round handles at a time
STILL = 1e-6  # gain of log likelihood a token under which the exchange of the vocabulary ends
TOLERANCE = 1e-3  # gain of log likelihood a token under which the rounds over the rest of the words end


def tokens(column: pa.Array) -> Iterator[list[bytes]]:
    """Words of every text of a column with A-Z in lower case (bytes.lower and bytes.split know ASCII only)."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return (x.as_py().lower().split() if x.is_valid else [] for x in raw)


def tail_class(word: bytes, classes: int) -> int:
    """The class of a word outside the vocabulary: by its last two bytes and whether it is long."""
    x = word[-1] * 31 + (word[-2] * 17 if len(word) > 1 else 0) + (7 if len(word) > 8 else 0)
    return x * 2654435761 % 4294967296 % classes


# --- counting ------------------------------------------------------------------------------------

def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """``(word, c)`` over all texts (without the end tokens): partial counts per task, then a sum."""
    def run(batches):
        held: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                               names=["word", "c"])
            held.clear()
            return batch
        for b in batches:
            for words in tokens(b.column(0)):
                held.update(words)
                if len(held) >= FLUSH_WORDS:
                    yield flush()
        if held:
            yield flush()
    return texts.select(text_col).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _ids(known: dict[bytes, int], base: int, classes: int) -> dict[bytes, int]:
    """Row of every word that is asked for: vocabulary rows, else by ending.  Endings are kept for a bounded
    number of words."""
    class Rows(dict):
        def __missing__(self, word):
            row = base + tail_class(word, classes)
            if len(self) < FLUSH_WORDS:
                self[word] = row
            return row
    return Rows(known)


def bigram_matrix(texts: DataFrame, text_col: str, vocabulary: list[bytes], tail_classes: int) -> np.ndarray:
    """Counts of (previous, next) over vocabulary words, tail classes and the end (last index, which
    also stands before the first word), over all texts."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    v, size = len(vocabulary), len(vocabulary) + tail_classes + 1

    def run(batches):
        row, total = _ids(known.value, v, tail_classes).__getitem__, np.zeros(size * size, dtype=np.int64)
        ids: list[int] = [size - 1]

        def add():
            a = np.array(ids, dtype=np.int64)
            np.add.at(total, a[:-1] * size + a[1:], 1)
        for b in batches:
            for words in tokens(b.column(0)):
                ids.extend(map(row, words))
                ids.append(size - 1)
                if len(ids) > 500_000:
                    add()
                    ids = ids[-1:]
        add()
        hit = np.flatnonzero(total)
        for a in range(0, len(hit), 100_000):
            part = hit[a: a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["k", "n"])

    got = texts.select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(size * size, dtype=np.int64)
    table = got.toArrow()
    out[table.column("k").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(size, size)


# --- exchange clustering -------------------------------------------------------------------------

def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _likelihood(joint: np.ndarray) -> float:
    """Log likelihood of the classes given their contexts, up to a part that no move of a word's class changes."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(axis=0)).sum())


def exchange(counts: np.ndarray, movable: int, classes: int, fixed: int) -> np.ndarray:
    """Class of every row of the bigram matrix ``counts``.

    The first ``movable`` words (by falling frequency) start dealt round robin into ``classes``; the
    other ``fixed`` rows keep a class each.  A word moves to the class of largest gain in
    ``sum n(a,b) log n(a,b) - sum n(a) log n(a) - sum n(b) log n(b)``; a round visits every word.  Rounds go
    on until no word moves or one raises the likelihood by less than ``STILL`` a token."""
    size = movable + fixed
    c = np.concatenate([np.arange(movable) % max(classes, 1), classes + np.arange(fixed)])
    k = classes + fixed
    n = counts.astype(np.float64)
    member = np.zeros((size, k))
    member[np.arange(size), c] = 1
    out_by = n @ member                 # word -> next class
    in_by = n.T @ member                # word <- previous class
    joint = member.T @ out_by
    own = np.diag(n)
    now, moved = -np.inf, 1
    while moved:
        moved = 0
        for w in range(movable):
            a = c[w]
            o, i, s = out_by[w].copy(), in_by[w].copy(), own[w]
            o[a] -= s
            i[a] -= s                   # bigrams with the other words of its own class only
            if not (o.any() or i.any() or s):
                continue
            joint[a, :] -= o
            joint[:, a] -= i
            joint[a, a] -= s
            rows, cols = joint.sum(axis=1), joint.sum(axis=0)
            to = slice(0, classes)
            gain = (_xlogx(joint[to] + o) - _xlogx(joint[to])).sum(axis=1) + (_xlogx(joint[:, to] + i[:, None]) - _xlogx(joint[:, to])).sum(axis=0)
            d = np.arange(classes)
            diag = joint[d, d]          # counted in both sums: take the true cell instead
            gain += _xlogx(diag + o[d] + i[d] + s) - _xlogx(diag + o[d]) - _xlogx(diag + i[d]) + _xlogx(diag)
            gain -= _xlogx(rows[to] + o.sum() + s) - _xlogx(rows[to]) + _xlogx(cols[to] + i.sum() + s) - _xlogx(cols[to])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b, :] += o
            joint[:, b] += i
            joint[b, b] += s
            if b != a:
                moved += 1
                c[w] = b
                out_by[:, a] -= n[:, w]
                out_by[:, b] += n[:, w]
                in_by[:, a] -= n[w]
                in_by[:, b] += n[w]
        before, now = now, _likelihood(joint) - float(_xlogx(joint.sum(axis=1)).sum())
        if now - before <= STILL * n.sum():
            break
    return c


# --- the rest of the words -----------------------------------------------------------------------

def word_contexts(texts: DataFrame, text_col: str, vocabulary: list[bytes], row_class: np.ndarray, tail_classes: int) -> DataFrame:
    """``(word, prev)`` of every word outside the vocabulary: the context classes before its occurrences, in any order.
    No list is longer than a share of one in ``len(vocabulary) + 1`` of all tokens."""
    known = texts.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    v, end = len(vocabulary), len(row_class) - 1

    def run(batches):
        row = _ids(known.value, v, tail_classes).__getitem__
        held: dict[bytes, list[int]] = {}
        n = 0

        def flush():
            lens = np.fromiter(map(len, held.values()), dtype=np.int32, count=len(held))
            flat = np.fromiter(chain.from_iterable(held.values()), dtype=np.int16, count=int(lens.sum()))
            at = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.ListArray.from_arrays(at, pa.array(flat))], names=["word", "prev"])
            held.clear()
            return batch
        for b in batches:
            for words in tokens(b.column(0)):
                at = np.fromiter(map(row, words), dtype=np.int64, count=len(words))
                before = row_class[np.concatenate([[end], at[:-1]])] if len(at) else at
                rest = np.flatnonzero(at >= v)
                n += len(rest)
                for i, g in zip(rest.tolist(), before[rest].tolist()):
                    w = words[i]
                    if w in held:
                        held[w].append(g)
                    else:
                        held[w] = [g]
                if len(held) >= FLUSH_WORDS or n >= FLUSH_CONTEXTS:
                    yield flush()
                    n = 0
        if held:
            yield flush()
    got = texts.select(text_col).mapInArrow(run, "word binary, prev array<short>")
    return got.groupBy("word").agg(F.flatten(F.collect_list("prev")).alias("prev"))


def context_likelihoods(joint: np.ndarray) -> np.ndarray:
    """``log P(context | class)`` of (context, class) counts, for all classes but the end's; a context that a class
    has not met keeps a share of one token."""
    share = (joint.sum(axis=1, keepdims=True) + 1) / (joint.sum() + len(joint))
    return np.log((joint + share) / (joint.sum(axis=0, keepdims=True) + 1))[:, :-1]


def _choices(likelihoods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The likelihoods, and the best class of a word met once and of one met twice, by its contexts."""
    pairs = np.stack([np.argmax(row + likelihoods, axis=1) for row in likelihoods])
    return likelihoods, np.argmax(likelihoods, axis=1), pairs


def _best(prev: pa.Array, choices: tuple[np.ndarray, np.ndarray, np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of contexts and the best class of every word of a column of context lists, and all contexts."""
    likelihoods, once, twice = choices
    lens, flat = np.diff(prev.offsets.to_numpy()).astype(np.int64), prev.flatten().to_numpy().astype(np.int64)
    start, k = np.cumsum(lens) - lens, len(likelihoods)
    best = np.zeros(len(lens), dtype=np.int64)
    one, two, more = (np.flatnonzero(x) for x in (lens == 1, lens == 2, lens > 2))
    best[one] = once[flat[start[one]]]
    best[two] = twice[flat[start[two]], flat[start[two] + 1]]
    step = max(1, cells // k)
    for a in range(0, len(more), step):
        some = more[a: a + step]
        n = lens[some]
        word = np.repeat(np.arange(len(some)), n)
        at = np.arange(len(word)) + np.repeat(start[some] - (np.cumsum(n) - n), n)
        x = np.bincount(word * k + flat[at], minlength=len(some) * k).reshape(len(some), k)
        best[some] = np.argmax(x @ likelihoods, axis=1)
    return lens, best, flat


def cluster_rest(contexts: DataFrame, joint: np.ndarray, fixed: np.ndarray, tolerance: float | None = None) -> tuple[DataFrame, np.ndarray]:
    """``(word, c, cls)`` of all words of ``contexts``, and the (context, class) counts with them.

    ``joint`` holds the counts of the start, ``fixed`` those of the words that stay.  A round sends every word to the
    class under which its contexts are likeliest and sums the counts anew; neither step lowers the likelihood but for
    the share kept for unmet contexts, so rounds end."""
    tolerance = TOLERANCE if tolerance is None else tolerance
    sc, k = contexts.sparkSession.sparkContext, len(joint)
    now, cells = _likelihood(joint), SLICE_CELLS
    while True:
        shared = sc.broadcast(_choices(context_likelihoods(joint)))

        def run(batches, shared=shared):
            total = np.zeros(k * k, dtype=np.int64)
            for b in batches:
                lens, best, flat = _best(b.column(0), shared.value, cells)
                total += np.bincount(flat * k + np.repeat(best, lens), minlength=k * k)
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["k", "n"])
        table = contexts.select("prev").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        met = np.zeros(k * k)
        met[table.column("k").to_numpy()] = table.column("n").to_numpy()
        joint = fixed + met.reshape(k, k)
        before, now = now, _likelihood(joint)
        if now - before <= tolerance * max(joint.sum(), 1):
            break

    def run_last(batches):
        for b in batches:
            lens, best, _ = _best(b.column(1), shared.value, cells)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens), pa.array(best.astype(np.int32))], names=["word", "c", "cls"])
    return materialise(contexts.mapInArrow(run_last, "word binary, c long, cls int"), "word-classes"), joint


# --- the model -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class ClassModel:
    vocabulary: dict[bytes, int]     # word -> row
    row_class: np.ndarray            # class of vocabulary rows; context class of the tail rows and the end
    tail_classes: int
    transition: np.ndarray           # log10 P(class | context class)
    row_emission: np.ndarray         # log10 P(word | class) of vocabulary rows and the end
    class_count: np.ndarray          # training tokens of every class
    discount: float
    train_tokens: int
    distinct: int                    # V, the end included

    @property
    def end(self) -> int:
        return len(self.row_class) - 1


def transitions(joint: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """Smoothed towards the class shares (add-one there, so no class is impossible)."""
    share = (joint.sum(axis=0) + 1) / (joint.sum() + joint.shape[0])
    return np.log10((joint + strength * share) / (joint.sum(axis=1, keepdims=True) + strength))


def learn(texts: DataFrame, text_col: str, counts: DataFrame, vocabulary: int = 1500, classes: int = 48,
          tail_classes: int = 64) -> tuple[ClassModel, DataFrame]:
    """The model, and ``(word, c, cls)`` of the training words outside the vocabulary."""
    top = [bytes(r["word"]) for r in counts.orderBy(F.desc("c"), "word").limit(vocabulary).collect()]
    n = bigram_matrix(texts, text_col, top, tail_classes)
    v = len(top)
    c = exchange(n, v, min(classes, max(v, 1)), tail_classes + 1)
    k = int(c.max()) + 1
    member = np.zeros((len(c), k))
    member[np.arange(len(c)), c] = 1
    stays = member.copy()
    stays[v: len(c) - 1] = 0
    contexts = materialise(word_contexts(texts, text_col, top, c, tail_classes), "word-contexts")
    rest, joint = cluster_rest(contexts, member.T @ n @ member, member.T @ n @ stays)
    in_count, class_count = n.sum(axis=0).astype(np.float64), joint.sum(axis=0)
    with np.errstate(divide="ignore"):
        emission = np.log10(np.maximum(in_count, 1e-300) / np.maximum(class_count[c], 1))
    s = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("n1"),
                   F.count_if(F.col("c") == 2).alias("n2")).first()
    ends = int(in_count[-1])
    discount = s["n1"] / (s["n1"] + 2 * s["n2"]) if s["n1"] and s["n2"] else 0.5
    model = ClassModel({w: i for i, w in enumerate(top)}, c, tail_classes, transitions(joint), emission, class_count, float(discount),
                       int(s["n"] or 0) + ends, int(s["v"]) + (1 if ends else 0))
    return model, rest


def tail_class_column(word: Column, classes: int) -> Column:
    """:func:`tail_class` of a binary column."""
    byte = lambda at: F.conv(F.hex(F.substring(word, at, F.lit(1))), 16, 10).cast("long")
    n = F.octet_length(word)
    x = byte(n) * 31 + F.when(n > 1, byte(F.greatest(n - 1, F.lit(1))) * 17).otherwise(0) + F.when(n > 8, 7).otherwise(0)
    return ((x * 2654435761) % 4294967296 % classes).cast("int")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1500,
          classes: int = 48, tail_classes: int = 64, head_words: int = 200_000) -> DataFrame:
    """Per document: its id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    (add-0.1 unigram) and ``score``; the model learns from the rows for which ``train`` holds."""
    spark = docs.sparkSession
    texts = docs.where(train)
    counts = materialise(word_counts(texts, text_col), "word-counts")
    model, rest = learn(texts, text_col, counts, vocabulary, classes, tail_classes)
    n_vocab, k = len(model.vocabulary), len(model.transition)
    first_tail = int(model.row_class[n_vocab])  # tail classes are numbered in one run, then the end's
    kinds = np.zeros((tail_classes, k))         # words outside the vocabulary by ending and class
    for r in rest.groupBy(tail_class_column(F.col("word"), tail_classes).alias("e"), "cls").agg(F.count(F.lit(1)).alias("n")).collect():
        kinds[r["e"], r["cls"]] = r["n"]
    of_class = kinds.sum(axis=0)
    # an unknown word: the class of most known words of its ending, else of most words, else the empty one of its ending
    unknown_class = np.where(kinds.any(axis=1), kinds.argmax(axis=1), of_class.argmax() if of_class.any() else first_tail + np.arange(tail_classes))
    d, total = model.discount, np.maximum(model.class_count, 1.0)
    unknown = np.where(of_class > 0, np.log10(np.maximum(d * of_class, 1e-9) / total), 0.0)
    log_total = np.log10(total)

    # bounded by ``head_words``; the vocabulary comes first.  Per head word, and last the end: its class, the class it
    # is as a context, and what it adds
    top = counts.orderBy(F.desc("c"), "word").limit(n_vocab).toArrow()
    head = rest.orderBy(F.desc("c"), "word").limit(max(head_words - n_vocab, 0)).toArrow()
    words = [bytes(w) for t in (top, head) for w in t.column("word").to_pylist()]
    c = np.concatenate([t.column("c").to_numpy() for t in (top, head)]).astype(np.float64)
    ends = model.train_tokens - int(counts.agg(F.sum("c")).first()[0] or 0)
    end_class = int(model.row_class[model.end])
    learnt = head.column("cls").to_numpy().astype(np.int64)
    tails = np.array([tail_class(w, tail_classes) for w in words[n_vocab:]], dtype=np.int64)
    cls = np.concatenate([model.row_class[:n_vocab], learnt, [end_class]]).astype(np.int64)
    context = np.concatenate([model.row_class[:n_vocab], first_tail + tails, [end_class]]).astype(np.int64)
    emission = np.concatenate([model.row_emission[:n_vocab], np.log10(np.maximum(c[n_vocab:] - d, 1e-9)) - log_total[learnt], model.row_emission[-1:]])
    base = np.log10(np.append(c, ends) + 0.1)
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, cls, context, emission, base, model.transition))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        index, cls, context, emission, base, transition = shared.value  # plain values: executors need no copy of this package
        end = len(index)

        def scored(ids: list[int], met: list, lengths: list[int]):
            """Sums per text of a slice; texts end with the end, which so stands before the first word of the next."""
            at, stop = np.array(ids, dtype=np.int64), np.cumsum(lengths)
            start = stop - lengths
            unknown = np.flatnonzero(at < 0)
            of, add, unigram, seen = context[at], emission[at], base[at], at >= 0
            if not ends:
                seen &= at != end
            of[unknown] = [first_tail + tail_class(met[i], tail_classes) for i in unknown]
            before = np.concatenate([[context[end]], of[:-1]])
            add += transition[before, cls[at]]
            add[unknown] = unigram[unknown] = 0
            rare: list[Counter] = [Counter() for _ in lengths]
            for i, g, text in zip(unknown.tolist(), before[unknown].tolist(), np.searchsorted(stop, unknown, side="right").tolist()):
                rare[text][met[i], g] += 1
            return (lengths, np.add.reduceat(seen.astype(np.int64), start).tolist(), np.add.reduceat(unigram, start).tolist(),
                    np.add.reduceat(add, start).tolist(), [[w for w, _ in r] for r in rare], [[g for _, g in r] for r in rare],
                    [list(r.values()) for r in rare])

        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            ids, met, lengths = [], [], []

            def flush():
                if lengths:
                    for values, more in zip(out, scored(ids, met, lengths)):
                        values.extend(more)
                    for x in (ids, met, lengths):
                        x.clear()
            for w in tokens(b.column(2)):
                ids.extend(map(index.get, w, repeat(-1)))
                ids.append(end)
                met.extend(w)
                met.append(None)
                lengths.append(len(w) + 1)
                if len(ids) >= SLICE_TOKENS:
                    flush()
            flush()
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip(out, types))],
                                             names=["id", "key", "words", "known", "base", "score", "rare", "prev", "times"])

    keyed = docs.select(id_col, F.xxhash64(id_col, text_col).alias("key"), text_col)
    local = materialise(keyed.mapInArrow(run, f"id {kind}, key long, words long, known long, base double, score double, "
                                              "rare array<binary>, prev array<int>, times array<long>"), "head-scores")
    # the words that are not in the head: one row per document, word and context, joined to their counts and classes
    rare = local.select("id", "key", F.explode(F.arrays_zip("rare", "prev", "times")).alias("x")).select(
        "id", "key", F.col("x.rare").alias("word"), F.col("x.prev").alias("prev"), F.col("x.times").alias("k")).distinct()
    at = lambda values, i: F.element_at(F.array(*[F.lit(x) for x in values.tolist()]), i + 1)
    met = rare.join(rest, "word", "left").withColumn("of", F.coalesce("cls", at(unknown_class, tail_class_column(F.col("word"), tail_classes))))
    steps = pa.table({"prev": np.repeat(np.arange(k), k).astype(np.int32), "of": np.tile(np.arange(k), k).astype(np.int32), "step": model.transition.ravel()})
    met = met.join(F.broadcast(spark.createDataFrame(steps)), ["prev", "of"])  # one row per pair of classes
    known = F.col("c").isNotNull()
    adds = met.groupBy("id", "key").agg(
        F.sum(F.when(known, F.col("k")).otherwise(0)).alias("a_known"),
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("a_base"),
        F.sum(F.col("k") * (F.col("step") + F.when(known, F.log10(F.greatest(F.col("c") - d, F.lit(1e-9))) - at(log_total, F.col("of")))
                            .otherwise(at(unknown, F.col("of"))))).alias("a_score"))
    own = local.select("id", "key", "words", "known", "base", "score")
    out = own.join(adds.withColumnsRenamed({"id": "i2", "key": "k2"}),
                   F.col("id").eqNullSafe(F.col("i2")) & (F.col("key") == F.col("k2")), "left")
    norm = float(np.log10(model.train_tokens + 0.1 * (model.distinct + 1)))
    zero = F.lit(0)
    return out.select(
        F.col("id").alias(id_col), F.col("words").alias("n_tokens"), (F.col("known") + F.coalesce("a_known", zero)).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("a_base", F.lit(0.0)) - F.col("words") * norm).alias("base_score"),
        (F.col("score") + F.coalesce("a_score", F.lit(0.0))).alias("score"))
