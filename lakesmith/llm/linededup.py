"""Line deduplication by a deletion-neighbourhood join (native).

A line is the sequence of its words; two lines match if they are equal, or if both have at least
``near_min_words`` words and differ by one word inserted, deleted or substituted.  A line goes if an
earlier line (by document id, then line number) matches it.

Deleting one word of a line gives its neighbourhood.  Two lines within one edit share a variant:
the same position deleted from both (substitution), or a deletion from one that equals the other
(insertion).  So every bucket of equal variants needs only its earliest member: a line's witness is
a minimum, taken with map-side combining, and no pairs within a bucket are made.  Each line's
witness is then verified by comparing the words.

Variants are emitted only for lines that can have a partner: of two lines within one edit, either
the first or the second half is equal, so lines whose half keys are all unique are left out first
(that loses nothing), and of the rest only deletions in the half that differs are made.  Variant keys
are mended sums of word hashes, so a line of n words costs n, not n * n.  A rearrangement with the same
neighbouring words has the same sum and may stand before the true witness; lines whose witness fails
the check, and all lines in their buckets, go through a second join on hashes of the whole variants.

Defined results: null text stays null; lines without a word are never dropped; a document of which
nothing is left has an empty text; rows equal in id and text are treated alike and are not each
other's duplicates; rows of equal id and different text are ordered by text hash; a null id sorts
first; an empty table gives an empty table; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesmith.llm.common import BLANKS, bind, bit_filter, materialise, may_contain, words
from lakesmith.operators.sequence import dense_id

LINE = ["h1", "h2"]  # a line's identity: 128 bits over its words


def _half_keys(w: Column, n: Column) -> list[Column]:
    """First and second half, of the line as the shorter one (length n) and as the longer one
    (partner of length n - 1) of a pair."""
    out = []
    for size in (n, n - 1):
        head = F.floor(size / 2).cast("int")
        out += [F.xxhash64(F.lit("head"), size, F.slice(w, F.lit(1), head)),
                F.xxhash64(F.lit("tail"), size, F.slice(w, n - (size - head) + 1, size - head))]
    return out


def _lines(docs: DataFrame, id_col: str, text_col: str, near_min_words: int) -> DataFrame:
    x = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("d"), F.xxhash64(text_col).alias("th"),
        F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    x = x.where(F.btrim("line", F.lit(BLANKS)) != "").select("d", "th", "no", words(F.col("line")).alias("w"))
    n = F.size("w")
    keys = F.when(n >= near_min_words, F.array(*_half_keys(F.col("w"), n)))
    return x.select("d", "th", "no", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("b"), "w").alias("h2"), keys.alias("keys"))


def _same_but_one(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one edit: common head, then one step, then equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")  # 0: all equal
    rest = lambda w, skip: F.slice(w, at + F.when(skip, 1).otherwise(0), F.size(w))
    longer, shorter = F.size(a) >= F.size(b), F.size(b) >= F.size(a)
    return (at == 0) | ((F.abs(F.size(a) - F.size(b)) <= 1)
                        & (rest(F.when(at > 0, a).otherwise(F.array(F.lit(""))), longer & (at > 0))
                           == rest(F.when(at > 0, b).otherwise(F.array(F.lit(""))), shorter & (at > 0))))


P61 = (1 << 61) - 1


def _neighbourhood(w: Column, mask: Column, kind: str) -> Column:
    """Variant keys of a line's words.  ``kind`` sub: one position deleted (from both lines of a
    substitution), del: one deleted so that the rest may equal a shorter line, full: the line itself.

    Substitution keys are the XOR of (word, position) hashes without one position; insertion keys
    are the sum of hashes of neighbouring words, mended around the deleted one.  Both cost one step
    a position.  ``mask`` tells which halves are shared (bits as in ``_half_keys``): an edit lies in
    the other half, so only its positions are emitted."""
    pair = lambda a, b: F.xxhash64(F.coalesce(a, F.lit(" ")), F.lit(0), F.coalesce(b, F.lit(" "))).bitwiseAND(F.lit((1 << 60) - 1))
    n, has = F.size(w), lambda bit: mask.bitwiseAND(F.lit(1 << bit)) != 0
    middle, upper = F.floor(n / 2), F.floor((n - 1) / 2)

    def keys(own: Column) -> Column:  # x: hashes of (word, position), t: their XOR, c: the sum over neighbours
        def of(i: Column) -> Column:
            left, right = F.get(w, i - 1), F.get(w, i + 1)
            mended = F.pmod((own["c"] - pair(left, w[i]) + pair(left, right)) % P61 - pair(w[i], right), F.lit(P61))
            if kind == "sub":
                return F.xxhash64(F.lit("sub"), n, i, own["t"].bitwiseXOR(own["x"][i]))
            return F.xxhash64(F.lit("ins"), n - 1, mended)
        if kind == "full":
            return F.when(has(0) | has(1), F.array(F.xxhash64(F.lit("ins"), n, own["c"]))).otherwise(F.array().cast("array<bigint>"))
        if kind == "sub":
            wanted = lambda i: (has(0) & (i >= middle)) | (has(1) & (i < middle))
        else:
            wanted = lambda i: (has(2) & (i >= upper)) | (has(3) & (i <= upper))
        return F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: wanted(i)), lambda i: of(i))

    x = F.transform(w, lambda v, i: F.xxhash64(v, i))
    p = F.transform(w, lambda v, i: pair(v, F.get(w, i + 1)))
    totals = bind(F.struct(x.alias("x"), p.alias("p")), lambda o: F.struct(
        o["x"].alias("x"), F.aggregate(o["x"], F.lit(0).cast("long"), lambda acc, v: acc.bitwiseXOR(v)).alias("t"),
        F.aggregate(o["p"], pair(F.lit(None).cast("string"), w[0]), lambda acc, v: (acc + v) % P61).alias("c")))
    return bind(totals, lambda o: keys(o))


def _spelled(w: Column, kind: str) -> Column:
    """``_neighbourhood`` for insertions with hashes over the whole variant (n * n for n words)."""
    n = F.size(w)
    if kind == "full":
        return F.array(F.xxhash64(w))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.slice(w, F.lit(1), i - 1), F.slice(w, i + 1, n))))


def _insertions(fulls: DataFrame, dels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``(lid, by)``: lines that equal a deletion variant of another, with the earliest such line;
    and ``(lid, key)`` of the deletion variants that equal a line."""
    least_full = materialise(fulls.groupBy("key").agg(F.min("lid").alias("by")), f"{name}-whole-lines")
    longer = materialise(dels.join(least_full, "key"), f"{name}-insertions")
    # a whole line equal to a variant of an earlier, longer line
    least_del = longer.groupBy("key").agg(F.min("lid").alias("by"))
    found = longer.where("by < lid").select("lid", "by").unionAll(
        fulls.join(least_del, "key").where("by < lid").select("lid", "by"))
    return found, longer.select("lid", "key")


def _verified(met: DataFrame, told: DataFrame) -> DataFrame:
    """Lines of ``met`` whose witness differs by one edit in fact."""
    mine = told.select("lid", F.col("w").alias("a"))
    theirs = told.select(F.col("lid").alias("by"), F.col("w").alias("b"))
    return met.join(mine, "lid").join(theirs, "by").where(_same_but_one(F.col("a"), F.col("b"))).select("lid").distinct()


def near_lines(lines: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct lines ``(h1, h2)`` that an earlier distinct line matches by one edit."""
    keyed = lines.where(F.col("keys").isNotNull())
    shared = materialise(keyed.select("h1", F.explode("keys").alias("key")).groupBy("key")
                         .agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("key"), "shared-halves")
    halves = keyed.select("d", "th", "no", *LINE, F.posexplode("keys").alias("ki", "key"))
    halves = may_contain(halves, F.col("key"), bit_filter(shared, "key"), "may").where("may")  # most are unique: not shuffled
    able = (halves.join(shared, "key", "left_semi")
            .groupBy(*LINE).agg(F.min(F.struct("d", "th", "no")).alias("at"),
                                F.bit_or(F.expr("shiftleft(1, ki)")).alias("mask")))
    # numbered in line order, so that the earliest of a bucket is the least number
    able = dense_id(able.select(*LINE, "at.*", "mask"), ["d", "th", "no"], name="lid")
    able = materialise(able, "partner-lines")
    per_doc = able.groupBy("d", "th").agg(F.collect_list(F.struct("no", "lid", "mask")).alias("ls"))  # a document's lines
    row_key = lambda d, th: F.xxhash64(d, th)
    bitmap = bit_filter(able.select(row_key("d", "th").alias("k")), "k")
    texts = docs.select(F.col(id_col).alias("d0"), F.xxhash64(text_col).alias("th0"), F.col(text_col).alias("text0"))
    texts = may_contain(texts, row_key("d0", "th0"), bitmap, "may").where("may")
    cond = F.col("d").eqNullSafe(F.col("d0")) & (F.col("th") == F.col("th0"))
    told = (texts.join(per_doc, cond).select(F.split("text0", "\n").alias("all"), F.explode("ls").alias("l"))
            .select("l.lid", "l.mask", words(F.get("all", F.col("l.no"))).alias("w")))
    told = materialise(told, "partner-words")
    subs, dels, fulls = (told.select("lid", F.explode(_neighbourhood(F.col("w"), F.col("mask"), kind)).alias("key"))
                         for kind in ("sub", "del", "full"))
    first = materialise(subs.groupBy("key").agg(F.min("lid").alias("by"), F.max("lid").alias("last"))
                        .where("by < last").select("key", "by"), "substitutions")
    changed = materialise(subs.join(first, "key").where("by < lid").groupBy("lid").agg(F.min("by").alias("by")), "changed")
    inserted, longer = _insertions(fulls, dels, "near")
    met = materialise(changed.unionAll(inserted).groupBy("lid").agg(F.min("by").alias("by")), "witnesses")
    sure = materialise(_verified(met, told), "verified")
    failed = materialise(met.join(sure, "lid", "left_anti").select("lid"), "unverified")
    if not failed.isEmpty():
        keyed_by = fulls.unionAll(longer)  # a deletion variant that equals no line decides nothing
        suspect = keyed_by.join(failed, "lid", "left_semi").select("key").distinct()
        again = materialise(told.join(keyed_by.join(suspect, "key", "left_semi").select("lid").distinct(), "lid", "left_semi"),
                            "second-look")
        exact = {k: again.select("lid", F.explode(_spelled(F.col("w"), k)).alias("key")) for k in ("full", "del")}
        second = changed.join(failed, "lid", "left_semi").unionAll(_insertions(exact["full"], exact["del"], "exact")[0])
        sure = sure.unionAll(_verified(second.distinct(), told)).distinct()
    return able.join(sure, "lid").select(*LINE)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_min_words: int = 8,
                        lines_col: str | None = None, dropped_col: str | None = None) -> DataFrame:
    """``docs`` with every repeated line removed from ``text_col``; with ``lines_col`` and
    ``dropped_col`` the numbers of lines with a word, and of those removed, are appended."""
    lines = materialise(_lines(docs, id_col, text_col, near_min_words), "lines")
    at = F.struct("d", "th", "no")
    near = near_lines(lines, docs, id_col, text_col).select(*LINE, F.lit(None).cast(
        lines.select(at.alias("a")).schema["a"].dataType).alias("first"), F.lit(True).alias("near"))
    # only lines seen twice, or near an earlier one, can lose a copy
    twice = (lines.groupBy(*LINE).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(*LINE, "first", F.lit(None).cast("boolean").alias("near")))
    judged = materialise(twice.unionAll(near).groupBy(*LINE).agg(F.max("first").alias("first"), F.max("near").alias("near")),
                         "repeated-lines")
    repeated = may_contain(lines.select("d", "th", "no", *LINE), F.col("h1"), bit_filter(judged, "h1"), "may").where("may")
    drops = (repeated.join(judged, LINE)
             .where(F.col("near").isNotNull() | (at != F.col("first")))
             .groupBy("d", "th").agg(F.collect_set("no").alias("__drops")))  # at most a document's lines
    drops = materialise(drops, "line-drops").withColumnsRenamed({"d": "__d2", "th": "__th2"})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    x = docs.select(row, F.col(id_col).alias("__d"), F.xxhash64(text_col).alias("__th"))
    bitmap = bit_filter(drops.select(F.xxhash64("__d2", "__th2").alias("k")), "k")
    x = may_contain(x, F.xxhash64("__d", "__th"), bitmap, "__may")
    # documents that lose nothing are not shuffled
    hit = x.where("__may").join(drops, F.col("__d").eqNullSafe(F.col("__d2")) & (F.col("__th") == F.col("__th2")), "left")
    none = F.lit(None).cast("array<int>")
    x = hit.select("__row", "__drops").unionAll(x.where("not __may").select("__row", none.alias("__drops")))
    text = F.col("__row").getField(text_col)
    def rebuilt(ls: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__drops"))
        return F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n")
    new = F.when(F.col("__drops").isNull(), text).otherwise(bind(F.split(text, "\n"), rebuilt))
    out = [new.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns]
    if lines_col:
        worded = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
        out.append(F.size(worded).cast("long").alias(lines_col))
    if dropped_col:
        out.append(F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias(dropped_col))
    return x.select(*out)
