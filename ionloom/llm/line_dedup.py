"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of words (white space and letter case don't count).  A line goes if
an earlier line is the same, or, among lines of at least ``fuzzy_words`` words, differs by one word
put in, taken out or exchanged.

1. Equal lines collapse to their first occurrence.
2. Every variant of a line with one block of its words deleted (a half, at ``blocks`` 2) is emitted
   as a hashed key, for the line's length and for one less.  Two lines within the bound share such a
   key: the edit lies in one block, and the words left of it (counted from the start) and right of
   it (counted from the end) agree.  Lines that share none are done with, which is nearly all.
3. The others emit the variants with one word of the shared block deleted, and themselves.  Equal
   variants are joined through their group's earliest line, never as pairs: lines with the same
   word position deleted are all within one exchange of each other, and a line equal to a variant
   is one insertion away.
4. The edit distance of each line and the earliest line found for it is verified on the words.

All of it is DataFrame expressions.  Hot lines combine before the shuffle; hot keys meet only in
grouped counts and in equi-joins against one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, discard, let, settle, texts
from .quality import SPACES

#: Stands for a null document id in the order of lines: after all others.
LAST = (1 << 63) - 1


#: White space inside a line that isn't a single blank.
UNEVEN_SPACE = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"


def _lines(own: DataFrame) -> DataFrame:
    """A row for each line with a word: its place, and its words in lower case joined by single blanks."""
    even = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), UNEVEN_SPACE, " ")
    return own.select("d", "mark", F.posexplode(F.split(even, "\n")).alias("line", "s")).select("d", "mark", "line", F.btrim("s").alias("s")).where("s <> ''")


def _word_hashes(line: Column) -> Column:
    trimmed = F.btrim(F.lower(line), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, SPACE_CLASS + "+"), lambda w: F.xxhash64(w)))


def _block(length: Column, k: int, blocks: int) -> tuple[Column, Column]:
    """First word of block ``k`` and of the next, for lines of ``length`` words."""
    return (F.floor(length * k / blocks).cast("int"), F.floor(length * (k + 1) / blocks).cast("int"))


def _block_keys(s: Column, n: Column, fuzzy_words: int, blocks: int) -> list[Column]:
    """A hash of the words before and after each block, for the line's length and for one less."""
    words = lambda count: F.call_function("substring_index", s, F.lit(" "), count)
    keys = []
    for less in (0, 1):
        base = n - less
        for k in range(blocks):
            lo, hi = _block(base, k, blocks)
            sides = [words(lo)] * (k > 0) + [words(hi - base)] * (k < blocks - 1)
            keys.append(F.when(base >= fuzzy_words, F.xxhash64(base, F.lit(k), *sides)))
    return keys


def edit_within_one(a: Column, b: Column) -> Column:
    """Whether two arrays are equal, or differ by one element put in, taken out or exchanged."""
    shorter = F.least(F.size(a), F.size(b))

    def check(p: Column) -> Column:
        rest = lambda x, skip: F.slice(x, p + 1 + skip, F.greatest(F.size(x) - p - skip, F.lit(0)))
        return (
            F.when(F.size(a) == F.size(b), rest(a, 1) == rest(b, 1))
            .when(F.size(a) == F.size(b) + 1, rest(a, 1) == rest(b, 0))
            .when(F.size(b) == F.size(a) + 1, rest(a, 0) == rest(b, 1))
            .otherwise(False)
        )

    same = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x == y)
    agree = let(same, lambda s: F.when(F.array_position(s, F.lit(False)) > 0, F.array_position(s, F.lit(False)).cast("int") - 1).otherwise(shorter))
    return let(agree, check)


def removed_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fuzzy_words: int = 8, blocks: int = 2
) -> DataFrame:
    """Lines that go: ``doc_id``, ``mark``, ``line`` (from 0), ``kind`` (exact or near), and the place of the earlier line (``of_doc``, ``of_line``).

    "Earlier" is by document id (nulls last), then a hash of the text, then line number; a line goes
    if any earlier line, kept or not, is within the bound.  Lines without a word stay.  A null text
    has no lines.  Rows that repeat both id and text are one document (``mark`` tells texts of one id
    apart).  Texts and lines of any length are compared whole.  An empty table gives no rows.  Other
    columns are not read.  The steps before the last run at once.
    """
    own = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("mark"), "text")
    place = F.struct("d", "mark", "line")
    keys = [f"k{t}" for t in range(2 * blocks)]
    s = F.col("s")
    n_words = (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("int")
    cut = _lines(own).select("d", "mark", "line", "s", n_words.alias("n"))
    # a few hashes for each line, so that the texts are cut up once
    lines = settle(cut.select("d", "mark", "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(9), s).alias("h2"), *(k.alias(name) for name, k in zip(keys, _block_keys(s, F.col("n"), fuzzy_words, blocks)))))
    # 1: the first occurrence of each distinct line
    distinct = settle(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c"), *(F.min(k).alias(k) for k in keys)))
    # 2: lines that share a variant with a block deleted
    coarse = distinct.select("h1", F.posexplode(F.array(*keys)).alias("t", "key")).where("key is not null")
    shared = coarse.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    few = settle(coarse.join(shared, "key").groupBy("h1").agg(F.collect_set("t").alias("ts")))
    wanted = distinct.select("h1", "h2", F.col("first").alias("o")).join(few, "h1").groupBy("o.d", "o.mark").agg(F.collect_set(F.struct("o.line", "h1", "h2", "ts")).alias("wanted"))
    met = own.join(wanted, ["d", "mark"]).select("d", "mark", F.split("text", "\n").alias("all"), F.explode("wanted").alias("x"))
    table = settle(
        met.select(F.struct("d", "mark", F.col("x.line").alias("line")).alias("o"), "x.h1", "x.h2", "x.ts", _word_hashes(F.get("all", F.col("x.line"))).alias("w")).dropDuplicates(["o"])
    )
    # 3: variants with one word deleted, and the lines themselves (position -1)
    n = F.size("w")
    spots = []
    for less in (0, 1):
        for k in range(blocks):
            lo, hi = _block(n - less, k, blocks)
            spots.append(F.when(F.array_contains("ts", less * blocks + k) & (hi + less > lo), F.sequence(lo, hi + less - 1)).otherwise(F.array().cast("array<int>")))
    spot = F.explode(F.array_append(F.array_distinct(F.concat(*spots)), F.lit(-1)))
    variants = table.select("o", "w", n.alias("n"), spot.alias("i")).select(
        "o",
        "i",
        F.when(F.col("i") < 0, F.xxhash64("w"))
        .otherwise(F.xxhash64(F.concat(F.slice("w", F.lit(1), F.col("i")), F.slice("w", F.col("i") + 2, F.col("n")))))
        .alias("v"),
    )
    meet = variants.groupBy("v").agg(F.count("*").alias("c"), F.min(F.when(F.col("i") < 0, F.col("o"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("o"))).alias("cut")).where("c > 1")
    joined = variants.join(meet.select("v", "whole", "cut"), "v")
    spotwise = joined.where("i >= 0").groupBy("v", "i").agg(F.min("o").alias("same"))
    tied = joined.join(spotwise, ["v", "i"], "left")
    earlier = tied.select("o", F.when(F.col("i") < 0, F.col("cut")).otherwise(F.least("same", "whole")).alias("of")).where("of < o")
    pairs = earlier.distinct()
    # 4: verify on the words, and take the earliest
    left = table.select("o", "h1", "h2", F.col("w").alias("wa"))
    right = table.select(F.col("o").alias("of"), F.col("w").alias("wb"))
    near = pairs.join(left, "o").join(right, "of").where(edit_within_one(F.col("wa"), F.col("wb"))).groupBy("h1", "h2").agg(F.min("of").alias("of"))
    # every occurrence of lines that occur twice or are near an earlier one
    # (settled, so that the join's sides come straight from a shuffle and a hot line can be split)
    known = settle(distinct.select("h1", "h2", "first", "c").join(near, ["h1", "h2"], "left").where("c > 1 or of is not null").select("h1", "h2", "first", "of"))
    discard(docs.sparkSession, distinct, few, table)
    places = lines.select(place.alias("o"), "h1", "h2")
    gone = places.join(known, ["h1", "h2"]).where("o > first or of is not null")
    exact = F.col("o") > F.col("first")
    earliest = F.when(exact, F.col("first")).otherwise(F.col("of"))
    null_last = lambda c: F.when(c == LAST, None).otherwise(c)
    return gone.select(
        null_last(F.col("o.d")).alias("doc_id"),
        F.col("o.mark").alias("mark"),
        F.col("o.line").cast("long").alias("line"),
        F.when(exact, "exact").otherwise("near").alias("kind"),
        null_last(earliest["d"]).alias("of_doc"),
        earliest["line"].cast("long").alias("of_line"),
    ).distinct()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True, **bounds) -> DataFrame:
    """``docs`` with the removed lines taken out of the texts; cases as in :func:`removed_lines`.

    With ``drop_emptied``, documents all of whose words went are dropped; a text that had no words
    stays as it is, null included.  Other columns stay as they are.
    """
    gone = removed_lines(docs, id_col=id_col, text_col=text_col, **bounds)
    lists = gone.groupBy("doc_id", "mark").agg(F.collect_set(F.col("line").cast("int")).alias("_gone"))
    lists = lists.select(F.coalesce("doc_id", F.lit(LAST)).alias("_d"), F.col("mark").alias("_mark"), "_gone")
    text = docs[text_col]
    names = docs.columns
    keyed = docs.select(
        F.struct(*(docs[c] for c in names)).alias("_row"), F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("_d"), F.xxhash64(text.cast("string")).alias("_mark")
    )
    met = keyed.join(lists, ["_d", "_mark"], "left")
    old = F.col("_row")[text_col]
    new = F.when(F.col("_gone").isNull(), old).otherwise(
        let(F.split(old, "\n"), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone"), lambda i: F.get(parts, i)), "\n"))
    )
    out = met.select("_row", "_gone", new.alias("_new"))
    if drop_emptied:
        out = out.where(F.col("_gone").isNull() | (F.btrim("_new", F.lit(SPACES)) != ""))
    return out.select(*(F.col("_new").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names))


ORACLE = """
    WITH occ AS (
        SELECT doc_id, (unnest(generate_series(1, len(ls))) - 1)::BIGINT AS line, unnest(ls) AS s
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
    worded AS (
        SELECT doc_id, line, w FROM (SELECT doc_id, line, regexp_extract_all(lower(s), '[^\\x20\\x09-\\x0D]+') AS w FROM occ) WHERE len(w) > 0),
    firsts AS (SELECT w, min((doc_id, line)) AS f FROM worded GROUP BY w),
    cuts AS (
        SELECT w, f, i, list_concat(w[1:i - 1], w[i + 1:]) AS v
        FROM (SELECT w, f, unnest(generate_series(1, len(w))) AS i FROM firsts WHERE len(w) >= 8)),
    near AS (
        SELECT w, min(f2) AS f2 FROM (
            SELECT b.w, a.f AS f2 FROM cuts a JOIN cuts b ON a.v = b.v AND a.i = b.i WHERE a.f < b.f
            UNION ALL SELECT c.w, s.f FROM cuts c JOIN firsts s ON c.v = s.w WHERE len(s.w) >= 8 AND s.f < c.f
            UNION ALL SELECT s.w, c.f FROM cuts c JOIN firsts s ON c.v = s.w WHERE len(s.w) >= 8 AND c.f < s.f)
        GROUP BY w)
    SELECT doc_id::BIGINT AS doc_id, line, CASE WHEN (doc_id, line) > f THEN 'exact' ELSE 'near' END AS kind,
           (CASE WHEN (doc_id, line) > f THEN f[1] ELSE f2[1] END)::BIGINT AS of_doc,
           (CASE WHEN (doc_id, line) > f THEN f[2] ELSE f2[2] END)::BIGINT AS of_line
    FROM worded JOIN firsts USING (w) LEFT JOIN near USING (w) WHERE (doc_id, line) > f OR f2 IS NOT NULL
"""
