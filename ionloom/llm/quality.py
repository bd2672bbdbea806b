"""Quality rules by distribution divergence.

Each document has two histograms: of its character classes and of its language's common words.
A language's reference is the mean histogram of all its documents that are long enough, so it is
read from the whole corpus.  A document is rejected where its Jensen-Shannon distance from the
reference is over a threshold (for common words, a share of the distance that a text without any of
them has, since most words of any text are others), provided it is long enough for the histogram to mean something;
the base rules (too few words, too many repeated words) reject on their own.

Everything is DataFrame expressions: a document is one row throughout, and the only shuffle is of
one partial sum per language and task.  The references are at most one row for each language that
has a word list and one for the rest, which is why they may be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let

#: Common function words of each language, as they stand inside a sentence.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"),
    "en": ("the", "of", "and", "to", "a", "in", "that", "is", "was", "it", "for", "on", "with", "as", "be", "at"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
CLASSES = ("lower", "upper", "digit", "point", "symbol", "wide", "space")
SPACES = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def _repeat_words(hashes: Column, window: int) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def covered(ordered: Column) -> Column:
        repeated = F.filter(
            ordered,
            lambda s, k: F.coalesce(F.get(ordered, k - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == s["h"], F.lit(False)),
        )
        starts = F.array_sort(F.transform(repeated, lambda s: s["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            zero,
            lambda acc, i: F.struct((acc["n"] + i + window - F.greatest(acc["end"], i)).alias("n"), (i + window).alias("end")),
            lambda acc: acc["n"],
        )

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, covered))


def _histograms(docs: DataFrame) -> DataFrame:
    """Words, character-class counts and common-word counts of each text."""
    key = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise("")
    lists = reduce(
        lambda rest, item: F.when(F.col("key") == item[0], F.array(*map(F.lit, item[1]))).otherwise(rest),
        COMMON_WORDS.items(),
        F.array().cast("array<string>"),
    )
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    step = docs.select("doc_id", "_row", "text", key.alias("key"), _words(F.coalesce("text", F.lit(""))).alias("words"))
    step = step.select(
        "*",
        F.array_join("words", "").alias("glued"),
        F.filter("words", lambda w: w.isin(*every)).alias("common"),
        lists.alias("list"),
    )
    step = step.select("*", F.regexp_replace("glued", "[a-z]+", "").alias("rest"))
    count = lambda pattern: F.char_length("rest") - F.char_length(F.regexp_replace("rest", pattern, ""))
    step = step.select(
        "doc_id",
        "_row",
        "text",
        "key",
        "words",
        F.char_length("glued").alias("word_chars"),
        F.transform("list", lambda c: F.size(F.filter("common", lambda w: w == c))).alias("hits"),
        (F.char_length("glued") - F.char_length("rest")).alias("lower"),
        count("[A-Z]+").alias("upper"),
        count("[0-9]+").alias("digit"),
        count("""[.,;:!?'"()-]+""").alias("point"),
        F.char_length(F.regexp_replace("rest", r"[\x00-\x7F]+", "")).alias("wide"),
        F.char_length("rest").alias("n_rest"),
        (F.char_length(F.coalesce("text", F.lit(""))) - F.char_length("glued")).alias("space"),
    )
    step = step.withColumn("symbol", F.col("n_rest") - F.col("upper") - F.col("digit") - F.col("point") - F.col("wide"))
    return step.select(
        "doc_id",
        "_row",
        "text",
        "key",
        "words",
        F.size("words").alias("n_words"),
        "word_chars",
        (F.col("word_chars") + F.col("space")).alias("n_chars"),
        F.array(*(F.col(c).cast("double") for c in CLASSES)).alias("class_hist"),
        F.when(
            F.size("hits") > 0,
            F.concat(
                F.transform("hits", lambda n: n.cast("double")),
                F.array((F.size("words") - F.aggregate("hits", F.lit(0), lambda a, n: a + n)).cast("double")),
            ),
        )
        .otherwise(F.array().cast("array<double>"))
        .alias("word_hist"),
    )


def _share(hist: Column, total: Column) -> Column:
    return F.transform(hist, lambda n: n / total)


def _references(hists: DataFrame, min_chars: int, min_words: int) -> DataFrame:
    """``key``, ``class_ref``, ``word_ref``: mean shares over the documents that are long enough."""
    width = max(map(len, COMMON_WORDS.values())) + 1
    long_c, long_w = F.col("n_chars") >= min_chars, F.col("n_words") >= min_words
    sums = [F.avg(F.when(long_c, F.get("class_hist", F.lit(i)) / F.col("n_chars"))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.avg(F.when(long_w, F.get("word_hist", F.lit(i)) / F.col("n_words"))).alias(f"w{i}") for i in range(width)]
    means = hists.groupBy("key").agg(*sums)
    return means.select(
        F.col("key").alias("ref_key"),
        F.array(*(f"c{i}" for i in range(len(CLASSES)))).alias("class_ref"),
        F.array(*(f"w{i}" for i in range(width))).alias("word_ref"),
        _ceiling(F.col(f"w{width - 1}")).alias("word_ceiling"),
    )


def references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_chars: int = 200, min_words: int = 60) -> DataFrame:
    """The references of ``docs``, a row for each language that has a word list and one for the rest, to be stored and given to :func:`quality`."""
    own = docs.select(F.lit(None).cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), F.struct(F.lit(1).alias("_")).alias("_row"))
    return _references(_histograms(own), min_chars, min_words)


def _ceiling(rest: Column) -> Column:
    """The word distance of a text without any common word, by the reference's share of other words."""
    return F.sqrt((1 - rest + F.log2(2 / (1 + rest)) + F.when(rest > 0, rest * F.log2(2 * rest / (1 + rest))).otherwise(0.0)) / 2)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares (null where either has a null)."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.when(a.isNull(), None).otherwise(0.0))

    parts = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)))


def quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    window: int = 8,
    fewest_words: int = 20,
    most_repeat_percent: int = 30,
    min_chars: int = 200,
    min_words: int = 60,
    most_class_distance: float = 0.3,
    most_word_share: float = 0.97,
    keep: tuple[str, ...] = (),
    stored: DataFrame | None = None,
) -> DataFrame:
    """Counts, distances and the verdict ``kept`` for each row of ``docs``.

    Words are runs of anything but ASCII white space.  A null text has no words and fails the base
    rules, as do all texts of under ``fewest_words`` words.  A null or unlisted language is compared
    with the mean of all such documents, by character classes only.  A document below ``min_chars``
    characters or ``min_words`` words isn't judged by that histogram (its distance is null), nor is
    any where no document is long enough to make a reference.  Texts of any length are judged whole; a
    distance at a threshold (a tie) passes.  Repeated rows and null ids each have
    their row; an empty table gives no rows; other columns are not read, but those in ``keep``, which
    come along in a struct ``_row``.  ``stored``: references made before (:func:`references`), in place
    of those of ``docs``, which saves the pass over them.
    """
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    row = F.struct(*(docs[c] for c in keep), F.lit(1).alias("_"))
    hists = _histograms(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), lang.alias("lang"), row.alias("_row")))
    refs = _references(hists, min_chars, min_words) if stored is None else stored
    with_hashes = hists.select(
        "*",
        F.when(
            F.col("n_words") >= window,
            F.transform(F.sequence(F.lit(1), F.col("n_words") - window + 1), lambda i: F.xxhash64(F.slice("words", i, window))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("hashes"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "").alias("lines"),
    )
    counted = with_hashes.select(
        "doc_id",
        "_row",
        "key",
        "n_chars",
        "class_hist",
        "word_hist",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        (F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("hashes"), window).cast("long").alias("n_repeat_words"),
    )
    judged = counted.join(F.broadcast(refs), counted["key"] == refs["ref_key"], "left").select(
        "doc_id",
        "_row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("n_chars") >= min_chars, js_distance(_share(F.col("class_hist"), F.col("n_chars")), F.col("class_ref"))).alias("class_distance"),
        F.when(
            (F.col("n_words") >= min_words) & (F.size("word_hist") > 0),
            js_distance(_share(F.col("word_hist"), F.col("n_words")), F.col("word_ref")),
        ).alias("word_distance"),
        "word_ceiling",
    )
    over = (F.coalesce("class_distance", F.lit(0.0)) > most_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > F.coalesce(F.lit(most_word_share) * F.col("word_ceiling"), F.lit(2.0)))
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*own, (~F.col("base_failed") & ~over).alias("kept"), "class_distance", "word_distance", *(["_row"] if keep else []))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that :func:`quality` keeps, with their columns.

    The verdict is worked out beside the row, so no join is needed and repeated rows are judged each
    for itself.
    """
    names = docs.columns
    judged = quality(docs, keep=tuple(names), **options)
    # Counting what is judged also keeps the filter above the expressions that it is made of: pushed
    # below them it would repeat each of them many times over.
    held = judged.select("_row", "kept").observe("judged", F.count(F.lit(1)).alias("documents"))
    return held.where("kept").select(*(F.col("_row")[c].alias(c) for c in names))


def oracle(min_chars: int = 200, min_words: int = 60, most_class: float = 0.3, most_word: float = 0.97) -> str:
    """The registered query's rows in SQL."""
    listed = ", ".join(f"('{k}', {i}, '{w}')" for k, words in COMMON_WORDS.items() for i, w in enumerate(words))
    keys = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    one = lambda p: f"length(regexp_replace(t, '[^{p}]', '', 'g'))"
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    distance = f"sqrt(greatest(0, sum(({term('p', 'q')} + {term('q', 'p')}) / 2)))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({keys}) THEN lang ELSE '' END AS k FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, length(t) AS n_chars FROM d),
    c AS (SELECT *, len(ws) AS n, length(list_aggregate(list_prepend('', ws), 'string_agg', '')) AS wc, {one("a-z")} AS c0, {one("A-Z")} AS c1, {one("0-9")} AS c2,
            length(regexp_replace(t, '[^.,;:!?''"()-]', '', 'g')) AS c3, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) AS c5 FROM w),
    cls AS (SELECT rid, k, n_chars, unnest([0, 1, 2, 3, 4, 5, 6]) AS i, unnest([c0, c1, c2, c3, wc - c0 - c1 - c2 - c3 - c5, c5, n_chars - wc])::DOUBLE / n_chars AS p FROM c WHERE n_chars >= {min_chars}),
    cls_ref AS (SELECT k, i, avg(p) AS q FROM cls GROUP BY ALL),
    cd AS (SELECT rid, {distance} AS cd FROM cls JOIN cls_ref USING (k, i) GROUP BY rid),
    lists(k, i, word) AS (VALUES {listed}),
    occ AS (SELECT rid, k, unnest(ws) AS word FROM c WHERE n >= {min_words} AND k <> ''),
    hit AS (SELECT rid, i, count(*) AS m FROM occ JOIN lists USING (k, word) GROUP BY ALL),
    grid AS (SELECT c.rid, c.k, c.n, l.i, coalesce(h.m, 0) AS m FROM c JOIN lists l ON l.k = c.k LEFT JOIN hit h ON h.rid = c.rid AND h.i = l.i WHERE c.n >= {min_words}),
    wrd AS (SELECT rid, k, i, m::DOUBLE / n AS p FROM grid UNION ALL SELECT rid, k, 99, (any_value(n) - sum(m))::DOUBLE / any_value(n) FROM grid GROUP BY rid, k),
    wrd_ref AS (SELECT k, i, avg(p) AS q FROM wrd GROUP BY ALL),
    top AS (SELECT k, sqrt((1 - q + log2(2 / (1 + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (1 + q)) ELSE 0 END) / 2) AS ceiling FROM wrd_ref WHERE i = 99),
    wd AS (SELECT rid, {distance} / any_value(ceiling) AS wd FROM wrd JOIN wrd_ref USING (k, i) JOIN top USING (k) GROUP BY rid),
    win AS (SELECT rid, i, ws[i:i + 7] AS g FROM (SELECT rid, ws, unnest(generate_series(1, n - 7)) AS i FROM c WHERE n >= 8)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS m FROM win) WHERE m > 1),
    rep AS (SELECT rid, count(DISTINCT i + j) AS m FROM twice, (SELECT unnest(generate_series(0, 7)) AS j) GROUP BY rid),
    ln AS (SELECT rid, count(*) - count(DISTINCT s) AS m FROM (SELECT rid, unnest(string_split(t, chr(10))) AS s FROM c) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
    b AS (SELECT c.rid, doc_id, n, wc, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS sy, coalesce(ln.m, 0) AS dl, coalesce(rep.m, 0) AS rw FROM c LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid))
    SELECT doc_id::BIGINT AS doc_id, n::BIGINT AS n_words, wc::BIGINT AS word_chars, sy::BIGINT AS n_symbols, dl::BIGINT AS n_dup_lines, rw::BIGINT AS n_repeat_words,
           (n < 20 OR 100 * rw > 30 * n) AS base_failed, NOT (n < 20 OR 100 * rw > 30 * n) AND coalesce(cd, 0) <= {most_class} AND coalesce(wd, 0) <= {most_word} AS kept
    FROM b LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid)"""
