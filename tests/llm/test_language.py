"""Language ID: the model against a plain one, held-out accuracy, and awkward texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import language, queries

ALPHABETS = {"aa": "aeiounrstl", "bb": "aäeiourdkm", "cc": "бвгдаеио"}


def corpus(n=240, seed=3):
    rnd = random.Random(seed)
    words = {lang: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 8))) for _ in range(150)] for lang, letters in ALPHABETS.items()}
    out = []
    for i in range(n):
        lang = sorted(words)[i % 3]
        text = " ".join(rnd.choice(words[lang]) if rnd.random() < 0.7 else "".join(rnd.choice(ALPHABETS[lang]) for _ in range(6)) for _ in range(rnd.randint(1, 60)))
        out.append((i, text, lang, "s", 1))
    return out


def plain(train, longest=5):
    """Counts by language in dictionaries, and a scorer that follows the definition."""
    counts = [defaultdict(Counter) for _ in range(longest + 1)]
    for text, lang in train:
        for w in language.WORD.findall(text.lower()):
            counts[0][lang][w] += 1
            for n in range(1, longest + 1):
                padded = f" {w} " if n > 1 else w
                counts[n][lang].update(padded[i : i + n] for i in range(len(padded) - n + 1))
    sizes = Counter(lang for _, lang in train)
    names = sorted(sizes, key=lambda x: (-sizes[x], x))

    def log(n, g):
        if not any(g in counts[n][x] for x in names):
            return None
        penalty = -math.log(max(sum(counts[n][x].values()) for x in names)) - 1
        return np.array([math.log(counts[n][x][g] / sum(counts[n][x].values())) if g in counts[n][x] else penalty for x in names])

    def predict(text):
        words = language.WORD.findall((text or "").lower())
        if not words:
            return "und", 0.0
        total = np.zeros(len(names))
        for w in words:
            score = log(0, w)
            n = longest
            while score is None and n:
                padded = f" {w} " if n > 1 else w
                found = [x for x in (log(n, padded[i : i + n]) for i in range(len(padded) - n + 1)) if x is not None]
                score, n = (np.mean(found, axis=0) if found else None), n - 1
            total += 0 if score is None else score
        return names[int(total.argmax())], float(1 / np.exp(total - total.max()).sum())

    return predict


def test_against_plain_model(spark, empty):
    from .conftest import table

    rows = corpus()
    got = {r.doc_id: r for r in language.language_id(table(spark, rows)).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    predict = plain([(t, lang) for i, t, lang, *_ in rows if not out[i]])
    right = 0
    for i, text, lang, *_ in rows:
        want = predict(text)
        assert got[i].held_out == out[i] and got[i].lang_pred == want[0] and got[i].score == pytest.approx(want[1], abs=1e-9)
        right += out[i] and got[i].lang_pred == lang
    assert right >= 0.95 * sum(out.values()) > 30
    assert language.language_id(empty).collect() == []


def test_awkward_texts(spark, rows):
    from .conftest import table

    more = [(1000 + i, t, lang, s, n) for i, t, lang, s, n in corpus()]
    odd = [(20, "123 ²½ _ +", "aa", "s", 1), (21, "漢字", "aa", "s", 1), (22, "x́ É", None, "s", 1), (23, "ab" * 1_500_000, None, "s", 1), (24, "unr stl " * 300_000, None, "s", 1)]
    got = defaultdict(list)
    for r in language.language_id(table(spark, [*rows, *more, *odd, *odd[:1]])).collect():
        got[r.doc_id].append(r)
    learned = {lang for _, t, lang, *_ in [*rows, *more] if lang is not None and t is not None}
    for i, text, *_ in [*rows, *odd]:
        for r in got[i]:
            assert 0 <= r.score <= 1 and (r.lang_pred in learned or r.lang_pred == "und")
    assert [r.lang_pred for r in got[20]] == ["und", "und"] and got[1][0].lang_pred == got[2][0].lang_pred == got[3][0].lang_pred == "und"
    assert len(got[5]) == 2 and got[None][0].held_out and got[21][0].lang_pred != "und" and got[24][0].lang_pred in ("aa", "en", "de", "fr")


def test_labels_are_no_input(spark):
    """Other languages, sources and ids of held-out rows change no prediction."""
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(spark.createDataFrame(rows, schema)).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    other = [(i, t, "zz" if out(i) else lang, "t", n) for i, t, lang, _, n in rows]
    two = {r.doc_id: (r.lang_pred, r.score) for r in language.language_id(spark.createDataFrame(other, schema)).collect()}
    assert one.keys() == two.keys() and all(one[i][0] == two[i][0] and one[i][1] == pytest.approx(two[i][1]) for i in one)


def test_nothing_to_learn_and_small_bounds(spark):
    rows = corpus(60)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    unlabelled = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in rows], schema)
    assert {(r.lang_pred, r.score) for r in language.language_id(unlabelled).collect()} == {("und", 0.0)}
    df = spark.createDataFrame(rows, schema)
    model = language.fit(df, fit_rows=5, languages=2, entries=60)
    assert model.languages == ["aa", "bb"] and all(len(places) <= 60 for places, _ in model.tables)
    kept = df.where(~language.held_out()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2)
    assert {r.lang_pred for r in language.language_id(df, fit_rows=5, languages=2, entries=60).collect()} <= {r.lang for r in kept.collect()}


def test_words_are_cut_between_blocks(monkeypatch):
    text = "Ab c1d e-f " * 50 + "z" * 100
    whole = language.word_counts(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(language, "BLOCK", size)
        assert language.word_counts(text) == whole


def test_query(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_language(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")] and got.count() == 240
