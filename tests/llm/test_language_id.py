"""Cross-parsing against substring search, and held-out languages."""
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from redline.llm import language_id as li
from redline.llm import queries

SYLLABLES = {"aa": ["ba", "ko", "ri", "ten"], "bb": ["schu", "ach", "ung", "ei"], "cc": ["ção", "lho", "ém", "ri"]}


def symbols(text):
    return li.SYMBOLS[np.frombuffer(text.encode(), np.uint8)].tobytes()


def phrases(text, reference):
    """Greedy longest matches by searching the reference itself."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in reference:
            j += 1
        if text[i:i + 1] not in reference:
            j = i + 1
        n, i = n + 1, j
    return n


def test_automaton_knows_exactly_the_substrings():
    text = b"abcbcabcabbbcab"
    edges = li.suffix_automaton(text)
    parts = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}

    def known(p):
        s = 0
        for c in p:
            if c not in edges[s]:
                return False
            s = edges[s][c]
        return True

    assert all(known(p) for p in parts)
    assert not any(known(p + b"z") or known(b"cc" + p) for p in parts)


def test_phrase_counts_match_substring_search():
    rnd = random.Random(4)
    refs = ["".join(rnd.choice("abé ") for _ in range(60)), "xyzxxyy zz", ""]
    parser = li.Parser(li.LanguageModel(["a", "b", "c"], [symbols(r) for r in refs]))
    texts = ["", "A", "?", "aé bab qq", "xyz", "zzzz qqqq", *("".join(rnd.choice("abéxyzQ. ") for _ in range(rnd.randint(1, 90))) for _ in range(60))]
    data = [t.encode() for t in texts]
    off = np.r_[0, np.cumsum([len(d) for d in data])]
    got = parser.phrases(np.frombuffer(b"".join(data), np.uint8), off[:-1], np.diff(off))
    for i, ref in enumerate(refs):
        assert got[i].tolist() == [phrases(symbols(t), symbols(ref)) for t in texts]


def corpus(n=200):
    rnd = random.Random(8)
    rows = []
    for d in range(n):
        lang = sorted(SYLLABLES)[d % 3]
        word = lambda: "".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3)))  # noqa: B023, E731
        rows.append((d, " ".join(word() for _ in range(rnd.randint(5, 60))), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 0.5, b"x", 1) for r in rows], "doc_id long, text string, lang string, source string, h long, score double, piece binary, has_letter int").repartition(3)


def test_query_predicts_held_out_languages(spark, tmp_path):
    rows = corpus()
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 .. 3", "cc"), (903, "ach ung", None), (None, "ko ten ba ko", None), (904, "é", None), rows[5], rows[5]]
    big = (905, "schuach ungei " * 400_000, "bb")                    # 5 MB in one row
    frame(spark, rows + odd + [big]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(odd) + 1
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [(by[d].lang_pred, lang) for d, _, lang in rows if by[d].held_out]
    assert len(held) > 40 and all(a == b for a, b in held)
    assert [by[d].lang_pred for d in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert by[903].lang_pred == "bb" and by[None].lang_pred == "aa" and by[905].lang_pred == "bb" and by[904].lang_pred == "cc"


def test_held_out_rows_are_never_learned(spark):
    df = frame(spark, corpus(30))
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = li.fit_languages(df, training=train)
    kept = b" ".join(symbols(t) for d, t, _ in corpus(30) if zlib.crc32(str(d).encode()) % 3 != 1)
    assert all(piece in kept for t in model.texts for piece in (t[:100],))
    flipped = frame(spark, [(d, t, lang if zlib.crc32(str(d).encode()) % 3 != 1 else "zz") for d, t, lang in corpus(30)])
    assert li.fit_languages(flipped, training=train) == model


def test_sample_is_bounded_and_the_same_for_any_partitioning(spark):
    rows = [(d, t * 5, lang) for d, t, lang in corpus(60)]
    a = li.fit_languages(frame(spark, rows), total_bytes=12 * 512)
    b = li.fit_languages(frame(spark, rows[::-1]).repartition(7), total_bytes=12 * 512)
    assert a == b and a.langs == ["aa", "bb", "cc"] and all(len(t) <= 4 * 513 for t in a.texts)


def test_nothing_labelled_one_language_and_empty_table(spark):
    df = frame(spark, [(1, "abc", None), (2, None, None)])
    none = li.fit_languages(df)
    assert sorted(tuple(r) for r in li.predict_languages(df, none).collect()) == [(1, "und", 0.0), (2, "und", 0.0)]
    one = li.LanguageModel(["xx"], [symbols("abc")])
    assert sorted(tuple(r) for r in li.predict_languages(df, one).collect()) == [(1, "xx", 1.0), (2, "und", 0.0)]
    assert li.predict_languages(df.where("false"), one).collect() == []
    assert li.fit_languages(df.where("false")).langs == []
