"""The dataset built from documents: noise of the pairs, tables written, split as a predicate."""
import hashlib
import pathlib
import random

from redline.operators.pairs import drop_null_pairs, minimal_edit_filter, tokenize_pairs
from redline.operators.align import diff_to_tags
from redline.operators.split import with_split
from redline.plans import corpus
from redline.plans.fixtures import derived_pairs


def _documents(spark, path, n=60):
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "a", "of", "Word", "naïve", "x1y2", "tab\there"]
    rows = [(i, "\n".join(" " * (k % 3) + "  ".join(r.choice(words) for _ in range(1 + (i * 7 + k * 13) % 40)) for k in range(3)) + "\n \n") for i in range(n)]
    rows += [(3, rows[3][1]), (-43, "alpha beta gamma delta"), (None, "alpha beta gamma delta alpha beta"), (900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows


def _expected(rows, lex):
    out = []
    for doc, text in rows:
        for ln, line in enumerate((text or "").split("\n")):
            clean, noisy = [t for t in line.split(" ") if t], []
            for i, t in enumerate(clean):
                h = 99
                if t in lex:
                    h = int(hashlib.md5("|".join(str(x) for x in (doc, ln, i) if x is not None).encode()).hexdigest()[:6], 16) % 100
                noisy.append(t[0] + t[2] + t[1] + t[3:] if h < 10 else t[0] + t[2:] if h < 20 else t[:2] + t[1:] if h < 26 else t[0] + "x" + t[2:] if h < 30
                             else None if h < 32 else f"{t} {t}" if h < 34 else f"{t[:2]} {t[2:]}" if h < 36 else t)
            if clean:
                c, o = " ".join(clean), " ".join(t for t in noisy if t is not None)
                o = o if doc is None else None if doc >= 0 and doc % 50 == 7 else c[::-1] if doc % 20 == 0 else o
                out.append((None if doc is None else doc * 100000 + ln, o, c))
    return out


def test_noise_of_a_batch_follows_the_rules(spark, tmp_path):
    rows = _documents(spark, tmp_path)
    got = [tuple(r) for r in derived_pairs(spark, str(tmp_path)).collect()]
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=order) == sorted(_expected(rows, {"alpha", "beta", "gamma", "delta", "Word"}), key=order)


def test_a_dataset_writes_the_lines_and_the_tagged_rows_alone(spark, tmp_path):
    """Neither the pairs nor the kept pairs are written; the rows are those of the operators one after the other."""
    _documents(spark, tmp_path)
    root = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {x.name for x in root.iterdir()}
    c = corpus.build_corpus(spark, str(tmp_path), val_split=0.25)
    made = sorted(x.name.rsplit("-", 1)[0] for x in root.iterdir() if x.name not in before)
    assert made == ["spread", "tagged", "vocab", "vocab_ids"]
    pairs = derived_pairs(spark, str(tmp_path))
    kept = minimal_edit_filter(drop_null_pairs(pairs)).select("pair_id", "original_text", "corrected_text")
    plain = diff_to_tags(tokenize_pairs(with_split(kept, 0.25))).select(c.tagged.columns)
    text = lambda df: sorted(str(r) for r in df.collect())
    assert text(plain) == text(c.tagged) and c.n_pairs == pairs.count()
    assert c.split("train").count() + c.split("validation").count() == kept.count() and c.split("validation").count() == kept.count() // 4


def test_rows_without_inserts_are_rebuilt_from_their_tags_alone(spark):
    """the gaps are walked only where one holds an insert; both ways give what the walk over the gaps gives."""
    from pyspark.sql import functions as F
    from redline.functions import tags as TG
    keep = TG.KEEP_GAP
    rows = [(["a", "b"], ["KEEP", "REPLACE_x"], [keep] * 3, ["a", "x"]), (["a", "b"], ["DELETE", "KEEP"], [keep, "INSERT_p INSERT_q", keep], ["p", "q", "b"]),
            ([], [], [keep], []), (["a", "b"], ["KEEP", "KEEP"], [keep], ["a"]), (["a", "b"], ["KEEP"], [keep] * 3, ["a"]),
            (["a"], ["KEEP", "REPLACE_z"], [keep] * 2, ["a"]), (["a"], ["KEEP"], [None, keep], None), (None, ["KEEP"], [keep], None), (["a"], None, [keep] * 2, []), (["a"], ["KEEP"], None, None), (None, ["KEEP"], [], [])]
    df = spark.createDataFrame(rows, "t array<string>, g array<string>, gaps array<string>, want array<string>")
    got = df.select(TG.rebuild_from_tags("t", "g", "gaps").alias("r"), "t", "g", "gaps").collect()
    toks, tgs, gaps = F.col("t"), F.col("g"), F.col("gaps")
    ins = lambda g: F.when(g == keep, F.array().cast("array<string>")).otherwise(F.transform(F.split(g, " "), lambda s: s.substr(F.lit(8), F.length(s))))
    walk = F.flatten(F.transform(gaps, lambda g, i: F.concat(ins(g), F.when(i < F.size(toks), F.filter(F.array(TG._apply_one(F.get(toks, i), F.get(tgs, i))), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))))
    assert [r["r"] for r in got] == [r["w"] for r in df.select(walk.alias("w")).collect()]
    assert [r["r"] for r in got][:6] == [r[3] for r in rows][:6]
    assert "forall" in df.select(TG.rebuild_from_tags("t", "g", "gaps"))._jdf.queryExecution().optimizedPlan().toString()
