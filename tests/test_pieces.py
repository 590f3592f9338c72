"""The sub-word plug-in against a search over all prefixes, and an encoding with it."""
import hashlib
import random

from redline.functions.pieces import longest_match
from redline.operators import encode
from redline.operators.vocab import build_tag_vocab

VOCAB = ["un", "a", "able", "th", "the", "##able", "##ab", "##a", "##e", "##the", "##é", "ca", "##t", ""]


def plain(word):
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = max((i for i in range(at + 1, len(word) + 1) if mark + word[at:i] in VOCAB), default=at + 1)
        out.append(mark + word[at:end])
        at = end
    return out


def test_longest_match_and_encoding(spark):
    rnd = random.Random(0)
    words = ["unable", "cat", "thé", "x", "the", "", *("".join(rnd.choice("theablcuné") for _ in range(rnd.randint(1, 9))) for _ in range(80))]
    fn = longest_match(VOCAB)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(900, None)], "i int, w string").repartition(2)
    got = {r.i: r.p for r in df.select("i", fn("w").alias("p")).collect()}
    assert got == {**{i: plain(w) for i, w in enumerate(words)}, 900: None}

    rows = [(k, [w for w in words[k * 9:k * 9 + 9] if w], ["KEEP"] * len([w for w in words[k * 9:k * 9 + 9] if w])) for k in range(9)]
    tagged = spark.createDataFrame(rows, "pair_id long, orig_tokens array<string>, tags array<string>")
    vocab = build_tag_vocab(tagged)
    keep = {r.tag: r.tag_id for r in vocab.collect()}["KEEP"]
    bucket = lambda p: 4 + int(hashlib.md5(p.encode()).hexdigest()[:6], 16) % 50261
    for r in encode.encode_examples(tagged, vocab, max_length=24, subword_fn=fn).collect():
        toks = dict((k, t) for k, t, _ in rows)[r.pair_id]
        ids = [(bucket(p), keep if n == 0 else -100) for w in toks for n, p in enumerate(plain(w))][:22]
        pad = 24 - 2 - len(ids)
        assert list(r.input_ids) == [0, *(i for i, _ in ids), 2, *[1] * pad]
        assert list(r.labels) == [-100, *(x for _, x in ids), -100, *[-100] * pad]
        assert sum(r.attention_mask) == len(ids) + 2
