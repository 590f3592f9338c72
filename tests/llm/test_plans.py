import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from redline.llm.bsi_topk import SlicedBlock, integer_vectors, top_k
from redline.llm.chat_collapse import chat_documents
from redline.llm.host_reputation import RULES, Reputation, url_verdicts
from redline.llm.mix_sources import mix_plan, mixed_documents
from redline.llm.pack_ffd import TournamentTree, pack_documents, pack_lengths
from redline.llm.queries import tokenizer_path

from .helpers import WORD, docs


def test_chat_keeps_maximal_conversations(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "bye")]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "no")], 6: [("user", None)], 7: [(None, "hi")], 8: [("user", "x<|im_end|>y")]}
    rows = [(c, 2 * i, r, t, "z", 3) for c, turns in logs.items() for i, (r, t) in enumerate(turns)]
    rows += [rows[0], (None, 0, "user", "stray", "z", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string, pos int").repartition(3)
    got = {r.conv_id: r for r in chat_documents(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8}
    assert got[3].n_turns == 3 and got[3].n_copies == 2
    assert got[3].chat == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a)
    assert got[6].chat == "<|im_start|>user\n<|im_end|>\n" and got[8].chat.count("<|im_end|>") == 1
    assert chat_documents(df.where("false")).count() == 0


def test_tournament_tree_finds_the_first_fit():
    rnd = random.Random(0)
    tree, rooms = TournamentTree(9, 10), [10] * 9
    for _ in range(40):
        need = rnd.randint(1, 6)
        want = next((i for i, r in enumerate(rooms) if r >= need), None)
        if want is None:
            break
        assert tree.first_fit(need) == want
        tree.take(want, need)
        rooms[want] -= need


@pytest.mark.parametrize("seed", range(5))
def test_pack_lengths_lose_nothing(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([0, 1, 5, 16, rnd.randint(1, 70)]) for _ in range(rnd.randint(0, 200))]
    used, at = defaultdict(list), defaultdict(list)
    for i, start, n, seq, off in pack_lengths(lengths, 16):
        assert n > 0
        at[i].append((start, n))
        used[seq].append((off, n))
    for i, n in enumerate(lengths):
        assert sum(m for _, m in at[i]) == n and sorted(at[i]) == sorted(at[i], key=lambda x: x[0])
    fill = []
    for pieces in used.values():
        end = 0
        for off, n in sorted(pieces):
            assert off == end
            end += n
        fill.append(end)
    assert all(f <= 16 for f in fill) and sum(f < 16 for f in fill) <= 1
    assert sorted(used) == list(range(len(used)))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(1)
    odd = ["a\x1cb\x85c\u00a0d", "<|endoftext|>x <|startoftext|>", "ΣΑΣ Ǆ\u0301e\u0301", "it's  WE'RE\t#1\r\n", None, "", " \n"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(50 + i, " ".join(rnd.choice(["alpha", "Beta,", "γ", "7", "don't"]) for _ in range(rnd.randint(0, 90)))) for i in range(30)]
    rows += [(99, "same row"), (99, "same row"), (100, "long " * 700)]
    got = pack_documents(docs(spark, rows), tokenizer_path(), seq_len=64, group_tokens=300, slice_len=256).collect()
    streams, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        streams[r.doc_id].append((r.start, ids, r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, t in rows:
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        copies = sum(x[0] == d for x in rows)
        joined = [i for _, ids, _ in sorted(streams[d]) for i in ids]
        assert len(joined) == copies * len(want)
        if copies == 1:
            assert joined == want, t
        assert all(n == len(want) for _, _, n in streams[d])
    for pieces in seqs.values():
        end = 0
        for off, n in sorted(pieces):
            assert off == end
            end += n
        assert end <= 64
    assert pack_documents(docs(spark, rows).where("false"), tokenizer_path()).count() == 0


def test_packing_with_a_tokenizer_of_other_rules(spark):
    """Case and signs count in the byte-level vocabulary, so texts are encoded whole."""
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(0, "The CAT isn't  here,\n ok?"), (1, None), (2, "Ωmega α-β <|endoftext|> end")]
    for r in pack_documents(docs(spark, rows), path, seq_len=512).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == tok.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids + [1]


def test_url_rules_and_reputation(spark):
    urls = ["http://A.com/x", "http://a.com", "https://m.example.com/en/1?x=/de/", "http://www.example.com/en/", "http://x.www.example.com/en/#a", "http://b.net/es/",
            "ftp://notnet/es/", "no scheme", None, "", "http://h.org/a://b", "http://bad.org/1", "http://bad.org/2", "http://new.bad.org/", "http://fine.io/1", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "<p>", "h") for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/q", "", "") for i in range(60)] + [(200 + i, f"http://s{i % 9}.fine.io/q", "", "") for i in range(60)],
                                  "page_id long, url string, html string, host string").repartition(3)
    good = spark.createDataFrame([(100 + i, int(i == 0)) for i in range(60)] + [(200 + i, int(i != 5)) for i in range(60)] + [(0, None)], "page_id long, good int")
    got = {r.page_id: r for r in url_verdicts(pages, good).collect()}
    rule = {i: got[i].rule for i in range(len(urls))}
    assert rule == {0: "com/", 1: None, 2: "example.com/en/", 3: "www.example.com/en/", 4: "www.example.com/en/", 5: "net/es/", 6: None, 7: None, 8: None, 9: None,
                    10: None, 11: None, 12: None, 13: None, 14: None, 15: "com/"}
    assert [got[i].verdict for i in (0, 2, 3, 5)] == ["allow", "block", "allow", "block"]
    assert got[11].verdict == "block" and got[14].verdict == "allow"
    assert (got[8].host, got[8].path, got[7].host) == ("", "", "") and (got[10].host, got[10].path) == ("h.org", "/a://b")
    assert got[2].path == "/en/1" and got[11].rate < 0.3 < got[14].rate
    assert {r.verdict for r in url_verdicts(pages, good.where("false")).where("rule is null").collect()} == {"allow"}
    assert url_verdicts(pages.where("false"), good).count() == 0
    assert len(RULES) == 5 and Reputation().min_rate == 0.5


def test_sliced_block_equals_sorting():
    rng = np.random.default_rng(0)
    for t in range(80):
        n, d = int(rng.integers(0, 150)), int(rng.integers(1, 8))
        x = rng.integers(-90, 90, (n, d)) // (1 if t % 3 else 40)
        ids = np.sort(rng.integers(0, 120, n))
        q, own, k = rng.integers(-90, 90, d), int(rng.integers(0, 120)), int(rng.integers(1, 7))
        want = sorted((-int(v @ q), int(j)) for j, v in zip(ids, x) if j != own)[:k]
        for coarse in (0, 4, 6):
            i, s = SlicedBlock(ids, x).best(q, own, k, coarse)
            assert [(-a, b) for a, b in zip(s.tolist(), i.tolist())] == want


def test_top_k_over_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(0, 0.4, 6)], 1, 2) for i in range(150)]
    rows += [(i + 1000, rows[3][1], 1, 2) for i in range(9)]                                # ties
    rows += [(2000, None, 1, 2), (2001, [1.0, None], 1, 2), (2002, [float("nan")] * 6, 1, 2), (2003, [float("inf")], 1, 2), (None, [0.1] * 6, 1, 2), (2004, [], 1, 2), (2005, [0.5], 1, 2),
             (2006, [1e6, -2.0], 1, 2), (2007, [200000.0, 1.0], 1, 2), (2050, [-1e6, 1e6, 3e5], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank int").repartition(3)
    v = integer_vectors(df)
    got = defaultdict(list)
    for r in top_k(v.where("vec_id % 50 = 0"), v, block_rows=40, chunk_rows=2).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    data = {i: [int(np.floor(256 * c)) for c in e] for i, e, _, _ in rows if i is not None and i not in (2000, 2001, 2002, 2003)}
    for q in (i for i in data if i % 50 == 0):
        want = sorted((-sum(a * b for a, b in zip(data[q], e)), i) for i, e in data.items() if i != q)[:5]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want]
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
    wide = integer_vectors(spark.createDataFrame([(i, [c * 1e7 for c in rows[i][1][:3]]) for i in range(40)], "vec_id long, embedding array<double>"))
    exact = {i: [int(np.floor(256 * c * 1e7)) for c in rows[i][1][:3]] for i in range(40)}
    assert max(abs(c) for e in exact.values() for c in e) ** 2 * 3 > 2**62
    assert sorted((r.rank, r.vec_id) for r in top_k(wide.where("vec_id = 0"), wide).collect()) == [
        (n + 1, i) for n, (_, i) in enumerate(sorted((-sum(a * b for a, b in zip(exact[0], e)), i) for i, e in exact.items() if i)[:5])]
    assert top_k(v.where("false"), v).count() == 0 and top_k(v.where("vec_id = 0"), v.where("vec_id = 0")).count() == 0


def _mix_by_hand(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]} if total else set()
        if not over:
            target.update({s: left * w[s] / total for s in open_})
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
        left, open_ = left - sum(2 * sizes[s] for s in over), open_ - over


def test_mix_meets_targets(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60))), rnd.choice(["b", "a", "é", None, "hot", "hot", "hot"])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "void"), (1002, "x y", "b"), (1002, "x y", "b")]
    d = docs(spark, rows)
    plan = mix_plan(d).collect()
    again = sorted((r.doc_id, r.size, r.taken) for r in mix_plan(d.repartition(5)).collect())
    assert sorted((r.doc_id, r.size, r.taken) for r in plan) == again and len(plan) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, src = _mix_by_hand(sizes), {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in plan:
        s = src[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    mixed = mixed_documents(d)
    assert mixed.columns == d.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert {s: n for s, n in taken.items() if n} == dict(words)
    assert mix_plan(d.where("false")).count() == 0 and mixed_documents(d.where("false")).count() == 0


def test_crc_of_ids_is_the_contract_s():
    assert zlib.crc32(np.array([320, 1], "<u4").tobytes()) == zlib.crc32(bytes([64, 1, 0, 0, 1, 0, 0, 0]))
