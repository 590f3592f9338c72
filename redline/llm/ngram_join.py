"""Similarity join on word shingles: prefix filtering under several token orders.

Two documents link when ``100 * |x & y| >= threshold * |x | y|`` over their sets
of distinct shingles.  The steps lose no link:

1. *Rarest first.*  Under the order by frequency, tokens of one document come
   first.  A document whose prefix (more than ``1 - threshold`` of its set)
   holds such tokens alone has no partner.  Frequencies are counted exactly by
   hash range, on compact arrays: a range is told each block's tokens, and
   answers how many of a document's occur nowhere else.
2. Documents with equal sets form a class; one row a class goes on, and
   frequencies are counted again over classes.
3. *Several orders.*  Partners must share a token within their prefixes under
   the order by frequency, and under each of the orders by salted hash
   (``ORDERS``).  Candidates come from the buckets of the first order and are
   kept if they also meet under the others; only then whole sets are compared.
   In the bucket of a pair's first common token the sides share no more than
   what each has from there on, which bounds the similarity before any set is
   read (tokens of one document come first, so they count against it).
4. Components grow from the verified links.  A bucket needs no pair inside one
   component, so buckets are worked in rounds: at first everyone meets the
   bucket's pivot alone (the member with the fewest tokens of its own), later
   the remaining components of a small bucket meet each other.  A large bucket
   that still holds several components is cut to blocks, and pairs of blocks
   are worked apart, so no task holds a whole group.

Cases: null, empty and wordless texts have no shingles and link with nothing;
with fewer words than a shingle the whole sequence is one; repeated rows and
repeated ids are copies (a document id has one row each in the result); rows
without an id are left out; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, connected_components, drop_tables, forget_shuffles, mix, released, row_chunks, text_bytes, window_hash, words_of, write_table

SHINGLE = 4
THRESHOLD_PCT = 85
#: Salts of the global token orders beside the one by frequency.
ORDERS = (101, 202)
#: Members of a bucket that may meet pairwise.
SMALL = 32
#: Members of a block of a larger bucket.
BLOCK_MEMBERS = 128
#: Rounds in which large buckets meet a pivot before they are cut to blocks.
PIVOT_ROUNDS = 3
#: Text whose tokens are counted together before they are sent.
COUNT_BYTES = 4 << 20
#: Text, or tokens of classes, to one hash range.
RANGE_BYTES = 8 << 20
#: Tokens of classes that are counted together.
BLOCK_BYTES = 2 << 20


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    n = len(off) - 1
    h, rows, _, _ = words_of(buf, off, lower=True)
    w, wr, _ = window_hash(h, rows, k)
    cut = np.searchsorted(wr, np.arange(n + 1))
    words = np.searchsorted(rows, np.arange(n + 1))
    out = []
    for i in range(n):
        m = words[i + 1] - words[i]
        if m >= k:
            out.append(np.unique(w[cut[i]:cut[i + 1]]))
        elif m:
            x = np.zeros(1, U64)
            for j in range(words[i], words[i + 1]):
                x = mix(x * U64(31) + h[j], 9)
            out.append(mix(x, 1000 + int(m)))
        else:
            out.append(np.zeros(0, U64))
    return out


def _sets_of(batch, k):
    buf, off = text_bytes(batch.column(1))
    for lo, hi in row_chunks(off):
        yield from shingle_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], k)


def _count_rows(k: int, ranges: int):
    """Per block: token values by range (once-in-the-block ones with their document), and the set sizes."""
    def emit(uid, docs, sets):
        sizes = np.array([len(s) for s in sets], np.int64)
        tok = np.concatenate(sets) if sets else np.zeros(0, U64)
        x = mix(tok, 17)
        doc = np.repeat(np.arange(len(sets)), sizes)
        rng = ((x & U64(0xFFFFFFFF)) % U64(ranges)).astype(np.int64)
        val = (x >> U64(24)) & U64(0xFFFFFFFFFF)     # 40 bits beside the range: a clash only keeps a document in
        order = np.lexsort((val, rng))
        rng, val, doc = rng[order], val[order], doc[order]
        new = np.ones(len(val), bool)
        new[1:] = (val[1:] != val[:-1]) | (rng[1:] != rng[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(val)))
        rng, val, doc = rng[first], val[first], np.where(count == 1, doc[first], -1)
        at = np.searchsorted(rng, np.arange(ranges + 1))
        # a value in several documents of the block is known to be shared; it is sent once, without a document
        rows = [(int(r), uid, val[at[r]:at[r + 1]].astype(U64).tobytes(), doc[at[r]:at[r + 1]].astype(np.int32).tobytes(), None)
                for r in range(ranges) if at[r + 1] > at[r]]
        once = np.bincount(doc[doc >= 0], minlength=len(sets))
        meta = np.stack([sizes, once]).tobytes()
        rows.append((int(uid % ranges), uid, None, np.array(docs, np.int64).tobytes(), meta))
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                                          ["rng", "uid", "vals", "docs", "meta"])

    def run(batches):
        from pyspark import TaskContext
        uid, docs, sets, held = TaskContext.get().partitionId() << 24, [], [], 0
        for b in batches:
            docs += b.column(0).to_pylist()
            for s in _sets_of(b, k):
                sets.append(s)
            held += b.column(1).nbytes
            if held >= COUNT_BYTES:
                yield emit(uid, docs, sets)
                uid, docs, sets, held = uid + 1, [], [], 0
        if docs:
            yield emit(uid, docs, sets)
    return run


def _alone(t: pa.Table) -> pa.Table:
    """For each block, how many tokens of each document occur in no other place; sizes pass through."""
    t = t.combine_chunks()
    vals = [None if not x.is_valid else np.frombuffer(x.as_buffer(), U64) for x in t.column("vals")]
    every = [v for v in vals if v is not None]
    twice = np.zeros(0, U64)
    if every:
        every = np.sort(np.concatenate(every))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    out = []
    for i, v in enumerate(vals):
        docs = t.column("docs")[i].as_buffer()
        if v is None:
            out.append((t.column("uid")[i].as_py(), docs.to_pybytes(), t.column("meta")[i].as_py(), None))
            continue
        d = np.frombuffer(docs, np.int32)
        at = np.minimum(np.searchsorted(twice, v), max(len(twice) - 1, 0))
        shared = twice[at] == v if len(twice) else np.zeros(len(v), bool)
        # once in its block, but met elsewhere
        hit = np.bincount(d[shared & (d >= 0)])
        out.append((t.column("uid")[i].as_py(), None, None, hit.astype(np.int64).tobytes()))
    cols = list(zip(*out))
    return pa.table({"uid": pa.array(cols[0], pa.int64()), "docs": pa.array(cols[1], pa.binary()), "meta": pa.array(cols[2], pa.binary()),
                     "shared": pa.array(cols[3], pa.binary())})


def _counted(t: pa.Table) -> pa.Table:
    """``doc_id, n, alone`` of one block."""
    t = t.combine_chunks()
    docs = meta = None
    shared = []
    for d, m, s in zip(t.column("docs"), t.column("meta"), t.column("shared")):
        if m.is_valid:
            docs, meta = np.frombuffer(d.as_buffer(), np.int64), np.frombuffer(m.as_buffer(), np.int64).reshape(2, -1)
        else:
            shared.append(np.frombuffer(s.as_buffer(), np.int64))
    alone = meta[1].copy()
    for s in shared:
        alone[: len(s)] -= s
    return pa.table({"doc_id": docs, "n": meta[0], "alone": alone})


def _class_rows(k: int):
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = []
            for d, s in zip(ids, _sets_of(b, k)):
                x = mix(s, 5).sum(dtype=U64), mix(s, 6).sum(dtype=U64)
                rows.append((d, *(int(v.astype(np.int64)) for v in x), len(s), s.astype(np.int64)))
                if len(rows) >= 256:
                    yield _class_batch(rows)
                    rows = []
            if rows:
                yield _class_batch(rows)
    return run


def _class_batch(rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.int64()))], ["doc_id", "c1", "c2", "n", "toks"])


def _class_blocks(batches):
    """Classes packed to blocks: ids, set sizes and tokens as bytes."""
    from pyspark import TaskContext
    uid, held, rows = TaskContext.get().partitionId() << 24, 0, []

    def block():
        return pa.RecordBatch.from_arrays(
            [pa.array([uid], pa.int64()), *(pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*rows))], ["uid", "reps", "sizes", "toks"])

    for b in batches:
        toks = b.column("toks")
        lens = np.diff(toks.offsets.to_numpy())
        rows.append((b.column("rep").to_numpy(), lens.astype(np.int64), toks.flatten().to_numpy()))
        held += rows[-1][2].nbytes
        if held >= BLOCK_BYTES:
            yield block()
            uid, held, rows = uid + 1, 0, []
    if rows:
        yield block()


def _block_tokens(tok: np.ndarray, ranges: int):
    """Distinct tokens of a block by range: ``(range bounds, tokens, order into the block, counts)``."""
    rng = (mix(tok, 17) & U64(0xFFFFFFFF)) % U64(ranges)
    order = np.lexsort((tok, rng))
    t, r = tok[order], rng[order]
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    first = np.flatnonzero(new)
    back = np.empty(len(t), np.int64)
    back[order] = np.cumsum(new) - 1
    return np.searchsorted(r[first], np.arange(ranges + 1).astype(U64)), t[first], back, np.diff(np.append(first, len(t)))


def _token_counts(ranges: int):
    def run(batches):
        for b in batches:
            for uid, toks in zip(b.column("uid").to_pylist(), b.column("toks")):
                at, t, _, n = _block_tokens(np.frombuffer(toks.as_buffer(), U64), ranges)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([uid] * len(full), pa.int64()),
                     pa.array([t[at[r]:at[r + 1]].tobytes() for r in full], pa.binary()),
                     pa.array([n[at[r]:at[r + 1]].astype(np.int32).tobytes() for r in full], pa.binary())], ["rng", "uid", "vals", "cnt"])
    return run


def _frequencies(t: pa.Table) -> pa.Table:
    """For each block's tokens in a range, in how many classes they occur."""
    t = t.combine_chunks()
    vals = [np.frombuffer(x.as_buffer(), U64) for x in t.column("vals")]
    uniq, inv = np.unique(np.concatenate(vals), return_inverse=True)
    total = np.bincount(inv, weights=np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in t.column("cnt")]), minlength=len(uniq)).astype(np.int64)
    ends = np.cumsum([len(v) for v in vals])
    return pa.table({"uid": t.column("uid"), "rng": t.column("rng"),
                     "freq": pa.array([total[inv[e - len(v):e]].tobytes() for v, e in zip(vals, ends)], pa.binary())})


def _ranked(ranges: int, pct: int, orders):
    """Classes that may have a partner, with their shared size and a prefix for every order."""
    def run(batches):
        for b in batches:
            for reps, sizes, toks, marks in zip(b.column("reps"), b.column("sizes"), b.column("toks"), b.column("marks").to_pylist()):
                reps, sizes, tok = np.frombuffer(reps.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.int64), np.frombuffer(toks.as_buffer(), U64)
                at, t, back, _ = _block_tokens(tok, ranges)
                freq = np.ones(len(t), np.int64)
                for m in marks or []:
                    freq[at[m["rng"]]:at[m["rng"] + 1]] = np.frombuffer(m["freq"], np.int64)
                freq = freq[back]
                rows, end = [], 0
                for rep, n in zip(reps.tolist(), sizes.tolist()):
                    x, f = tok[end:end + n], freq[end:end + n]
                    end += n
                    common = int((f > 1).sum())
                    if 100 * common < pct * n:
                        continue
                    size = n * (100 - pct) // 100 + 1
                    first = np.lexsort((mix(x, 1), f))[:size]
                    p = [x[first[f[first] > 1]], *(x[np.argsort(mix(x, o))[:size]] for o in orders)]
                    rows.append((rep, n, common, x.astype(np.int64), *(v.astype(np.int64) for v in p)))
                    if len(rows) == 128:
                        yield _ranked_batch(rows)
                        rows = []
                if rows:
                    yield _ranked_batch(rows)
    return run


def _ranked_batch(rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[3:])],
                                      ["rep", "n", "common", "toks", *(f"p{i}" for i in range(len(cols) - 4))])


def ranked_classes(classes: DataFrame, pct: int = THRESHOLD_PCT, orders=ORDERS) -> tuple[DataFrame, str]:
    """``rep, n, common, toks, p0, p1 ...`` and its path: ``p0`` the prefix under the order by frequency."""
    blocks, blocks_at = write_table(classes.mapInArrow(_class_blocks, "uid long, reps binary, sizes binary, toks binary"), "join_blocks", "lz4")
    total = blocks.agg(F.sum(F.octet_length("toks"))).first()[0] or 0
    ranges = int(max(2 * classes.sparkSession.sparkContext.defaultParallelism, total // RANGE_BYTES + 1))
    freq = (blocks.select("uid", "toks").mapInArrow(released(_token_counts(ranges)), "rng int, uid long, vals binary, cnt binary")
            .groupBy("rng").applyInArrow(released(_frequencies), "uid long, rng int, freq binary"))
    marks = freq.groupBy("uid").agg(F.collect_list(F.struct("rng", "freq")).alias("marks"))
    schema = "rep long, n long, common long, toks array<long>" + "".join(f", p{i} array<long>" for i in range(len(orders) + 1))
    ranked, ranked_at = write_table(blocks.join(marks, "uid", "left").mapInArrow(released(_ranked(ranges, pct, orders)), schema), "join_ranked", "lz4")
    drop_tables(classes.sparkSession, blocks_at)
    forget_shuffles(classes.sparkSession)
    return ranked, ranked_at


def shingle_classes(docs: DataFrame, k: int = SHINGLE, pct: int = THRESHOLD_PCT, doc_id: str = "doc_id", text: str = "text"):
    """``(documents (doc_id, n), members (doc_id, rep), classes (rep, n, toks), path of classes)``.

    ``classes`` leaves out the documents that cannot have a partner.
    """
    spark = docs.sparkSession
    rows = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(2 * spark.sparkContext.defaultParallelism, total // RANGE_BYTES + 1))
    told = (rows.mapInArrow(released(_count_rows(k, ranges)), "rng int, uid long, vals binary, docs binary, meta binary")
            .groupBy("rng").applyInArrow(released(_alone), "uid long, docs binary, meta binary, shared binary"))
    counted, _ = write_table(told.groupBy("uid").applyInArrow(_counted, "doc_id long, n long, alone long"), "join_counts")
    forget_shuffles(spark)
    maybe = counted.where((F.col("n") > 0) & (100 * (F.col("n") - F.col("alone")) >= pct * F.col("n"))).select("doc_id").distinct()
    sets = (rows.join(maybe.hint("shuffle_hash"), "doc_id", "left_semi")
            .mapInArrow(released(_class_rows(k)), "doc_id long, c1 long, c2 long, n long, toks array<long>"))
    sets, sets_at = write_table(sets, "join_sets", "lz4")
    # copies meet by their ids alone; the tokens are those of the representative's own row, looked up by its id
    ids = sets.select("doc_id", "c1", "c2", "n")
    reps, _ = write_table(ids.groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("doc_id")), "join_reps")
    members, _ = write_table(ids.join(reps.withColumnRenamed("doc_id", "rep"), ["c1", "c2", "n"]).select("doc_id", "rep"), "join_members")
    one = reps.groupBy("doc_id").agg(F.min(F.struct("c1", "c2", "n")).alias("c")).select("doc_id", "c.*")      # an id on several texts stands for one class
    key = ["doc_id", "c1", "c2", "n"]
    classes = sets.join(one, key, "left_semi").dropDuplicates(key).select(F.col("doc_id").alias("rep"), "n", "toks")
    forget_shuffles(spark)
    return counted.groupBy("doc_id").agg(F.max("n").alias("n")), members, classes, sets_at


def similar_links(ranked: DataFrame, pct: int = THRESHOLD_PCT, orders=ORDERS) -> tuple[DataFrame, DataFrame | None]:
    """Verified links ``(a, b)`` between classes, enough to span every component, and the components ``(node, component)``."""
    spark = ranked.sparkSession
    prefixes = ranked.drop("toks")
    # can: the tokens from this one on, in the order by frequency
    tokens = (prefixes.select("rep", "n", "common", F.posexplode("p0").alias("i", "tok"))
              .select("rep", "n", (F.col("common") - F.col("i")).alias("can"), "tok"))
    many = tokens.groupBy("tok").agg(F.count("*").alias("size")).where("size > 1").select("tok")
    bucket, _ = write_table(tokens.join(many, "tok"), "join_buckets")
    links, tested, label, rounds = None, None, None, 0
    while True:
        cur = bucket.withColumn("comp", F.col("rep")) if label is None else (
            bucket.join(label, bucket["rep"] == label["node"], "left").select(*bucket.columns, F.coalesce("component", "rep").alias("comp")))
        rank = (F.col("n") - F.col("can")) if rounds == 0 else F.xxhash64(F.lit(rounds), "rep")
        shape = cur.groupBy("tok").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"),
                                       F.min(F.struct(rank.alias("r"), "rep", "n", "can", "comp")).alias("pivot"))
        mixed, path = write_table(cur.join(shape.where("c0 <> c1").drop("c0", "c1"), "tok"), "join_mixed")
        small, large = mixed.where(F.col("size") <= SMALL), mixed.where(F.col("size") > SMALL)
        pairs = _bucket_pairs(small.withColumnRenamed("tok", "key"), pct) if rounds else _pivot_pairs(small, pct)
        last = rounds >= PIVOT_ROUNDS
        pairs = pairs.unionByName(_block_pairs(large, pct) if last else _pivot_pairs(large, pct)).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, at = write_table(pairs, "join_pairs")
        fresh = pairs.isEmpty()
        drop_tables(spark, path)
        if not fresh:
            good, _ = write_table(_verified(_meeting(pairs, prefixes, len(orders)), ranked, pct), "join_links")
            tested = pairs if tested is None else tested.unionByName(pairs)
            if not good.isEmpty():
                links = good if links is None else links.unionByName(good)
                label = connected_components(links)
        if last and fresh:
            return (links if links is not None else pairs), label
        rounds = PIVOT_ROUNDS if fresh else rounds + 1


def _may_link(an, ac, bn, bc, pct):
    """Whether sets of these sizes, sharing at most so many tokens, can reach the threshold."""
    most = F.least(ac, bc)
    return F.lit(100) * most >= F.lit(pct) * (an + bn - most)


def _pivot_pairs(rows: DataFrame, pct: int) -> DataFrame:
    p = lambda c: F.col(f"pivot.{c}")
    return (rows.where((F.col("comp") != p("comp")) & _may_link(F.col("n"), F.col("can"), p("n"), p("can"), pct))
            .select(F.least("rep", "pivot.rep").alias("a"), F.greatest("rep", "pivot.rep").alias("b")))


def _bucket_pairs(rows: DataFrame, pct: int) -> DataFrame:
    """Pairs of different components within buckets of a bounded number of members."""
    m = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "n", "can", "comp"))).alias("g"))
    pair = F.flatten(F.transform("g", lambda x, i: F.transform(
        F.filter(F.slice(F.col("g"), i + 2, F.size("g")), lambda y: (x["comp"] != y["comp"]) & _may_link(x["n"], x["can"], y["n"], y["can"], pct)),
        lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))
    return m.select(F.explode(pair).alias("p")).select("p.a", "p.b")


def _block_pairs(rows: DataFrame, pct: int) -> DataFrame:
    """As ``_bucket_pairs`` for large buckets: members fall into blocks, pairs of blocks meet apart.

    Members that cannot reach the threshold with any size found in the bucket stay out.
    """
    able = rows.where(_may_link(F.col("n"), F.col("can"), F.greatest("n0", "can"), F.greatest("n0", "can"), pct))
    left = able.groupBy("tok").agg(F.count("*").alias("left"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    able = able.join(left.select("tok", "left"), "tok")
    blocks = F.ceil(F.col("left") / BLOCK_MEMBERS).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    r = able.select("tok", "rep", "n", "can", "comp", mine.alias("mine"), other.alias("other"))
    key = F.struct("tok", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return _bucket_pairs(r.select(key.alias("key"), "rep", "n", "can", "comp"), pct)


def _meeting(pairs: DataFrame, prefixes: DataFrame, orders: int) -> DataFrame:
    """Pairs whose prefixes meet under every order."""
    cols = [f"p{i}" for i in range(1, orders + 1)]
    left = prefixes.select(F.col("rep").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = prefixes.select(F.col("rep").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = pairs.join(left, "a").join(right, "b")
    for c in cols:
        j = j.where(F.arrays_overlap(f"a_{c}", f"b_{c}"))
    return j.select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    left = classes.select(F.col("rep").alias("a"), F.col("toks").alias("x"))
    right = classes.select(F.col("rep").alias("b"), F.col("toks").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("s"))
            .where(F.lit(100) * F.col("i") >= F.lit(pct) * (F.col("s") - F.col("i"))).select("a", "b"))


def ngram_join(docs: DataFrame, k: int = SHINGLE, pct: int = THRESHOLD_PCT, orders=ORDERS, doc_id: str = "doc_id", text: str = "text"):
    """``doc_id, n_shingles, component_id`` of every document."""
    sizes, members, classes, classes_at = shingle_classes(docs, k, pct, doc_id, text)
    ranked, ranked_at = ranked_classes(classes, pct, orders)
    drop_tables(docs.sparkSession, classes_at)
    _, label = similar_links(ranked, pct, orders)
    drop_tables(docs.sparkSession, ranked_at)         # what follows reads documents, members and components
    found = members.select("doc_id", F.col("rep").alias("c"))
    if label is not None:
        found = members.join(label, members["rep"] == label["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    found = found.groupBy("doc_id").agg(F.min("c").alias("c"))
    return sizes.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
