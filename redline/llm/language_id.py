"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton, which knows every
substring of it.  A text is parsed from left to right into the longest phrases
that occur in a language's labelled text (a symbol that never occurs there is a
phrase of its own).  A phrase names a place in the labelled text, so it costs
about ``log2`` of that text's length; the language with the fewest phrases,
weighed by this cost and divided by the text's length, wins.

Texts are parsed as UTF-8 bytes: A-Z lower-cased, other ASCII that is no letter
one separating symbol.  Walking needs only the automaton's forward edges, which
are laid out as one table for all languages; a missing edge holds the edge from
the root and the number of phrases that end, so a step is one lookup, and the steps of thousands of
text pieces and all languages are taken together.  Texts are parsed whole, in
pieces of ``PIECE`` bytes whose phrase counts add up, so a text of any length
takes bounded memory and gives the same count in any batch.

Fitting takes a bounded random sample of all labelled text: of all its pieces
those with the smallest hashes of text and place, ``total_bytes`` over all
languages in equal shares.  Every task keeps its own smallest pieces, which are
merged per language; the driver and each worker hold the sample, each worker
builds the automata once.

Cases: null or letterless texts give ``und`` with score 0, so does every text
if nothing is labelled; with one language every other text gets it with score 1;
ties go to the language that is smaller by code point; copies of a text are
sampled once; a null id counts as the empty text in the split; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, released, text_bytes

UND = "und"
PIECE = 1024
SAMPLE_PIECE = 512
TOTAL_BYTES = 1 << 18
#: Pieces walked side by side in a step.
LANES = 8192
#: The top two bits of an edge count the phrases that end with the step.
_COUNT_AT = np.uint32(30)
_EDGE = np.uint32((1 << 30) - 1)


def _symbols() -> np.ndarray:
    """Byte to symbol: 0 separates words, then the letters, then the bytes beyond ASCII."""
    out = np.zeros(256, np.uint8)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    out[128:] = np.arange(27, 155)
    return out


SYMBOLS = _symbols()


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Forward edges of the smallest automaton of all substrings; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return edges


@dataclass
class LanguageModel:
    """Sampled text per language, joined by separators, as symbols."""
    langs: list[str]
    texts: list[bytes]

    @property
    def digest(self) -> str:
        return hashlib.md5(pickle.dumps((self.langs, self.texts))).hexdigest()


class Parser:
    """All languages' automata as one table of ``state * width + symbol``."""

    def __init__(self, model: LanguageModel):
        self.langs = model.langs
        seen = np.unique(np.frombuffer(b"".join(model.texts), np.uint8)) if model.texts else np.zeros(0, np.uint8)
        # symbols that no labelled text has share the last column, which has no edge anywhere
        self.width = len(seen) + 1
        self.code = np.full(256, len(seen), np.uint8)
        self.code[seen] = np.arange(len(seen))
        self.code_of_byte = self.code[SYMBOLS]
        tables, self.roots, base = [], [], 0
        for text in model.texts:
            edges = suffix_automaton(text)
            t = np.zeros((len(edges), self.width), np.uint32)
            at = [(s, c, to) for s, e in enumerate(edges) for c, to in e.items()]
            if at:
                s, c, to = np.array(at, np.int64).T
                t[s, self.code[c]] = to
            # no edge leads back to the root, so 0 says that there is none: the phrase ends and the symbol starts the next
            missing = t == 0
            unknown = missing[0]
            t = (t + np.uint32(base)) * np.uint32(self.width)
            ends = np.ones(t.shape, np.uint32)
            ends[1:, unknown] = 2                     # the phrase so far, and the symbol itself
            first = np.broadcast_to(t[0], t.shape) | ends << _COUNT_AT
            t[missing] = first[missing]
            tables.append(t)
            self.roots.append(base * self.width)
            base += len(edges)
        if base * self.width > int(_EDGE):
            raise ValueError("labelled text too large for one table: lower total_bytes")
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.uint32)
        self.price = np.array([np.log2(max(2, len(t))) for t in model.texts])

    def phrases(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each piece ``buf[start:start + length]`` under each language, ``(language, piece)``."""
        out = np.zeros((len(self.roots), len(start)), np.int64)
        by = np.argsort(-length, kind="stable")
        codes = self.code_of_byte[buf]
        for lo in range(0, len(by), LANES):
            who = by[lo:lo + LANES]
            at, left = start[who], length[who]
            state = np.repeat(np.array(self.roots, np.uint32)[:, None], len(who), 1)
            count = np.zeros(state.shape, np.uint32)
            live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right") if len(left) else []
            for step, n in enumerate(live):
                v = self.table[state[:, :n] + codes[at[:n] + step]]
                count[:, :n] += v >> _COUNT_AT
                state[:, :n] = v & _EDGE
            out[:, who] = count
            # the phrase that the end of the piece cuts; none after a symbol that has no edge
            out[:, who] += (state != np.array(self.roots, np.uint32)[:, None]) & (left > 0)
        return out


_PARSERS: dict[str, Parser] = {}


def _parser(model: LanguageModel, digest: str) -> Parser:
    """The worker's parser of this model; an earlier one is let go."""
    if digest not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[digest] = Parser(model)
    return _PARSERS[digest]


# --------------------------------------------------------------------------
# fitting
# --------------------------------------------------------------------------

def _smallest(n: int):
    """Each task's ``n`` pieces of smallest hash per language."""
    def run(batches):
        kept: dict[str, dict[int, bytes]] = {}
        limit: dict[str, int] = {}

        def trim(lang):
            p = kept[lang]
            if len(p) > n:
                kept[lang] = {h: p[h] for h in sorted(p)[:n]}
                limit[lang] = max(kept[lang])

        for b in batches:
            buf, off = text_bytes(b.column(0))
            data = buf.tobytes()
            for i, lang in enumerate(b.column(1).to_pylist()):
                text = data[off[i]:off[i + 1]]
                # nearly alike hash for alike texts is avoided by the finaliser; signed for the long column
                h = mix(np.uint64(xxhash.xxh64_intdigest(text)) + np.arange(-(-len(text) // SAMPLE_PIECE), dtype=np.uint64)).view(np.int64)
                kept.setdefault(lang, {})
                for j in np.flatnonzero(h < limit.get(lang, np.iinfo(np.int64).max)).tolist():
                    kept[lang][int(h[j])] = text[j * SAMPLE_PIECE:(j + 1) * SAMPLE_PIECE]
                    if len(kept[lang]) > 2 * n:
                        trim(lang)
        for lang in list(kept):
            trim(lang)
        rows = [(lang, h, t) for lang, p in kept.items() for h, t in p.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.binary())], ["lang", "h", "piece"])
    return run


def fit_languages(documents: DataFrame, training: Column | None = None, text: str = "text", lang: str = "lang", total_bytes: int = TOTAL_BYTES) -> LanguageModel:
    """Model of the rows where ``training`` holds and text and language are not null.

    The sample is ``total_bytes`` over all languages, each language's share equal.
    """
    rows = documents.where(F.lit(True) if training is None else training).select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    langs = rows.agg(F.count_distinct("lang")).first()[0]
    share = max(1, total_bytes // SAMPLE_PIECE // max(1, langs))
    best = Window.partitionBy("lang").orderBy("h")
    pieces = (rows.mapInArrow(released(_smallest(share)), "lang string, h long, piece binary").distinct()
              .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= share).orderBy("lang", "rank").collect())
    texts: dict[str, list[bytes]] = {}
    for r in pieces:
        texts.setdefault(r.lang, []).append(bytes(r.piece))
    by_code_point = sorted(texts)
    return LanguageModel(by_code_point, [SYMBOLS[np.frombuffer(b" ".join(texts[x]), np.uint8)].tobytes() for x in by_code_point])


# --------------------------------------------------------------------------
# prediction
# --------------------------------------------------------------------------

def _predict(shared, digest: str):
    def run(batches):
        model = shared.value
        parser = _parser(model, digest) if model.langs else None
        for b in batches:
            buf, off = text_bytes(b.column(1))
            n = len(off) - 1
            wanted = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            langs = np.full(n, UND, object)
            score = np.zeros(n)
            if parser is not None and n:
                size = np.where(wanted, np.diff(off), 0)
                pieces = -(-size // PIECE)
                doc = np.repeat(np.arange(n), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = off[doc] + nth * PIECE
                length = np.minimum(PIECE, off[doc + 1] - start)
                bits = np.zeros((len(parser.langs), n))
                counts = parser.phrases(buf, start, length)
                for i in range(len(bits)):
                    bits[i] = np.bincount(doc, counts[i], n) * parser.price[i] / np.maximum(size, 1)
                first = bits.argmin(axis=0)
                least = bits[first, np.arange(n)]
                if len(bits) > 1:
                    bits[first, np.arange(n)] = np.inf
                    margin = 1 - least / np.maximum(bits.min(axis=0), 1e-300)
                else:
                    margin = np.ones(n)
                langs[wanted] = np.array(parser.langs, object)[first[wanted]]
                score[wanted] = np.clip(margin[wanted], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
    return run


def predict_languages(documents: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``; the score is the share by which the best language undercuts the second."""
    shared = documents.sparkSession.sparkContext.broadcast(model)      # at most total_bytes
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    kind = documents.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(released(_predict(shared, model.digest)), f"doc_id {kind}, lang_pred string, score double")
