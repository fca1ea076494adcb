"""Toxicity by classifier chains: sparse linear models in a row, each fed the probabilities before it.

A document's features are those of its distinct tokens (what stands between white space) and four
shares (capitals, symbols, distinct words, length). A token's words are all its letters joined and, if
signs or digits part them, each run of letters; a word gives itself and its beginnings of three to
five letters. A word in a script without spaces, or of more than LONG letters, also gives the runs of
two to five letters at each of its places, so no part of any text is without features. The chain predicts categories in order; the
model of a category also sees the log odds of the categories before it. In training these come from
models fitted without the fold that the row is in, so later models learn from predictions as good as
those they will get. Models are fitted on the driver by accelerated proximal gradient with an L1
penalty, on at most `train_rows` labelled documents; scoring covers every row of every document.

Defined results: null text is empty and gets the models' intercepts; a label that is null is left out
of its category's training; a category with one class or no labels predicts its share (0.5 if
none, and then calls nothing toxic);
several labels of one document count as its lowest quality and its highest toxicity; of documents that
share a labelled id, one is trained on; repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

BITS = 20
FOLDS = 3
DENSE = ("capitals", "symbols", "distinct", "length")
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ",.'")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Thai to Tibetan, Myanmar, Khmer, kana and bopomofo, Han, halfwidth kana.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af]")
#: Letters of a word from which on it is taken to be several, written without spaces.
LONG = 40
#: Penalty of a feature by its kind: whole words are believed before beginnings, long before short.
_PENALTY = {0: 1.0, 5: 1.3, 4: 1.6, 3: 2.5}


def _feature(mark: bytes, letters: str) -> int:
    return zlib.crc32(mark + letters.encode()) & (1 << BITS) - 1


def word_features(token: str) -> list[tuple[int, int]]:
    """(feature, kind) of a token, each once: kind 0 is a word, k one's first k letters (or k in a row)."""
    runs = _LETTERS.findall(token)
    joined = "".join(runs)
    if not joined.isalpha():
        joined = "".join(c for c in joined if c.isalpha())
    if not joined:
        return []
    if len(runs) == 1 and len(joined) <= LONG and (joined.isascii() or not _UNSPACED.search(joined)):
        return [(_feature(b"w", joined), 0)] + [(_feature(b"p", joined[:k]), k) for k in (3, 4, 5) if len(joined) > k]
    out: dict[int, int] = {}
    for word in dict.fromkeys([joined, *runs]):
        out.setdefault(_feature(b"w", word), 0)
        for k in (3, 4, 5):
            if len(word) > k:
                out.setdefault(_feature(b"p", word[:k]), k)
        if len(word) > LONG or _UNSPACED.search(word):
            for i in range(len(word) - 1):
                # Two letters are a word of their own in such scripts; longer runs are as beginnings.
                out.setdefault(_feature(b"w", word[i : i + 2]), 0)
                for k in (3, 4, 5):
                    if i + k <= len(word):
                        out.setdefault(_feature(b"p", word[i : i + k]), k)
    return list(out.items())


def tokens(text: str) -> tuple[set[str], np.ndarray]:
    """Distinct lower-case tokens and the dense features."""
    raw, words = text.encode(), text.lower().split()
    own = set(words)
    n = max(1, len(raw))
    shares = ((n - len(raw.translate(None, _CAPITALS))) / n, (n - len(raw.translate(None, _SYMBOLS))) / n, len(own) / max(1, len(words)), np.log1p(len(words)) / 10)
    return own, np.array(shares if raw else (0.0, 0.0, 1.0, 0.0))


@dataclass
class Model:
    """Log odds = bias + sum of weights of a document's word features + dense @ its dense ones."""

    weights: dict[int, float]
    dense: np.ndarray
    bias: float


def distinct(x: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row's features, each once: as int32, with its count (4 at most) and the kind that it had first."""
    f, first, n = np.unique(x, return_index=True, return_counts=True)
    return f.astype("<i4"), np.minimum(n, 4).astype("i1"), kind[first].astype("i1")


class Sample:
    """Sparse rows: of nonzero k, row[k] has feature col[k] count[k] times; kind by feature."""

    def __init__(self, rows: list[np.ndarray], kinds: list[np.ndarray], dense: np.ndarray, least: int = 4):
        """Features of fewer than `least` rows are left out at once: no model could use them."""
        own = [distinct(x, k) for x, k in zip(rows, kinds)]
        self._take([x[0] for x in own], [x[1] for x in own], [x[2] for x in own], dense, least)

    @classmethod
    def of_distinct(cls, cols: list[np.ndarray], counts: list[np.ndarray], kinds: list[np.ndarray], dense: np.ndarray, least: int = 4) -> Sample:
        """From what distinct() gives of each row."""
        out = cls.__new__(cls)
        out._take(cols, counts, kinds, dense, least)
        return out

    def _take(self, cols: list[np.ndarray], counts: list[np.ndarray], kinds: list[np.ndarray], dense: np.ndarray, least: int) -> None:
        # The driver does this: what it holds besides the given rows is a byte or two a feature, and the result.
        df = np.zeros(1 << BITS, np.int32)
        for x in cols:
            df[x] += 1
        keep = [df[x] >= least for x in cols]
        n = np.array([int(k.sum()) for k in keep], np.int64)
        at = np.append(0, np.cumsum(n))
        self.row = np.repeat(np.arange(len(cols), dtype=np.int32), n)
        self.col, self.count, self.kind = np.empty(at[-1], np.int32), np.empty(at[-1], np.int8), np.empty(at[-1], np.int8)
        for i, k in enumerate(keep):
            for to, own in ((self.col, cols), (self.count, counts), (self.kind, kinds)):
                to[at[i] : at[i + 1]] = own[i][k]
        self.dense, self.n = dense, len(cols)

    def parts(self, most: int = 500_000) -> Iterator[slice]:
        """Runs of nonzeros, so that what is made of each is small."""
        for i in range(0, len(self.row), most):
            yield slice(i, i + most)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(s: Sample, dense: np.ndarray, y: np.ndarray, use: np.ndarray, least: int = 4, most: int = 600, penalty: float = 0.05, rounds: int = 150) -> Model:
    """A model of y (0, 1) on the rows in use: the `most` features that tell most by chi-squared, then L1."""
    n, pos = int(use.sum()), int(y[use].sum())
    if not n or not pos or pos == n:
        share = (pos + 0.5) / (n + 1)
        return Model({}, np.zeros(dense.shape[1]), float(np.log(share / (1 - share))))
    df, with_pos = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for part in s.parts():
        live = use[s.row[part]]
        np.add.at(df, s.col[part][live], 1)
        np.add.at(with_pos, s.col[part][live], y[s.row[part][live]])
    expected = df * pos / n
    chi = np.where(df >= least, (with_pos - expected) ** 2 / np.maximum(expected * (1 - pos / n), 1e-9), -1)
    chosen = np.argsort(-chi, kind="stable")[:most]  # of the fold's own rows: held-out ones stay unseen
    chosen = np.sort(chosen[chi[chosen] > 4])
    to = np.full(1 << BITS, -1)
    to[chosen] = np.arange(len(chosen))
    found = []
    for part in s.parts():
        ok = use[s.row[part]] & (to[s.col[part]] >= 0)
        found.append((s.row[part][ok], to[s.col[part][ok]], s.count[part][ok].astype(float), s.kind[part][ok]))
    row, col, count, kinds = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(zip(*found) if found else [()] * 4, (np.int32, np.int64, float, np.int8)))
    kind = np.zeros(len(chosen), np.int64)
    kind[col] = kinds
    cost = np.array([_PENALTY[int(k)] for k in kind]) * penalty
    index = np.full(s.n, -1)
    index[use] = np.arange(n)
    row, t = index[row], y[use].astype(float)
    mean, spread = dense[use].mean(axis=0), dense[use].std(axis=0) + 1e-6
    d = (dense[use] - mean) / spread
    w, v, b = np.zeros(len(chosen)), np.zeros(d.shape[1]), float(np.log(pos / (n - pos)))
    # The largest curvature, by power iteration over all three parts.
    x = np.ones(len(chosen)), np.ones(d.shape[1]), 1.0
    top = 1.0
    for _ in range(15):
        z = np.bincount(row, weights=count * x[0][col], minlength=n) + d @ x[1] + x[2]
        x = np.bincount(col, weights=count * z[row], minlength=len(chosen)), d.T @ z, z.sum()
        top = float(np.sqrt((x[0] ** 2).sum() + (x[1] ** 2).sum() + x[2] ** 2))
        x = tuple(a / top for a in x)
    step, momentum = 4 / (1.05 * top), 1.0
    yw, yv, yb = w, v, b
    for _ in range(rounds):
        z = np.bincount(row, weights=count * yw[col], minlength=n) + d @ yv + yb
        gap = _sigmoid(z) - t
        aw = yw - step * np.bincount(col, weights=count * gap[row], minlength=len(chosen))
        nw = np.sign(aw) * np.maximum(np.abs(aw) - step * cost, 0)
        nv, nb = (yv - step * (d.T @ gap)) / (1 + step * 0.5), yb - step * gap.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        k = (momentum - 1) / after
        yw, yv, yb = nw + k * (nw - w), nv + k * (nv - v), nb + k * (nb - b)
        w, v, b, momentum = nw, nv, nb, after
    v = v / spread
    return Model({int(f): float(x) for f, x in zip(chosen, w) if x}, v, float(b - v @ mean))


def score(s: Sample, dense: np.ndarray, m: Model) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[list(m.weights)] = list(m.weights.values())
    words = np.zeros(s.n)
    for part in s.parts():
        np.add.at(words, s.row[part], s.count[part] * table[s.col[part]])
    return m.bias + dense @ m.dense + words


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Model]
    threshold: float
    #: Held-out log odds and labels of the sample, for reports.
    held_out: dict[str, tuple[np.ndarray, np.ndarray]]


def fit_chain(s: Sample, labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """labels: per category 0, 1 or nan, in the order of the chain. The threshold is the last category's
    best by F1 on held-out predictions; 0.5 unless another does better."""
    dense, models, held = s.dense, [], {}
    for name, y in labels.items():
        known = ~np.isnan(y)
        y = np.nan_to_num(y)
        out = np.zeros(s.n)
        for k in range(FOLDS):
            part = folds == k
            out[part] = score(s, dense, fit(s, dense, y, known & ~part))[part]
        models.append(fit(s, dense, y, known))
        held[name] = out[known], y[known]
        dense = np.column_stack([dense, np.clip(out, -8, 8)])
    p, y = held[name]
    p = _sigmoid(p)

    def f1(c: float) -> float:
        hit = (p >= c) & (y == 1)
        return 2 * hit.sum() / max(1, (p >= c).sum() + y.sum())

    if not len(p):  # nothing was learnt, so nothing is called so
        return Chain(tuple(labels), models, float("inf"), held)
    threshold = max([0.5, *np.arange(0.1, 0.95, 0.05).round(2).tolist()], key=f1)
    return Chain(tuple(labels), models, 0.5 if f1(threshold) <= f1(0.5) else threshold, held)


class _Scorer:
    """Scores texts; a token's weights in every model are kept while the cache lasts."""

    def __init__(self, chain: Chain, limit: int = 150_000):
        self.chain, self.limit = chain, limit
        self.cache: dict[str, tuple[tuple[int, float, int], ...] | None] = {}
        self.used = {f for m in chain.models for f in m.weights}

    def _look(self, token: str) -> tuple:
        found = tuple(f for f, _ in word_features(token) if f in self.used)
        if len(token) <= 60:
            if len(self.cache) >= self.limit:
                self.cache.clear()
            self.cache[token] = found
        return found

    def __call__(self, text: str) -> list[float]:
        own, dense = tokens(text)
        counts: dict[int, int] = {}
        get = self.cache.get
        for t in own:
            f = get(t)
            if f is None:
                f = self._look(t)
            for x in f:
                counts[x] = counts.get(x, 0) + 1
        out: list[float] = []
        for m in self.chain.models:
            z = m.bias + float(np.concatenate([dense, np.clip(out, -8, 8)]) @ m.dense)
            w = m.weights
            for x in sorted(counts):
                if x in w:
                    z += w[x] * min(counts[x], 4)
            out.append(z)
        return [float(_sigmoid(np.array(z))) for z in out]


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 6000) -> Chain:
    """The chain low_quality -> toxic, from at most train_rows labelled documents (the first by a hash of doc_id)."""
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id").limit(train_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text in batch.column(1).to_pylist():
                words, dense = tokens(text or "")
                f = [x for t in sorted(words) for x in word_features(t)]
                own = distinct(np.array([x for x, _ in f], np.int64), np.array([k for _, k in f], np.int64))
                got.append((*[x.tobytes() for x in own], dense.tolist()))
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, *batch.columns[2:]], names=["doc_id", "features", "counts", "kinds", "dense", "quality", "toxic"])

    # At most train_rows labels are broadcast and as many documents' features come back: of documents that
    # share an id, the one with the smallest hash of its text.
    texts = docs.select("doc_id", "text").join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    texts = texts.join(F.broadcast(own), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    got = common.text_batches(texts).mapInArrow(extract, common.schema_with(docs, "doc_id", features="binary", counts="binary", kinds="binary", dense="array<double>", quality="double", toxic="double"))
    rows = got.toArrow()
    order = pa.table({"doc_id": rows.column("doc_id"), "at": np.arange(rows.num_rows)}).sort_by("doc_id").column("at").to_numpy()
    small = rows.drop_columns(["features", "counts", "kinds"]).take(pa.array(order))
    names, dense = small.column("doc_id").to_pylist(), np.array(small.column("dense").to_pylist(), float).reshape(len(order), len(DENSE))
    quality, toxic = (np.array(small.column(c).to_pylist(), float) for c in ("quality", "toxic"))
    # Features stay where Arrow holds them until the sample is made.
    s = Sample.of_distinct(*[_values(rows.column(c), order, kind) for c, kind in (("features", "<i4"), ("counts", "i1"), ("kinds", "i1"))], dense)
    del rows, small
    folds = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in names], int)
    chain = fit_chain(s, {"low_quality": 1 - quality, "toxic": toxic}, folds)
    del s
    common.tidy()  # the driver goes on for as long as the session does
    return chain


def _values(column: pa.ChunkedArray, order: np.ndarray, kind: str) -> list[np.ndarray]:
    """A binary column's values in the order given, as views of its memory."""
    views = [np.frombuffer(x.as_buffer(), kind) for chunk in column.chunks for x in chunk]
    return [views[i] for i in order.tolist()]


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category> of every category of the chain, and toxic (the last one's decision).

    Columns of docs with those names give way.
    """
    added = {f"p_{n}": "double" for n in chain.names} | {"toxic": "boolean"}
    kept = [c for c in docs.columns if c not in added]
    schema = common.schema_with(docs, *kept, **added)
    at, names = kept.index("text"), schema.names
    shared = docs.sparkSession.sparkContext.broadcast(Chain(chain.names, chain.models, chain.threshold, {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            p = [scorer(t.as_py() or "") for t in batch.column(at)]
            cols = [pa.array([x[k] for x in p], pa.float64()) for k in range(len(scorer.chain.names))]
            toxic = pa.array([x[-1] >= scorer.chain.threshold for x in p], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, toxic], names=names)
        common.tidy()

    return common.text_batches(docs.select(*kept)).mapInArrow(run, schema)
