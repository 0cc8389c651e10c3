"""Filling containers of fixed capacity with whole documents (problem 7).

Lexical retrieval packing: the corpus is spread over shards by topic, each
shard holds a BM25 inverted index of its documents (with document frequencies
of the whole corpus).  As many seeds as containers are needed ask the shards
nearest to them, wherever they lie themselves; a document that several seeds
are offered goes to the one it fits best, and a seed's unused neighbours fill
its window best match first.  The gaps left take unused neighbours of the
seed's own shard, then the largest documents that still fit.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import tokens as tok
from tidemark.session import cut

K1, B = 1.2, 0.75
#: Tokens that one topic holds on average; the corpus is measured in such shares.
TOPIC_TOKENS = 250_000
#: Shares that one shard holds at most, that a seed asks, and neighbours that a shard returns for it.
SHARD_SHARES, ASKED_SHARES, NEIGHBOURS = 8, 24, 32
#: Cells of the dense part of an index.
DENSE_CELLS = 8_000_000
#: Documents that the topics are fitted on, at most; topics at most; buckets that words are hashed to for topics.
SAMPLE_DOCUMENTS, TOPICS, BUCKETS = 5_000, 512, 2048
#: Documents without tokens that share a container, on average at most.
EMPTY_EACH = 50_000

PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("container_id", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("tokens", T.IntegerType()),
    ]
)
_WORD = re.compile(r"[^\W_]+")


class Hashes(dict):
    """Words and their hashes, each taken once."""

    def __missing__(self, word: str) -> int:
        h = self[word] = zlib.crc32(word.encode()) - 2**31
        return h


def term_counts(text: str | None, known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words of a text and how often each occurs."""
    counts = Counter(_WORD.findall((text or "").lower()))
    return np.fromiter(map(known.__getitem__, counts), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))


class Index:
    """BM25 inverted index of one shard; ties go to the lesser id."""

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], df: dict[int, int], n_docs: int, mean_len: float):
        self.n = len(ids)
        self.order = np.empty(self.n, dtype=np.int64)
        self.order[np.argsort(ids, kind="stable")] = np.arange(self.n)
        size = np.array([len(t) for t in terms], dtype=np.int64)
        row = np.repeat(np.arange(self.n), size)
        flat = np.concatenate(terms) if self.n and size.sum() else np.zeros(0, dtype=np.int32)
        tf = np.concatenate(tfs).astype(np.float64) if len(flat) else np.zeros(0)
        self.vocab, col = np.unique(flat, return_inverse=True)
        d = np.array([df.get(int(w), 1) for w in self.vocab], dtype=np.float64)
        idf = np.log1p((max(n_docs, self.n) - d + 0.5) / (d + 0.5))
        length = np.bincount(row, weights=tf, minlength=self.n)
        weight = idf[col] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / max(mean_len, 1e-9))) if len(flat) else tf
        by_term = np.argsort(col, kind="stable")
        self.start = np.searchsorted(col[by_term], np.arange(len(self.vocab) + 1))
        self.doc, self.weight = row[by_term], weight[by_term]
        # The most frequent terms also as dense rows, for many queries at once; the cells are bounded.
        often = np.argsort(-np.diff(self.start), kind="stable")[: DENSE_CELLS // max(self.n, 1)]
        self.dense_row = np.full(len(self.vocab), -1)
        self.dense_row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), dtype=np.float32)
        at = self.dense_row[col]
        np.add.at(self.dense, (at[at >= 0], row[at >= 0]), weight[at >= 0])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Score of every document for a query of distinct terms."""
        return self.many_scores([terms])[0]

    def many_scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """Scores of every document (columns) for several queries (rows)."""
        out = np.zeros((len(queries), self.n))
        of = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        terms = np.concatenate(queries)
        at = np.searchsorted(self.vocab, terms)
        known = at < len(self.vocab)
        known[known] = self.vocab[at[known]] == terms[known]
        at, of = at[known], of[known]
        if not len(at):
            return out
        row = self.dense_row[at]
        if (row >= 0).any():
            q = np.zeros((len(queries), len(self.dense)), dtype=np.float32)
            np.add.at(q, (of[row >= 0], row[row >= 0]), 1)
            out += q @ self.dense
        at, of = at[row < 0], of[row < 0]
        if len(at):
            lo, n = self.start[at], self.start[at + 1] - self.start[at]
            where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            flat = np.repeat(of * self.n, n) + self.doc[where]
            out += np.bincount(flat, weights=self.weight[where], minlength=out.size).reshape(out.shape)
        return out

    def ranked(self, score: np.ndarray, most: int | None = None) -> np.ndarray:
        """Documents of positive score, best first."""
        hits = np.nonzero(score > 0)[0]
        if most is not None and len(hits) > most:
            edge = np.partition(score[hits], len(hits) - most)[len(hits) - most]
            hits = hits[score[hits] >= edge]
        return hits[np.lexsort((self.order[hits], -score[hits]))][:most]


def fill_shard(sizes: list[int], terms: list[np.ndarray], index: Index, capacity: int, seeds: list[tuple[int, int]]) -> list[list[int]]:
    """Containers as lists of item positions; sizes are at most `capacity`.

    `seeds` are (position, room left) of windows already begun; they come first
    in each of their containers.  Items that fit none of them begin new windows
    from the largest down.
    """
    n = len(sizes)
    size = np.array(sizes, dtype=np.int64)
    order = index.order
    used = np.zeros(n, dtype=bool)
    used[[i for i, _ in seeds]] = True
    free: list[tuple[int, int, int]] = sorted((sizes[i], -int(order[i]), i) for i in range(n) if not used[i])

    def take(i: int) -> None:
        used[i] = True
        free.pop(bisect_right(free, (sizes[i], -int(order[i]), i)) - 1)

    containers: list[list[int]] = []
    rest = sorted((i for i in range(n) if not used[i]), key=lambda i: (-sizes[i], order[i]))
    for seed, gap in [*sorted(seeds, key=lambda s: (-sizes[s[0]], order[s[0]])), *[(i, None) for i in rest]]:
        if gap is None:
            if used[seed]:
                continue
            take(seed)
            gap = capacity - sizes[seed]
        box = [seed]
        if gap and free and free[0][0] <= gap:
            score = index.scores(terms[seed])
            score[used | (size > gap)] = 0
            for i in index.ranked(score, 4 * NEIGHBOURS):
                if sizes[i] <= gap:
                    take(int(i))
                    box.append(int(i))
                    gap -= sizes[i]
                    if not free or free[0][0] > gap:
                        break
            while free and free[0][0] <= gap:
                i = free[bisect_right(free, (gap, 1, n)) - 1][2]
                take(i)
                box.append(i)
                gap -= sizes[i]
        containers.append(box)
    return containers


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of item positions: largest items first, each into the fullest container that has room."""
    gaps: list[tuple[int, int]] = []
    boxes: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_right(gaps, (sizes[i], -1))
        if at < len(gaps):
            room, k = gaps.pop(at)
        else:
            room, k = capacity, len(boxes)
            boxes.append([])
        boxes[k].append(i)
        insort(gaps, (room - sizes[i], k))
    return boxes


def topic_vectors(terms: list[np.ndarray], tfs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit vectors of damped, weighted word counts by hashed word; zero for texts without words."""
    x = np.zeros((len(terms), BUCKETS))
    for i, (t, k) in enumerate(zip(terms, tfs, strict=True)):
        if len(t):
            x[i] = np.bincount(np.asarray(t, dtype=np.int64) % BUCKETS, weights=k / (k + K1), minlength=BUCKETS)
    x *= idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Directions of at most k groups by spherical k-means, begun at points far apart."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    far = 1 - x @ x[at[0]]
    while len(at) < min(k, len(x)) and far.max() > 1e-9:
        p = np.maximum(far, 0) ** 2
        at.append(int(rng.choice(len(x), p=p / p.sum())))
        far = np.minimum(far, 1 - x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        filled = np.bincount(near, minlength=len(c)) > 0
        c = np.where(filled[:, None], sums, c)
        c = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def fit_topics(documents: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(topic directions, their mass in shares, word weights), fitted on at most SAMPLE_DOCUMENTS texts chosen by hash of their id."""
    if shards <= 1:
        return np.zeros((1, BUCKETS)), np.ones(1), np.ones(BUCKETS)

    chosen = documents.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCUMENTS)
    words = T.StructType([T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(words)
    def counted(texts: pd.Series) -> pd.DataFrame:
        known = Hashes()
        both = [term_counts(t, known) for t in texts]
        return pd.DataFrame({"terms": [t for t, _ in both], "tfs": [k for _, k in both]})

    fitted = T.StructType([T.StructField(c, T.BinaryType()) for c in ("centres", "mass", "idf")])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = topic_vectors(pdf["terms"].tolist(), pdf["tfs"].tolist(), np.ones(BUCKETS))
        idf = np.log1p(len(x) / (1 + (x > 0).sum(0)))
        x *= idf
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        c = k_means(x, min(shards, TOPICS))
        held = np.bincount((x @ c.T).argmax(1), weights=pdf["terms"].str.len(), minlength=len(c))
        return pd.DataFrame({"centres": [c.tobytes()], "mass": [(held * shards / max(held.sum(), 1)).tobytes()], "idf": [idf.tobytes()]})

    some = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", counted("text").alias("x")).select("doc_id", "x.*")
    row = some.groupBy().applyInPandas(fit, fitted).first()
    if row is None:
        return np.zeros((1, BUCKETS)), np.ones(1), np.ones(BUCKETS)
    return np.frombuffer(row["centres"]).reshape(-1, BUCKETS), np.frombuffer(row["mass"]), np.frombuffer(row["idf"])


def read_documents(documents: DataFrame, centres: np.ndarray, mass: np.ndarray, idf: np.ndarray, path: str = tok.DEFAULT_TOKENIZER, sizes: bool = True) -> DataFrame:
    """doc_id, tokens, terms, tfs and the nearest topics of every document, each text read once.

    `near` goes on until it holds ASKED_SHARES of the corpus.
    With `sizes` False the documents bring their own column `tokens`.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("near", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tok.load(path) if sizes else None
        known = Hashes()
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                texts = [t or "" for t in some["text"]]
                n = tok.counts(tokenizer, texts) if sizes else some["tokens"].fillna(0).astype("int32").to_numpy()
                both = [term_counts(t, known) for t in texts]
                x = topic_vectors([t for t, _ in both], [k for _, k in both], idf)
                # Rounded, so that equal texts get the same topics in any batch.
                near = np.argsort(-np.round(x @ centres.T, 9), axis=1, kind="stable").astype("int32")
                held = np.cumsum(mass[near], axis=1) - mass[near] < ASKED_SHARES
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "tokens": n, "terms": [t for t, _ in both], "tfs": [k for _, k in both], "near": [r[h] for r, h in zip(near, held, strict=True)]})

    return documents.select("doc_id", "text", *([] if sizes else ["tokens"])).mapInPandas(run, schema)


def placed(read: DataFrame, shards: int) -> DataFrame:
    """Add `shard` (topic and part) and the shards it would ask.

    A topic of more than SHARD_SHARES shares is spread over parts by hash of
    the document.  A seed asks all parts of its topics, up to ASKED_SHARES of
    any one topic, beginning with the part its own hash says.
    """
    mass = F.sum(F.size("terms").cast("long"))
    share = read.agg(F.greatest(mass / max(shards, 1), F.lit(1.0)).alias("m")).scalar()
    heavy = read.groupBy(F.col("near")[0].alias("topic")).agg(mass.alias("m")).where(F.col("m") > SHARD_SHARES * share).select("topic", F.ceil(F.col("m") / (SHARD_SHARES * share)).alias("parts"))
    # At most TOPICS rows.
    split = sorted(heavy.collect()) if shards > 1 else []
    table = F.create_map(*[F.lit(int(x)) for r in split for x in (r["topic"], r["parts"])]) if split else None
    parts = lambda topic: F.lit(1) if table is None else F.coalesce(table[topic], F.lit(1))
    cell = lambda topic, k=0: F.concat_ws("-", topic, F.pmod(F.xxhash64("doc_id") + k, parts(topic)))
    asks = F.flatten(F.transform("near", lambda topic: F.transform(F.sequence(F.lit(0), F.least(parts(topic), F.lit(ASKED_SHARES // SHARD_SHARES)) - 1), lambda k: cell(topic, k))))
    return read.select("doc_id", "tokens", "terms", "tfs", cell(F.col("near")[0]).alias("shard"), asks.alias("asks"))


NEAR = T.StructType([T.StructField("seed", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def with_statistics(items: DataFrame) -> DataFrame:
    """One row per shard: its terms and their document frequencies in the whole corpus, with corpus totals."""
    in_shard = items.select("shard", F.explode("terms").alias("term")).groupBy("shard", "term").agg(F.count(F.lit(1)).alias("n"))
    df = in_shard.groupBy("term").agg(F.sum("n").cast("int").alias("df"))
    totals = items.agg(F.struct(F.count(F.lit(1)).alias("docs"), F.avg(F.aggregate("tfs", F.lit(0), lambda s, x: s + x)).alias("mean_len"))).scalar()
    lists = in_shard.join(df, "term").groupBy("shard").agg(F.collect_list("term").alias("terms"), F.collect_list("df").alias("dfs"))
    return lists.select("shard", "terms", "dfs", totals["docs"].alias("n_docs"), totals["mean_len"].alias("mean_len"))


def neighbours(items: DataFrame, seeds: DataFrame, stats: DataFrame, fits: bool = True) -> DataFrame:
    """(seed, doc_id, score): of each shard a seed asks, its best NEIGHBOURS documents that are no seeds.

    Shards answer in parallel; a query goes to ASKED_SHARES of the corpus however large it is.
    """
    asked = seeds.select(F.explode("asks").alias("shard"), F.col("doc_id").alias("seed"), "terms", F.lit(None).cast("array<int>").alias("dfs"), F.lit(None).cast("long").alias("n_docs"), F.lit(None).cast("double").alias("mean_len"))
    known = stats.select("shard", F.lit(None).cast("long").alias("seed"), "terms", "dfs", "n_docs", "mean_len")

    def run(key: tuple, docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        about = queries[queries["seed"].isna()]
        queries = queries[queries["seed"].notna()]
        out = []
        if len(docs) and len(queries) and len(about):
            ids = docs["doc_id"].to_numpy()
            row = about.iloc[0]
            index = Index(ids, docs["terms"].tolist(), docs["tfs"].tolist(), dict(zip(row["terms"].tolist(), row["dfs"].tolist(), strict=True)), int(row["n_docs"]), float(row["mean_len"]))
            terms, seeds = queries["terms"].tolist(), queries["seed"].to_numpy(dtype="int64")
            step = max(1, DENSE_CELLS // max(index.n, 1) // 2)
            for k in range(0, len(seeds), step):
                for seed, score in zip(seeds[k : k + step], np.round(index.many_scores(terms[k : k + step]), 4), strict=True):
                    best = index.ranked(score, NEIGHBOURS)
                    out.append((np.full(len(best), seed), ids[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)]
        return pd.DataFrame(dict(zip(("seed", "doc_id", "score"), columns, strict=True)))

    return items.select("shard", "doc_id", "terms", "tfs").groupBy("shard").cogroup(asked.unionByName(known).groupBy("shard")).applyInPandas(run, NEAR)


def choose_seeds(sized: DataFrame, capacity: int) -> DataFrame:
    """Add `is_seed`: the largest documents, as many as full containers are needed.

    The least size of a seed comes from counts per size (at most `capacity`
    rows); of documents of just that size a share is chosen by hash.
    """
    per = sized.where("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    need = F.ceil(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy(F.lit(0))) / capacity)
    run = per.withColumns({"above": F.sum("n").over(w) - F.col("n"), "need": need}).where("above < need")
    edge = run.agg(F.min_by(F.struct("size", ((F.col("need") - F.col("above")) / F.col("n")).alias("share")), "size")).scalar()
    lot = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1e6
    return sized.withColumn("is_seed", F.coalesce((F.col("size") > edge["size"]) | ((F.col("size") == edge["size"]) & (lot < edge["share"])), F.lit(False)))


def prepared(documents: DataFrame, capacity: int, shards: int, sizes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents read, placed in shards and marked as seeds or not; and the statistics of the shards."""
    items = placed(cut(read_documents(documents, *fit_topics(documents, shards), sizes=sizes)), shards)
    full = F.greatest(F.floor((F.col("tokens") - 1) / capacity).cast("int"), F.lit(0))
    return choose_seeds(items.withColumns({"piece": full, "size": F.col("tokens") - full * capacity}), capacity), cut(with_statistics(items))


def pack(documents: DataFrame, capacity: int, shards: int, sizes: bool = False) -> DataFrame:
    """Container of every document: doc_id, piece, container_id, position, tokens.

    `documents` has unique doc_id and text, and tokens unless `sizes` asks to
    count them.  A document larger than the capacity is cut into pieces: full
    ones fill containers alone, the rest is packed like any other item.
    Documents without tokens (NULL or empty text) take no space and share
    containers of their own.
    """
    rest, stats = prepared(documents, capacity, shards, sizes)
    whole = (
        rest.where(F.col("tokens") > capacity)
        .select("doc_id", F.explode(F.sequence(F.lit(0), F.col("piece") - 1)).alias("piece"))
        .select("doc_id", "piece", F.concat(F.lit("d"), "doc_id", F.lit(":"), "piece").alias("container_id"), F.lit(0).alias("position"), F.lit(capacity).alias("tokens"))
    )
    none = rest.where("size = 0").select("doc_id", "piece", F.col("size").alias("tokens"))
    bins = F.floor(none.agg(F.count(F.lit(1))).scalar() / EMPTY_EACH) + 1
    none = none.withColumn("container_id", F.concat(F.lit("e"), F.pmod(F.xxhash64("doc_id"), bins)))
    empty = none.select("doc_id", "piece", "container_id", (F.row_number().over(Window.partitionBy("container_id").orderBy("doc_id")) - 1).alias("position"), "tokens")
    live = rest.where("size > 0")
    seeds = live.where("is_seed")
    offers = neighbours(live.where("not is_seed"), seeds, stats)
    # A document goes to the seed it fits best; a seed takes its documents best first while they fit.
    chosen = offers.groupBy("doc_id").agg(F.max_by(F.struct("seed", "score"), F.struct("score", -F.col("seed"))).alias("b")).select("doc_id", "b.*")
    w = Window.partitionBy("seed").orderBy(F.col("score").desc(), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    small = live.select("doc_id", "piece", "size")
    given = chosen.join(small, "doc_id").join(seeds.select(F.col("doc_id").alias("seed"), F.col("size").alias("seed_size")), "seed")
    given = given.withColumns({"filled": F.col("seed_size") + F.sum("size").over(w), "position": F.row_number().over(w)}).where(F.col("filled") <= capacity)
    given = cut(given.select("doc_id", "piece", "seed", "position", "size", "filled"))
    filled = given.groupBy("seed").agg(F.max("filled").alias("filled"))

    left = live.join(given.select("doc_id"), "doc_id", "left_anti").join(filled.withColumnRenamed("seed", "doc_id"), "doc_id", "left")
    left = left.select("shard", "doc_id", "piece", "size", "terms", "tfs", F.when(F.col("is_seed"), F.coalesce("filled", "size")).alias("filled"))
    begun = T.StructType([*PACKED.fields, T.StructField("seed", T.LongType()), T.StructField("room", T.IntegerType())])

    def run(key: tuple, pdf: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[f.name for f in begun.fields])
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        ids, size, filled = pdf["doc_id"].tolist(), pdf["size"].tolist(), pdf["filled"].to_numpy(dtype=float)
        terms = list(pdf["terms"])
        df = dict(zip(about["terms"].iloc[0].tolist(), about["dfs"].iloc[0].tolist(), strict=True)) if len(about) else {}
        index = Index(pdf["doc_id"].to_numpy(), pdf["terms"].tolist(), pdf["tfs"].tolist(), df, int(about["n_docs"].iloc[0]) if len(about) else len(pdf), float(about["mean_len"].iloc[0]) if len(about) else 1.0)
        seeds = [(i, capacity - int(f)) for i, f in enumerate(filled) if f == f]
        room = dict(seeds)
        boxes = fill_shard(size, terms, index, capacity, seeds)
        out = []
        for box in boxes:
            gap = room.get(box[0], capacity - size[box[0]]) - sum(size[i] for i in box[1:])
            # Documents awarded to a seed stand between it and those added here.
            out += [(ids[i], int(pdf["piece"].iloc[i]), f"s{ids[box[0]]}", 0 if p == 0 else 100_000 + p, size[i], ids[box[0]], gap) for p, i in enumerate(box)]
        return pd.DataFrame(out, columns=[f.name for f in begun.fields])

    own = cut(left.groupBy("shard").cogroup(stats.groupBy("shard")).applyInPandas(run, begun))
    rooms = own.where("position = 0").select("seed", "room")
    granted = given.join(rooms, "seed").select("doc_id", "piece", F.concat(F.lit("s"), "seed").alias("container_id"), "position", F.col("size").alias("tokens"), "seed", "room")
    boxed = own.select(*granted.columns).unionByName(granted)
    return merged(boxed, capacity).unionByName(whole).unionByName(empty)


def merged(boxed: DataFrame, capacity: int) -> DataFrame:
    """Containers less than 98 % full are emptied and their items packed anew across shards."""
    thin = F.col("room") * 50 > capacity
    good = boxed.where(~thin)
    place = Window.partitionBy("container_id").orderBy("position")
    good = good.select("doc_id", "piece", "container_id", (F.row_number().over(place) - 1).cast("int").alias("position"), "tokens")
    pool = boxed.where(thin)
    pools = pool.agg(F.greatest(F.ceil(F.sum(F.col("tokens").cast("long")) / (SHARD_SHARES * TOPIC_TOKENS)), F.lit(1))).scalar()
    pool = pool.select("doc_id", "piece", "tokens", F.pmod(F.xxhash64("container_id"), F.coalesce(pools, F.lit(1))).alias("pool"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        ids, pieces, size = pdf["doc_id"].tolist(), pdf["piece"].tolist(), pdf["tokens"].tolist()
        out = [(ids[i], pieces[i], f"m{key[0]}:{k}", p, size[i]) for k, box in enumerate(best_fit(size, capacity)) for p, i in enumerate(box)]
        return pd.DataFrame(out, columns=[f.name for f in PACKED.fields])

    return good.unionByName(pool.groupBy("pool").applyInPandas(run, PACKED))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row on the containers that hold tokens: their number, tokens, unused space as a share, the least containers possible."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).where("tokens > 0")
    total = F.sum("tokens")
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        total.alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.ceil(total / capacity).alias("least_containers"),
        (1 - total / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
        F.avg("documents").alias("documents_each"),
    )
