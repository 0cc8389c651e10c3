"""Linear-chain conditional random field with two states over hashed token features (problem 9)."""

from __future__ import annotations

import re
import zlib

import numpy as np

from tidemark.llm.textfold import INVISIBLE, fold

#: Size of the hashed feature table.
FEATURES = 1 << 18
#: Digits and signs that stand for letters in disguised words.
LEET = str.maketrans("0134578@$€!|", "oieastbaseil")
_TOKEN = re.compile(r"[^\s.,;:?\"()\[\]{}<>/\\…–—«»“”„&=+~^%#]+")
_RUN = re.compile(r"(.)\1{2,}")
_EDGE = "!'’‘`´-_*"
_MIXED = re.compile("[а-яіјѕԁА-ЯІЈЅα-ωΑ-Ω]")
_LATIN = re.compile("[A-Za-z]")
#: Tokens of a training piece.
PIECE = 48
#: Tokens, padding included, of texts that are run side by side.
PADDED_TOKENS = 400_000
FLAGS = ("masked", "mixed", "hidden", "stretched", "spaced", "leet", "caps", "name")


def _norm(raw: str) -> tuple[str, int]:
    """(plain word, flag bits) of one token."""
    flags = 0
    if INVISIBLE.search(raw):
        flags |= 4
    if _MIXED.search(raw) and _LATIN.search(raw):
        flags |= 2
    core = raw.strip(_EDGE)
    if "*" in core and any(c.isalpha() for c in core):
        flags |= 1
    word = fold(core)
    if any(c.isdigit() for c in word) and not any(c.isalpha() for c in word):
        return "0", flags
    if any(c in "0134578@$€!|" for c in word) and any(c.isalpha() for c in word):
        word = word.translate(LEET)
        flags |= 32
    if _RUN.search(word):
        word = _RUN.sub(r"\1", word)
        flags |= 8
    word = re.sub(r"[_\-'’.]", "", word)
    if len(core) > 1 and core.isupper():
        flags |= 64
    elif core[:1].isupper():
        flags |= 128
    return word, flags


class Encoder:
    """Texts to hashed features; remembers tokens, so a word is folded once per worker."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[str, int, int, int]] = {}

    def word(self, raw: str) -> tuple[str, int, int, int]:
        got = self.memo.get(raw)
        if got is None:
            w, f = _norm(raw)
            got = (w, f, zlib.crc32(w.encode()), zlib.crc32(b"p" + w[:5].encode()))
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[raw] = got
        return got

    def tokens(self, text: str) -> tuple[list[tuple[str, int, int, int]], np.ndarray]:
        """Words and their (start, end) offsets in the text; letters set apart singly are one word."""
        words, spans = [], []
        run: list[tuple[int, int]] = []

        def close() -> None:
            if len(run) >= 3:
                raw = "".join(text[a:b].strip(_EDGE) for a, b in run)
                w, f, h, p = self.word(raw)
                words.append((w, f | 16, h, p))
                spans.append((run[0][0], run[-1][1]))
            else:
                for a, b in run:
                    words.append(self.word(text[a:b]))
                    spans.append((a, b))
            run.clear()

        for m in _TOKEN.finditer(text):
            a, b = m.span()
            single = b - a <= 2 and len(INVISIBLE.sub("", m.group()).strip(_EDGE)) <= 1
            if run and (not single or a - run[-1][1] > 1):
                close()
            if single:
                run.append((a, b))
            else:
                words.append(self.word(m.group()))
                spans.append((a, b))
        close()
        return words, np.array(spans, dtype=np.int64).reshape(-1, 2)

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(n, 7) feature ids and (n, 2) offsets of a text."""
        words, spans = self.tokens(text)
        n = len(words)
        if not n:
            return np.zeros((0, 7), dtype=np.int32), spans
        h = np.array([w[2] for w in words], dtype=np.uint64)
        pre = np.array([w[3] for w in words], dtype=np.uint64)
        flag = np.array([w[1] for w in words], dtype=np.uint64)
        # A name in a slot of a phrase differs each time; its neighbours see only that it is one.
        slot = np.where((flag & 128) > 0, np.uint64(3), h)
        left, right = np.concatenate([[np.uint64(1)], slot[:-1]]), np.concatenate([slot[1:], [np.uint64(2)]])
        left2 = np.concatenate([[np.uint64(1)], left[:-1]])
        k = np.uint64(0x9E3779B97F4A7C15)
        cols = [h * k, (left * k) ^ (slot << np.uint64(7)) * np.uint64(31), (slot * k) ^ (right << np.uint64(9)) * np.uint64(37), (left * k) ^ (right << np.uint64(11)) * np.uint64(41), pre * k ^ np.uint64(77), flag * k ^ np.uint64(99), (left2 * k) ^ ((left << np.uint64(5)) * np.uint64(43)) ^ ((slot << np.uint64(3)) * np.uint64(47))]
        mixed = np.stack(cols, 1)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(40)).astype(np.int64) % FEATURES, spans


def forward_backward(scores: list[np.ndarray], trans: np.ndarray, with_pairs: bool = False) -> tuple[list[np.ndarray], np.ndarray | None]:
    """P(state 1) of each token of each chain, and the expected transition counts if wanted.

    scores: state-1 scores against state 0, one array per chain.  Chains are
    run side by side, long ones first, so each step works on all that reach it.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lens = np.array([len(scores[i]) for i in order])
    top = int(lens[0]) if len(lens) else 0
    out: list[np.ndarray] = [np.zeros(0)] * len(scores)
    pairs = np.zeros((2, 2))
    if not top:
        return out, pairs
    n = len(order)
    em = np.zeros((top, n))
    for j, i in enumerate(order):
        em[: lens[j], j] = scores[i]
    alive = [int(np.searchsorted(-lens, -t, side="left")) for t in range(top)]  # chains longer than t
    e1 = np.exp(np.clip(em, -30, 30))
    m = np.exp(trans)
    fwd = np.zeros((top, n, 2))
    a = np.stack([np.ones(n), e1[0]], 1)
    a /= a.sum(1, keepdims=True)
    fwd[0] = a
    for t in range(1, top):
        k = alive[t]
        b = fwd[t - 1, :k] @ m
        b[:, 1] *= e1[t, :k]
        fwd[t, :k] = b / b.sum(1, keepdims=True)
    bwd = np.ones((top, n, 2))
    for t in range(top - 2, -1, -1):
        k = alive[t + 1]
        x = bwd[t + 1, :k].copy()
        x[:, 1] *= e1[t + 1, :k]
        b = x @ m.T
        bwd[t, :k] = b / b.sum(1, keepdims=True)
        if with_pairs:
            joint = fwd[t, :k, :, None] * m[None] * x[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    post = fwd * bwd
    p1 = post[..., 1] / np.maximum(post.sum(-1), 1e-300)
    for j, i in enumerate(order):
        out[i] = p1[: lens[j], j]
    return out, pairs


class Model:
    """Feature weights and transition scores."""

    def __init__(self, weights: np.ndarray | None = None, trans: np.ndarray | None = None, threshold: float = 0.5) -> None:
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.trans = np.array([[0.0, -2.0], [-1.0, 1.0]]) if trans is None else trans
        self.threshold = threshold

    def marginals(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        """P(offending) of each token of each text; texts of like length are run together."""
        scores = [self.weights[f].sum(1) for f in feats]
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(scores)
        at = 0
        while at < len(order):
            # Arrays are as long as the group's longest text, so a book runs with few others.
            part = order[at : at + max(1, PADDED_TOKENS // max(len(scores[order[at]]), 1))]
            for i, p in zip(part, forward_backward([scores[i] for i in part], self.trans)[0], strict=True):
                out[i] = p
            at += len(part)
        return out

    def fit(self, feats: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 128, rate: float = 0.3, l2: float = 1e-5, seed: int = 5) -> Model:
        """AdaGrad on the conditional likelihood of the token labels.

        All tokens are used; chains are cut into pieces of PIECE tokens, which
        costs a few transitions and lets pieces of one length run side by side.
        """
        rng = np.random.default_rng(seed)
        f = [x[i : i + PIECE] for x in feats for i in range(0, len(x), PIECE)]
        y = [x[i : i + PIECE] for x in labels for i in range(0, len(x), PIECE)]
        keep = np.arange(len(f))
        gw, gt = np.full(FEATURES, 1e-2), np.full((2, 2), 1.0)
        for _ in range(epochs):
            rng.shuffle(keep)
            for at in range(0, len(keep), batch):
                part = keep[at : at + batch]
                marg, pairs = forward_backward([self.weights[f[i]].sum(1) for i in part], self.trans, with_pairs=True)
                ids = np.concatenate([f[i] for i in part])
                diff = np.concatenate([y[i] - p for i, p in zip(part, marg, strict=True)])
                grad = np.bincount(ids.ravel(), weights=np.repeat(diff, ids.shape[1]), minlength=FEATURES)
                hit = np.nonzero(grad)[0]
                g = grad[hit] - l2 * len(diff) * self.weights[hit]
                gw[hit] += g * g
                self.weights[hit] += rate * g / np.sqrt(gw[hit])
                seen = np.zeros((2, 2))
                for i in part:
                    t = y[i].astype(int)
                    np.add.at(seen, (t[:-1], t[1:]), 1)
                g2 = seen - pairs
                gt += g2 * g2
                self.trans = np.clip(self.trans + rate * g2 / np.sqrt(gt), -8, 8)
        return self


def smooth(x: np.ndarray, width: int) -> np.ndarray:
    """Running mean over `width` tokens, as long as x."""
    if not len(x):
        return x
    pad = np.concatenate([[0.0], np.cumsum(x)])
    half = width // 2
    lo, hi = np.maximum(np.arange(len(x)) - half, 0), np.minimum(np.arange(len(x)) + half + 1, len(x))
    return (pad[hi] - pad[lo]) / (hi - lo)


def document_score(p: np.ndarray) -> float:
    """The most offending three tokens in a row; 0 for no tokens."""
    return float(smooth(p, 3).max()) if len(p) else 0.0


def evidence(feats: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Per token how much more often its words and word pairs occur in offending documents (log odds)."""
    cols = [0, 1, 2, 6]
    pos, neg = np.zeros(FEATURES), np.zeros(FEATURES)
    for f, label in zip(feats, y, strict=True):
        ids = np.unique(f[:, cols]) if len(f) else []
        (pos if label else neg)[ids] += 1
    np_, nn = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    odds = np.log((pos + 0.3) / (np_ + 0.6)) - np.log((neg + 0.3) / (nn + 0.6))
    odds[pos + neg < 2] = np.minimum(odds[pos + neg < 2], 0.8)
    return [smooth(odds[f[:, cols]].mean(1), 5) if len(f) else np.zeros(0) for f in feats]


def fit_from_documents(texts: list[str], y: np.ndarray, weight: np.ndarray, rounds: int = 2) -> Model:
    """Model from document labels that may be wrong.

    Tokens are first labelled from the evidence of their words over all labelled
    documents.  Then each half of the documents is read by a model of the other
    half, which keeps what is offending elsewhere too and drops phrases that
    merely stood beside it; documents whose label no token bears out are left
    out.  The threshold is the best F1 of the scores across the halves.
    """
    enc = Encoder()
    feats = [enc.features(t)[0] for t in texts]
    n = len(feats)
    ev = evidence(feats, y)
    own = [(e > 0.7).astype(float) if label else np.zeros(len(e)) for e, label in zip(ev, y, strict=True)]
    tags = list(own)
    good = np.array([bool(t.any()) if label else not (len(e) and e.max() > 2.5) for t, e, label in zip(tags, ev, y, strict=True)], dtype=bool)
    half = np.arange(n) % 2
    scores = np.zeros(n)
    for _ in range(rounds if n >= 40 else 0):
        cross: list[np.ndarray] = [np.zeros(0)] * n
        for h in (0, 1):
            use = np.nonzero((half != h) & good)[0]
            ask = np.nonzero(half == h)[0]
            model = Model().fit([feats[i] for i in use], [tags[i] for i in use])
            for i, p in zip(ask, model.marginals([feats[i] for i in ask]), strict=True):
                cross[i] = p
        scores = np.array([document_score(p) for p in cross])
        for i in range(n):
            if y[i]:
                seen = (np.maximum(cross[i], smooth(cross[i], 3)) > 0.35).astype(float)
                tags[i] = seen if seen.any() else own[i]
                good[i] = bool(tags[i].any())
            else:
                good[i] = scores[i] < 0.9
    use = np.nonzero(good)[0]
    model = Model().fit([feats[i] for i in use], [tags[i] for i in use])
    model.threshold = best_threshold(scores, y, weight) if scores.any() else 0.5
    return model


def best_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Score cut of the best weighted F1, kept inside [0.4, 0.8]; the middle of the best stretch."""
    grid = np.linspace(0.4, 0.8, 41)
    f1 = []
    for t in grid:
        hit = scores >= t
        tp, fp, fn = (weight * (hit & (y > 0))).sum(), (weight * (hit & (y == 0))).sum(), (weight * (~hit & (y > 0))).sum()
        f1.append(2 * tp / max(1e-9, 2 * tp + fp + fn))
    best = np.array(f1) >= max(f1) - 0.005
    return float(np.median(grid[best]))
