"""Toxicity by a subsequence-kernel support vector machine on Nystrom landmarks.

Words are compared by shared character triples, gaps allowed: a triple spanning s characters
weighs DECAY ** (s - 3), so inserted characters cost similarity but don't hide a word, and the
normalised kernel is raised to a power to favour near-complete agreement.  A document is
judged by its most toxic words.  Labels are of documents, so training is multiple-instance: the
machine picks, in each toxic document, the words that it finds most toxic, and in clean ones the
words it is most wrong about, and is fitted again.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import crc_mod, rows_kept, ship, shipped, small_batches
from sectiva.llm._labels import labelled

SPAN = 5
DECAY = 0.5
POWER = 3
LANDMARKS = 256
#: Labelled rows of each class that the machine is fitted on at most.
TRAIN_ROWS = 1500
THRESHOLD = 0.3
#: Distinct words that a worker remembers at most.
MEMO = 150_000
#: Words are compared by their windows of at most so many characters, which overlap by half.
PIECE = 24
#: Words whose kernel values are held at once.
CHUNK = 4000
#: Substring hashes that are gathered before they are counted.
MERGE = 1_000_000
ROUNDS = 3
#: Weight of the losses against the ridge.
COST = 2000.0
#: Log-likelihood ratio from which a word counts as toxic by itself in the first round.
STRONG = 20.0
#: Highest word values that decide on a document, and the ridge of their weights.
TOP, RIDGE = 3, 0.01
PURITY = 20
#: Landmarks that share their strongest substring at most.
SIBLINGS = 16
#: Characters that stand in for letters inside a word.
STAND_INS = str.maketrans("013457@$!", "oieastasi")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
LOW = np.uint64((1 << 40) - 1)
SPELLED = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\S)")


def normal(word: str) -> str:
    """A word as it is compared: outer punctuation off, stand-ins inside it replaced by letters."""
    word = word.strip(".,;:!?\"'()[]{}|*#%&$-_")
    return word if word.isalpha() or word.isdigit() else word.translate(STAND_INS)


def doc_words(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text; letters spelled out one by one count as a word, too."""
    low = (text or "").lower()
    found = set(low.split())
    found.update(x.replace(" ", "") for x in SPELLED.findall(low))
    return found


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, 40-bit triple hash, weight) of all gapped triples, equal ones of a word summed."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.uint64) << np.uint64(40), [len(m) for m in marked])
    n, keys, weights = len(codes), [], []
    for b in range(1, SPAN - 1):
        for c in range(b + 1, SPAN):
            if n > c:
                h = (codes[:-c] * MIX[0] + codes[b : n - c + b]) * MIX[1] + codes[c:]
                h = (h * MIX[2]) >> np.uint64(24)
                h = (h | owner[c:])[owner[:-c] == owner[c:]]
                keys.append(h), weights.append(np.full(len(h), DECAY ** (c - 2)))
    if not keys or not sum(map(len, keys)):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key = key[first]
    return (key >> np.uint64(40)).astype(np.int64), key & LOW, np.add.reduceat(weight, first)


class Kernel:
    """Normalised, powered kernel values between words and fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        own, h, weight = triples(landmarks)
        norm = np.sqrt(np.bincount(own, weight**2, len(landmarks)))
        order = np.lexsort((own, h))
        self.owner, self.value = own[order], (weight / np.maximum(norm, 1e-9)[own])[order]
        self.keys, self.starts, self.counts = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys & np.uint64((1 << 20) - 1)] = True

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)))
        for at in range(0, len(words) if len(self.keys) else 0, CHUNK):
            own, h, weight = triples(words[at : at + CHUNK])
            n = min(CHUNK, len(words) - at)
            norm = np.sqrt(np.bincount(own, weight**2, n))
            near = np.flatnonzero(self.seen[h & np.uint64((1 << 20) - 1)])
            k = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
            hit = self.keys[k] == h[near]
            near, k = near[hit], k[hit]
            count = self.counts[k]
            row = np.repeat(np.arange(len(k)), count)
            slot = np.repeat(self.starts[k] - (np.cumsum(count) - count), count) + np.arange(len(row))
            word = own[near][row]
            cell = word * len(self.landmarks) + self.owner[slot]
            cells = np.bincount(cell, (weight[near] / np.maximum(norm, 1e-9)[own[near]])[row] * self.value[slot], n * len(self.landmarks))
            # Products cost a tenth of a general power.
            np.minimum(cells, 1, out=cells)
            out[at : at + n] = math.prod([cells] * (POWER - 1), start=cells).reshape(n, -1)
        return out


def _pieces(word: str) -> list[str]:
    """Windows of a word as it is compared, and of the word without signs inside it; a short word is one window."""
    if len(word) <= PIECE and word.isalpha():
        return [word]
    word = normal(word)
    forms = [word] if word.isalnum() or not word else [word, "".join(filter(str.isalnum, word))]
    return [f[i : i + PIECE] for f in forms for i in range(0, max(len(f) - PIECE // 2, 1), PIECE // 2)]


class Machine:
    """A linear machine on Nystrom features, with a calibrated probability for documents."""

    def __init__(self, landmarks: list[str]):
        self.kernel = Kernel(landmarks)
        values, vectors = np.linalg.eigh(self.kernel(landmarks).astype(float))
        keep = values > 1e-4 * values.max()
        self.map = (vectors[:, keep] / np.sqrt(values[keep]))
        self.w, self.b, self.a, self.c = np.zeros(keep.sum()), 0.0, [1.0] + [0.0] * (TOP - 1), 0.0
        self.direction = None

    def features(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.map

    def fit(self, x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = 30):
        """Squared hinge loss by Newton steps; classes weigh alike."""
        x1 = np.hstack([x, np.ones((len(x), 1))]).astype(float)
        sign = np.where(y > 0, 1.0, -1.0)
        weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * cost
        w, ridge = np.zeros(x1.shape[1]), np.diag([1.0] * x.shape[1] + [1e-3])
        for _ in range(steps):
            active = sign * (x1 @ w) < 1
            xa = x1[active] * weight[active, None]
            new = np.linalg.solve(ridge + x1[active].T @ xa, xa.T @ sign[active])
            done = np.abs(new - w).max() < 1e-6
            w = new
            if done:
                break
        self.w, self.b = w[:-1], float(w[-1])
        self.direction = (self.map @ self.w)

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision value of each word; a long one is as toxic as its most toxic piece."""
        out = [np.zeros(0)]
        for at in range(0, len(words), CHUNK):
            parts = [_pieces(w) for w in words[at : at + CHUNK]]
            own = {p: i for i, p in enumerate(dict.fromkeys(p for x in parts for p in x))}
            flat = (self.kernel(list(own)) @ self.direction + self.b)[[own[p] for x in parts for p in x]]
            n = np.array([len(x) for x in parts])
            out.append(np.maximum.reduceat(flat, np.cumsum(n) - n))
        return np.concatenate(out)

    def calibrate(self, f: np.ndarray, y: np.ndarray):
        """Logistic weights of the TOP highest decision values of documents, by Newton steps on smoothed targets."""
        n1, n0 = (y > 0).sum(), (y <= 0).sum()
        if not n1:
            self.a, self.c = np.zeros(TOP), -5.0
            return
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        z, theta = np.hstack([f, np.ones((len(f), 1))]), np.zeros(TOP + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([RIDGE] * TOP + [1e-6])
            step = np.linalg.solve(h, z.T @ (target - p) - RIDGE * theta * ([1] * TOP + [0]))
            theta = theta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.a, self.c = np.maximum(theta[:TOP], 0.0), float(theta[TOP])

    def top(self, values) -> list[float]:
        """The highest decision values of a document's words; without a word, that of an empty one."""
        return (sorted(values, reverse=True) + [self.b] * TOP)[:TOP]

    def score(self, top: list[float]) -> float:
        f = self.c + sum(a * x for a, x in zip(self.a, top, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, f))))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of all substrings of four to nine characters of marked words, and of the whole words."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(m) for m in marked], np.int64)
    owner, starts = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    rolled, own, found = codes * MIX[1], [], []
    for n in range(2, 10):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * MIX[0] + codes[n - 1 :] * MIX[1]
        if n > 3:
            inside = owner[: len(rolled)] == owner[n - 1 :]
            own.append(owner[: len(rolled)][inside]), found.append((rolled[inside] ^ np.uint64(n)) * MIX[2])
    weights = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(sizes.max(initial=1)), MIX[0]))))
    place = np.arange(len(codes)) - starts[owner] if len(codes) else np.zeros(0, np.int64)
    whole = np.add.reduceat(codes * weights[place], starts) if len(words) else np.zeros(0, np.uint64)
    return np.concatenate([*own, np.arange(len(words))]), np.concatenate([*found, whole * MIX[2] ^ MIX[1]])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(count, first)


def _counts(bags: list[set[str]], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents that contain each substring, by hash; only those ``among`` sorted hashes, if given."""
    total, keys, held = (np.zeros(0, np.uint64), np.zeros(0, np.int32)), [], 0
    for bag in filter(None, bags):
        own = np.unique(_grams(sorted(bag))[1])
        if among is not None and len(among):
            own = own[among[np.minimum(np.searchsorted(among, own), len(among) - 1)] == own]
        keys.append(own)
        held += len(own)
        if held > MERGE:
            total, keys, held = _added([total[0], *keys], [total[1], np.ones(held, np.int32)]), [], 0
    return _added([total[0], *keys], [total[1], np.ones(held, np.int32)]) if held else total


def _seed(bags: list[set[str]], y: np.ndarray) -> dict[str, tuple[float, int]]:
    """Words of toxic documents: the strongest log-likelihood ratio of their substrings, and that substring's hash.

    Only substrings that are at least PURITY times as frequent in toxic documents count.
    """
    toxic, clean = [b for b, v in zip(bags, y, strict=True) if v > 0], [b for b, v in zip(bags, y, strict=True) if v <= 0]
    n1, n0 = len(toxic), len(clean)
    grams, k = _counts(toxic)
    grams, k = grams[k > 2], k[k > 2].astype(float)
    other, m = _counts(clean, grams)
    at = np.minimum(np.searchsorted(other, grams), max(len(other) - 1, 0))
    neg = np.where(other[at] == grams, m[at], 0).astype(float) if len(other) else np.zeros(len(grams))
    pure = k * n0 > PURITY * (neg + 0.3) * n1
    grams, k, neg = grams[pure], k[pure], neg[pure]
    p = np.clip((k + neg) / max(n1 + n0, 1), 1e-9, 1 - 1e-9)
    term = lambda a, b: a * np.log(np.maximum(a, 1e-9) / np.maximum(b, 1e-9))
    rate = 2 * (term(k, n1 * p) + term(n1 - k, n1 * (1 - p)) + term(neg, n0 * p) + term(n0 - neg, n0 * (1 - p)))
    words = sorted({w for b in toxic for w in b})
    out = dict.fromkeys(words, (0.0, 0))
    for lo in range(0, len(words) if len(grams) else 0, 20_000):
        own, h = _grams(words[lo : lo + 20_000])
        at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
        hit = grams[at] == h
        own, at = own[hit], at[hit]
        for i in np.lexsort((-h[hit].astype(float), rate[at], own)):
            out[words[lo + own[i]]] = (float(rate[at[i]]), int(grams[at[i]]))
    return out


def train(texts_words: list[set[str]], labels: list[int]) -> Machine:
    """Fit on bags of words with document labels; a quarter of the bags serves calibration alone.

    The list is reused: its bags become bags of compared forms.
    """
    bags = texts_words
    for k, b in enumerate(bags):
        bags[k] = {sys.intern(p) for w in b for p in _pieces(w) if p}
    y = np.array(labels)
    rng = np.random.default_rng(7)
    held = np.arange(len(bags)) % 4 == 3 if len(bags) >= 40 else np.zeros(len(bags), bool)
    own = [b for b, h in zip(bags, held, strict=True) if not h]
    own_y = y[~held]
    seed = _seed(own, own_y)
    toxic, clean = [b for b, v in zip(own, own_y, strict=True) if v > 0 and b], [b for b, v in zip(own, own_y, strict=True) if v <= 0 and b]
    often, harmless = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    for w in seed:
        if harmless[w] and often[w] * len(clean) < PURITY * (harmless[w] + 0.3) * len(toxic):
            seed[w] = (0.0, 0)
    ranked = sorted((w for w, x in seed.items() if x[0] > STRONG), key=lambda w: (-often[w], w))
    common, of = [], Counter()
    for w in ranked:
        of[seed[w][1]] += 1
        if of[seed[w][1]] <= SIBLINGS and len(common) < LANDMARKS * 3 // 4:
            common.append(w)
    vocabulary = sorted({w for b in clean for w in b} - set(ranked))
    rest = [vocabulary[i] for i in sorted(rng.choice(len(vocabulary), min(LANDMARKS // 4, len(vocabulary)), replace=False))] if vocabulary else []
    machine = Machine(list(dict.fromkeys([*common, *rest])) or ["-"])
    negatives = {vocabulary[i] for i in rng.choice(len(vocabulary), min(4000, len(vocabulary)), replace=False)} if vocabulary else set()
    chosen = [w for b in toxic if seed[w := max(b, key=lambda w: (seed[w][0], often[w], w))][0] > STRONG]
    strong = ranked[: 8 * LANDMARKS]
    for turn in range(ROUNDS):
        minus = sorted(negatives - set(chosen))
        words = [*chosen, *strong, *minus]
        machine.fit(machine.features(words), np.array([1] * (len(chosen) + len(strong)) + [0] * len(minus)))
        if turn < ROUNDS - 1 and words:
            flat = sorted({w for b in own for w in b})
            f = dict(zip(flat, machine.decide(flat), strict=True))
            chosen = [w for b in toxic for k, w in enumerate(sorted(b, key=lambda w: (-f[w], w))[:TOP]) if not k or f[w] > 0]
            strong = [w for w in strong if f[w] > 0]
            for b in clean:
                negatives.update(sorted(b, key=lambda w: (-f[w], w))[:3])
    if machine.direction is None:
        machine.fit(machine.features(["-"]), np.zeros(1))
    judged = [(b, v) for b, v, h in zip(bags, y, held, strict=True) if h] or list(zip(bags, y, strict=True))
    machine.calibrate(np.array([machine.top(machine.decide(sorted(b)).tolist()) for b, _ in judged]), np.array([v for _, v in judged]))
    return machine


class Scorer:
    """Scores of whole texts; values of words are remembered."""

    def __init__(self, machine: Machine):
        self.machine, self.memo = machine, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        bags = [doc_words(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = sorted(set().union(*bags).difference(self.memo)) if bags else []
        self.memo.update(zip(new, self.machine.decide(new).tolist(), strict=True))
        return [self.machine.score(self.machine.top(map(self.memo.__getitem__, b))) for b in bags]


def _scores(batches, machine):
    score = Scorer(machine)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])


def _bags(batches):
    for batch in batches:
        words = [sorted(doc_words(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)], names=["words", "y"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Machine:
    """Machine fitted on ``labels.toxic`` of rows outside the held-out fold, ``train_rows`` a class at most."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, "toxic", crc_mod("k", 4) != 2, train_rows, doc_id, text)
    got = rows.select("text", "y").mapInArrow(_bags, "words array<string>, y int").collect()
    got.sort(key=lambda r: (r.y, len(r.words), r.words))
    bags, y = [], [r.y for r in got]
    for k, r in enumerate(got):
        bags.append(set(map(sys.intern, r.words)))
        got[k] = None
    return train(bags, y)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null or empty texts get the score of a document without words.  Repeated rows and null ids are
    kept (a null id is not held out); only ids and texts are read; labels that are null are left
    out of training, and of an id labelled twice the higher one counts.  Without any labels every
    document scores alike, below the threshold.  Long texts are read whole, columns of other names
    are ignored, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    machine = ship(spark, fit_toxicity(docs, labels, doc_id, text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False)).alias("held_out"))
    scored = rows.mapInArrow(lambda it: _scores(it, shipped(machine)), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows not predicted toxic, each by its own text, whatever its id; null and empty texts stay unless a text without words is predicted toxic."""
    machine = ship(docs.sparkSession, fit_toxicity(docs, labels, doc_id, text))

    def keep():
        score = Scorer(shipped(machine))
        return lambda texts: [s < THRESHOLD for s in score(texts)]

    return rows_kept(docs, text, keep)
