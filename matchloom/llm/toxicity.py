"""Toxicity by a gappy-subsequence string kernel, Nyström landmarks and a linear support vector machine.

Words are folded (lower case, accents off, look-alike digits and signs to letters, other signs out).  The
kernel of two words is the cosine of their gapped subsequences: 3 letters within 5 places and 4 within 5,
each gap weighing ``DECAY``; a stem with another ending, a dropped or an inserted character keeps most of
it.  Spelled-out words ("i d i o t") are put together first.

Training (``train_rows`` labelled rows at most, those with the smallest hashes of their id):
landmarks are words that stand in toxic rows far more often than in clean ones; a row's features are its
largest kernel values per landmark above ``FLOOR``, mapped by K_LL^(-1/2); a linear SVM with hinge loss is
fitted to the labels, and its margins are calibrated to probabilities by logistic regression.

Scoring reads whole texts: every word is weighed, whole and by its words between signs; a landmark that stands within a
longer word, at any place and whatever that word's length, counts as if it stood alone, so what it stands in doesn't dilute it.  A word is
passed over only if the part of its features that any landmark has (``NEAR``) is too small.  Labels, lang, source and doc_id are no inputs.  Null
and empty texts, and all texts if there is no label of each kind, score the calibrated value of no match.
Repeated rows score alike; null labels are left out; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, claim, id_and_text, slices, stored

DECAY, FLOOR = 0.6, 0.45
TRAIN_ROWS, LANDMARKS = 20_000, 64
SHAPES = [(0, *c) for k in (3, 4) for c in combinations(range(1, 5), k - 1)]
#: A word is looked at if this share of its features' mass, repeats counted apart, is in any landmark.
NEAR = 0.1
FEATURES = 28**4 + 28**3  # codes of four letters, then of three
CACHE_WORDS = 100_000
#: Log-likelihood gain over chance that a landmark must have.
MIN_GAIN = 12.0

#: Signs and digits that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(LOOKALIKES)
_SPELLED = re.compile(r"(?<!\S)(?:[a-z][ .\-_*]){3,}[a-z](?!\S)")
_PLAIN = re.compile(r"[a-z]+")
_OUT = re.compile(r"[^a-z]+")
_SIGNS = re.compile(r"[^\w@$!]+|_+")
#: Words of more characters are no landmarks and aren't kept from text to text; beside what they contain their kernel value
#: as a whole would be nothing.
LONGEST = 24


def fold(word: str) -> str:
    """A lower-case word in the letters a to z."""
    if _PLAIN.fullmatch(word):
        return word
    word = word.strip(".,;:!?\"'()").translate(_FOLD)
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word)
    return _OUT.sub("", word)


def parts(word: str) -> list[str]:
    """The folded word and its folded words between signs."""
    bare = word.strip(".,;:!?\"'()")
    if _PLAIN.fullmatch(bare):
        return [bare]
    return sorted({fold(word), *map(fold, _SIGNS.split(word))} - {""})


def words_of(text: str) -> set[str]:
    """Distinct lower-case words of a text as they stand, and spelled-out words put together."""
    low = text.lower()
    plain = low.replace(", ", " ").replace(". ", " ").replace(".\n", "\n")  # fold() strips these signs anyway
    return {*plain.split(), *(_OUT.sub("", m[0]) for m in _SPELLED.finditer(low))}


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, sizes): a row of numbers per folded word, 27 as a start sign, 1 to 26, and zeros at the end."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    width = int(sizes.max(initial=0))
    letters = np.zeros((len(words), width + 4), np.int32)
    letters[:, 0] = 27
    flat = np.frombuffer("".join(words).encode(), np.uint8).astype(np.int32) - 96
    row = np.repeat(np.arange(len(words)), sizes - 1)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes - 1) - (sizes - 1), sizes - 1) + 1
    letters[row, col] = flat
    return letters, sizes


def _codes(letters: np.ndarray):
    """(shape, weight, codes) of each shape; a code with a zero letter reaches over the word's end."""
    width = letters.shape[1] - 4
    begun: dict[tuple, np.ndarray] = {(0,): letters[:, :width]}
    for shape in SHAPES:
        for k in range(2, len(shape) + 1):
            if shape[:k] not in begun:
                begun[shape[:k]] = begun[shape[: k - 1]] * np.int32(28) + letters[:, shape[k - 1] : shape[k - 1] + width]
        yield shape, DECAY ** (shape[-1] + 1 - len(shape)), begun[shape] + np.int32(28**4 if len(shape) == 3 else 0)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, code of a gapped subsequence, weight) of folded words."""
    letters, _ = _letters(words)
    width = letters.shape[1] - 4
    at, code, weight = [], [], []
    for shape, w, codes in _codes(letters):
        i, j = np.nonzero(letters[:, shape[-1] : shape[-1] + width])
        at.append(i)
        code.append(codes[i, j])
        weight.append(np.full(len(i), w, np.float32))
    return np.concatenate(at), np.concatenate(code), np.concatenate(weight)


class Kernel:
    """Kernel values of words against landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        at, code, weight = features(landmarks)
        used, column = np.unique(code, return_inverse=True)
        dense = np.zeros((len(landmarks), len(used)), np.float32)
        np.add.at(dense, (at, column), weight)
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
        self.place = np.full(FEATURES, -1, np.int32)  # of a feature among those that landmarks have
        self.place[used] = np.arange(len(used))
        self.dense = np.ascontiguousarray(dense.T)
        claim("toxicity", lambda: None)  # freed with the task
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.rows: list[np.ndarray] = [np.zeros(len(landmarks), np.float32)]
        self.within = re.compile("|".join(sorted(map(re.escape, landmarks))) or r"(?!)")
        self.own = self.above(landmarks)

    def near(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words, as _letters() gives them, have enough features of any landmark to be looked at."""
        mass, hit = np.zeros(len(letters)), np.zeros(len(letters))
        for shape, w, codes in _codes(letters):
            mass += w * w * np.maximum(sizes - shape[-1], 0)
            hit += w * w * np.count_nonzero(self.place[codes] >= 0, axis=1)
        return hit >= NEAR * np.maximum(mass, 1e-9)

    def values(self, words: list[str]) -> np.ndarray:
        """(words, landmarks) kernel values, exact; a word without features has zeros."""
        if not words:
            return np.zeros((0, len(self.landmarks)), np.float32)
        at, code, weight = features(words)
        # a feature that repeats in a word adds up: sum by (word, feature)
        both = at * FEATURES + code.astype(np.int64)
        order = np.argsort(both, kind="stable")
        both, weight = both[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, first) if len(first) else weight
        at, code = both[first] // FEATURES, both[first] % FEATURES
        norm = np.sqrt(np.maximum(np.bincount(at, total.astype(np.float64) ** 2, len(words)), 1e-12)).astype(np.float32)
        place = self.place[code]
        hit = place >= 0
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        share = np.sqrt(np.bincount(at[hit], total[hit].astype(np.float64) ** 2, len(words))) / norm
        near = share >= FLOOR  # no kernel value exceeds this share
        keep = hit & near[at]
        if keep.any():
            a, p, t = at[keep], place[keep], total[keep]
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            out[a[starts]] = np.add.reduceat(self.dense[p] * t[:, None], starts, axis=0)
        return out / norm[:, None]

    def above(self, words: list[str]) -> np.ndarray:
        """Kernel values above the floor, scaled to 0..1, of folded words."""
        return np.maximum(self.values(words) - FLOOR, 0) / (1 - FLOOR)

    def contained(self, word: str) -> np.ndarray | None:
        """The largest scaled values of the landmarks that stand within a folded word; None if none does."""
        if not self.within.search(word):
            return None
        return self.own[[k for k, w in enumerate(self.landmarks) if w in word]].max(axis=0)

    def short_rows(self, words: set[str]) -> dict[str, np.ndarray]:
        """The largest scaled values of words of up to LONGEST characters: of their parts, and of the landmarks within them."""
        owners: dict[str, list[str]] = {}
        for w in words:
            for part in parts(w):
                owners.setdefault(part, []).append(w)
        best: dict[str, np.ndarray] = {}

        def take(part: str, row: np.ndarray) -> None:
            for w in owners[part]:
                best[w] = np.maximum(best[w], row) if w in best else row.copy()

        folded = sorted(owners, key=len)
        for i in range(0, len(folded), 2048):
            some = folded[i : i + 2048]
            near = [some[j] for j in np.flatnonzero(self.near(*_letters(some))).tolist()]
            if near:
                above = self.above(near)
                for j in np.flatnonzero(above.any(axis=1)).tolist():
                    take(near[j], above[j])
        for part in filter(self.within.search, folded):
            take(part, self.contained(part))
        return best

    def long_row(self, word: str) -> np.ndarray:
        """The largest scaled values of a long word: of its words between signs, and of the landmarks within it."""
        best = self.rows[0].copy()
        for part in parts(word):
            rows = [self.above([part])[0]] if len(part) <= LONGEST else []
            if (own := self.contained(part)) is not None:
                rows.append(own)
            for row in rows:
                best = np.maximum(best, row)
        return best

    def row(self, texts: list[str]) -> np.ndarray:
        """(texts, landmarks): largest kernel value above the floor, scaled to 0..1."""
        if len(self.known) > CACHE_WORDS:  # words not met since the last time go
            self.known, self.older = {}, self.known
            if len(self.rows) > CACHE_WORDS // 4:
                self.older = {}
                del self.rows[1:]
        sets, long = [words_of(t) for t in texts], {}
        for k, some in enumerate(sets):
            if many := [w for w in some if len(w) > LONGEST]:  # these aren't kept from text to text
                some.difference_update(many)
                long[k] = np.max([self.long_row(w) for w in many], axis=0)
        new = {w for s in sets for w in s if w not in self.known}
        met = [w for w in new if w in self.older]
        self.known.update((w, self.older[w]) for w in met)
        new.difference_update(met)
        self.known.update(dict.fromkeys(new, 0))
        for word, row in self.short_rows(new).items():
            self.known[word] = len(self.rows)
            self.rows.append(row)
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        for k, s in enumerate(sets):
            if near := {self.known[w] for w in s} - {0}:
                out[k] = np.max([self.rows[i] for i in near], axis=0)
            if k in long:
                out[k] = np.maximum(out[k], long[k])
        return out


class Model:
    """Landmarks, Nyström map, SVM weights and calibration."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.weights, self.bias, self.slope, self.shift = landmarks, weights, bias, slope, shift

    def scores(self, rows: np.ndarray) -> np.ndarray:
        margin = rows @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, y) of the labelled rows outside the held-out fold, the bounded sample of smallest hashes."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    marks = marks.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(train_rows)
    # at most train_rows pairs of a long and an int; of documents that share an id, the text of the smallest hash
    found = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y")


def pick_landmarks(rows: DataFrame, landmarks: int) -> list[str]:
    """Folded words that mark toxic rows, the strongest first, none too near another."""
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches):
        for b in slices(batches):
            seen: dict[str, list[int]] = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in {part for w in words_of(text) for part in parts(w)}:
                    if 3 <= len(w) <= LONGEST:
                        seen.setdefault(w, [0, 0])[0 if y else 1] += 1
            if seen:
                yield batch_of(schema, list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()])

    sizes = rows.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    if not sizes.n or not sizes.t or sizes.t == sizes.n:
        return []
    counts = rows.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    expected = F.lit(sizes.t / sizes.n) * (F.col("t") + F.col("c"))
    # log-likelihood gain of a word's share of toxic rows over the general share
    gain = F.col("t") * F.log(F.col("t") / expected)
    best = counts.where((F.col("t") >= 3) & (F.col("t") > 3 * expected) & (gain > MIN_GAIN)).orderBy(F.desc(gain), "word").limit(40 * landmarks).collect()
    words = [r.word for r in best]
    chosen: list[str] = []
    if not words:
        return chosen
    vectors: list[dict[int, float]] = [{} for _ in words]
    for i, code, weight in zip(*(x.tolist() for x in features(words)), strict=True):
        vectors[i][code] = vectors[i].get(code, 0.0) + weight
    picked: list[dict[int, float]] = []
    for word, vector in zip(words, vectors, strict=True):
        norm = sum(v * v for v in vector.values()) ** 0.5 or 1.0
        unit = {k: v / norm for k, v in vector.items()}
        if all(sum(v * other.get(k, 0.0) for k, v in unit.items()) < 0.65 for other in picked):
            picked.append(unit)
            chosen.append(word)
            if len(chosen) == landmarks:
                break
    return chosen


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM: squared hinge loss, both classes of equal weight, by Nesterov's descent from zero."""
    s = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ahead, t = w.copy(), 1.0
    step = 1 / (2 * np.linalg.norm((x1 * share[:, None]).T @ x1, 2) + penalty)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - s * (x1 @ ahead))
        grad = -2 * x1.T @ (share * s * slack) + penalty * np.append(ahead[:-1], 0)
        new = ahead - step * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        v = p * (1 - p) + 1e-6
        g = np.array([((p - y) * margin).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def kernel_rows(docs: DataFrame, landmarks: list[str], keep: str) -> DataFrame:
    """(keep, rows: the landmark features) of a table (keep, text)."""
    schema = pa.schema([(keep, pa.int64()), ("rows", pa.list_(pa.float32()))])

    def run(batches):
        kernel = Kernel(landmarks)
        for b in slices(batches):
            yield batch_of(schema, b.column(0).to_pylist(), list(kernel.row(b.column(1).to_pylist())))

    return docs.mapInArrow(run, f"{keep} long, rows array<float>")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit the model; labels are looked up for rows whose crc32(doc_id as text) mod 5 is not 0 only."""
    rows = stored(training_rows(docs, labels, train_rows, id_col, text_col, label_col), "toxicity-train")
    marks = pick_landmarks(rows, landmarks)
    if not marks:
        share = rows.agg(F.avg("y")).first()[0]
        share = min(max(share if share is not None else 0.0, 0.01), 0.99)
        return Model([], np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    # train_rows vectors of at most `landmarks` numbers
    got = kernel_rows(rows.select(F.col("y").cast("long").alias("y"), "text"), marks, "y").toPandas()
    x, y = np.stack(got.rows.to_numpy()).astype(float), got.y.to_numpy().astype(float)
    gram = Kernel(marks).values(marks).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T  # K_LL^(-1/2)
    w, b = fit_svm(x @ root, y)
    w = root @ w
    slope, shift = calibrate(x @ w + b, y)
    return Model(marks, w, b, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, tkey (XXH64 of the text), score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        kernel = Kernel(model.landmarks) if model.landmarks else None
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            rows = kernel.row(texts) if kernel else np.zeros((len(texts), 0))
            found = np.round(model.scores(rows.astype(float)), 9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], schema=schema)

    base = id_and_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    return base.mapInArrow(run, "doc_id long, tkey long, score double, predicted int")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold.  No shuffle."""
    place = docs.columns.index(text_col)

    def run(batches):
        kernel = Kernel(model.landmarks) if model.landmarks else None
        for b in slices(batches):
            texts = [t or "" for t in b.column(place).to_pylist()]
            rows = kernel.row(texts) if kernel else np.zeros((len(texts), 0))
            kept = b.filter(pa.array(np.round(model.scores(rows.astype(float)), 9) < threshold))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
