"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talkloom.llm.common import body, free, scratch

#: The field is fitted on so many labelled documents at most (those of smallest hash), whole ones, of so many lines together.
SAMPLE_DOCS, SAMPLE_LINES = 3000, 120_000
STEPS, RATE, RIDGE = 250, 0.1, 1e-4
#: Texts of about so many bytes are scored together; their arrays take some 200 bytes for each.
GROUP_BYTES = 256 << 10

LETTER, UPPER, DIGIT, SPACE, STOP, MARK, BANG, BAR, OTHER = range(9)
KIND = np.full(256, OTHER, np.uint8)
for _k, _chars in ((LETTER, [*range(97, 123), *range(128, 256)]), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (SPACE, b" \t\r"), (STOP, b".,;:?'\"-()"), (MARK, b"$%&#*@~^+=_<>\\/{}[]`"), (BANG, b"!"), (BAR, b"|")):
    KIND[list(_chars)] = _k
OWN = 17
#: A line's own features and those of the lines before and after it.
FEATURES = 3 * OWN + 3


def spans_code(joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans cover the array."""
    place = (np.arange(len(joined)) - np.repeat(starts, sizes)).astype(np.uint64)
    code = (joined.astype(np.uint64) + np.uint64(1)) * ((place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return np.add.reduceat(code, starts)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weight, lines per text) of all lines of some texts; a text has one line at least."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts)), per_text)
    size = (ends - starts).astype(float)
    kind = KIND[joined]
    share = np.empty((len(ends), 9))
    for k in range(9):
        counts = np.concatenate([[0], np.cumsum(kind == k)])
        share[:, k] = counts[ends] - counts[starts]
    words = share[:, SPACE] + (size > 0)
    length = np.maximum(size, 1)[:, None]
    # hashes tell lines repeated within a text, and words repeated at once
    code = spans_code(joined, starts, ends - starts + 1) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    cuts = np.flatnonzero((joined == 10) | (joined == 32))
    begins = np.concatenate([[0], cuts[:-1] + 1])
    blank = np.where(joined == 10, np.uint8(32), joined)
    word = spans_code(blank, begins, cuts - begins + 1)
    again = np.zeros(len(joined) + 1, np.int64)
    again[begins[1:] + 1] = (word[1:] == word[:-1]) & (cuts[1:] > begins[1:])
    again = np.cumsum(again)
    again = (again[ends] - again[starts]) / np.maximum(words, 1)
    _, back, times = np.unique(code, return_inverse=True, return_counts=True)
    own = np.column_stack([
        share[:, [LETTER, UPPER, DIGIT, STOP, MARK, BANG, BAR, OTHER]] / length, np.minimum(share[:, [MARK, BANG, BAR]] / np.maximum(words, 1)[:, None], 3),
        np.log1p(size) / 6, np.minimum(size / np.maximum(words, 1) / 8, 3), np.minimum(times[back] - 1, 4) / 2, size == 0, share[:, STOP] / np.maximum(words, 1), again,
    ])
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    last = np.concatenate([doc[1:] != doc[:-1], [True]])
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last, np.ones(len(own))]), size + 1, per_text


@dataclass
class Field:
    """Weights of the good state's advantage, transition scores [from, to], and the document's scale."""

    weights: np.ndarray
    moves: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    slope: float = 8.0
    offset: float = -4.0

    def marginals(self, features: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each line is good, and expected transitions, by forward-backward over all texts at once."""
        score = ((features - self.centre) / self.spread) @ self.weights
        node = np.column_stack([np.zeros_like(score), score])
        order = np.argsort(-lengths, kind="stable")
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        steps = lengths[order]
        alive = [int(np.searchsorted(-steps, -t, side="left")) for t in range(steps[0])] if len(steps) else []
        ahead, behind = np.empty_like(node), np.zeros_like(node)
        for t, n in enumerate(alive):
            at = start[:n] + t
            ahead[at] = node[at] if t == 0 else node[at] + np.logaddexp(*(ahead[at - 1][:, [s]] + self.moves[s] for s in (0, 1)))
        for t in range(len(alive) - 2, -1, -1):
            at = start[: alive[t + 1]] + t
            behind[at] = np.logaddexp(*(self.moves[:, s] + (node[at + 1, s] + behind[at + 1, s])[:, None] for s in (0, 1)))
        both = ahead + behind
        total = np.logaddexp(both[:, 0], both[:, 1])
        pairs = np.zeros((2, 2))
        inner = np.ones(len(node), bool)
        inner[start] = False
        at = np.flatnonzero(inner)
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] = np.exp(ahead[at - 1, a] + self.moves[a, b] + node[at, b] + behind[at, b] - total[at]).sum()
        return np.exp(both[:, 1] - total), pairs

    def documents(self, features: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        good, _ = self.marginals(features, lengths)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)

    def scores(self, *lines) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.documents(*lines) + self.offset)))


def sigmoid_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset of one variable by Newton steps with a small ridge."""
    w, design = np.array([4.0, -2.0]), np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(w[0]), float(w[1])


def fit(features: np.ndarray, weight: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> Field:
    """Conditional likelihood by gradient ascent; every line of a text carries the text's label."""
    spread = features.std(axis=0)
    field = Field(np.zeros(features.shape[1]), np.zeros((2, 2)), np.where(spread > 0, features.mean(axis=0), 0), np.where(spread > 0, spread, 1))
    scaled = (features - field.centre) / field.spread
    truth = np.repeat(labels, lengths).astype(float)
    pulls = 1 / np.repeat(lengths, lengths)  # every text counts alike
    inner = lengths - 1
    seen = np.array([[inner[labels == 0].sum(), 0], [0, inner[labels == 1].sum()]], float)
    n = len(lengths)
    m = v = 0.0
    for step in range(1, STEPS + 1):
        good, pairs = field.marginals(features, lengths)
        g = np.concatenate([scaled.T @ ((truth - good) * pulls) / n - RIDGE * field.weights, ((seen - pairs) / max(1, inner.sum()) - 1e-2 * field.moves).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field.weights += move[:-4]
        field.moves += move[-4:].reshape(2, 2)
    field.slope, field.offset = sigmoid_fit(field.documents(features, weight, lengths), labels.astype(float))
    return field


def remainder(id_col: str = "doc_id"):
    """crc32 of the identifier as text, modulo 3; 0 for a null identifier."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)), F.lit(0))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """The field fitted on a bounded sample of the labelled rows outside the held-out third; None without labels.

    Documents come in order of their hash; one that has more lines than are left of SAMPLE_LINES is passed over.
    """
    known = labels.select(F.col("doc_id").alias("i"), "quality").where("i is not null and quality is not null").where(remainder("i") != 1)
    chosen = known.groupBy("i").agg(F.max("quality").alias("q")).orderBy(F.xxhash64("i"), "i").limit(SAMPLE_DOCS)
    rows = docs.select(F.col(id_col).alias("i"), body(text_col).alias("text")).join(F.broadcast(chosen), "i")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2):
                raw = text.as_py().encode()
                n = raw.count(b"\n") + 1
                x, w, _ = line_features([raw]) if n <= SAMPLE_LINES else (np.empty(0), np.empty(0), None)
                out.append((x.astype("<f4").tobytes(), w.astype("<f4").tobytes(), n))
            made = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["h", "q", "x", "w", "n"])

    with scratch() as put:
        drawn = rows.select(F.xxhash64("i", "text").alias("h"), F.col("q").cast("long").alias("q"), "text")
        drawn = put(drawn.mapInArrow(measure, "h long, q long, x binary, w binary, n long"), "quality-sample").dropDuplicates(["h"])
        left, taken = SAMPLE_LINES, []
        for r in drawn.select("h", "n").orderBy("h").limit(SAMPLE_DOCS).collect():
            if r["n"] <= left:
                left -= r["n"]
                taken.append(r["h"])
        got = sorted(drawn.where(F.col("h").isin(taken)).select("q", "x", "w", "n").collect(), key=lambda r: (r["q"], bytes(r["x"]))) if taken else []
    if not got:
        return None
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), "<f4").reshape(-1, FEATURES).astype(float)
    w = np.frombuffer(b"".join(bytes(r["w"]) for r in got), "<f4").astype(float)
    return fit(x, w, np.array([r["n"] for r in got]), np.array([r["q"] for r in got]))


def scored(docs: DataFrame, field: Field | None, *, text_col: str = "text") -> DataFrame:
    """The input's columns and as the last one a score from 0 to 1, __score (with more underscores where that is taken)."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    (name,) = free(docs, "__score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            group, size, done = [], 0, 0
            for k, text in enumerate(batch.column(at)):
                group.append((text.as_py() or "").encode())
                size += len(group[-1])
                if size > GROUP_BYTES or k + 1 == batch.num_rows:  # small batches go back, whatever came
                    scores = field.scores(*line_features(group)) if field else np.full(len(group), 0.5)
                    part = batch.slice(done, len(group))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])
                    group, size, done = [], 0, k + 1

    return docs.mapInArrow(score, docs.withColumn(name, F.lit(0.0)).schema)


def quality_report(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Each line has two states; its features are its own shares of characters, its repeats within the text
    and the same of the lines before and after.  Only texts enter a score.  Null and empty texts are one
    empty line and have a score like others.  Rows are scored alone, so repeats, ties and null identifiers
    (never held out) do no harm.  A text is scored whole by one task.  Without a label outside the
    held-out third every score is 0.5.  Empty tables stay empty; other columns are not looked at.
    """
    field = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = scored(docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col) == 1).alias("held_out"), body(text_col).alias("text")), field)
    return rows.select("doc_id", "held_out", F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents scored 0.5 or more, with the columns of the input, whatever their names."""
    rows = scored(docs, train(docs, labels, **options), text_col=options.get("text_col", "text"))
    return rows.where(F.col(rows.columns[-1]) >= 0.5).select(*docs.columns)
