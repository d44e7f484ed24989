"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a window of bytes from either side; at every byte both states give a softmax over the languages. The
network is trained in numpy by backpropagation through time on the driver, from a bounded sample of labelled documents: of
every language the ``DOCS_PER_LANG`` documents whose hashes are smallest, ``WINDOWS`` passages of each, at offsets drawn from a hash.
The states grow with the number of languages (``hidden_size``), the training steps with its root. Every language is learned;
more than ``MAX_LANGS`` raise an error, as the column can hardly be one of languages then.
Prediction runs over whole texts: a text is cut into windows, all windows of a block advance together, every byte is
labelled, and the document's probabilities are the means over the bytes of letters.

Defined cases: a null text, or one without a letter, gets ``und`` and score 0; so does every document when nothing is
labelled; a language whose labelled texts are all null or empty can't be learned. Only ``text`` enters a prediction. Rows without doc_id are neither held out nor learnt from. Repeated rows
get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of each direction up to eight languages.
HIDDEN = 8
#: Bytes of a window; recurrence starts anew in each.
WINDOW = 64
#: Windows that advance together.
LANES = 2048
#: Bounds of the training sample.
DOCS_PER_LANG = 500
WINDOWS = 4
PASSAGE = 120
MAX_LANGS = 4096
#: Up to four languages.
STEPS = 300
BATCH = 128
UNKNOWN = "und"
_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class Model:
    """Per direction: input table (3H, 256) with biases, recurrent weights (3H, H), output weights (L, H); then the output bias. Gates in order update, reset, candidate."""

    langs: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.recurrent[0].shape[1]

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, *self.out, self.bias]


def hidden_size(langs: int) -> int:
    """HIDDEN states up to eight languages, four more for each doubling."""
    return HIDDEN + 4 * max(0, (langs - 1).bit_length() - 3)


def new_model(langs: list[str], seed: int = 7) -> Model:
    rng, h = np.random.default_rng(seed), hidden_size(len(langs))
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Model(langs, [draw(3 * h, 256, scale=0.3) for _ in "fb"], [draw(3 * h, h, scale=0.3) for _ in "fb"], [draw(len(langs), h, scale=0.3) for _ in "fb"], np.zeros((len(langs), 1), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(0))
    return e / e.sum(0)


def loss_and_gradients(model: Model, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the unmasked bytes and its gradients, by backpropagation through time. x: (steps, lanes)."""
    steps, lanes = x.shape
    h_ = model.hidden
    tapes, states = [], []
    for d, times in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
        h = np.zeros((h_, lanes), np.float32)
        tape, state = {}, np.empty((steps, h_, lanes), np.float32)
        for t in times:
            a = model.tables[d][:, x[t]]
            u = model.recurrent[d] @ h
            z, r = _sigmoid(a[:h_] + u[:h_]), _sigmoid(a[h_ : 2 * h_] + u[h_ : 2 * h_])
            n = np.tanh(a[2 * h_ :] + r * u[2 * h_ :])
            tape[t] = (h, z, r, n, u[2 * h_ :])
            h = (n + z * (h - n)) * mask[t]
            state[t] = h
        tapes.append(tape)
        states.append(state)
    total = max(1.0, float(mask.sum()))
    grads = [np.zeros_like(p) for p in model.parameters()]
    g_tables, g_rec, g_out, g_bias = grads[:2], grads[2:4], grads[4:6], grads[6]
    delta = np.empty((steps, len(model.langs), lanes), np.float32)
    loss = 0.0
    lane = np.arange(lanes)
    for t in range(steps):
        p = _softmax(model.out[0] @ states[0][t] + model.out[1] @ states[1][t] + model.bias)
        loss -= float((np.log(p[labels, lane] + 1e-9) * mask[t]).sum()) / total
        p[labels, lane] -= 1
        delta[t] = p * (mask[t] / total)
    g_bias += delta.sum((0, 2))[:, None]
    for d, times in ((0, range(steps - 1, -1, -1)), (1, range(steps))):
        back = np.zeros((h_, lanes), np.float32)
        gates = np.empty((steps, 3 * h_, lanes), np.float32)
        for t in times:
            h, z, r, n, u = tapes[d][t]
            g_out[d] += delta[t] @ states[d][t].T
            dh = (model.out[d].T @ delta[t] + back) * mask[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            rec = np.concatenate([dz, dr, dn * r])
            gates[t] = np.concatenate([dz, dr, dn])
            g_rec[d] += rec @ h.T
            back = dh * z + model.recurrent[d].T @ rec
        flat = gates.transpose(1, 0, 2).reshape(3 * h_, -1)
        for k in range(3 * h_):
            g_tables[d][k] += np.bincount(x.ravel(), weights=flat[k], minlength=256).astype(np.float32)
    return loss, grads


def train(passages: list[tuple[bytes, str]], steps: int | None = None, seed: int = 11) -> Model | None:
    """Adam over windows cut at random from the passages; every language is drawn equally often."""
    langs = sorted({lang for _, lang in passages})
    if not langs:
        return None
    steps = steps or round(STEPS * max(1.0, len(langs) / 4) ** 0.5)
    model = new_model(langs)
    if len(langs) == 1:
        return model
    of = [[p for p, lang in passages if lang == k] for k in langs]
    rng = np.random.default_rng(seed)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in model.parameters()]
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(langs), BATCH)
        x, mask = np.zeros((WINDOW, BATCH), np.uint8), np.zeros((WINDOW, BATCH), np.float32)
        for i, k in enumerate(labels):
            p = of[k][rng.integers(len(of[k]))]
            at = rng.integers(0, max(1, len(p) - WINDOW + 1))
            p = p[at : at + rng.integers(8, WINDOW + 1)]
            x[: len(p), i] = np.frombuffer(p, np.uint8)
            mask[: len(p), i] = 1
        _, grads = loss_and_gradients(model, x, mask, labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for p, g, m in zip(model.parameters(), grads, moments):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return model


def _advance(table: np.ndarray, recurrent: np.ndarray, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One step for all lanes; the update and reset rows of table and recurrent are halved beforehand."""
    k = len(h)
    a = table.take(x, 1)
    u = recurrent @ h
    gates = np.tanh(a[: 2 * k] + u[: 2 * k])
    gates += 1
    gates *= 0.5
    n = gates[k:]
    n *= u[2 * k :]
    n += a[2 * k :]
    np.tanh(n, out=n)
    h = h - n
    h *= gates[:k]
    h += n
    return h


def window_sums(model: Model, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(langs, lanes): sums of the position probabilities over the bytes of letters. x, mask: (steps, lanes)."""
    half = np.r_[np.full(2 * model.hidden, 0.5), np.ones(model.hidden)].astype(np.float32)[:, None]
    tables, recurrent = [t * half for t in model.tables], [r * half for r in model.recurrent]
    steps, lanes = x.shape
    x = x.astype(np.intp)
    votes = _LETTER[x] * mask
    forward = np.empty((steps, len(model.langs), lanes), np.float32)
    h = np.zeros((model.hidden, lanes), np.float32)
    for t in range(steps):
        h = _advance(tables[0], recurrent[0], x[t], h)
        np.matmul(model.out[0], h, out=forward[t])
    sums = np.zeros((len(model.langs), lanes), np.float32)
    h = np.zeros((model.hidden, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        h = _advance(tables[1], recurrent[1], x[t], h)
        h *= mask[t]
        p = forward[t]
        p += model.out[1] @ h
        p += model.bias
        p -= p.max(0)
        np.exp(p, out=p)
        p *= votes[t] / p.sum(0)
        sums += p
    return sums


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and probability of whole texts."""
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return langs, scores
    sums = np.zeros((len(texts), len(model.langs)))
    encoded = [t.encode("utf-8", "surrogatepass") if t and any(map(str.isalpha, t)) else b"" for t in texts]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    counts = -(-sizes // WINDOW)
    raw = np.frombuffer(b"".join(encoded) + bytes(WINDOW), np.uint8)
    doc = np.repeat(np.arange(len(texts)), counts)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    left = np.minimum(WINDOW, sizes[doc] - at)
    at += (np.cumsum(sizes) - sizes)[doc]
    span = np.arange(WINDOW)[:, None]
    for k in range(0, len(doc), LANES):
        one = slice(k, k + LANES)
        found = window_sums(model, raw[at[one] + span], (span < left[one]).astype(np.float32))
        for j in range(len(model.langs)):
            sums[:, j] += np.bincount(doc[one], weights=found[j], minlength=len(texts))
    totals = sums.sum(1)
    some = totals > 0
    best = sums.argmax(1)
    scores[some] = np.minimum(1.0, sums[some, best[some]] / totals[some])
    for i in np.flatnonzero(some).tolist():
        langs[i] = model.langs[best[i]]
    # letters outside the bytes of letters don't exist: every alphabetic character has one
    return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def cutoff(count: int, wanted: int) -> int:
    """Below which of 2**62 hashes about four times the wanted of ``count`` rows lie; all, of few."""
    return (1 << 62) if count <= 8 * wanted else (4 * wanted << 62) // count


def sample(docs: DataFrame, wanted: int = DOCS_PER_LANG) -> list[tuple[bytes, str]]:
    """Passages of a bounded number of labelled documents that are not held out, of each language.

    A cut on the hash of doc_id leaves a few times as many rows as are wanted, of however many; of those the ones with the smallest hashes are taken.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = labelled.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    counts = labelled.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return []
    few = docs.sparkSession.createDataFrame([(r["lang"], cutoff(r["count"], wanted)) for r in counts], "lang string, below long")
    hashed = labelled.withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    room = F.greatest(F.lit(1), F.length("text") - PASSAGE + 1)
    passages = [F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1).cast("int"), F.lit(PASSAGE)) for k in range(WINDOWS)]
    drawn = hashed.join(F.broadcast(few), "lang").where("h < below").withColumn("p", F.array(*passages)).withColumn("n", F.row_number().over(first)).where(F.col("n") <= wanted)
    rows = drawn.select("lang", "h", "doc_id", "p").collect()
    ordered = sorted(rows, key=lambda r: (r["h"], r["doc_id"], r["lang"], r["p"]))
    return [(q, r["lang"]) for r in ordered for p in dict.fromkeys(r["p"]) if (q := p.encode("utf-8", "surrogatepass"))]


def fit(docs: DataFrame) -> Model | None:
    return train(sample(docs))


def classifier(model: Model | None):
    """A Pandas UDF: text to (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = [], []
            for a, b in _blocks(texts):
                x, y = predict(model, texts.iloc[a:b].tolist())
                langs += x
                scores.append(y)
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": np.concatenate(scores or [np.zeros(0)])})

    return run.asNondeterministic()  # evaluated once, never pushed below or repeated


def _blocks(texts: pd.Series, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    run = classifier(model or fit(docs))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), run(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents whose language is known with a probability of ``least`` or more, with all columns. A column named __lang is an error."""
    if "__lang" in docs.columns:
        raise ValueError("the column __lang is the operator's own")
    run = classifier(fit(docs))
    return docs.withColumn("__lang", run(F.col("text").cast("string"))).where((F.col("__lang.lang_pred") != UNKNOWN) & (F.col("__lang.score") >= least)).drop("__lang")
