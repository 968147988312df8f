"""Scores of texts under a log-bilinear language model trained by noise-contrastive estimation.

The score of a token is r_w . (c1 + c2 + c3) + b_w, with one table of context vectors for each place: the two tokens before
it, and the last of the `MARKS` most frequent words before those, which reaches further back. Outputs are the `vocab` most
frequent words, a class for all other words with the same hash of first and last two bytes, and the end of the text. Softmax
over outputs normalises it; within a class, words share its probability by smoothed counts. So each token has a
normalised probability, in batched matrix products.

Passes over the texts: (1) counts of all words, combined per task before the shuffle; (2) noise-contrastive training,
in which every task goes over all its training tokens from one common start (fitted on a bounded sample), and the
tables are averaged by tokens; (3) scores, where words out of the bounded head table are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm import kernel
from gridlark.llm.common import scratch, text_blocks

BLOCK = 1 << 21
#: Classes of words out of the vocabulary.
CLASSES = 128
#: Most frequent words that serve as the third context.
MARKS = 64
#: Words of the count table that every task gets; all others are joined.
HEAD = 1 << 18
#: Key of the end token.
END = -(2**63) + 7
#: Distinct words a task holds before it sends their counts on.
HELD_WORDS = 1 << 20
_TAIL_MIX = 0.1


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of the words of a block, and the number of words of each row."""
    starts, ends, counts = kernel.word_spans(data, offsets)
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    before_last = lower[np.maximum(ends - 2, starts)].astype(np.int64)
    kinds = (lower[starts].astype(np.int64) + 7 * lower[ends - 1].astype(np.int64) + 53 * before_last) % CLASSES
    return kernel.word_hashes(data, starts, ends).view(np.int64), kinds, counts


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    docs = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, kinds, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(words)
        words = words[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        return words[first], kinds[order][first], np.add.reduceat(n[order], first)

    def out(words: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(kinds.astype(np.int32)), pa.array(n)], names=["word", "kind", "n"])

    for rows, data, offsets in text_blocks(batches, "text", BLOCK):
        train = ~rows.column("held_out").to_numpy(zero_copy_only=False)
        docs += int(train.sum())
        words, kinds, counts = _tokens(data, offsets)
        use = np.repeat(train, counts)
        words, kinds = words[use], kinds[use]
        if len(words):
            held.append((words, kinds, np.ones(len(words), dtype=np.int64)))
            held[-1:] = [merged()] if len(held) == 1 else [held[-1]]
        if sum(len(x[0]) for x in held) > HELD_WORDS:
            held[:] = [merged()]
            if len(held[0][0]) > HELD_WORDS // 2:
                yield out(*held.pop())
    if held:
        yield out(*merged())
    if docs:
        yield out(np.array([END]), np.array([-1]), np.array([docs]))


@dataclass
class Model:
    """What a task needs to score: vocabulary (sorted hashes), tables, class totals, head counts."""

    vocab: np.ndarray
    contexts: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    noise: np.ndarray
    class_base: np.ndarray
    head: np.ndarray
    head_log: np.ndarray
    mark: np.ndarray
    end_log: float

    @property
    def size(self) -> int:
        return len(self.bias)

    def sequence(self, words: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output numbers of all tokens with their ends, and of the three contexts of each token."""
        at = np.searchsorted(self.vocab, words)
        at[at == len(self.vocab)] = 0
        known = self.vocab[at] == words if len(self.vocab) else np.zeros(len(words), dtype=bool)
        number = np.where(known, at, len(self.vocab) + kinds)
        begins = np.cumsum(counts + 3) - counts - 3
        full = np.full(int((counts + 3).sum()), self.size, dtype=np.int64)
        place = np.arange(len(words)) + np.repeat(begins + 2 - (np.cumsum(counts) - counts), counts)
        full[place] = number
        full[begins + 2 + counts] = self.size - 1
        is_token = np.ones(len(full), dtype=bool)
        is_token[begins] = is_token[begins + 1] = False
        at = np.flatnonzero(is_token)
        # the last mark before the two tokens, within the row
        spot = np.maximum.accumulate(np.where(self.mark[full], np.arange(len(full)), -1)) if len(full) else full
        spot = np.where(at >= 3, spot[at - 3], -1) if len(full) else spot
        far = np.where(spot >= np.repeat(begins, counts + 1), full[spot], self.size)
        return full[at], np.stack([full[at - 1], full[at - 2], far])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return self.contexts[0, context[0]] + self.contexts[1, context[1]] + self.contexts[2, context[2]]


def _tables(model: Model) -> list[np.ndarray]:
    return [*model.contexts, model.outputs, model.bias[:, None]]


def _steps(model: Model, words: np.ndarray, context: np.ndarray, squares: list[np.ndarray], rng: np.random.Generator, rate: float, batch: int = 8192, n_noise: int = 48) -> None:
    """Noise-contrastive steps over all given tokens, with noise words shared by a batch and adaptive rates."""
    cdf = np.cumsum(model.noise)
    log_noise = np.log(model.noise * n_noise + 1e-12).astype(np.float32)
    for k in range(0, len(words), batch):
        w, c = words[k : k + batch], context[:, k : k + batch]
        v = np.searchsorted(cdf, rng.random(n_noise) * cdf[-1]).clip(0, model.size - 1)
        h = model.hidden(c)
        r, rv = model.outputs[w], model.outputs[v]
        good = np.einsum("ij,ij->i", h, r) + model.bias[w] - log_noise[w]
        bad = h @ rv.T + (model.bias[v] - log_noise[v])
        g_good = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        g_bad = -1 / (1 + np.exp(np.clip(-bad, -30, 30)))
        dh = g_good[:, None] * r + g_bad @ rv
        tables = _tables(model)
        grads = [np.zeros_like(x) for x in tables]
        for g, key, values in (*((grads[j], c[j], dh) for j in range(3)), (grads[3], w, np.concatenate([g_good[:, None] * h, g_good[:, None]], axis=1))):
            order = np.argsort(key.astype(np.uint16), kind="stable")
            ranked = key[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            sums = np.add.reduceat(values[order], first, axis=0)
            if g is grads[3]:
                grads[4][ranked[first]] += sums[:, -1:]
                sums = sums[:, :-1]
            g[ranked[first]] += sums
        np.add.at(grads[3], v, g_bad.T @ h)
        np.add.at(grads[4], v, g_bad.sum(axis=0)[:, None])
        for x, g, s in zip(tables, grads, squares, strict=True):
            g /= np.float32(np.sqrt(len(w)))
            s += g * g
            x += np.float32(rate) * g / np.sqrt(s + np.float32(1e-2))


def _fresh_squares(model: Model) -> list[np.ndarray]:
    return [np.full_like(x, 1.0) for x in _tables(model)]


def _copy(model: Model) -> Model:
    return Model(**{k: v.copy() if k in ("contexts", "outputs", "bias") else v for k, v in model.__dict__.items()})


def _trainer(shared, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _copy(shared.value)
        squares, rng, seen = _fresh_squares(model), np.random.Generator(np.random.PCG64(5)), 0
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            keep = ~rows.column("held_out").to_numpy(zero_copy_only=False)
            words, kinds, counts = _tokens(data, offsets)
            use = np.repeat(keep, counts)
            tokens, context = model.sequence(words[use], kinds[use], counts[keep])
            _steps(model, tokens, context, squares, rng, rate)
            seen += len(tokens)
        if seen:
            flat = np.concatenate([x.ravel() for x in (model.contexts, model.outputs, model.bias)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), seen, dtype=np.int64))], names=["k", "x", "n"])

    return train


def log_probabilities(model: Model, contexts: np.ndarray, words: np.ndarray, which: np.ndarray, at_once: int = 512) -> np.ndarray:
    """Natural log probabilities of outputs `words`, each after the column `which` of the contexts, in batched matrix
    products over all outputs; a batch stays within the processor's cache."""
    out, order = np.empty(len(words)), np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(0, contexts.shape[1] + at_once, at_once))
    outputs = np.ascontiguousarray(model.outputs.T)
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        s = model.hidden(contexts[:, k * at_once : (k + 1) * at_once]) @ outputs
        s += model.bias
        here = order[a:b]
        row = which[here] - k * at_once
        chosen = s[row, words[here]]
        # exponentials of scores up to 60 neither overflow nor lose their sum; otherwise rows are shifted by their largest
        top = s.max(axis=1)
        if len(top) and -60 < top.min() and top.max() < 60:
            top = np.zeros_like(top)
        else:
            s -= top[:, None]
        np.exp(s, out=s)
        out[here] = chosen - (top + np.log(s.sum(axis=1)))[row]
    return out


def _scorer(shared, n_sum: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        wide = model.size + 1
        for rows, data, offsets in text_blocks(batches, "text", BLOCK):
            words, kinds, counts = _tokens(data, offsets)
            w, context = model.sequence(words, kinds, counts)
            # tokens with the same contexts share their sums
            _, first, same = np.unique((context[0] * wide + context[1]) * wide + context[2], return_index=True, return_inverse=True)
            token = log_probabilities(model, context[:, first], w, same)
            token /= np.log(10)
            lengths = counts + 1
            first = np.cumsum(lengths) - lengths
            is_end = np.zeros(len(w), dtype=bool)
            is_end[first + counts] = True
            keys = np.full(len(w), END)
            keys[~is_end] = words
            spot = np.searchsorted(model.head, keys).clip(0, max(len(model.head) - 1, 0))
            known = model.head[spot] == keys if len(model.head) else np.zeros(len(keys), dtype=bool)
            known |= is_end  # the end's count is known apart from the head table
            count_log = np.where(known, model.head_log[spot] if len(model.head) else 0.0, 0.0)
            count_log[is_end] = model.end_log
            rare = (w >= len(model.vocab)) & ~is_end
            token += np.where(rare, model.class_base[np.where(rare, w - len(model.vocab), 0)] + count_log, 0.0)
            base = np.add.reduceat(count_log, first) - lengths * n_sum
            tail = ~known
            n_tail = np.add.reduceat(tail.astype(np.int64), first)
            in_train = known & (count_log > -0.99)
            ends = np.concatenate([[0], np.cumsum(n_tail)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("held_out"), pa.array(lengths), pa.array(np.add.reduceat(in_train.astype(np.int64), first)), pa.array(base), pa.array(np.add.reduceat(token, first)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[tail]))],
                names=["id", "held_out", "n_tokens", "n_known", "base", "score", "tail"],
            )

    return score


def _head(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with at least so many occurrences that at most `limit` words are; sorted by key."""
    level = F.floor(F.log2(F.col("n")) * 64)
    levels = sorted(((r["level"], r["c"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    total, least = 0, None
    for at, c in levels:
        if total + c > limit:
            break
        total, least = total + c, at
    if least is None:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    found = counts.where(level >= F.lit(least)).select("word", "kind", "n").toArrow()
    word, kind, n = (found.column(c).to_numpy() for c in ("word", "kind", "n"))
    order = np.argsort(word)
    return word[order], kind[order].astype(np.int64), n[order]


def log_bilinear_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", vocab: int = 511, dims: int = 24, start_tokens: int = 400_000, rate: float = 0.1) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows where the Column held_out is false. Tokens are words (A-Z lower-cased) and one end a text; null
    and empty texts are an end only. base_score is the smoothed unigram log10 probability, score the model's.
    `start_tokens` bounds the sample that fits the common start: whole training texts with the least hashes of id and
    text, as many as have so many tokens; counts and training cover all rows. Repeated rows and null ids are scored like any others; an empty
    table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"))
    spark = docs.sparkSession
    counts = scratch(docs.mapInArrow(_counter, "word long, kind int, n long").groupBy("word").agg(F.max("kind").alias("kind"), F.sum("n").alias("n")))
    totals = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_all, v_all = sum(n for n, _ in totals.values()), sum(v for _, v in totals.values())
    head, head_kind, head_n = _head(counts, HEAD)
    words = np.flatnonzero(head != END)
    top = words[np.lexsort((head[words], -head_n[words]))[:vocab]]
    top = top[np.argsort(head[top])]
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (n, v) in totals.items():
        if k >= 0:
            class_n[k], class_v[k] = n, v
    np.subtract.at(class_n, head_kind[top], head_n[top])
    np.subtract.at(class_v, head_kind[top], 1)
    noise = np.concatenate([head_n[top], class_n, [totals.get(-1, (0, 0))[0]]]).astype(np.float64) + 0.1
    noise /= noise.sum()
    rng = np.random.Generator(np.random.PCG64(3))
    size = len(noise)
    model = Model(
        vocab=head[top],
        contexts=rng.normal(0, 0.1, (3, size + 1, dims)).astype(np.float32),
        outputs=rng.normal(0, 0.1, (size, dims)).astype(np.float32),
        bias=np.log(noise).astype(np.float32),
        noise=noise,
        class_base=-np.log10(class_n + _TAIL_MIX * (class_v + 1)),
        head=head,
        head_log=np.log10(head_n + 0.1),
        mark=np.isin(np.arange(size + 1), np.lexsort((head[top], -head_n[top]))[:MARKS]),
        end_log=float(np.log10(totals.get(-1, (0, 0))[0] + 0.1)),
    )
    for rows, data, offsets in text_blocks(_sample(docs, start_tokens), "text", BLOCK):
        found, kinds, per = _tokens(data, offsets)
        tokens, context = model.sequence(found, kinds, per)
        squares = _fresh_squares(model)
        for _ in range(5):
            _steps(model, tokens, context, squares, rng, rate, batch=2048)
    start = spark.sparkContext.broadcast(model)
    parts = docs.mapInArrow(_trainer(start, rate), "k int, x double, n long").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x"))
    found = parts.toArrow().to_pandas().sort_values("k")["x"].to_numpy()
    if len(found):
        a, b = model.contexts.size, model.outputs.size
        model = Model(**model.__dict__ | {"contexts": found[:a].reshape(model.contexts.shape).astype(np.float32), "outputs": found[a : a + b].reshape(model.outputs.shape).astype(np.float32), "bias": found[a + b :].astype(np.float32)})
    final = spark.sparkContext.broadcast(model)
    n_sum = float(np.log10(n_all + 0.1 * (v_all + 1)))
    scored = docs.mapInArrow(_scorer(final, n_sum), f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>")
    scored = scratch(scored.withColumn("row", F.monotonically_increasing_id()))
    tail = scored.select("row", F.explode("tail").alias("word")).join(counts.select("word", "n"), "word", "left")
    more = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.count("n").alias("more_known"))
    out = scored.drop("tail").join(more, "row", "left")
    add = F.coalesce("more", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("score") + add).alias("score"))


def _sample(docs: DataFrame, tokens: int) -> Iterator[pa.RecordBatch]:
    """A bounded sample of training rows for the common start: whole texts, those with the least hashes.

    Texts of over a tenth of the sample's bytes are left out of it (not of training), which bounds what reaches the driver."""
    most = 6 * tokens
    some = docs.where(~F.col("held_out") & (F.octet_length("text") <= most // 10)).select("held_out", "text", F.xxhash64("id", "text").alias("h"))
    rows = some.orderBy("h", "text").limit(400)
    total = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("h", "text"))
    rows = rows.withColumn("total", total).where(F.col("total") <= most).select("held_out", "text")
    return iter(rows.toArrow().combine_chunks().to_batches())
