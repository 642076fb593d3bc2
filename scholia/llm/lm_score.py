"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Each word has a slot.  The most frequent words have one of their own; the others share
slots by a hash of their ending, which tells languages and word forms apart.  Slots are
dealt to classes, and

    p(word | history) = p(class | history) p(slot | class, history) p(word | slot).

The first two are softmaxes over sums of weight rows: one row for each n-gram or skip
feature of the history, hashed into tables of fixed size.  p(word | slot) is the smoothed
share of the word's count in its slot's, where one more type stands for unknown words, so
that the probabilities of all words sum to one.

Counts of all training tokens come from one aggregation.  Training is distributed gradient
descent: in each round every task walks its share of the texts, updating its own copy of
the weights batch by batch, and the rows that tasks have changed are averaged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.rows import column, placed_rows
from scholia.llm.staging import staged
from scholia.llm.textvec import lower_ascii, mix64, slices, span_hashes, text_buffer, word_bounds

#: Classes, and slots of each.
CLASSES, MEMBERS = 32, 32
SLOTS = CLASSES * MEMBERS
#: Slots of single words; the rest are shared by word endings.
OWN_SLOTS = 768
#: Words at most whose counts go to every worker; the counts of others are joined.
HEAD = 1 << 18
#: Rows of the hashed tables of pairs of slots, and of class-dependent features.
PAIR_ROWS, MEMBER_ROWS = 1 << 14, 1 << 15
ROUNDS = 2
#: Tokens of a gradient step, and of a step of scoring, whose arrays stay in the processor's cache.
BATCH, CHUNK = 1 << 14, 1 << 11
RATE = 0.3
#: Training tokens of a task, about, so that the changed rows that it sends are fewer than its texts' bytes.
TASK_TOKENS = 1 << 21

START = SLOTS
_U = np.uint64
_END = int(mix64(np.array([0x656E64], dtype=_U))[0])
#: Weight rows of the class softmax: bias, three single slots back, the pair of the last two.
_SINGLE = SLOTS + 1
CLASS_ROWS = 1 + 3 * _SINGLE + PAIR_ROWS


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, hash of its ending, and the number of tokens of each text.

    A text's tokens are its words, with A-Z lower-cased, and one end.
    """
    buf, off = text_buffer(texts)
    buf = lower_ascii(buf)
    start, end, doc = word_bounds(buf, off)
    n = np.bincount(doc, minlength=len(off) - 1) + 1 if len(doc) else np.ones(len(off) - 1, np.int64)
    at = np.arange(len(start)) + doc
    out = np.full(int(n.sum()), _END, dtype=_U)
    tail = np.zeros(len(out), dtype=_U)
    out[at] = span_hashes(buf, start, end)
    tail[at] = span_hashes(buf, np.maximum(start, end - 3), end)
    return out, tail, n


def _add_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (h, t, c): partial counts of the tokens, with the hash of their ending."""
    for batch in batches:
        for i, j in slices(batch.column(0)):
            h, t, _ = tokens(batch.column(0).slice(i, j - i))
            kinds, first, count = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(t[first].view(np.int64)), pa.array(count)], names=["h", "t", "c"])


@dataclass
class Lexicon:
    """Counts and slots of frequent words, and the mass of each slot."""

    keys: np.ndarray  # sorted hashes
    counts: np.ndarray
    own: np.ndarray  # the word's own slot, or -1
    mass: np.ndarray  # of each slot: tokens + 0.1 (types + 1)
    total: int
    types: int

    def look_up(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, count and whether the count is known here, of each token."""
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        here = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        count = np.where(here, self.counts[at] if len(self.keys) else 0, 0)
        slot = OWN_SLOTS + (tail % _U(SLOTS - OWN_SLOTS)).astype(np.int64)
        if len(self.keys):
            own = np.where(here, self.own[at], -1)
            slot = np.where(own >= 0, own, slot)
        return slot, count, here


def histories(slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Slots one, two and three tokens back, START before the text."""
    place = np.arange(len(slot)) - np.repeat(np.cumsum(n) - n, n)
    out = np.full((3, len(slot)), START)
    for k in (1, 2, 3):
        out[k - 1, k:] = slot[:-k]
        out[k - 1][place < k] = START
    return out


def _rows(back: np.ndarray, classes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature rows of the class softmax and, for the given classes, of the member softmax."""
    pair = (mix64((back[0] * _SINGLE + back[1]).astype(_U)) % _U(PAIR_ROWS)).astype(np.int64)
    first = [1 + back[0], 1 + _SINGLE + back[1], 1 + 2 * _SINGLE + back[2], 1 + 3 * _SINGLE + pair]
    hashed = [(mix64(((k * _SINGLE + back[k]) * CLASSES + classes).astype(_U)) % _U(MEMBER_ROWS - CLASSES)).astype(np.int64) + CLASSES for k in (0, 1)]
    return first, hashed


_ONES = {width: np.ones(width, np.float32) for width in (CLASSES, MEMBERS)}


def _sums(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The sums of a token's rows; where one is so large that it might overflow, less the largest of the token."""
    z = np.take(table, rows[0], axis=0, mode="clip")
    z += bias
    more = np.empty_like(z)
    for r in rows[1:]:
        np.take(table, r, axis=0, out=more, mode="clip")
        z += more
    if len(z) and max(z.max(), -z.min()) > 60:
        z -= z.max(1, keepdims=True)
    return z


def _shares(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities of a softmax over sums of rows."""
    z = _sums(table, bias, rows)
    np.exp(z, out=z)
    z /= (z @ _ONES[z.shape[1]])[:, None]
    return z


def _log_share(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], right: np.ndarray) -> np.ndarray:
    """The log probability of one value of each token."""
    z = _sums(table, bias, rows)
    own = z[np.arange(len(right)), right]
    np.exp(z, out=z)
    return own - np.log(z @ _ONES[z.shape[1]])


class Weights:
    """Weight rows of both softmaxes; the member table's first rows are the classes' biases."""

    def __init__(self, classes: np.ndarray, members: np.ndarray):
        self.classes, self.members = classes, members

    @staticmethod
    def start(mass: np.ndarray) -> Weights:
        """The model of slot frequencies alone."""
        share = np.log(mass / mass.sum()).reshape(CLASSES, MEMBERS)
        w = Weights(np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((MEMBER_ROWS, MEMBERS), np.float32))
        w.classes[0] = np.logaddexp.reduce(share, 1)
        w.members[:CLASSES] = share
        return w

    def copy(self) -> Weights:
        return Weights(self.classes.copy(), self.members.copy())

    def log_probability(self, slot: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Natural log of p(class) p(slot | class) of each token."""
        out = np.empty(len(slot))
        for i in range(0, len(slot), CHUNK):
            s = slot[i : i + CHUNK]
            cls, mem = s // MEMBERS, s % MEMBERS
            first, second = _rows(back[:, i : i + CHUNK], cls)
            out[i : i + CHUNK] = _log_share(self.classes, self.classes[0], first, cls) + _log_share(self.members, self.members[cls], second, mem)
        return out


class Trainer:
    """Gradient steps on a task's own copy of the weights, with a step size for each row as in Adagrad."""

    def __init__(self, start: Weights):
        self.base, self.now = start, start.copy()
        self.seen_c = np.zeros(CLASS_ROWS, np.float32)
        self.seen_m = np.zeros(MEMBER_ROWS, np.float32)

    def _apply(self, table: np.ndarray, seen: np.ndarray, row: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(row.astype(np.uint16) if row.max() < 65536 else row, kind="stable")
        sorted_ = row[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
        number = np.empty(len(row), np.int64)
        number[order] = np.cumsum(new) - 1
        row, width = sorted_[new], grad.shape[1]
        total = np.bincount((number[:, None] * width + np.arange(width)).ravel(), weights=grad.ravel(), minlength=len(row) * width).reshape(-1, width)
        seen[row] += (total * total).mean(1)
        table[row] -= (RATE * total / np.sqrt(seen[row] + 1.0)[:, None]).astype(np.float32)

    def step(self, slot: np.ndarray, back: np.ndarray) -> None:
        cls, mem = slot // MEMBERS, slot % MEMBERS
        first, second = _rows(back, cls)
        at = np.arange(len(slot))
        g = _shares(self.now.classes, self.now.classes[0], first)
        g[at, cls] -= 1
        for row in first:
            self._apply(self.now.classes, self.seen_c, row, g)
        g = _shares(self.now.members, self.now.members[cls], second)
        g[at, mem] -= 1
        for row in second:
            self._apply(self.now.members, self.seen_m, row, g)

    def changes(self) -> Iterator[pa.RecordBatch]:
        for table, seen, now, base in ((0, self.seen_c, self.now.classes, self.base.classes), (1, self.seen_m, self.now.members, self.base.members)):
            row = np.flatnonzero(seen)
            for i in range(0, len(row), 4096):
                r = row[i : i + 4096]
                d = now[r] - base[r]
                yield pa.RecordBatch.from_arrays([pa.array(r + table * CLASS_ROWS), *[pa.array(d[:, k].astype(np.float32)) for k in range(CLASSES)]], names=["row", *[f"d{k}" for k in range(CLASSES)]])


def _lexicon(counts: DataFrame) -> Lexicon:
    """From the whole table of counts (h, t, c): its totals, its head and the slots' masses; all of bounded size."""
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the words above a count, which few enough have: a top-k would gather k rows of every partition
    step = F.floor(F.log2("c") * 16).cast("int")
    level, left = 1 << 30, HEAD
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        left -= row.k
        if left < 0:
            break
        level = row.step
    top = counts.where(step >= level).select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True])
    h, c = top["h"].to_numpy().view(_U), top["c"].to_numpy()
    own = np.where(np.arange(len(h)) < OWN_SLOTS, np.arange(len(h)), -1)
    # frequent words of all ranks in every class, so that no class is rare
    own = np.where(own >= 0, (own % (OWN_SLOTS // MEMBERS)) * MEMBERS + own // (OWN_SLOTS // MEMBERS), -1)
    single = [int(x) for x in top["h"].to_numpy()[:OWN_SLOTS]]
    # the number of shared slots is a power of two, so the sign of a hash doesn't matter
    slot = F.pmod("t", F.lit(SLOTS - OWN_SLOTS)) + OWN_SLOTS
    mass = np.full(SLOTS, 0.1)
    shared = counts.where(~F.col("h").isin(single)) if single else counts
    for row in shared.groupBy(slot.alias("slot")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        mass[row.slot] += row.n + 0.1 * row.k
    for k in range(min(OWN_SLOTS, len(h))):
        mass[own[k]] += c[k] + 0.1
    order = np.argsort(h)
    return Lexicon(h[order], c[order], own[order], mass, int(total), int(types))


def walk(trainer: Trainer, lex: Lexicon, batches: Iterable[pa.RecordBatch]) -> None:
    """Gradient steps on every token of the texts, BATCH tokens each."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for i, j in slices(batch.column(0)):
            h, t, n = tokens(batch.column(0).slice(i, j - i))
            slot, _, _ = lex.look_up(h, t)
            held.append((slot, histories(slot, n)))
            size += len(slot)
            if size >= BATCH:
                s, b = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], 1)
                for k in range(0, size - BATCH + 1, BATCH):
                    trainer.step(s[k : k + BATCH], b[:, k : k + BATCH])
                rest = size - size % BATCH
                held, size = [(s[rest:], b[:, rest:])], size % BATCH
    if size:
        trainer.step(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], 1))


def lm_scores(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Model and base scores of every row, learned from the rows that aren't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score and score
    (double): the sums over a text's tokens of log10 (c + 0.1) / (N + 0.1 (V + 1)) and of
    log10 of the model's probability.  held_out is a condition on docs; without one a row
    is held out if crc32 of its id as text is 0 modulo 10, a null id counting as ''.

    The model depends on how the files are dealt to tasks, as each task trains on its own.
    A null text is empty and has one token, its end.  Repeated rows are scored, and
    learned from, each.  With no training rows N and V are 0.  An empty table gives an
    empty result; other columns are ignored.

    Tokens are told apart by 64-bit hashes.  Workers get the counts of the HEAD most
    frequent words and the weights, both of fixed size; the counts of other words are
    joined by hash, and being rare they make no hot keys.
    """
    ident = column(id_col)
    out = F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0 if held_out is None else F.coalesce(held_out, F.lit(False))
    # each row is named by its place in its file, so a task that runs again names it alike
    named = docs.select(ident.cast("long").alias("doc_id"), out.alias("held_out"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    rows = placed_rows(named).select("row.*", "place", "at")
    train = rows.where(~F.col("held_out"))
    counts = staged(train.select("text").mapInArrow(_add_counts, "h long, t long, c long").groupBy("h").agg(F.first("t").alias("t"), F.sum("c").alias("c")), "counts")
    lex = _lexicon(counts)
    weights = Weights.start(lex.mass)

    def train_on(weights: Weights):
        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(weights)
            walk(trainer, lex, batches)
            yield from trainer.changes()

        return task

    schema = "row long, " + ", ".join(f"d{k} float" for k in range(CLASSES))
    for r in range(ROUNDS):
        part = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == r).select("text")
        # many small files become few tasks; there are never more tasks than files have parts
        part = part.coalesce(max(1, -(-lex.total // (ROUNDS * TASK_TOKENS))))
        moved = part.mapInArrow(train_on(weights), schema).groupBy("row").agg(*[F.avg(f"d{k}").alias(f"d{k}") for k in range(CLASSES)])
        found = moved.toPandas()  # as many rows as the tables have, at most
        if len(found):
            at, step = found["row"].to_numpy(), found.drop(columns="row").to_numpy(np.float32)
            both = np.concatenate([weights.classes, weights.members])
            both[at] += step
            weights = Weights(both[:CLASS_ROWS], both[CLASS_ROWS:])

    base_z = np.log10(lex.total + 0.1 * (lex.types + 1))
    log_mass = np.log10(lex.mass)

    names = ["place", "at", "h", "times", "doc_id", "held_out", "n", "known", "base", "score"]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's row, and a row for each of its words whose count isn't here."""
        for batch in batches:
            for i, j in slices(batch.column(0)):
                text, place, at, doc_id, held = (c.slice(i, j - i) for c in batch.columns)
                h, t, n = tokens(text)
                slot, count, here = lex.look_up(h, t)
                doc = np.repeat(np.arange(j - i), n)
                p = weights.log_probability(slot, histories(slot, n)) / np.log(10) - log_mass[slot]
                log_c = np.where(here, np.log10(count + 0.1), 0.0)
                total = lambda x: np.bincount(doc, weights=x, minlength=j - i)
                # a text's own row goes anywhere in the join; it has no times, and a count that it meets means nothing
                spread = mix64(place.to_numpy().view(_U)).view(np.int64)
                whole = [place, at, pa.array(spread), pa.nulls(j - i, pa.int32()), doc_id, held, *map(pa.array, (n, total(here).astype(np.int64), total(log_c) - n * base_z, total(p + log_c)))]
                yield pa.RecordBatch.from_arrays(whole, names=names)
                rare = np.flatnonzero(~here)
                rare = rare[np.lexsort((h[rare], doc[rare]))]
                new = np.ones(len(rare), bool)
                new[1:] = (h[rare][1:] != h[rare][:-1]) | (doc[rare][1:] != doc[rare][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare))).astype(np.int32)
                owner = pa.array(doc[rare[first]])
                word = [place.take(owner), at.take(owner), pa.array(h[rare[first]].view(np.int64)), pa.array(times)]
                yield pa.RecordBatch.from_arrays(word + [pa.nulls(len(first), f.type) for f in whole[4:]], names=names)

    schema = "place long, at long, h long, times int, doc_id long, held_out boolean, n long, known long, base double, score double"
    parts = rows.select("text", "place", "at", "doc_id", "held_out").mapInArrow(score, schema)
    rare = F.coalesce(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) * F.col("times"), F.lit(0.0))
    sums = (
        parts.join(counts.select("h", "c").hint("merge"), "h", "left")
        .groupBy("place", "at")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.sum("n").alias("n_tokens"),
            F.sum(F.coalesce("known", F.lit(0)) + F.when(F.col("c") > 0, F.coalesce("times", F.lit(0))).otherwise(0)).alias("n_known"),
            F.sum(F.coalesce("base", F.lit(0.0)) + rare).alias("base_score"),
            F.sum(F.coalesce("score", F.lit(0.0)) + rare).alias("score"),
        )
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base_score", "score")
