"""Main text of web pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.html_blocks import Block, add_features, leaf_blocks
from scholia.llm.html_training import MARK, labelled_page

#: Labelled pages that the model is fitted on, and the rounds of the fit.
TRAINING_PAGES = 900
ROUNDS = 240
#: Pages that are decoded together.
PAGES_AT_ONCE = 256


class BlockModel:
    """Two labels (0 around the article, 1 in it): a weight for each feature and label, and for each pair of neighbours."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.index, self.weights, self.moves, self.first = index, weights, moves, first

    def scores(self, pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores (page, place, label), padded, and the number of blocks of each page."""
        count = np.array([len(p) for p in pages])
        cells, ids = [], []
        width = int(count.max(initial=0))
        get = self.index.get
        for i, page in enumerate(pages):
            for j, block in enumerate(page):
                own = [k for k in map(get, block.features) if k is not None]
                ids += own
                cells += [i * width + j] * len(own)
        out = np.zeros((len(pages) * width, 2))
        for y in (0, 1):
            out[:, y] = np.bincount(cells, weights=self.weights[ids, y], minlength=len(out)) if ids else 0
        return out.reshape(len(pages), width, 2), count

    def decode(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The most likely labels of each page, by Viterbi over all pages side by side."""
        emit, count = self.scores(pages)
        n, width, _ = emit.shape
        if not width:
            return [np.zeros(0, int) for _ in pages]
        best = emit[:, 0] + self.first
        back = np.zeros((n, width, 2), np.int8)
        at_end = best.copy()
        for t in range(1, width):
            step = best[:, :, None] + self.moves[None]
            back[:, t] = step.argmax(1)
            best = step.max(1) + emit[:, t]
            at_end[count - 1 == t] = best[count - 1 == t]
        out = []
        for i in range(n):
            labels = np.zeros(count[i], int)
            if count[i]:
                y = int(at_end[i].argmax())
                for t in range(count[i] - 1, -1, -1):
                    labels[t] = y
                    y = int(back[i, t, y])
            out.append(labels)
        return out


def _gradient(emit: np.ndarray, moves: np.ndarray, first: np.ndarray, mask: np.ndarray, gold: np.ndarray):
    """Expected minus observed counts of the labels, of the pairs of neighbours and of the first labels."""
    n, width, _ = emit.shape
    soft = np.logaddexp.reduce
    ahead = np.zeros((n, width, 2))
    behind = np.zeros((n, width, 2))
    ahead[:, 0] = emit[:, 0] + first
    for t in range(1, width):
        step = soft(ahead[:, t - 1, :, None] + moves[None], axis=1) + emit[:, t]
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    total = soft(ahead[:, -1], axis=1)
    for t in range(width - 2, -1, -1):
        step = soft(moves[None] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(mask[:, t + 1, None], step, behind[:, t + 1])
    own = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
    pair = np.zeros((2, 2))
    for t in range(1, width):
        p = ahead[:, t - 1, :, None] + moves[None] + (emit[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
        pair += (np.exp(np.minimum(p, 0)) * mask[:, t, None, None]).sum(0)
    seen = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    hot = np.stack([1 - gold, gold], 2) * mask[:, :, None]
    return own - hot, pair - seen, (own[:, 0] - hot[:, 0]).sum(0)


@lru_cache(maxsize=4)
def fit(n_pages: int = TRAINING_PAGES, rounds: int = ROUNDS, penalty: float = 0.02) -> BlockModel:
    """Maximum likelihood with an L2 penalty, by gradient steps scaled as in Adam."""
    pages = [p for seed in range(n_pages) if (p := add_features(leaf_blocks(labelled_page(seed))))]
    width = max(map(len, pages))
    gold = np.zeros((len(pages), width), int)
    mask = np.zeros((len(pages), width), bool)
    index: dict[str, int] = {}
    cells, ids = [], []
    for i, page in enumerate(pages):
        for j, block in enumerate(page):
            gold[i, j] = MARK in block.text
            mask[i, j] = True
            for f in block.features:
                cells.append(i * width + j)
                ids.append(index.setdefault(f, len(index)))
    cells, ids = np.array(cells), np.array(ids)
    params = np.zeros(len(index) * 2 + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    cut = len(index) * 2
    for r in range(1, rounds + 1):
        w, moves, first = params[:cut].reshape(-1, 2), params[cut : cut + 4].reshape(2, 2), params[cut + 4 :]
        emit = np.stack([np.bincount(cells, weights=w[ids, y], minlength=gold.size) for y in (0, 1)], 1).reshape(*gold.shape, 2)
        own, pair, start = _gradient(emit, moves, first, mask, gold)
        flat = own.reshape(-1, 2)[cells]
        g = np.concatenate([np.stack([np.bincount(ids, weights=flat[:, y], minlength=len(index)) for y in (0, 1)], 1).ravel(), pair.ravel(), start]) / len(pages)
        g += penalty / 10 * params
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        params = params - 0.08 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return BlockModel(index, params[:cut].reshape(-1, 2), params[cut : cut + 4].reshape(2, 2), params[cut + 4 :])


def extract(pages: list[str | None], model: BlockModel) -> list[str]:
    """The main text of each page."""
    blocks = [add_features(leaf_blocks(p or "")) for p in pages]
    labels = model.decode(blocks)
    return [" ".join(b.text for b, y in zip(page, own) if y) for page, own in zip(blocks, labels)]


def main_text(pages: DataFrame, training_pages: int = TRAINING_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row.

    The model is fitted on `training_pages` labelled pages before the job starts; its few
    hundred weights go to the workers.  Blocks labelled as the article are joined by one
    space.  A null or empty page, or one without an article, has the empty text.  Null
    ids and urls and repeated rows are kept as they are; other columns are ignored.
    """
    model = fit(training_pages)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(i, PAGES_AT_ONCE)
                text = extract(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(task, "page_id long, url string, text string, n_chars long")
