"""Areas of many bootstrap rounds at once, slice by slice of the scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

#: Rows whose vectors are worked on at a time.
CHUNK = 256


def dense_draws(rounds: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(cluster, b, m) with the rounds and their draws -> (cluster, times): an unsigned 16-bit count per round."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b, m in zip(batch["b"], batch["m"]):
                times = np.zeros(rounds, np.uint16)
                times[np.asarray(b, np.int64)] = m
                out.append(times.tobytes())
            yield pd.DataFrame({"cluster": batch["cluster"], "times": out})
    return run


def slice_areas(rounds: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(score, pos, neg, times) of one slice in order of score -> one row (low, area, pos, neg) with a value per round.

    ``area`` counts, for every positive, the negatives below it inside the slice, and half of those at its score.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        area, below, pos_all, pos, neg = (np.zeros(rounds) for _ in range(5))
        low = at = None
        for batch in batches:
            for i in range(0, len(batch), CHUNK):
                part = batch.iloc[i:i + CHUNK]
                score = part["score"].to_numpy()
                starts = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
                times = np.stack([np.frombuffer(t, np.uint16) for t in part["times"]]).astype(np.float64)
                p = np.add.reduceat(times * part["pos"].to_numpy(np.float64)[:, None], starts)
                n = np.add.reduceat(times * part["neg"].to_numpy(np.float64)[:, None], starts)
                for j, s in enumerate(score[starts]):
                    if at is None or s != at:  # a score may go on in the next chunk
                        area += pos * (below + neg / 2)
                        below, pos_all = below + neg, pos_all + pos
                        pos, neg = p[j], n[j]
                        low, at = (s if low is None else low), s
                    else:
                        pos, neg = pos + p[j], neg + n[j]
        if low is not None:
            area += pos * (below + neg / 2)
            yield pd.DataFrame({"low": [low], "area": [area], "pos": [pos_all + pos], "neg": [below + neg]})
    return run
