"""Spatial verification: one affine map between a query and an image, agreed on by as many matches as possible.

Every match proposes a map; all maps of a chunk are held against all matches at once, and only those that could beat
the best so far go through the one-to-one assignment, which is sequential. A better map is refined by least squares.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

MIN_MATCHES = 4
MIN_INLIERS = 4
TRANSFER_ERROR = 1600.0
SCALE_CHANGE = float(np.sqrt(1000.0))
WIDER = float(np.sqrt(2.0))
LEAST_SQUARES_SAMPLE, INNER_SAMPLE, REPEATS = 21, 12, 10
PATCH = 24
CHUNK = 1 << 18
VERIFIED = "query_id int, image_id int, num_matches int, num_inliers int, eff double, inlier_feature_ids array<int>"


@dataclass
class Candidates:
    """Candidate pairs of one query and one image: features with the fewest come first, each with its pairs in a row."""

    feature: np.ndarray  # number of the feature within the order
    feature_id: np.ndarray
    target: np.ndarray  # identity of the database feature
    one: np.ndarray  # x, y, a, b, c of the query's keypoint
    two: np.ndarray
    n_features: int

    @classmethod
    def of(cls, feature_id, target, one, two) -> Candidates:
        feature_id, target = np.asarray(feature_id), np.asarray(target)
        order = np.lexsort((target, feature_id))
        f, t = feature_id[order], target[order]
        order = order[np.concatenate([[True], (f[1:] != f[:-1]) | (t[1:] != t[:-1])])] if len(order) else order
        ids, count = np.unique(feature_id[order], return_counts=True)
        rank = np.empty(len(ids), int)
        rank[np.lexsort((ids, count))] = np.arange(len(ids))
        number = rank[np.searchsorted(ids, feature_id[order])]
        again = np.argsort(number, kind="stable")
        order, number = order[again], number[again]
        return cls(number, feature_id[order], target[order], np.asarray(one, float)[order], np.asarray(two, float)[order], len(ids))


def triangles(k: np.ndarray) -> np.ndarray:
    """d, e, f of the lower triangle that maps each ellipse to the unit circle; nan where there is none."""
    with np.errstate(invalid="ignore", divide="ignore"):
        f = np.sqrt(np.where(k[:, 4] > 0, k[:, 4], np.nan))
        e = k[:, 3] / (2 * f)
        rest = k[:, 2] - e * e
        return np.stack([np.sqrt(np.where(rest > 0, rest, np.nan)), e, f], 1)


def affine_maps(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Maps [A | t] (n, 2, 3) of keypoints one to two by which the direction of y is kept."""
    p, q = triangles(one), triangles(two)
    out = np.zeros((len(one), 2, 3))
    out[:, 0, 0], out[:, 1, 1] = p[:, 0] / q[:, 0], p[:, 2] / q[:, 2]
    out[:, 1, 0] = (p[:, 1] - q[:, 1] * out[:, 0, 0]) / q[:, 2]
    out[:, :, 2] = two[:, :2] - np.einsum("nij,nj->ni", out[:, :, :2], one[:, :2])
    return out


def similarity_maps(one: np.ndarray, two: np.ndarray, rotate: bool) -> np.ndarray:
    """Maps of keypoints (x, y, scale, orientation) by scale and shift, and by rotation if asked for."""
    s = two[:, 2] / one[:, 2]
    turn = two[:, 3] - one[:, 3] if rotate else np.zeros(len(one))
    out = np.zeros((len(one), 2, 3))
    out[:, 0, 0] = out[:, 1, 1] = s * np.cos(turn)
    out[:, 0, 1] = s * np.sin(turn)  # orientations turn against the axes' sense: y points down
    out[:, 1, 0] = -out[:, 0, 1]
    out[:, :, 2] = two[:, :2] - np.einsum("nij,nj->ni", out[:, :, :2], one[:, :2])
    return out


MODELS = {"affine": affine_maps, "similarity": lambda a, b: similarity_maps(a, b, True), "upright": lambda a, b: similarity_maps(a, b, False)}


def area(k: np.ndarray, m: np.ndarray | None = None, model: str = "affine") -> np.ndarray:
    """What is proportional to each keypoint's area, under each linear map m (h, 2, 2) if given: (n) or (h, n)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if model != "affine":
            size = k[:, 2] ** 2 / 2
            return size if m is None else size / np.abs(np.linalg.det(m))[:, None]
        det = 4 * k[:, 2] * k[:, 4] - k[:, 3] ** 2
        det = det if m is None else np.linalg.det(m)[:, None] ** 2 * det  # of the ellipse's matrix under the map
        return 1 / np.sqrt(np.where(det > 0, det, np.nan))


def errors(c: Candidates, there: np.ndarray, back: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Two-way transfer error and change of scale (1 or more) of all candidates under each map: (h, n)."""
    x, y = c.one[:, :2], c.two[:, :2]
    to = np.einsum("hij,nj->hni", there[:, :, :2], x) + there[:, None, :, 2] - y
    fro = np.einsum("hij,nj->hni", back[:, :, :2], y) + back[:, None, :, 2] - x
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        ratio = area(c.one, back[:, :, :2], model) / area(c.two, None, model)
        return (to**2).sum(2) + (fro**2).sum(2), np.maximum(ratio, 1 / ratio)


def assign(c: Candidates, ok: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Feature by feature the nearest candidate that passes and whose target is free: positions of the pairs taken."""
    used, out = set(), []
    at = np.flatnonzero(ok)
    at = at[np.lexsort((at, error[at], c.feature[at]))]
    last = -1
    for i, f, t in zip(at.tolist(), c.feature[at].tolist(), c.target[at].tolist(), strict=True):
        if f != last and t not in used:
            used.add(t)
            out.append(i)
            last = f
    return np.array(out, int)


class Verifier:
    def __init__(self, c: Candidates, seed, model: str = "affine", transfer_error: float = TRANSFER_ERROR, scale_change: float = SCALE_CHANGE):
        self.c, self.seed, self.model, self.limits = c, seed, model, (transfer_error, scale_change)

    def passing(self, there, back, wider: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        error, scale = errors(self.c, there, back, self.model)
        with np.errstate(invalid="ignore"):
            return (error < self.limits[0] * wider) & (scale < self.limits[1] * wider), error

    def inliers(self, there: np.ndarray, back: np.ndarray, wider: float = 1.0) -> np.ndarray:
        ok, error = self.passing(there[None], back[None], wider)
        return assign(self.c, ok[0], error[0])

    def least_squares(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The affine map of the pairs' positions and its inverse; None if there is none."""
        x, y = self.c.one[pairs, :2], self.c.two[pairs, :2]
        mean, scale = x.mean(0), np.linalg.norm(x - x.mean(0), axis=1).mean() or 1.0
        a, _, rank, _ = np.linalg.lstsq(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), y, rcond=None)
        m = np.vstack([np.hstack([a[:2].T / scale, (a[2] - mean @ a[:2] / scale)[:, None]]), [0, 0, 1]])
        if len(pairs) < 3 or rank < 3 or not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-12:
            return None
        return m[:2], np.linalg.inv(m)[:2]

    def refine(self, there, back, best: np.ndarray) -> np.ndarray:
        """The largest set of inliers that least squares on samples of them finds, `best` if none is larger."""
        rng = np.random.default_rng(self.seed)
        draw = lambda k, of: of if k >= len(of) else of[rng.choice(len(of), k, replace=False)]
        wide = self.inliers(there, back, WIDER)
        if len(wide) < MIN_INLIERS or (fit := self.least_squares(draw(LEAST_SQUARES_SAMPLE, wide))) is None:
            return best
        wide = self.inliers(*fit, WIDER)
        if len(wide) < MIN_INLIERS:
            return best
        for _ in range(REPEATS):
            fit = self.least_squares(draw(max(min(INNER_SAMPLE, len(wide) // 2), MIN_INLIERS), wide))
            if fit is not None and len(found := self.inliers(*fit)) >= max(MIN_INLIERS, len(best) + 1):
                best = found
        return best

    def run(self) -> np.ndarray:
        """Positions of the inlier pairs of the best map."""
        c, make = self.c, MODELS[self.model]
        with np.errstate(invalid="ignore", divide="ignore"):
            there, back = make(c.one, c.two), make(c.two, c.one)
        able = np.flatnonzero(np.isfinite(there).all((1, 2)) & np.isfinite(back).all((1, 2)))
        best = np.zeros(0, int)
        step = max(1, CHUNK // max(1, len(c.target)))
        for a in range(0, len(able), step):
            some = able[a : a + step]
            ok, error = self.passing(there[some], back[some])
            for k, h in enumerate(some.tolist()):
                if len(np.unique(c.feature[ok[k]])) <= len(best):
                    continue  # can't have more inliers than features with a candidate that passes
                found = assign(c, ok[k], error[k])
                if len(found) > len(best) and len(found) >= 3:
                    best = self.refine(there[h], back[h], found)
        return best


def effective_inliers(x: np.ndarray, y: np.ndarray, patch: int = PATCH) -> float:
    """The area of the union of squares whose top left corners are the rounded positions, in squares."""
    if not len(x):
        return 0.0
    corners = np.unique(np.stack([np.floor(x + 0.5), np.floor(y + 0.5)], 1).astype(np.int64), axis=0)
    pixels = corners[:, None, None, :] + np.stack(np.meshgrid(np.arange(patch), np.arange(patch), indexing="ij"), -1)
    flat = pixels.reshape(-1, 2)
    return len(np.unique((flat[:, 0] << 32) + flat[:, 1])) / patch**2


def one_to_one(feature: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[int]:
    """Pairs such that no feature on either side comes twice: the side and feature with the fewest choices left goes first,
    the database's on ties, then the smaller id, and takes its partner of the highest weight."""
    sides: tuple[dict, dict] = ({}, {})
    for k, (f, t) in enumerate(zip(np.asarray(feature).tolist(), np.asarray(target).tolist(), strict=True)):
        sides[0].setdefault(f, set()).add(k)
        sides[1].setdefault(t, set()).add(k)
    w, ends = np.asarray(weight).tolist(), (np.asarray(feature).tolist(), np.asarray(target).tolist())
    heap = [(len(v), 1 - s, i) for s in (0, 1) for i, v in sides[s].items()]  # 0: the database's side
    heapq.heapify(heap)
    out = []
    while heap:
        n, order, i = heapq.heappop(heap)
        left = sides[1 - order].get(i)
        if not left or len(left) != n:
            continue
        k = min(left, key=lambda k: (-w[k], ends[order][k]))
        out.append(k)
        for s in (0, 1):
            for gone in list(sides[s].pop(ends[s][k])):
                other = sides[1 - s].get(ends[1 - s][gone])
                if other is not None and ends[1 - s][gone] != ends[1 - s][k]:
                    other.discard(gone)
                    if other:
                        heapq.heappush(heap, (len(other), 1 - (1 - s), ends[1 - s][gone]))
    return sorted(out)


def matches_of(top: DataFrame, voted: DataFrame, idf: DataFrame) -> DataFrame:
    """The votes for each query's best images, with both keypoints and weight x idf^2; groups of fewer than MIN_MATCHES votes are left out by verify()."""
    rows = voted.join(top.select("query_id", "image_id"), ["query_id", "image_id"]).join(idf, "word_id")
    return rows.withColumn("weight", F.col("weight") * F.col("idf") * F.col("idf")).drop("idf")


def hypothesis_support(matches: DataFrame, transfer_error: float = TRANSFER_ERROR, scale_change: float = SCALE_CHANGE, min_matches: int = MIN_MATCHES) -> DataFrame:
    """(query_id, image_id, feature_id, posting_id, support): for each match's own map the query features with a match that it explains, by its error both ways and the
    change of scale. The relational form of a verifier's first step: an inner join within a pair of images, whose size two images' features bound."""
    sides = [f"q_{c}" for c in "xyabc"] + list("xyabc")
    several = matches.groupBy("query_id", "image_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_matches).drop("n")
    pairs = matches.join(several, ["query_id", "image_id"]).select("query_id", "image_id", "feature_id", "posting_id", *[F.col(c).cast("double").alias(c) for c in sides]).dropDuplicates(["query_id", "image_id", "feature_id", "posting_id"])
    one, two = tuple(F.col(f"q_{c}") for c in "xyabc"), tuple(F.col(c) for c in "xyabc")
    names = [f"{d}_{n}" for d in ("to", "back") for n in ("a11", "a21", "a22", "t1", "t2")]
    maps = pairs.select("query_id", "image_id", "feature_id", "posting_id", *[m.alias(n) for m, n in zip([*C.upright_affine(one, two), *C.upright_affine(two, one)], names, strict=True)]).dropna()
    other = pairs.select("query_id", "image_id", F.col("feature_id").alias("f"), *[F.col(c).alias(f"o_{c}") for c in sides])
    at = lambda d, x, y: (F.col(f"{d}_a11") * x + F.col(f"{d}_t1"), F.col(f"{d}_a21") * x + F.col(f"{d}_a22") * y + F.col(f"{d}_t2"))
    p, q = (F.col("o_q_x"), F.col("o_q_y")), (F.col("o_x"), F.col("o_y"))
    square = lambda u, v: (u[0] - v[0]) * (u[0] - v[0]) + (u[1] - v[1]) * (u[1] - v[1])
    error = square(at("to", *p), q) + square(at("back", *q), p)
    det = F.abs(F.col("back_a11") * F.col("back_a22"))
    ratio = C.ellipse_area(F.col("o_q_a"), F.col("o_q_b"), F.col("o_q_c")) / det / C.ellipse_area(F.col("o_a"), F.col("o_b"), F.col("o_c"))
    passes = (error < transfer_error) & (F.greatest(ratio, 1 / ratio) < scale_change)
    keys = ["query_id", "image_id", "feature_id", "posting_id"]
    return maps.join(other, ["query_id", "image_id"]).groupBy(*keys).agg(F.count_distinct(F.when(passes, F.col("f"))).alias("support"))


def verify(matches: DataFrame, model: str = "affine", matching: str = "all") -> DataFrame:
    """(query_id, image_id, num_matches, num_inliers, eff, inlier_feature_ids) of the pairs with MIN_INLIERS inliers or more.

    A group holds the votes of one query image for one database image, so its size is bounded by the features of two images.
    matching='one_to_one' first thins the candidates to a one-to-one set.
    """
    first, second = ("q_x", "q_y", "q_a", "q_b", "q_c"), ("x", "y", "a", "b", "c")

    def each(key, pdf):
        names = [f.split()[0] for f in VERIFIED.split(", ")]
        n = len(pdf)  # votes, those of one pair of features under several words included
        pdf = pdf.sort_values(["feature_id", "posting_id", "word_id"]).drop_duplicates(["feature_id", "posting_id"])
        if matching == "one_to_one":
            pdf = pdf.iloc[one_to_one(pdf["feature_id"], pdf["posting_id"], pdf["weight"])]
        if n < MIN_MATCHES:
            return pd.DataFrame(columns=names)
        c = Candidates.of(pdf["feature_id"], pdf["posting_id"], pdf[list(first)], pdf[list(second)])
        found = Verifier(c, [int(k) & 0x7FFFFFFF for k in key], model).run()
        if len(found) < MIN_INLIERS:
            return pd.DataFrame(columns=names)
        eff = effective_inliers(c.one[found, 0], c.one[found, 1])
        return pd.DataFrame([(*key, n, len(found), eff, sorted(c.feature_id[found].tolist()))], columns=names)

    return matches.select("query_id", "image_id", "feature_id", "word_id", "posting_id", "weight", *first, *second).groupBy("query_id", "image_id").applyInPandas(each, VERIFIED)
