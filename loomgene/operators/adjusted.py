"""Structure- and kinship-adjusted correlation, one chromosome held out at a time.

Gram matrices are sums over markers, so each partition adds up its own and one matrix
per chromosome meets in the end; a held-out chromosome is subtracted from the total.
Matrices are samples by samples and don't grow with the markers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGES = {"V": 1e-6, "V_RIDGE": 0.01}
MODELS = ("RAW", "PC2", "PC5", "V", "V_RIDGE", "V_PC2")
ZERO = 1e-12


def gram_sums(markers: DataFrame) -> DataFrame:
    """(chromosome, n_markers, scale, kernel, standard) from complete, variable markers (chromosome, dosage)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, group in rows.groupby("chromosome"):
                x = np.stack(group["dosage"].to_numpy()).astype(float)
                p = x.mean(axis=1, keepdims=True) / 2
                z = x - 2 * p
                v = 2 * p * (1 - p)
                out.append((name, len(x), float(v.sum()), (z.T @ z).ravel(), ((z / np.sqrt(v)).T @ (z / np.sqrt(v))).ravel()))
            yield pd.DataFrame(out, columns=["chromosome", "n_markers", "scale", "kernel", "standard"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows["chromosome"].iloc[0], int(rows["n_markers"].sum()), float(rows["scale"].sum()), sum(rows["kernel"]), sum(rows["standard"]))], columns=list(rows.columns))

    schema = "chromosome string, n_markers long, scale double, kernel array<double>, standard array<double>"
    return markers.select("chromosome", "dosage").mapInPandas(part, schema).groupBy("chromosome").applyInPandas(add, schema)


def held_out_models(grams: list) -> dict[str, dict]:
    """For each chromosome the kernel and principal axes of all others."""
    side = int(len(grams[0]["kernel"]) ** 0.5)
    out = {}
    for own in grams:
        others = [g for g in grams if g["chromosome"] != own["chromosome"]]
        if not others:
            continue
        kernel = sum(np.array(g["kernel"]) for g in others).reshape(side, side) / sum(g["scale"] for g in others)
        kernel /= np.trace(kernel) / side
        values, vectors = np.linalg.eigh(sum(np.array(g["standard"]) for g in others).reshape(side, side))
        axes = vectors[:, ::-1][:, :5]
        # One sign for each axis: its largest entry is positive.
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
        out[own["chromosome"]] = {"kernel": kernel, "axes": axes, "values": values[::-1], "n": sum(g["n_markers"] for g in others)}
    return out


def finite_matrix(x: np.ndarray) -> np.ndarray:
    """A matrix of numbers; anything missing or infinite is an error, never filled in."""
    x = np.asarray(x, float)
    if x.ndim != 2 or not x.size or not np.isfinite(x).all():
        raise ValueError("a matrix must have two dimensions and finite entries")
    return x


def projection(model: dict, name: str) -> np.ndarray:
    """T with T'T = P: whitened by the covariance of the model, free of its nuisance columns."""
    n = len(model["kernel"])
    ones = np.ones((n, 1))
    nuisance = np.hstack([ones, model["axes"][:, : int(name[-1])]]) if "PC" in name else ones
    if name.startswith("V"):
        cov = model["kernel"] + RIDGES["V_RIDGE" if name == "V_RIDGE" else "V"] * np.eye(n) + np.ones((n, n)) / n
        values, vectors = np.linalg.eigh(finite_matrix(cov))
        if values.min() < -1e-8 * values.max():
            raise ValueError(f"the covariance of {name} isn't positive semidefinite")
        white = (vectors / np.sqrt(np.maximum(values, values.max() * 1e-12))).T
    else:
        white = np.eye(n)
    q, r = np.linalg.qr(white @ finite_matrix(nuisance))
    rank = np.abs(np.diag(r)) > 1e-10
    if not rank.all() or nuisance.shape[1] >= n:
        raise ValueError(f"nuisance columns of {name} aren't independent")
    out = white - q @ (q.T @ white)
    if np.abs(out @ nuisance).max() > 1e-6 * max(1.0, np.abs(white).max()):
        raise ValueError(f"the projection of {name} isn't orthogonal to its nuisance columns")
    return out


def unit_vectors(markers: DataFrame, models: dict[str, dict]) -> DataFrame:
    """(marker, chromosome, model, unit): projected and normalised dosages; null where nothing is left of a marker."""
    sent = markers.sparkSession.sparkContext.broadcast({c: {m: projection(x, m) for m in MODELS} for c, x in models.items()})

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for marker, chromosome, x in zip(rows["marker"], rows["chromosome"], rows["dosage"]):
                x = np.array(x, float)
                centred = float(((x - x.mean()) ** 2).sum())
                for name, t in sent.value.get(chromosome, {}).items():
                    u = t @ x
                    size = float(u @ u)
                    out.append((marker, chromosome, name, u / size**0.5 if size > ZERO * max(1.0, centred) else None))
            yield pd.DataFrame(out, columns=["marker", "chromosome", "model", "unit"])

    return markers.select("marker", "chromosome", "dosage").mapInPandas(project, "marker long, chromosome string, model string, unit array<double>")


def thin(markers: DataFrame, bin_bp: int = 100_000) -> DataFrame:
    """Per held-out chromosome, in order of position, one marker for each bin and each family; which one depends on those before it."""

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["chromosome", "position", "marker"])
        bins: set = set()
        families: set = set()
        keep = []
        for c, p, f in zip(rows["chromosome"], rows["position"], rows["family"]):
            spot = (c, p // bin_bp)
            ok = spot not in bins and f not in families
            if ok:
                bins.add(spot)
                families.add(f)
            keep.append(ok)
        return rows.loc[keep, ["held_out", "marker", "chromosome", "position"]]

    return markers.groupBy("held_out").applyInPandas(greedy, "held_out string, marker long, chromosome string, position long")


def tolerant_best(pairs: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Best partner of each marker by a scan in pair order: a later one must be better by more than the tolerance, or as good and lower."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        best, who = -1.0, None
        for partner, r2 in rows.sort_values("partner")[["partner", "r2"]].itertuples(index=False):
            if r2 > best + tolerance or (abs(r2 - best) <= tolerance and partner < who):
                best, who = r2, partner
        return pd.DataFrame([(rows["marker"].iloc[0], who, best)], columns=["marker", "partner", "r2"])

    return pairs.filter("r2 IS NOT NULL").groupBy("marker").applyInPandas(scan, "marker long, partner long, r2 double")


def best_partner(pairs: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Of the partners (marker, partner, position, r2) within the tolerance of a marker's best the first by position, then by partner."""
    most = pairs.filter("r2 IS NOT NULL").groupBy("marker").agg(F.max("r2").alias("most"))
    tied = pairs.join(most, "marker").filter(F.col("most") - F.col("r2") <= tolerance)
    return tied.groupBy("marker").agg(F.min(F.struct("position", "partner", "r2")).alias("x"), F.count("*").alias("n_tied")).select("marker", "x.partner", "x.position", "x.r2", "n_tied")
