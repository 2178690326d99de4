"""Networks on token frames: a regressor, an encoder into a target space, a decoder back to sequences, and both at once.

Frames are those of ``functions.names.tokens``: 40 places of 21 tokens.  An encoder is a convolution over places and two
dense layers; a decoder gives every place's tokens from a code.  All are trained by ``learn.training``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexivec.functions.names import FRAME, GAP, prototype_hash, tokens, tokens_to_sequence
from plexivec.learn.training import AT_ONCE, Fitted, Net, fit, load_params, save_params, split
from plexivec.operators.basis import Basis, fit_projection

KINDS = GAP + 1
REACH = 2  # places on either side that a convolution sees
CHANNELS = 16
HIDDEN = 96


def _padded(frames: np.ndarray) -> np.ndarray:
    """Frames with the places beyond both ends, where nothing is."""
    out = np.full((len(frames), FRAME + 2 * REACH), KINDS)
    out[:, REACH : REACH + FRAME] = frames
    return out


def encoder_shapes(out: int) -> dict[str, tuple[int, ...]]:
    return {"conv": ((2 * REACH + 1) * KINDS, CHANNELS), "conv0": (CHANNELS,), "deep": (FRAME * CHANNELS, HIDDEN), "deep0": (HIDDEN,), "out": (HIDDEN, out), "out0": (out,)}


def decoder_shapes(code: int) -> dict[str, tuple[int, ...]]:
    return {"from": (code, HIDDEN), "from0": (HIDDEN,), "to": (HIDDEN, FRAME * KINDS), "to0": (FRAME * KINDS,)}


def encoded(p: dict[str, np.ndarray], frames: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The encoder's outputs, and what its gradient needs."""
    near = _padded(frames.astype(np.int64))
    by_token = np.concatenate([p["conv"].reshape(-1, KINDS, CHANNELS), np.zeros((2 * REACH + 1, 1, CHANNELS))], 1)
    seen = sum(by_token[k][near[:, k : k + FRAME]] for k in range(2 * REACH + 1))
    a = np.maximum(seen + p["conv0"], 0).reshape(len(frames), -1)
    b = np.maximum(a @ p["deep"] + p["deep0"], 0)
    return b @ p["out"] + p["out0"], (near, a, b)


def encoder_gradient(p: dict[str, np.ndarray], g: dict[str, np.ndarray], kept: tuple, d: np.ndarray) -> None:
    """Adds the gradient for the outputs' ``d``."""
    near, a, b = kept
    g["out"] += b.T @ d
    g["out0"] += d.sum(0)
    d = (d @ p["out"].T) * (b > 0)
    g["deep"] += a.T @ d
    g["deep0"] += d.sum(0)
    d = ((d @ p["deep"].T) * (a > 0)).reshape(-1, CHANNELS)
    hot = np.eye(KINDS + 1)[near]
    for k, part in enumerate(g["conv"].reshape(-1, KINDS, CHANNELS)):
        part += hot[:, k : k + FRAME, :KINDS].reshape(-1, KINDS).T @ d
    g["conv0"] += d.sum(0)


def decoded(p: dict[str, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits by row, place and token, and the hidden layer."""
    h = np.maximum(codes @ p["from"] + p["from0"], 0)
    return (h @ p["to"] + p["to0"]).reshape(len(codes), FRAME, KINDS), h


def decoder_loss(p: dict[str, np.ndarray], g: dict[str, np.ndarray] | None, codes: np.ndarray, frames: np.ndarray) -> tuple[float, np.ndarray | None]:
    """Mean cross entropy of the places, summed over rows; adds its gradient and returns that for the codes."""
    logits, h = decoded(p, codes)
    logits -= logits.max(2, keepdims=True)
    chances = np.exp(logits)
    chances /= chances.sum(2, keepdims=True)
    i, j, t = np.arange(len(codes))[:, None], np.arange(FRAME)[None, :], frames.astype(np.int64)
    loss = -np.log(np.maximum(chances[i, j, t], 1e-300)).sum() / FRAME
    if g is None:
        return float(loss), None
    chances[i, j, t] -= 1
    d = chances.reshape(len(codes), -1) / FRAME
    g["to"] += h.T @ d
    g["to0"] += d.sum(0)
    d = (d @ p["to"].T) * (h > 0)
    g["from"] += codes.T @ d
    g["from0"] += d.sum(0)
    return float(loss), d @ p["from"].T


class EncoderNet(Net):
    """Mean squared error of outputs against ``target``."""

    columns = ("frame", "target")

    def __init__(self, out: int):
        super().__init__(encoder_shapes(out))

    def loss(self, p, cols, g):
        y, kept = encoded(p, cols["frame"])
        d = y - cols["target"]
        if g is not None:
            encoder_gradient(p, g, kept, 2 * d / d.shape[1])
        return float((d * d).sum() / d.shape[1])


class DecoderNet(Net):
    """Cross entropy of the tokens given ``code``."""

    columns = ("code", "frame")

    def __init__(self, code: int):
        super().__init__(decoder_shapes(code))

    def loss(self, p, cols, g):
        return decoder_loss(p, g, cols["code"].astype(float), cols["frame"])[0]


class CodecNet(Net):
    """``weight`` times the encoder's error plus the cross entropy of the tokens decoded from its outputs."""

    columns = ("frame", "target")

    def __init__(self, code: int, weight: float = 1.0):
        super().__init__(encoder_shapes(code) | decoder_shapes(code))
        self.weight = weight

    def loss(self, p, cols, g):
        y, kept = encoded(p, cols["frame"])
        d = y - cols["target"]
        loss, back = decoder_loss(p, g, y, cols["frame"])
        if g is not None:
            encoder_gradient(p, g, kept, 2 * self.weight * d / d.shape[1] + back)
        return loss + float(self.weight * (d * d).sum() / d.shape[1])


@dataclass(frozen=True)
class Targets:
    """A whitened projection that keeps a share of the variance: codes of vectors, and vectors of codes."""

    basis: Basis

    @property
    def width(self) -> int:
        return self.basis.loadings.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return (x - self.basis.mean) / self.basis.scale @ self.basis.loadings / np.sqrt(self.basis.variances)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        return codes * np.sqrt(self.basis.variances) @ self.basis.loadings.T * self.basis.scale + self.basis.mean


def fit_targets(df: DataFrame, vector: str, share: float = 0.95) -> Targets:
    """Principal components of ``vector`` up to ``share`` of the variance, each scaled to variance 1."""
    width = df.select(F.size(vector)).first()[0]
    b = fit_projection(df, vector, width, scale=False)
    k = int(np.searchsorted(np.cumsum(b.variances) / b.variances.sum(), share) + 1)
    k = max(1, min(k, int((b.variances > 1e-12 * b.variances[0]).sum())))
    return Targets(Basis(b.mean, b.scale, b.loadings[:, :k], b.variances[:k], meta=b.meta))


@dataclass(frozen=True)
class SequenceModel:
    """A trained network with what turns its outputs into results; ``net`` is of one of the kinds above."""

    net: Net
    params: np.ndarray
    losses: list[float]
    center: float = 0.0
    spread: float = 1.0
    targets: Targets | None = None

    def _mapped(self, df: DataFrame, column: str, output: str, kind: str, f) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m = shared.value
            p = m.net.views(m.params)
            for x in batches:
                parts = [f(m, p, np.stack(x.to_numpy()[a : a + AT_ONCE])) for a in range(0, len(x), AT_ONCE)]
                yield pd.concat([pd.Series(part) for part in parts], ignore_index=True) if parts else pd.Series([])

        return df.withColumn(output, run(F.col(column)))

    def predict(self, df: DataFrame, sequence: str, output: str = "predicted") -> DataFrame:
        """``df`` with the regressor's value of every sequence; a null one is all gaps."""
        out = self._mapped(df.withColumn("_frame", tokens(F.col(sequence))), "_frame", output, "double", lambda m, p, x: encoded(p, x)[0][:, 0] * m.spread + m.center)
        return out.drop("_frame")

    def code(self, df: DataFrame, sequence: str, output: str = "code") -> DataFrame:
        """``df`` with the code of every sequence."""
        out = self._mapped(df.withColumn("_frame", tokens(F.col(sequence))), "_frame", output, "array<double>", lambda m, p, x: list(encoded(p, x)[0]))
        return out.drop("_frame")

    def encode(self, df: DataFrame, sequence: str, output: str = "embedding") -> DataFrame:
        """``df`` with the vector in the target space that every sequence's code stands for."""
        out = self._mapped(df.withColumn("_frame", tokens(F.col(sequence))), "_frame", output, "array<double>", lambda m, p, x: list(m.targets.vectors(encoded(p, x)[0])))
        return out.drop("_frame")

    def decode(self, df: DataFrame, code: str, output: str = "recon") -> DataFrame:
        """``df`` with the sequence of the likeliest token at every place."""
        out = self._mapped(df, code, "_tokens", "array<int>", lambda m, p, x: list(decoded(p, x)[0].argmax(2).astype(np.int32)))
        return out.withColumn(output, tokens_to_sequence(F.col("_tokens"))).drop("_tokens")

    def roundtrip(self, df: DataFrame, sequence: str, output: str = "recon") -> DataFrame:
        """``df`` with what a codec makes of its own code of every sequence."""
        return self.decode(self.code(df, sequence, "_code"), "_code", output).drop("_code")


def _prepared(df: DataFrame, key: str, sequence: str, target) -> DataFrame:
    """``key, frame`` and the targets, not staged: what is trained on is written by batches, all other rows are never made."""
    return df.select(F.col(key).alias("key"), tokens(F.col(sequence)).alias("frame"), *target)


def train_regressor(df: DataFrame, key: str, sequence: str, label: str, **kwargs) -> SequenceModel:
    """A regressor of ``label``; rows without one teach nothing."""
    rows = df.filter(F.col(label).isNotNull())
    mean, dev = rows.agg(F.avg(label), F.stddev_pop(label)).first()
    center, spread = mean or 0.0, dev or 1.0
    data = _prepared(rows, key, sequence, [F.array((F.col(label) - F.lit(float(center))) / F.lit(float(spread))).alias("target")])
    return _trained(EncoderNet(1), data, kwargs, center=float(center), spread=float(spread))


def train_encoder(df: DataFrame, key: str, sequence: str, vector: str, share: float = 0.95, **kwargs) -> SequenceModel:
    """An encoder of sequences into the space of ``vector``, by the whitened components of ``share`` of its variance."""
    targets = fit_targets(df, vector, share)
    return _trained(EncoderNet(targets.width), _with_codes(df, key, sequence, vector, targets, "target"), kwargs, targets=targets)


def train_decoder(df: DataFrame, key: str, sequence: str, code: str, **kwargs) -> SequenceModel:
    """A decoder of codes to sequences."""
    width = df.select(F.size(code)).first()[0]
    return _trained(DecoderNet(width), _prepared(df, key, sequence, [F.col(code).cast("array<double>").alias("code")]), kwargs)


def train_codec(df: DataFrame, key: str, sequence: str, vector: str, share: float = 0.95, weight: float = 1.0, **kwargs) -> SequenceModel:
    """An encoder into the space of ``vector`` and a decoder of its codes, trained together."""
    targets = fit_targets(df, vector, share)
    return _trained(CodecNet(targets.width, weight), _with_codes(df, key, sequence, vector, targets, "target"), kwargs, targets=targets)


def _with_codes(df: DataFrame, key: str, sequence: str, vector: str, targets: Targets, output: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def coded(x: pd.Series) -> pd.Series:
        return pd.Series(list(targets.codes(np.stack(x.to_numpy()).astype(float))) if len(x) else [])

    return _prepared(df, key, sequence, [coded(vector).alias(output)])


def _trained(net: Net, data: DataFrame, options: dict, **what) -> SequenceModel:
    learn, choose, _ = split(data, "key", options.get("seed", 0))
    found: Fitted = fit(net, learn, "key", validation=choose, **options)
    return SequenceModel(net, found.params, found.losses, **what)


def mean_cosine(df: DataFrame, a: str, b: str) -> float:
    """Mean cosine of two vector columns."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return df.agg(F.avg(F.try_divide(dot(F.col(a), F.col(b)), F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b)))))).first()[0]


def _name(prototypes: DataFrame) -> str:
    """The hash of a set of prototypes, ``proto_idx`` and ``junction_aa``."""
    return prototypes.agg(prototype_hash(prototypes).alias("h")).first()[0]


def save_codec(spark: SparkSession, path: str, model: SequenceModel, prototypes: DataFrame) -> None:
    """Write a model with the hash of the prototypes that its target space belongs to."""
    record = model.targets.basis.record() if model.targets else None
    meta = {"kind": type(model.net).__name__, "shapes": {k: list(v) for k, v in model.net.shapes.items()}, "center": model.center, "spread": model.spread, "targets": record, "prototypes": _name(prototypes)}
    save_params(spark, path, model.params, meta)


def load_codec(spark: SparkSession, path: str, prototypes: DataFrame, verify: bool = True) -> SequenceModel:
    """Read a model; ValueError if it belongs to other prototypes."""
    params, meta = load_params(spark, path)
    if verify and meta["prototypes"] != _name(prototypes):
        raise ValueError("the model belongs to other prototypes")
    shapes = meta["shapes"]
    kinds = {"EncoderNet": lambda: EncoderNet(shapes["out0"][0]), "DecoderNet": lambda: DecoderNet(shapes["from"][0]), "CodecNet": lambda: CodecNet(shapes["out0"][0])}
    record = meta["targets"]
    targets = Targets(Basis(**{k: v if k == "meta" or v is None else np.array(v) for k, v in record.items()})) if record else None
    return SequenceModel(kinds[meta["kind"]](), params, [], meta["center"], meta["spread"], targets)
