"""Encoders and analysers by name: a model is made once in each worker process and gets images in small batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[list[bytes]], np.ndarray]


@dataclass(frozen=True)
class Encoder:
    """make() returns a function from image files to vectors; text() (if there is a text tower) one from texts to vectors."""

    name: str
    input_size: int
    dim: int
    make: Callable[[], Model]
    text: Callable[[], Callable[[list[str]], np.ndarray]] | None = None

    @property
    def encoder_id(self) -> str:
        """What features are stored under: another input size or dimension is another encoder."""
        return f"{self.name}@{self.input_size}d{self.dim}"


_known: dict[str, Encoder] = {}
_models: dict[tuple[str, str], Callable] = {}


def register(encoder: Encoder) -> None:
    _known[encoder.name.strip().lower()] = encoder


def encoder(name: str) -> Encoder:
    found = _known.get(name.strip().lower())
    if found is None:
        raise ValueError(f"no encoder {name!r}; there are {sorted(_known)}")
    return found


def once(kind: str, key: str, make: Callable[[], Callable]) -> Callable:
    """The model of this worker process, made at its first use."""
    if (kind, key) not in _models:
        _models[kind, key] = make()
    return _models[kind, key]


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def embed(files: DataFrame, by: Encoder, keep: tuple[str, ...] = ("path",), batch: int = 8) -> DataFrame:
    """keep columns and emb, the normalised vector of each file's content; null with error where the model fails on it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once("image", by.encoder_id, by.make)
        for p in parts:
            for at in range(0, len(p), batch):
                rows = p.iloc[at : at + batch]
                out, vectors, errors = rows[list(keep)].copy(), [], []
                images = [bytes(c) for c in rows["content"]]
                try:
                    vectors, errors = unit_rows(np.asarray(model(images), float)).tolist(), [None] * len(rows)
                except Exception:  # noqa: BLE001  one bad image fails a batch: find out which
                    for image in images:
                        try:
                            vectors.append(unit_rows(np.asarray(model([image]), float))[0].tolist())
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            vectors.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
                out["emb"], out["error"] = vectors, errors
                yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema.fields)
    return files.select(*keep, "content").mapInPandas(run, f"{kinds}, emb array<double>, error string")


def text_vector(by: Encoder, text: str) -> list[float]:
    """The normalised vector of a query text, made on the driver; an encoder without a text tower is an error."""
    if by.text is None:
        raise ValueError(f"{by.name} has no text tower")
    return unit_rows(np.asarray(once("text", by.encoder_id, by.text)([text]), float))[0].tolist()


def analysed(files: DataFrame, make: Callable[[], Callable[[bytes], dict]], schema: str, key: str, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep columns and what an analyser (of faces, persons, expressions) says of each file; made once per worker under `key`."""
    from .images import decoded

    return decoded(files, lambda content: once("analyser", key, make)(content), schema, keep)


# Grey levels from which on a pixel counts as clipped.
DARK, BRIGHT = 2, 253


def pixel_stats(gray: np.ndarray) -> dict[str, float]:
    """Sharpness (variance of the Laplacian, mirrored at the edges) and the share of clipped pixels of a grey image."""
    g = gray.astype(float)
    if not g.size:
        return {"sharpness": 0.0, "exposure_clipped_frac": 0.0}
    p = np.pad(g, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return {"sharpness": float(lap.var()), "exposure_clipped_frac": float(np.mean((g <= DARK) | (g >= BRIGHT)))}


def stub_vectors(images: list[bytes]) -> np.ndarray:
    """Eight numbers from the SHA-1 of a file: for tests and runs without models."""
    return np.array([[b + 1.0 for b in hashlib.sha1(i).digest()[:8]] for i in images])


register(Encoder("stub", 1, 8, lambda: stub_vectors, lambda: lambda texts: stub_vectors([t.encode() for t in texts])))
