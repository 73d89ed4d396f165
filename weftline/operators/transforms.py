"""Kernels on image rows (img, h, w, data): a chain of steps runs in one pass over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import augment, image

Step = Callable[[np.ndarray, augment.Draw], np.ndarray]
SCHEMA = "img long, h int, w int, data binary"


def rows_from_vectors(df: DataFrame, key: str, vector: str, n: int = 8) -> DataFrame:
    """Images of ``pixels.from_vectors`` as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (np.arange(n * n)[:, None] + 21 * np.arange(3)) % (n * n)
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, n * n)
            data = np.clip(np.floor(128 + 64 * v), 0, 255).astype(np.uint8)[:, at]
            size = pa.array(np.full(batch.num_rows, n, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), size, size, pa.array([x.tobytes() for x in data], pa.binary())], names=["img", "h", "w", "data"])

    return df.select(F.col(key).cast("long"), vector).mapInArrow(run, SCHEMA)


class Chain:
    """Steps joined by ``|``; ``apply`` is one Python pass however many there are."""

    def __init__(self, *steps: Step, seed: int = 0, epoch: int = 0):
        self.steps, self.seed, self.epoch = steps, seed, epoch

    def __or__(self, other: Chain) -> Chain:
        return Chain(*self.steps, *other.steps, seed=self.seed, epoch=self.epoch)

    def one(self, x: np.ndarray, sample: int) -> np.ndarray:
        for k, step in enumerate(self.steps):
            u = augment.draws(self.seed, self.epoch, sample)
            x = step(x, lambda draw, k=k, u=u: u(f"{k}-{draw}"))
        return x

    def apply(self, images: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [self.one(np.frombuffer(d, np.uint8).reshape(h, w, 3), i) for i, h, w, d in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                sizes = [pa.array([x.shape[k] for x in out], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array([np.ascontiguousarray(x, np.uint8).tobytes() for x in out], pa.binary())], names=["img", "h", "w", "data"])

        return images.select("img", "h", "w", "data").mapInArrow(run, SCHEMA)


#: Steps by name, for lists of (name, arguments): what other libraries call these.
STEPS: dict[str, Callable[..., Step]] = {
    "Resize": lambda w, h, mode="bilinear": lambda x, u: image.resize(x, w, h, mode),
    "CenterCrop": lambda w, h: lambda x, u: x[max(0, (x.shape[0] - h) // 2) :, max(0, (x.shape[1] - w) // 2) :][:h, :w],
    "RandomHorizontalFlip": lambda p=0.5: lambda x, u: x[:, ::-1] if u("flip") < p else x,
    "RandomVerticalFlip": lambda p=0.5: lambda x, u: x[::-1] if u("flip") < p else x,
    "Grayscale": lambda: lambda x, u: image.to_byte(image.gray(x))[..., None].repeat(3, -1),
    "Pad": lambda by, mode="constant", value=0: lambda x, u: np.pad(x, ((by, by), (by, by), (0, 0)), mode, **({"constant_values": value} if mode == "constant" else {})),
    "GaussianBlur": lambda k, sigma=0: lambda x, u: image.blur(x, k, sigma),
    "RandomGaussianBlur": lambda k=5, sigma=0, p=0.5: lambda x, u: augment.random_blur(x, u, k, sigma, p),
    "Invert": lambda: lambda x, u: image.invert(x),
    "AutoContrast": lambda: lambda x, u: image.autocontrast(x),
    "Equalize": lambda: lambda x, u: image.equalize(x),
    "Sharpness": lambda f: lambda x, u: image.sharpness(x, f),
    "Posterize": lambda bits: lambda x, u: image.posterize(x, bits),
    "Solarize": lambda t=128: lambda x, u: image.solarize(x, t),
    "RandomPosterize": lambda bits, p=0.5: lambda x, u: image.posterize(x, bits) if u("p") < p else x,
    "RandomSolarize": lambda t=128, p=0.5: lambda x, u: image.solarize(x, t) if u("p") < p else x,
    "ColorJitter": lambda b=0, c=0, s=0, h=0: lambda x, u: augment.color_jitter(x, u, b, c, s, h),
    "RandomRotation": lambda d: lambda x, u: augment.random_rotation(x, u, d),
    "RandomAffine": lambda *a, **k: lambda x, u: augment.random_affine(x, u, *a, **k),
    "RandomPerspective": lambda d=0.5, p=0.5: lambda x, u: augment.random_perspective(x, u, d, p),
    "AutoAugment": lambda name="imagenet": lambda x, u: augment.auto_augment(x, u, name),
    "RandAugment": lambda n=2, m=9: lambda x, u: augment.rand_augment(x, u, n, m),
    "TrivialAugment": lambda wide=True: lambda x, u: augment.trivial_augment(x, u, wide),
    "Rotate": lambda d, expand=False: lambda x, u: image.rotate(x, d, expand),
}


def chain(*steps: tuple, seed: int = 0, epoch: int = 0) -> Chain:
    """chain(("Resize", 4, 4), ("Invert",)); an unknown name raises."""
    unknown = [s[0] for s in steps if s[0] not in STEPS]
    if unknown:
        raise ValueError(f"unknown transforms: {', '.join(unknown)}")
    return Chain(*(STEPS[name](*args) for name, *args in steps), seed=seed, epoch=epoch)


def preset(training: bool, size: int = 224, seed: int = 0, epoch: int = 0) -> Chain:
    steps = [("Resize", size, size), ("RandomHorizontalFlip",), ("ColorJitter", 0.4, 0.4, 0.4, 0.1)] if training else [("Resize", size + size // 7, size + size // 7), ("CenterCrop", size, size)]
    return chain(*steps, seed=seed, epoch=epoch)


def mosaics(grouped: DataFrame, size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """grouped: (group, data, h, w) lists of up to four images; one mosaic each, black corners where fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                u = augment.draws(seed, epoch, row["group"])
                parts = [np.frombuffer(d, np.uint8).reshape(h, w, 3) for d, h, w in zip(row["data"], row["h"], row["w"], strict=True)]
                out.append({"img": row["group"], "h": size, "w": size, "data": image.mosaic(parts, size, 0.4 + 0.2 * u("x"), 0.4 + 0.2 * u("y")).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("img", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())]))

    return grouped.select("group", "data", "h", "w").mapInArrow(run, SCHEMA)
