"""Random policies over the kernels. Every draw is u(draw) in [0, 1), a function of seed, epoch and sample."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from weftline.functions import image as im

Draw = Callable[[str], float]


def draws(seed: int, epoch: int, sample: int) -> Draw:
    """The same numbers as ``rng.uniform``."""
    return lambda draw: int(hashlib.md5(f"{seed}:{epoch}:{sample}:{draw}".encode()).hexdigest()[:13], 16) / 16.0**13


#: Sub-policies as (operation, probability, magnitude) pairs.
POLICIES = {
    "imagenet": """Posterize .4 8 Rotate .6 9; Solarize .6 5 AutoContrast .6 0; Equalize .8 0 Equalize .6 0; Posterize .6 7 Posterize .6 6; Equalize .4 0 Solarize .2 4;
        Equalize .4 0 Rotate .8 8; Solarize .6 3 Equalize .6 0; Posterize .8 5 Equalize 1 0; Rotate .2 3 Solarize .6 8; Equalize .6 0 Posterize .4 6;
        Rotate .8 8 Color .4 0; Rotate .4 9 Equalize .6 0; Equalize 0 0 Equalize .8 0; Invert .6 0 Equalize 1 0; Color .6 4 Contrast 1 8;
        Rotate .8 8 Color 1 2; Color .8 8 Solarize .8 7; Sharpness .4 7 Invert .6 0; ShearX .6 5 Equalize 1 0; Color .4 0 Equalize .6 0""",
    "cifar10": """Invert .1 0 Contrast .2 6; Rotate .7 2 TranslateX .3 9; Sharpness .8 1 Sharpness .9 3; ShearY .5 8 TranslateY .7 9; AutoContrast .5 0 Equalize .9 0;
        ShearY .2 7 Posterize .3 7; Color .4 3 Brightness .6 7; Sharpness .3 9 Brightness .7 9; Equalize .6 0 Equalize .5 0; Contrast .6 7 Sharpness .6 5;
        Color .7 7 TranslateX .5 8; Equalize .3 0 AutoContrast .4 0; TranslateY .4 3 Sharpness .2 6; Brightness .9 6 Color .2 8; Solarize .5 2 Invert 0 0;
        Equalize .2 0 AutoContrast .6 0; Equalize .2 0 Equalize .6 0; Color .9 9 Equalize .6 0; AutoContrast .8 0 Solarize .2 8; Brightness .1 3 Color .7 0""",
    "svhn": """ShearX .9 4 Invert .2 0; ShearY .9 8 Invert .7 0; Equalize .6 0 Solarize .6 6; Invert .9 0 Equalize .6 0; Equalize .6 0 Rotate .9 3;
        ShearX .9 4 AutoContrast .8 0; ShearY .9 8 Invert .4 0; ShearY .9 5 Solarize .2 6; Invert .9 0 AutoContrast .8 0; Equalize .6 0 Rotate .9 3;
        ShearX .9 4 Solarize .3 3; ShearY .8 8 Invert .7 0; Equalize .9 0 TranslateY .6 6; Invert .9 0 Equalize .6 0; Contrast .3 3 Rotate .8 4""",
}


def policy(name: str) -> list[list[tuple[str, float, float]]]:
    out = []
    for sub in POLICIES[name.lower()].split(";"):
        w = sub.split()
        out.append([(w[k], float(w[k + 1]), float(w[k + 2])) for k in range(0, len(w), 3)])
    return out


def auto_operation(x: np.ndarray, name: str, m: float, u: float) -> np.ndarray:
    """An operation of AutoAugment at magnitude m of 10; u draws the angle."""
    up = 1 + 0.09 * m
    table = {
        "Posterize": lambda: im.posterize(x, int(max(1.0, 8 - m / 2))), "Solarize": lambda: im.solarize(x, int(256 - 25.6 * m) & 255), "Rotate": lambda: im.rotate(x, (2 * u - 1) * 3 * m),
        "Invert": lambda: im.invert(x), "AutoContrast": lambda: im.autocontrast(x), "Equalize": lambda: im.equalize(x), "Color": lambda: im.color(x, up), "Brightness": lambda: im.brightness(x, up),
        "Contrast": lambda: im.contrast(x, up), "Sharpness": lambda: im.sharpness(x, up), "ShearX": lambda: im.shear_x(x, 0.03 * m), "ShearY": lambda: im.shear_y(x, 0.03 * m),
        "TranslateX": lambda: im.translate_x(x, 0.045 * m), "TranslateY": lambda: im.translate_y(x, 0.045 * m),
    }
    return table[name]()


def auto_augment(x: np.ndarray, u: Draw, name: str = "imagenet") -> np.ndarray:
    subs = policy(name)
    for k, (op, p, m) in enumerate(subs[int(u("policy") * len(subs))]):
        if u(f"apply{k}") < p:
            x = auto_operation(x, op, m, u(f"angle{k}"))
    return x


RAND_OPERATIONS = ("Identity", "AutoContrast", "Equalize", "Rotate", "Solarize", "Color", "Posterize", "Contrast", "Brightness", "Sharpness", "ShearX", "ShearY", "TranslateX", "TranslateY")


def rand_augment(x: np.ndarray, u: Draw, n: int = 2, m: float = 9) -> np.ndarray:
    """n of 14 operations at magnitude m of 30."""
    f = m / 30
    enhance = 1 + (f - 0.5) * 0.8
    for k in range(n):
        name = RAND_OPERATIONS[int(u(f"op{k}") * len(RAND_OPERATIONS))]
        sign = 1 if u(f"sign{k}") < 0.5 else -1
        table = {
            "Identity": lambda x=x: x, "AutoContrast": lambda x=x: im.autocontrast(x), "Equalize": lambda x=x: im.equalize(x), "Rotate": lambda x=x, s=sign: im.rotate(x, s * 30 * f),
            "Solarize": lambda x=x: im.solarize(x, int(256 - 256 * f), inclusive=True), "Color": lambda x=x: im.color(x, enhance), "Posterize": lambda x=x: im.posterize(x, max(1, 8 - int(4 * f))),
            "Contrast": lambda x=x: im.contrast(x, enhance, mean=128), "Brightness": lambda x=x: im.brightness(x, enhance), "Sharpness": lambda x=x: im.sharpness(x, enhance),
            "ShearX": lambda x=x, s=sign: im.shear_x(x, s * 0.3 * f), "ShearY": lambda x=x, s=sign: im.shear_y(x, s * 0.3 * f), "TranslateX": lambda x=x, s=sign: im.translate_x(x, s * 0.45 * f), "TranslateY": lambda x=x, s=sign: im.translate_y(x, s * 0.45 * f),
        }
        x = table[name]()
    return x


TRIVIAL_STANDARD = RAND_OPERATIONS[:10]


def trivial_augment(x: np.ndarray, u: Draw, wide: bool = True) -> np.ndarray:
    """One operation at a uniform magnitude."""
    names = RAND_OPERATIONS if wide else TRIVIAL_STANDARD
    name, m = names[int(u("op") * len(names))], u("magnitude")
    enhance = 0.1 + 1.8 * m
    table = {
        "Identity": lambda: x, "AutoContrast": lambda: im.autocontrast(x, flat_stays=True), "Equalize": lambda: im.equalize(x), "Rotate": lambda: im.rotate(x, 30 * (2 * m - 1)),
        "Solarize": lambda: im.solarize(x, int((1 - m) * 255)), "Color": lambda: im.color(x, enhance), "Posterize": lambda: im.posterize(x, 4 + int(4 * m)), "Contrast": lambda: im.contrast(x, enhance),
        "Brightness": lambda: im.brightness(x, enhance), "Sharpness": lambda: im.sharpness(x, enhance), "ShearX": lambda: im.shear_x(x, (m - 0.5) * 0.6), "ShearY": lambda: im.shear_y(x, (m - 0.5) * 0.6),
        "TranslateX": lambda: im.translate_x(x, (m - 0.5) * 0.45), "TranslateY": lambda: im.translate_y(x, (m - 0.5) * 0.45),
    }
    return table[name]()


def color_jitter(x: np.ndarray, u: Draw, b: float = 0, c: float = 0, s: float = 0, h: float = 0) -> np.ndarray:
    """Factors uniform around 1, hue around 0, in an order that is drawn too."""
    factor = lambda name, by: max(0.0, 1 - by) + u(name) * (1 + by - max(0.0, 1 - by))
    steps = {
        "brightness": (b, lambda x: im.brightness(x, factor("brightness", b))), "contrast": (c, lambda x: im.contrast(x, factor("contrast", c), per_channel=True)),
        "saturation": (s, lambda x: im.saturate(x, factor("saturation", s))), "hue": (h, lambda x: im.shift_hue(x, (2 * u("hue") - 1) * h * 360)),
    }
    for name in sorted(steps, key=lambda n: u(f"order-{n}")):
        if steps[name][0]:
            x = steps[name][1](x)
    return x


def random_rotation(x: np.ndarray, u: Draw, degrees: float) -> np.ndarray:
    return im.rotate(x, (2 * u("angle") - 1) * degrees)


def random_affine(x: np.ndarray, u: Draw, degrees: float = 0, tx: float = 0, ty: float = 0, scale=(1.0, 1.0), shear: float = 0) -> np.ndarray:
    h, w = x.shape[:2]
    sym = lambda d, by: (2 * u(d) - 1) * by
    return im.affine(x, sym("angle", degrees), sym("tx", tx * w), sym("ty", ty * h), scale[0] + u("scale") * (scale[1] - scale[0]), sym("shear", shear))


def random_perspective(x: np.ndarray, u: Draw, distortion: float = 0.5, p: float = 0.5) -> np.ndarray:
    if u("p") >= p:
        return x
    h, w = x.shape[:2]
    corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    moves = np.array([[(2 * u(f"x{k}") - 1) * distortion * w / 2, (2 * u(f"y{k}") - 1) * distortion * h / 2] for k in range(4)])
    return im.perspective(x, corners + moves)


def random_blur(x: np.ndarray, u: Draw, k: int = 5, sigma: float = 0, p: float = 0.5) -> np.ndarray:
    return im.blur(x, k, sigma) if u("p") < p else x
