"""Small regression networks in NumPy: layers with forward and backward passes, trained with Adam.

A network is a list of layers; weights live in the layers' ``p`` dicts, so that saving is one ``.npz``.
"""

from __future__ import annotations

import io
from math import sqrt

import numpy as np

from pulsegrid.config import DEFAULT, Config

_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)  # Abramowitz and Stegun 7.1.26


def erf(x: np.ndarray) -> np.ndarray:
    """Error function within 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = np.zeros_like(t)
    for c in reversed(_ERF):
        poly = (poly + c) * t
    return np.sign(x) * (1 - poly * np.exp(-x * x))


class Layer:
    """p: parameters, g: gradients of the last backward pass, s: state that isn't trained."""

    def __init__(self):
        self.p: dict[str, np.ndarray] = {}
        self.g: dict[str, np.ndarray] = {}
        self.s: dict[str, np.ndarray] = {}


class Linear(Layer):
    def __init__(self, n_in: int, n_out: int, rng: np.random.Generator):
        super().__init__()
        bound = 1 / sqrt(n_in)
        self.p = {"w": rng.uniform(-bound, bound, (n_out, n_in)), "b": rng.uniform(-bound, bound, n_out)}

    def forward(self, x, train):
        self._x = x
        return x @ self.p["w"].T + self.p["b"]

    def backward(self, d):
        self.g = {"w": d.T @ self._x, "b": d.sum(0)}
        return d @ self.p["w"]


class Conv1d(Layer):
    """(B, C, T) -> (B, K, T'), zero padding."""

    def __init__(self, n_in: int, n_out: int, size: int, rng: np.random.Generator, stride: int = 1):
        super().__init__()
        bound = 1 / sqrt(n_in * size)
        self.size, self.stride, self.pad = size, stride, size // 2
        self.p = {"w": rng.uniform(-bound, bound, (n_out, n_in, size)), "b": rng.uniform(-bound, bound, n_out)}

    def forward(self, x, train):
        wide = np.pad(x, ((0, 0), (0, 0), (self.pad, self.pad)))
        self._shape = wide.shape
        self._cols = np.lib.stride_tricks.sliding_window_view(wide, self.size, 2)[:, :, :: self.stride]
        return np.einsum("bctk,ock->bot", self._cols, self.p["w"], optimize=True) + self.p["b"][:, None]

    def backward(self, d):
        self.g = {"w": np.einsum("bot,bctk->ock", d, self._cols, optimize=True), "b": d.sum((0, 2))}
        cols = np.einsum("bot,ock->bctk", d, self.p["w"], optimize=True)
        out = np.zeros(self._shape)
        for k in range(self.size):
            out[:, :, k : k + self.stride * cols.shape[2] : self.stride] += cols[..., k]
        return out[:, :, self.pad : out.shape[2] - self.pad]


class BatchNorm(Layer):
    """Over all axes but the second."""

    def __init__(self, n: int):
        super().__init__()
        self.p = {"scale": np.ones(n), "shift": np.zeros(n)}
        self.s = {"mean": np.zeros(n), "var": np.ones(n)}

    def forward(self, x, train):
        axes = tuple(a for a in range(x.ndim) if a != 1)
        self._axes, self._view = axes, (1, -1) + (1,) * (x.ndim - 2)
        if train:
            mean, var, n = x.mean(axes), x.var(axes), x.size / x.shape[1]
            for k, v in (("mean", mean), ("var", var * n / max(n - 1, 1))):
                self.s[k] = 0.9 * self.s[k] + 0.1 * v
        else:
            mean, var = self.s["mean"], self.s["var"]
        self._inv = 1 / np.sqrt(var + 1e-5)
        self._hat = (x - mean.reshape(self._view)) * self._inv.reshape(self._view)
        return self._hat * self.p["scale"].reshape(self._view) + self.p["shift"].reshape(self._view)

    def backward(self, d):
        self.g = {"scale": (d * self._hat).sum(self._axes), "shift": d.sum(self._axes)}
        h = d * self.p["scale"].reshape(self._view)
        centred = h - h.mean(self._axes, keepdims=True) - self._hat * (h * self._hat).mean(self._axes, keepdims=True)
        return centred * self._inv.reshape(self._view)


class Gelu(Layer):
    def forward(self, x, train):
        self._x = x
        return 0.5 * x * (1 + erf(x / sqrt(2)))

    def backward(self, d):
        x = self._x
        return d * (0.5 * (1 + erf(x / sqrt(2))) + x * np.exp(-x * x / 2) / sqrt(2 * np.pi))


class Dropout(Layer):
    def __init__(self, rate: float, rng: np.random.Generator):
        super().__init__()
        self.rate, self._rng = rate, rng

    def forward(self, x, train):
        self._keep = (self._rng.random(x.shape) >= self.rate) / (1 - self.rate) if train and self.rate else 1.0
        return x * self._keep

    def backward(self, d):
        return d * self._keep


class Pool(Layer):
    """Mean over time."""

    def forward(self, x, train):
        self._n = x.shape[2]
        return x.mean(2)

    def backward(self, d):
        return np.repeat(d[:, :, None] / self._n, self._n, 2)


class Stack(Layer):
    def __init__(self, *layers):
        super().__init__()
        self.layers = layers

    def forward(self, x, train=False):
        for layer in self.layers:
            x = layer.forward(x, train)
        return x

    def backward(self, d):
        for layer in reversed(self.layers):
            d = layer.backward(d)
        return d

    def leaves(self):
        for layer in self.layers:
            yield from layer.leaves() if isinstance(layer, Stack) else (layer,)


def save(net: Stack) -> bytes:
    """Weights and states as the bytes of an .npz."""
    out = io.BytesIO()
    np.savez(out, **{f"{i}.{kind}.{k}": v for i, x in enumerate(net.leaves()) for kind in ("p", "s") for k, v in getattr(x, kind).items()})
    return out.getvalue()


def load(net: Stack, data: bytes) -> Stack:
    held = np.load(io.BytesIO(data))
    for i, x in enumerate(net.leaves()):
        for kind in ("p", "s"):
            for k in getattr(x, kind):
                getattr(x, kind)[k] = held[f"{i}.{kind}.{k}"]
    return net


def parameters(net: Stack) -> int:
    return sum(v.size for x in net.leaves() for v in x.p.values())


class Adam:
    """Adam with L2 weight decay added to the gradients."""

    def __init__(self, net: Stack, rate: float = 1e-3, decay: float = 1e-4):
        self.net, self.rate, self.decay, self.t = net, rate, decay, 0
        self.m = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in x.p.items()} for x in net.leaves()]

    def step(self) -> None:
        self.t += 1
        for x, moments in zip(self.net.leaves(), self.m, strict=True):
            for k, (m, v) in moments.items():
                g = x.g[k] + self.decay * x.p[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x.p[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


# ---- spectra and readouts ----


def band(config: Config = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """In-band bins of the networks' FFT and their BPM."""
    bpm = np.fft.rfftfreq(config.net_nfft, 1 / config.fps) * 60
    at = np.flatnonzero((bpm >= config.net_hr_min) & (bpm <= config.net_hr_max))
    return at, bpm[at]


def spectral_input(x: np.ndarray, config: Config = DEFAULT) -> np.ndarray:
    """(B, C, T) -> (B, C, F): log power in the band, each row normalised (periodic Hann, unbiased deviation)."""
    n = x.shape[-1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.log1p(np.abs(np.fft.rfft(x * hann, config.net_nfft, axis=-1)[..., band(config)[0]]) ** 2)
    power -= power.mean(-1, keepdims=True)
    return power / (power.std(-1, ddof=1, keepdims=True) + 1e-6)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def local_readout(p: np.ndarray, bpm: np.ndarray, half: float) -> np.ndarray:
    """Mean BPM around the highest bin."""
    near = np.abs(bpm - bpm[p.argmax(-1)][:, None]) <= half
    w = p * near
    return (w * bpm).sum(-1) / (w.sum(-1) + 1e-9)


def gaussian_target(hr: np.ndarray, bpm: np.ndarray, sigma: float) -> np.ndarray:
    w = np.exp(-0.5 * ((bpm - hr[:, None]) / sigma) ** 2)
    return w / (w.sum(-1, keepdims=True) + 1e-9)


def confidence(p: np.ndarray, bpm: np.ndarray, hr: np.ndarray, within: float = DEFAULT.within_bpm) -> np.ndarray:
    """Probability near the prediction."""
    return (p * (np.abs(bpm - hr[:, None]) <= within)).sum(-1)


def smooth_l1(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes."""
    return np.where(np.abs(e) < 1, 0.5 * e * e, np.abs(e) - 0.5), np.clip(e, -1, 1)


def network_input(colours: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(B, R, T, 3) and (B, R, T) -> (B, 4R, T): missing colours are 0, the count is a fourth channel, rows are z-scored."""
    x = np.concatenate([np.nan_to_num(colours), counts[..., None]], -1).transpose(0, 1, 3, 2)
    x = x.reshape(len(x), -1, x.shape[-1])
    return (x - x.mean(-1, keepdims=True)) / (x.std(-1, keepdims=True) + 1e-6)


# ---- the three networks ----


def _conv_stack(n_in: int, width: int, size: int, stride: int, drop: float, rng) -> list[Layer]:
    out: list[Layer] = []
    for k in range(3):
        out += [Conv1d(n_in if k == 0 else width, width, size, rng, stride), BatchNorm(width), Gelu()]
        if k < 2:
            out.append(Dropout(drop, rng))
    return out


class PulseNet(Stack):
    """Heart rate (and, with ``n_features``, hemoglobin) from a spectral and a temporal branch."""

    def __init__(self, channels: int = 12, *, width: int = 96, drop: float = 0.3, n_features: int = 0, seed: int = 0, config: Config = DEFAULT):
        rng = np.random.default_rng(seed)
        self.config, self.width = config, width
        self.bpm = band(config)[1]
        self.spectral = Stack(*_conv_stack(channels, width, 5, 1, drop, rng))
        self.temporal = Stack(*_conv_stack(channels, width, 7, 2, drop, rng), Pool())
        middle = [] if n_features else [Dropout(drop, rng)]
        self.fusion = Stack(Conv1d(2 * width, width, 1, rng), BatchNorm(width), Gelu(), *middle, Conv1d(width, 1, 1, rng))
        own = [self.spectral, self.temporal, self.fusion]
        self.head = None
        if n_features:
            self.head = Stack(Linear(width + n_features, 64, rng), BatchNorm(64), Gelu(), Dropout(drop, rng), Linear(64, 32, rng), BatchNorm(32), Gelu(), Dropout(drop, rng), Linear(32, 1, rng))
            own.append(self.head)
        super().__init__(*own)

    def forward(self, x, train=False, features=None):
        """(B, C, T) -> BPM, logits, probabilities, hemoglobin (or None)."""
        spectral = self.spectral.forward(spectral_input(x, self.config), train)
        pooled = self.temporal.forward(x, train)
        wide = np.repeat(pooled[:, :, None], spectral.shape[2], 2)
        self._logits = self.fusion.forward(np.concatenate([spectral, wide], 1), train)[:, 0]
        self._p = softmax(self._logits)
        hb = self.head.forward(np.concatenate([pooled, features], 1), train)[:, 0] if self.head else None
        return local_readout(self._p, self.bpm, self.config.readout_bpm), self._logits, self._p, hb

    def loss(self, hr: np.ndarray, out, *, l1: float = 0.2, ce: float = 1.0, hb: np.ndarray | None = None, hb_weight: float = 0.1, cap_k: float | None = None) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Loss and its slopes by logits and hemoglobin: SmoothL1 of the rate, soft cross-entropy with a Gaussian
        target, SmoothL1 of hemoglobin; ``cap_k`` caps each row's parts at lower median + k * (lower MAD + 1e-6)."""
        bpm, logits, p, hb_out = out
        n = len(hr)
        near = np.abs(self.bpm - self.bpm[p.argmax(-1)][:, None]) <= self.config.readout_bpm
        w = p * near
        total = w.sum(-1, keepdims=True) + 1e-9
        e, slope = smooth_l1(bpm - hr)
        target = gaussian_target(hr, self.bpm, self.config.target_sigma_bpm)
        log_p = logits - logits.max(-1, keepdims=True)
        log_p = log_p - np.log(np.exp(log_p).sum(-1, keepdims=True))
        cross = -(target * log_p).sum(-1)
        on_e, on_c = np.ones(n), np.ones(n)
        if cap_k is not None:
            for v, on in ((e, on_e), (cross, on_c)):
                middle = np.sort(v)[(n - 1) // 2]
                cap = middle + cap_k * (np.sort(np.abs(v - middle))[(n - 1) // 2] + 1e-6)
                on[v > cap] = 0
                np.minimum(v, cap, out=v)
        d_p = l1 * (slope * on_e)[:, None] / n * near * (self.bpm - bpm[:, None]) / total
        d_logits = p * (d_p - (d_p * p).sum(-1, keepdims=True)) + ce * (p - target) * on_c[:, None] / n
        value, d_hb = l1 * e.mean() + ce * cross.mean(), None
        if hb is not None and hb_out is not None:
            f, slope = smooth_l1(hb_out - hb)
            value, d_hb = value + hb_weight * f.mean(), hb_weight * slope / n
        return float(value), d_logits, d_hb

    def backward(self, d_logits, d_hb=None):
        d = self.fusion.backward(d_logits[:, None])
        pooled = d[:, self.width :].sum(2)
        if d_hb is not None and self.head:
            pooled = pooled + self.head.backward(d_hb[:, None])[:, : self.width]
        self.spectral.backward(d[:, : self.width])
        self.temporal.backward(pooled)


class HbNet(Stack):
    """Hemoglobin from colour features."""

    def __init__(self, n_in: int = 60, *, width: int = 128, drop: float = 0.3, seed: int = 0):
        rng = np.random.default_rng(seed)
        layers: list[Layer] = []
        sizes = [n_in, width, width // 2, width // 4]
        for a, b in zip(sizes, sizes[1:], strict=False):
            layers += [Linear(a, b, rng), BatchNorm(b), Gelu(), Dropout(drop, rng)]
        super().__init__(*layers, Linear(sizes[-1], 1, rng))

    def predict(self, x, train=False):
        return self.forward(x, train)[:, 0]

    @staticmethod
    def loss(pred: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray]:
        """1 - correlation + 0.1 * MSE (MSE alone under two rows), and its slope."""
        n, e = len(pred), pred - truth
        if n < 2:
            return float((e * e).mean()), 2 * e / n
        x, y = pred - pred.mean(), truth - truth.mean()
        sx, sy = np.sqrt((x * x).sum()) + 1e-8, np.sqrt((y * y).sum()) + 1e-8
        r = (x * y).sum() / (sx * sy)
        d_r = y / (sx * sy) - r * x / (sx * sx)
        return float(1 - r + 0.1 * (e * e).mean()), -(d_r - d_r.mean()) + 0.2 * e / n
