"""Shapes of the networks that make frames: the registry by name, and closed forms of their size and cost.

Training stays outside the engine; these describe what `score.infer` is given.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Blocks a stage and channels a stage of the encoders; hidden size and layers of the decoders.
ENCODERS = {"blconv_b": ((3, 3, 3), (128, 256, 512)), "blconv_s": ((1, 1, 1), (64, 128, 256))}
DECODERS = {"bilstm_b": (128, 3), "bilstm_s": (64, 2)}
KERNELS = (1, 3, 5)


@dataclass(frozen=True)
class Cost:
    """Parameters, and multiply-accumulates of convolutions, recurrences and the linear layer (norms and activations aside)."""

    params: int
    macs: int

    def __add__(self, other: Cost) -> Cost:
        return Cost(self.params + other.params, self.macs + other.macs)


def _shape(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"unknown architecture: {name}; known are {', '.join(registry)}")
    return registry[name]


def ratio(encoder: str) -> int:
    """Steps of a recording a frame: every stage halves."""
    return 2 ** len(_shape(ENCODERS, encoder)[0])


def _conv(inputs: int, outputs: int, kernel: int, steps: int, groups: int = 1) -> Cost:
    weights = inputs // groups * kernel * outputs
    return Cost(weights + outputs, weights * steps)


def encoder_cost(channels: int, name: str, steps: int) -> tuple[Cost, int]:
    """Cost of an encoder over `steps` steps, and the frames it makes."""
    cost = Cost(0, 0)
    for blocks, width in zip(*_shape(ENCODERS, name)):
        steps = (steps - 2) // 2 + 1
        cost += _conv(channels, width, 2, steps)
        for _ in range(blocks):
            for kernel in KERNELS:
                cost += _conv(width, 2 * width, kernel, steps, width)
            cost += _conv(2 * width, width, 1, steps)
        channels = width
    return cost, steps


def decoder_cost(width: int, classes: int, name: str, frames: int) -> Cost:
    """Cost of a bidirectional LSTM with a linear layer to the classes."""
    hidden, layers = _shape(DECODERS, name)
    cost = Cost(0, 0)
    for _ in range(layers):
        weights = 2 * 4 * hidden * (width + hidden)
        cost += Cost(weights + 2 * 8 * hidden, weights * frames)
        width = 2 * hidden
    return cost + Cost(width * classes + classes, width * classes * frames)


def network_cost(channels: int, encoder: str, decoder: str, num_concat: int = 0, classes: int = 500, steps: int = 1024) -> Cost:
    """Cost of encoder and decoder over a recording and the `num_concat` joined to it."""
    first, frames = encoder_cost(channels, encoder, steps * (num_concat + 1))
    return first + decoder_cost(_shape(ENCODERS, encoder)[1][-1], classes, decoder, frames)
