"""Run parameters.

The reference imports its parameters from a module it does not ship; every one of
them is a field here with a default of our own choosing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Margin triples (ms, mc, mn), compared with *squared* distances of unit vectors.
DEFAULT_MARGINS: tuple[tuple[float, float, float], ...] = (
    (1.8, 2.0, 2.2),
    (1.7, 2.1, 2.3),
    (1.9, 2.05, 2.1),
)


@dataclass(frozen=True)
class TupleConfig:
    seed: str = "0"                      # text seed of every hash draw
    margins: tuple[tuple[float, float, float], ...] = DEFAULT_MARGINS
    batch_size: int = 1024
    drop_remainder: bool = True          # trainer drops the last partial batch
    hidden: tuple[int, ...] = (16, 12, 8)  # tower widths after the input layer
    lr: float = 0.005
    epochs: int = 2
    exclude_self: bool = False           # sampled similar item may be the anchor itself
    init_seed: int = 7                   # weight initialisation seed
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def margin(self) -> tuple[float, float, float]:
        return self.margins[0]
