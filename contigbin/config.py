"""Parameters of a binning run, grouped by the operator that reads them (E21, PRJ-16).

The defaults are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


def _whole(name: str, value: int) -> str | None:
    return None if value >= 1 else f"{name} must be 1 or more"


def _share(name: str, value: float) -> str | None:
    return None if 0 < value < 1 else f"{name} must be between 0 and 1"


@dataclass(frozen=True)
class Search:
    """Neighbours: how many of each row, how many in the seed graph, and up to which size all rows are compared."""

    neighbours: int = 48
    seed_neighbours: int = 8
    exact_rows: int = 4_000

    def faults(self) -> list:
        return [_whole("neighbours", self.neighbours), _whole("seed_neighbours", self.seed_neighbours)]


@dataclass(frozen=True)
class Evidence:
    """Random pairs of the null, rounds of the prior and when it has settled, the price of disagreement, the resolution of small graphs."""

    null_draws: int = 600_000
    rounds: int = 3
    settled: float = 0.02
    disagreement: float = 0.25
    resolution: float = 1.05

    def faults(self) -> list:
        return []


@dataclass(frozen=True)
class Training:
    """The autoencoder: widths, what is masked and held out, steps, when to check and stop, weights of graph and embedding."""

    hidden: int = 128
    latent: int = 64
    masked: float = 0.30
    held_out: float = 0.10
    rate: float = 1e-3
    decay: float = 1e-4
    epochs: tuple[int, int] = (40, 100)  # least and most
    check_every: int = 10
    patience: int = 3
    least_rank: float = 0.20
    settled_graph: float = 0.90
    embedding_weight: float = 0.15
    graph_gate: float = 1 / 11

    def faults(self) -> list:
        least, most = self.epochs
        late = None if least <= most else "epochs: the most must not be under the least"
        shares = [_share(n, getattr(self, n)) for n in ("masked", "held_out", "graph_gate")]
        return [_whole("epochs", least), late, _whole("check_every", self.check_every), *shares]


@dataclass(frozen=True)
class Repeats:
    """Terminal repeats: whether contigs that have them stay alone, letters of the seed, least length, greatest share of the contig."""

    alone: bool = True
    seed: int = 21
    least: int = 20
    share: float = 0.20

    def faults(self) -> list:
        return []


@dataclass(frozen=True)
class BinningConfig:
    """All that decides a run's result. Raises ValueError with every fault found."""

    seed: int = 0
    least_length: int = 2_000
    search: Search = field(default_factory=Search)
    evidence: Evidence = field(default_factory=Evidence)
    training: Training = field(default_factory=Training)
    repeats: Repeats = field(default_factory=Repeats)

    def __post_init__(self):
        parts = (self.search, self.evidence, self.training, self.repeats)
        faults = [x for x in (_whole("least_length", self.least_length), *(x for p in parts for x in p.faults())) if x]
        if faults:
            raise ValueError("; ".join(faults))

    def told(self) -> dict:
        """Nested plain values, for the report of a run."""
        return asdict(self)
