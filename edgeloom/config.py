"""What the engine can be told."""

from __future__ import annotations

from dataclasses import dataclass

#: Scenarios (gid div 100) of each dataset.
DATASETS = {"all": (0, 1, 2, 3, 4, 5), "gfc": (1, 2, 3, 5), "ydc": (0, 3, 4, 5)}
#: Reserved cluster ids; UNSEEN is the first score too.
ANOMALY, UNSEEN = -1, -2
#: The literal that distances are defined with.
PI = 3.1415926535897


@dataclass(frozen=True)
class Config:
    chunk_length: int
    sketch_bits: int = 1000
    bands: int = 50
    band_rows: int = 20
    seed: int = 23
    snapshot_interval: int = 10_000
    max_edges: int | None = None  # edges that are live at a time over all graphs; None: all
    parallel_graphs: int = 10
    dataset: str = "all"
    odd_chunk_mode: str = "reference"  # or "consistent": a chunk completed by one character is counted as well
    hops: int = 1

    def __post_init__(self):
        if self.hops != 1:
            raise ValueError("shingles are of one hop")
        if self.chunk_length < 4:
            raise ValueError("chunk_length is 4 at least")
        if self.bands * self.band_rows != self.sketch_bits:
            raise ValueError("bands * band_rows is sketch_bits")
        if self.dataset not in DATASETS:
            raise ValueError(f"dataset is one of {', '.join(DATASETS)}")
        if self.max_edges is not None and self.max_edges <= 0:
            object.__setattr__(self, "max_edges", None)
        if self.odd_chunk_mode not in ("reference", "consistent"):
            raise ValueError("odd_chunk_mode is 'reference' or 'consistent'")
        if self.parallel_graphs < 1 or self.snapshot_interval < 1:
            raise ValueError("parallel_graphs and snapshot_interval are positive")

    @property
    def scenarios(self) -> tuple[int, ...]:
        return DATASETS[self.dataset]
