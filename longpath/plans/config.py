"""Parameters of a path selection, checked on creation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PathConfig:
    """Defaults are those of a pipeline run; ``golden()`` gives the second round's."""

    min_length: int = 20000
    min_phred: int = 0  # 0: from the median of the reads
    max_delta: int = 5
    tile: int = 1000
    block: int = 10
    span: int = 22
    weight: int = 16
    patterns: int = 3
    preset: str = "1011011110110111101101"
    hits: int = 10
    min_unassigned: int = 5
    max_assigned: int = 1
    genome_size: int = 0
    ratio: float = 0.9
    max_paths: int = 5
    occupancy: float = 0.1
    strict: bool = False  # id 0 is no neighbour of id 1

    def __post_init__(self) -> None:
        for name in ("span", "weight", "patterns", "tile", "block"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} has to be positive")
        if self.weight > 31 or self.patterns << (2 * self.weight) >= 1 << 63:
            raise ValueError("codes hold at most 31 selected bases (with several patterns, 30)")
        if self.preset:
            if len(self.preset) != self.span:
                raise ValueError("the seed preset has to be as long as the span")
            if self.preset.count("1") != self.weight:
                raise ValueError("the seed preset has to have as many ones as the weight")

    def for_run(self) -> PathConfig:
        """Itself, if it can run over a read set: that needs a genome size."""
        if self.genome_size < 1:
            raise ValueError("the genome size has to be positive")
        return self

    @property
    def target_bases(self) -> int:
        return int(self.ratio * self.genome_size)

    def golden(self) -> PathConfig:
        from dataclasses import replace

        return replace(self, min_length=0)

    @property
    def seeds(self) -> list[str]:
        from longpath.functions.seeds import seed_patterns

        return seed_patterns(self.preset, self.span, self.weight, self.patterns)


#: Parameters for the derived reads of the test tables: tiles of 100 bases instead of 1000.
SMALL = PathConfig(min_length=500, tile=100, block=2, min_unassigned=3)
