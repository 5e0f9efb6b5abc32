"""Where things lie and what is drawn: one place for paths, seeds and dates."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """data: the folder of the tables; out: that of results. Seeds are strings of their names, so that draws don't depend on each other."""

    data: str
    out: str
    seed: int = 20240
    # fixed values: the dates of the reform
    dates: dict[str, str] = field(default_factory=lambda: {"speedy": "2014-08-26", "pilot": "2016-11-16", "national": "2018-10-26"})

    def table(self, name: str) -> str:
        return f"{self.data}/{name}.parquet"

    def result(self, name: str) -> str:
        return f"{self.out}/{name}"

    def seed_of(self, draw: str) -> str:
        return f"{self.seed}-{draw}"
