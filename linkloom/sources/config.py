"""Where a job reads and writes, from the environment or from arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

SEED = 42


def _roots(variable: str, default: str):
    return field(default_factory=lambda: os.environ.get(variable, default))


@dataclass(frozen=True)
class Config:
    """Folders may be on any file system that Spark reads."""

    data: str = _roots("LINKLOOM_DATA", "data")
    work: str = _roots("LINKLOOM_WORK", "work")

    def source(self, split: str, number: int) -> str:
        return f"{self.data}/{split}/{split}_source{number}.tsv"

    def truth(self, split: str = "train") -> str:
        return f"{self.data}/{split}/{split}_ground_truth.tsv"

    def step(self, split: str) -> str:
        return f"{self.work}/{split}"
