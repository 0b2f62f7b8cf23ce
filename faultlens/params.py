"""One diagnosis run ("scenario") and its argument checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Scenario:
    """Parameters of one run.

    candidates: components in the study (at least 2); targets: components
    labelled 1 (at least 1, subset of candidates); fault_codes: codes of which
    one must appear in the window; platforms/emissions: tokens 0 and 1 of the
    packed ``platform_emission_maker`` group (both empty = no group filter);
    features: telemetry columns to aggregate.
    """

    candidates: tuple[str, ...]
    targets: tuple[str, ...]
    fault_codes: tuple[str, ...]
    features: tuple[str, ...]
    platforms: tuple[str, ...] = ()
    emissions: tuple[str, ...] = ()
    window_days: int = 7
    split_ratio: float = 0.2
    validation_ratio: float = 0.0   # > 0: three-way split (train / validation / test)
    seed: int = 42
    early_stopping: int = 100
    max_depth: int = 5
    max_iterations: int = 1000
    training_partitions: int = 8    # of the training rows; fixed so that models repeat, more for large tables
    scenario_id: str = "default"

    def __post_init__(self):
        for name in ("candidates", "targets", "fault_codes", "features",
                     "platforms", "emissions"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        self.validate()

    def validate(self) -> None:
        if len(self.candidates) < 2:
            raise ValueError("at least 2 candidate components are needed to build a model")
        if len(self.targets) < 1:
            raise ValueError("at least one target component is needed")
        if not set(self.targets) <= set(self.candidates):
            raise ValueError("target components must be among the candidates")
        if len(self.fault_codes) < 1:
            raise ValueError("at least one fault code is needed")
        if len(self.features) < 1:
            raise ValueError("at least one feature is needed")
        if bool(self.platforms) != bool(self.emissions):
            raise ValueError("platforms and emission levels go together: give both or neither")
        if self.window_days < 0:
            raise ValueError("window_days must be >= 0")
        if self.early_stopping < 0 or self.training_partitions < 1:
            raise ValueError("early_stopping must be >= 0 (0 = off) and training_partitions >= 1")
        if not 0.0 < self.split_ratio < 1.0:
            raise ValueError("split_ratio must be in (0, 1)")
        if self.validation_ratio < 0 or self.split_ratio + self.validation_ratio >= 1.0:
            raise ValueError("validation_ratio must be >= 0 and leave training rows")
