"""Parameters of the network clock and of the demand model.

Every operator takes these as arguments; the values below are only defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Clock:
    """Slot grid of the counters: slot length, service day and the nightly pause."""

    slot_minutes: int = 15
    service_start_hour: int = 5
    slots_per_day: int = 80
    holidays: tuple[str, ...] = ()

    @property
    def slots_per_hour(self) -> int:
        return 60 // self.slot_minutes

    @property
    def calendar_slots(self) -> int:
        return 1440 // self.slot_minutes


# Public holidays of the network's city in the reference year.
HOLIDAYS_2026 = (
    "2026-01-01", "2026-03-08", "2026-04-03", "2026-04-06", "2026-05-01",
    "2026-05-14", "2026-05-25", "2026-10-03", "2026-12-25", "2026-12-26",
)

# Share of an event's attendance per slot, relative to its start and its end.
ARRIVAL_KERNEL = {-6: 0.015, -5: 0.025, -4: 0.057, -3: 0.087, -2: 0.115, -1: 0.128, 0: 0.146, 1: 0.010}
DEPARTURE_KERNEL = {0: 0.130, 1: 0.140, 2: 0.109, 3: 0.080, 4: 0.049, 5: 0.025, 6: 0.011, 7: 0.004}
# Part of the demand lost in a closure that returns in the slots after reopening.
REBOUND = (0.39, 0.12, 0.05)


@dataclass(frozen=True)
class ModelParams:
    """Constants of the censored-exponential demand model."""

    arrival_kernel: dict = field(default_factory=lambda: dict(ARRIVAL_KERNEL))
    departure_kernel: dict = field(default_factory=lambda: dict(DEPARTURE_KERNEL))
    rebound: tuple[float, ...] = REBOUND
    rebound_mask_slots: int = 4
    venue_sigma_km: float = 0.6
    venue_radius_km: float = 2.0
    learn_radius_km: float = 1.8
    min_share: float = 0.01
    t_ref: float = 18.0


DEFAULT_CLOCK = Clock()
DEFAULT_PARAMS = ModelParams()
