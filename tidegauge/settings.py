"""Parameters of the log pipeline, with the defaults of a live deployment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Window sizes in seconds, thresholds and source options.

    Windows have to be whole multiples of their slide, and the lookback of the anomaly slide.
    """

    topic: str = "logs.raw"
    batch_size: int = 50
    trigger_seconds: int = 10
    bot_window: int = 60
    bot_slide: int = 10
    anomaly_window: int = 60
    anomaly_slide: int = 10
    anomaly_lookback: int = 300
    bucket: int = 60
    history: int = 10
    use_original_event_time: bool = False
    mode: str = "mock"
    bot_ips: tuple[str, ...] = ("1.2.3.4", "1.1.1.1")
    bot_threshold: float = 0.55
    anomaly_threshold: float = 0.6
    forecast_smoothing: float = 0.2

    def __post_init__(self) -> None:
        if self.bot_window % self.bot_slide or self.anomaly_window % self.anomaly_slide or self.anomaly_lookback % self.anomaly_slide:
            raise ValueError("windows and lookback must be whole multiples of their slide")
        if min(self.bot_slide, self.anomaly_slide, self.bucket, self.history, self.batch_size) < 1:
            raise ValueError("slides, bucket, history and batch size must be positive")

    @property
    def event_retention(self) -> int:
        """Seconds of events that any window still needs."""
        return max(self.bot_window, self.anomaly_window + self.anomaly_lookback)

    @property
    def bucket_retention(self) -> int:
        return self.bucket * (self.history + 2)

    def label(self, task: str) -> str:
        return f"{self.mode}-{task}-v2"
