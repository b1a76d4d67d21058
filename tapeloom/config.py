"""Settings of backtests: frozen dataclasses with range checks, read from and written to YAML-like mappings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass


def _within(name: str, value: float, low: float, high: float | None = None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be {'at least ' + str(low) if high is None else f'from {low} to {high}'}, not {value}")


SLIPPAGE = ("fixed", "percentage", "volume_dependent", "almgren_chriss")
COMMISSION = ("zero", "fixed", "per_share", "percentage", "tiered")
MODES = ("vectorized", "event_driven", "hybrid")
VALIDATION = ("walk_forward", "purged_kfold", "combinatorial_purged")
BACKENDS, DEVICES = ("numpy", "jax", "numba"), ("cpu", "gpu")
QUEUES, RESOLUTIONS = ("fifo", "priority"), ("second", "minute", "daily")


def _one_of(name: str, value: str, known: tuple[str, ...]) -> None:
    if value not in known:
        raise ValueError(f"unknown {name} {value!r}; one of {known}")


@dataclass(frozen=True)
class SlippageConfig:
    model: str = "volume_dependent"
    base_bps: float = 5.0
    impact_factor: float = 0.1

    def __post_init__(self):
        if self.model not in SLIPPAGE:
            raise ValueError(f"unknown slippage model {self.model!r}")
        _within("base_bps", self.base_bps, 0)
        _within("impact_factor", self.impact_factor, 0)


@dataclass(frozen=True)
class CommissionConfig:
    model: str = "tiered"
    min_commission: float = 1.0
    per_share: float = 0.005
    max_pct: float = 0.01

    def __post_init__(self):
        if self.model not in COMMISSION:
            raise ValueError(f"unknown commission model {self.model!r}")
        _within("min_commission", self.min_commission, 0)
        _within("per_share", self.per_share, 0)
        _within("max_pct", self.max_pct, 0, 1)


@dataclass(frozen=True)
class VectorizedConfig:
    """Kept so that settings can be carried over; Spark generates its own code."""

    backend: str = "jax"
    device: str = "cpu"
    precision: str = "float32"
    parallel_strategies: int = 1

    def __post_init__(self):
        _one_of("backend", self.backend, BACKENDS)
        _one_of("device", self.device, DEVICES)
        _within("parallel_strategies", self.parallel_strategies, 1)


@dataclass(frozen=True)
class EventDrivenConfig:
    queue_type: str = "priority"
    time_resolution: str = "minute"
    process_after_close: bool = True

    def __post_init__(self):
        _one_of("queue type", self.queue_type, QUEUES)
        _one_of("time resolution", self.time_resolution, RESOLUTIONS)


@dataclass(frozen=True)
class ExecutionConfig:
    slippage: SlippageConfig = field(default_factory=SlippageConfig)
    commission: CommissionConfig = field(default_factory=CommissionConfig)
    market_impact: bool = True
    fill_ratio: float = 0.95

    def __post_init__(self):
        _within("fill_ratio", self.fill_ratio, 0, 1)


@dataclass(frozen=True)
class WalkForwardConfig:
    train_period: int = 252
    test_period: int = 63
    min_trades: int = 30
    anchored: bool = False

    def __post_init__(self):
        for name in ("train_period", "test_period", "min_trades"):
            _within(name, getattr(self, name), 1)


@dataclass(frozen=True)
class CrossValidationConfig:
    method: str = "purged_kfold"
    n_splits: int = 5
    embargo_period: int = 5

    def __post_init__(self):
        _one_of("validation method", self.method, VALIDATION)
        _within("n_splits", self.n_splits, 2)
        _within("embargo_period", self.embargo_period, 0)


@dataclass(frozen=True)
class ValidationConfig:
    walk_forward: WalkForwardConfig = field(default_factory=WalkForwardConfig)
    cross_validation: CrossValidationConfig = field(default_factory=CrossValidationConfig)


@dataclass(frozen=True)
class EngineConfig:
    """mode is what engine.run takes unless it's told another: hybrid chooses by the strategy."""

    mode: str = "hybrid"
    default_capital: float = 100_000.0
    currency: str = "USD"
    vectorized: VectorizedConfig = field(default_factory=VectorizedConfig)
    event_driven: EventDrivenConfig = field(default_factory=EventDrivenConfig)
    execution: ExecutionConfig = field(default_factory=ExecutionConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)

    def __post_init__(self):
        _one_of("mode", self.mode, MODES)
        _within("default_capital", self.default_capital, 0)

    @property
    def slippage(self) -> SlippageConfig:
        return self.execution.slippage

    @property
    def commission(self) -> CommissionConfig:
        return self.execution.commission

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: dict) -> EngineConfig:
        """Accepts the keys at the top or below `engine`; slippage and commission also outside of `execution`."""
        raw = dict(raw.get("engine", raw))
        costs = {k: raw.pop(k) for k in ("slippage", "commission") if k in raw}
        if costs:
            raw["execution"] = dict(raw.get("execution", {})) | costs
        return _build(cls, raw)

    def to_yaml(self, path: str) -> None:
        import yaml

        with open(path, "w") as f:
            yaml.safe_dump(self.to_dict(), f)

    @classmethod
    def from_yaml(cls, path: str) -> EngineConfig:
        import yaml

        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f) or {})


def _build(cls, raw: dict):
    known = {f.name: f for f in fields(cls)}
    if unknown := set(raw) - set(known):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    made = {}
    for name, value in raw.items():
        default = known[name].default_factory if callable(known[name].default_factory) else None
        made[name] = _build(default, value) if default and is_dataclass(default) and isinstance(value, dict) else value
    return cls(**made)


def config_warnings(config: EngineConfig) -> list[str]:
    """What is legal but likely a mistake."""
    out = []
    if config.default_capital <= 0:
        out.append("the initial capital isn't positive")
    if config.slippage.base_bps < 0:
        out.append("the slippage is negative")
    if config.commission.min_commission < 0:
        out.append("the least commission is negative")
    if config.validation.walk_forward.train_period <= config.validation.walk_forward.test_period:
        out.append("the train period isn't longer than the test period")
    return out
