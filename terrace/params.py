"""Training parameters, their defaults and limits, and command-line names."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Defaults, limits and names of the training parameters.
OBJECTIVES = {"logistic": "logistic", "binary": "logistic", "l2": "l2", "rmse": "l2", "reg": "l2"}
DEVICES = {"cpu": "spark", "host": "spark", "gpu": "spark", "cuda": "spark", "spark": "spark"}
FLAGS = {
    "trees": "n_trees", "depth": "depth", "lr": "learning_rate", "bins": "n_bins", "lambda": "l2", "min-child": "min_child", "subsample": "subsample", "colsample": "colsample",
    "unique-bins": "unique_bins", "te-smoothing": "te_smoothing", "cat-hash-buckets": "cat_hash_buckets", "subtract": "subtract", "goss-top": "goss_top", "goss-other": "goss_other",
    "clamp-hessian": "clamp_hessian", "pgbm": "pgbm", "int-hist": "int_hist", "int-scale": "int_scale", "monotone": "monotone", "categorical": "categorical", "bin-sample": "bin_sample", "objective": "objective", "device": "device",
}
IGNORED_FLAGS = ("pack4", "smem-hist", "f16-hist", "gpu", "replicas")
"""They choose kernels and a card; here the plan is Spark's. They take a value, which is read and not used."""


@dataclass(frozen=True)
class Params:
    n_trees: int = 500
    depth: int = 6
    learning_rate: float = 0.1
    n_bins: int = 256
    l2: float = 1.0
    min_child: float = 1e-3
    subsample: float = 1.0
    colsample: float = 1.0
    unique_bins: bool = False
    te_smoothing: float = 10.0
    cat_hash_buckets: int = 0
    subtract: bool = True
    goss_top: float = 0.0
    goss_other: float = 0.1
    clamp_hessian: float = 0.0
    pgbm: bool = False
    int_hist: bool = False
    int_scale: float = 16384.0
    objective: str = "logistic"
    bin_sample: int = 200_000
    categorical: tuple[str, ...] = ()
    monotone: dict[str, int] = field(default_factory=dict)
    device: str = "spark"
    te_folds: int = 5
    seed: int = 0
    sampling: str = "stride"
    """How rows are subsampled: every stride-th, or by a hash of the row's position."""
    goss_mode: str = "exact"
    """The threshold of one-sided sampling: the exact k-th largest gradient, or that of a half-normal distribution (gaussian)."""
    strict_goss: bool = False
    """Sampled rows count 1 (amplified ones the factor) as hessian, whatever the objective."""
    feasibility: str = "each"
    """A split counts the nodes that it leaves enough hessian on both sides (each), or all nodes if any of them is so (any)."""
    clamp_base: bool = True
    """The mean is clamped to (0, 1) for either objective; off: for the logistic one only."""

    def __post_init__(self):
        object.__setattr__(self, "objective", OBJECTIVES.get(str(self.objective).lower()) or _no("objective", self.objective))
        object.__setattr__(self, "device", DEVICES.get(str(self.device).lower()) or _no("device", self.device))
        object.__setattr__(self, "categorical", tuple(self.categorical))
        checks = {
            "n_bins": 2 <= self.n_bins <= 256, "depth": 1 <= self.depth <= 12, "n_trees": self.n_trees >= 1, "l2": self.l2 >= 0, "subsample": 0 < self.subsample <= 1,
            "colsample": 0 < self.colsample <= 1, "goss_top": 0 <= self.goss_top < 1, "goss_other": 0 < self.goss_other <= 1, "clamp_hessian": 0 <= self.clamp_hessian < 0.5,
            "bin_sample": self.bin_sample >= 1, "cat_hash_buckets": self.cat_hash_buckets >= 0, "te_folds": self.te_folds >= 2, "sampling": self.sampling in ("stride", "hash"),
            "goss_mode": self.goss_mode in ("exact", "gaussian"), "feasibility": self.feasibility in ("each", "any"), "monotone": set(self.monotone.values()) <= {-1, 0, 1},
        }
        for name, ok in checks.items():
            if not ok:
                _no(name, getattr(self, name))

    @staticmethod
    def from_flags(tokens: list[str], base: Params | None = None) -> tuple[Params, dict[str, str]]:
        """Parameters from `--name value` pairs, and the pairs that are no parameters. Only 1 and true are true; an unknown form or a missing value raises."""
        kinds = {f.name: f.type for f in fields(Params)}
        found, rest = {}, {}
        if len(tokens) % 2:
            raise ValueError(f"no value for {tokens[-1]}")
        for flag, value in zip(tokens[::2], tokens[1::2]):
            if not flag.startswith("--"):
                raise ValueError(f"not a flag: {flag}")
            name = FLAGS.get(flag[2:])
            if name is None:
                if flag[2:] not in IGNORED_FLAGS:
                    rest[flag[2:]] = value
            elif name == "categorical":
                found[name] = tuple(x for x in value.split(",") if x)
            elif name == "monotone":
                signs = [x for x in value.split(",") if x]
                found[name] = {a: int(b) for a, b in (x.split(":") for x in signs)} if ":" in value else {f"f{i}": int(x) for i, x in enumerate(signs)}
            else:
                found[name] = value in ("1", "true") if kinds[name] == "bool" else {"int": int, "float": float, "str": str}[kinds[name]](value)
        return replace(base or Params(), **found), rest


def _no(name: str, value) -> str:
    raise ValueError(f"{name} can't be {value!r}")
