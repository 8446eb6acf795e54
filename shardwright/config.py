"""Parameter objects with their bounds (P18), checked on the driver.

Every operator takes plain values; these dataclasses collect the values a run
uses, reject impossible combinations early and round-trip through a JSON
column (S13).
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

# Results depend on exactly these.
UINT16_MAX = 65535            # largest id a uint16 shard can hold
SPLIT_TRAIN_RATIO = 0.95      # train share of a shard set
MATRIX_LR = 0.04              # matrix-group rate at the base learning rate
RATE_WINDOW_SECONDS = 30.0    # rolling-rate window of the telemetry meters
RENDER_INTERVAL_SECONDS = 0.5  # minimum gap between two emitted progress rows
STATE_SCHEMA_VERSION = 1      # build ledger schema version
SHARD_DTYPE = "uint16"


def _positive(name: str, value) -> None:
    if value is None or value <= 0:
        raise ValueError(f"{name} must be greater than zero")


@dataclass(frozen=True)
class PackingConfig:
    """Geometry of the corpus: shard size S, window length T, stride."""

    shard_size: int = 100_000_000
    seq_len: int = 1024
    stride: int | None = None
    max_shards: int | None = None          # a limit only when given
    chunk_tokens: int = 65_536

    def __post_init__(self):
        _positive("shard_size", self.shard_size)
        _positive("seq_len", self.seq_len)
        if self.max_shards is not None:
            _positive("max_shards", self.max_shards)
        _positive("chunk_tokens", self.chunk_tokens)
        if self.stride is not None:
            _positive("stride", self.stride)

    @property
    def step(self) -> int:
        return self.seq_len if self.stride is None else self.stride

    @property
    def windows_per_shard(self) -> int:
        return windows_in(self.shard_size, self.seq_len, self.step)


def windows_in(n_tokens: int, seq_len: int, stride: int) -> int:
    """Windows of seq_len+1 tokens at the given stride in n tokens."""
    if seq_len <= 0 or stride <= 0:
        raise ValueError(f"no windows of length {seq_len} at stride {stride}: both must be positive")
    return max(0, (n_tokens - (seq_len + 1)) // stride + 1)


# Fixed names and SQL types of a stored training configuration.
CONFIG_COLUMNS = {
    "B": "long", "grad_accum_steps": "long", "T": "long", "learning_rate": "double", "min_lr": "double",
    "warmup_steps": "long", "max_steps": "long", "eval_interval": "long", "eval_batches": "long",
    "data_seed": "long", "num_processes": "long", "logit_softcap": "double", "vocab_size": "long",
}


@dataclass
class TrainConfig:
    """Training-side numbers the data plan needs (batching, schedule, evals)."""

    B: int = 16
    grad_accum_steps: int = 4
    T: int = 1024
    learning_rate: float = 1.2e-3
    min_lr: float = 1.2e-4
    warmup_steps: int = 200
    max_steps: int = 152587
    eval_interval: int = 250
    eval_batches: int = 20
    data_seed: int = 1337
    num_processes: int = 1
    logit_softcap: float = 15.0
    vocab_size: int = 49152
    decay_start_step: int = field(init=False)

    def __post_init__(self):
        for name in ("B", "grad_accum_steps", "T", "max_steps", "eval_interval",
                     "eval_batches", "num_processes"):
            _positive(name, getattr(self, name))
        if self.warmup_steps < 0:
            raise ValueError("warmup_steps cannot be negative")
        if self.min_lr < 0 or self.learning_rate <= 0:
            raise ValueError("learning rates must be positive")
        self.decay_start_step = int(0.8 * self.max_steps)

    @property
    def tokens_per_step(self) -> int:
        return self.B * self.grad_accum_steps * self.T * self.num_processes

    def to_metadata(self) -> dict:
        """The stored columns; what follows from them is worked out again on load."""
        return {name: getattr(self, name) for name in CONFIG_COLUMNS}

    @classmethod
    def from_metadata(cls, **values) -> "TrainConfig":
        extra = sorted(values.keys() - CONFIG_COLUMNS.keys())
        if extra:
            raise ValueError(f"not config columns: {', '.join(extra)}")
        return cls(**values)

    def to_json(self) -> str:
        return json.dumps(self.to_metadata(), sort_keys=True)


@dataclass(frozen=True)
class DecodeConfig:
    """Candidate-selection policy (C10) with the reference's bounds."""

    greedy: bool = False
    temperature: float = 1.0
    top_k: int = 0
    top_p: float = 1.0
    min_p: float = 0.0
    repetition_penalty: float = 1.0
    no_repeat_ngram_size: int = 0
    seed: int = 0

    def __post_init__(self):
        if not self.greedy and self.temperature <= 0:
            raise ValueError("temperature must be greater than zero unless greedy")
        if self.top_k < 0:
            raise ValueError("top_k cannot be negative")
        if not 0.0 < self.top_p <= 1.0:
            raise ValueError("top_p must be in (0, 1]")
        if not 0.0 <= self.min_p < 1.0:
            raise ValueError("min_p must be in [0, 1)")
        if self.repetition_penalty <= 0:
            raise ValueError("repetition_penalty must be greater than zero")
        if self.no_repeat_ngram_size < 0:
            raise ValueError("no_repeat_ngram_size cannot be negative")


@dataclass(frozen=True)
class BuildIdentity:
    """What a corpus build is pinned to; compared on resume (A4)."""

    dataset_id: str = "documents"
    dataset_config: str = "default"
    dataset_split: str = "train"
    dataset_revision: str = ""
    tokenizer_name: str = "bytes"
    tokenizer_revision: str = ""

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)


def check_vocab(vocab_size: int, eos_id: int | None) -> None:
    """The vocabulary must fit uint16 shards and define EOS."""
    if vocab_size > UINT16_MAX:
        raise ValueError(f"{vocab_size} ids do not fit two bytes")
    if eos_id is None:
        raise ValueError("the vocabulary has no end-of-text id")
