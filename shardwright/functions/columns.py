"""Column expressions (P2, P4, P6–P20): pure JVM built-ins, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.config import MATRIX_LR, TrainConfig


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# P2
def with_eos(df: DataFrame, eos: int, ids_col: str = "ids", n_col: str = "n_tokens") -> DataFrame:
    """Append EOS to every document (an empty text still yields one token)."""
    ids = F.concat(F.col(ids_col), F.array(F.lit(eos).cast("int")))
    return df.withColumn(ids_col, ids).withColumn(n_col, F.size(ids_col).cast("long"))


# P4
def xy(window: Column | str, seq_len: int) -> tuple[Column, Column]:
    """Inputs and targets of a T+1 window, shifted by one."""
    w = _c(window)
    return F.slice(w, 1, seq_len).alias("x"), F.slice(w, 2, seq_len).alias("y")


# P6
def truncate_left(ids: Column | str, keep: int) -> Column:
    """Keep the last ``max(1, keep)`` ids."""
    n = max(1, keep)
    c = _c(ids)
    return F.when(F.size(c) <= n, c).otherwise(F.slice(c, -n, n))


def prompt_budget(seq_len: int, max_new_tokens: int) -> int:
    return max(1, seq_len - max_new_tokens)


# P7
def stop_at_eos(ids: Column | str, eos: int, include_eos: bool = True) -> Column:
    """Cut a generated sequence at its first EOS (kept when ``include_eos``)."""
    c = _c(ids)
    pos = F.array_position(c, F.lit(eos))
    keep = pos if include_eos else pos - 1
    return F.when(pos == 0, c).otherwise(F.slice(c, 1, keep.cast("int")))


def pad_with_eos(ids: Column | str, length: Column | int, eos: int) -> Column:
    """Pad a finished row with EOS up to the batch's length."""
    c = _c(ids)
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(c, F.array_repeat(F.lit(eos), F.greatest(n - F.size(c), F.lit(0)).cast("int")))


# P8
def softcap(values: Column | str, cap: float) -> Column:
    """``cap·tanh(x/cap)`` elementwise over an array; off when cap ≤ 0."""
    c = _c(values)
    if cap <= 0:
        return c
    return F.transform(c, lambda x: F.lit(cap) * F.tanh(x / F.lit(cap)))


# P9
def wsd_lr(step: Column | str, cfg: TrainConfig) -> Column:
    """Warmup – stable – linear decay learning rate at a step."""
    s = _c(step)
    base, lo = F.lit(cfg.learning_rate), F.lit(cfg.min_lr)
    decay_len = max(1, cfg.max_steps - cfg.decay_start_step)
    warm = base * (s + 1) / F.lit(max(cfg.warmup_steps, 1))
    ratio = (s - F.lit(cfg.decay_start_step)) / F.lit(decay_len)
    decay = lo + (F.lit(1.0) - ratio) * (base - lo)
    return (F.when(s < cfg.warmup_steps, warm)
            .when(s < cfg.decay_start_step, base)
            .otherwise(decay))


def matrix_lr(lr: Column, cfg: TrainConfig) -> Column:
    return F.lit(MATRIX_LR) * (lr / F.lit(cfg.learning_rate))


# P10
def data_position(step: Column | str, accum: int, n_batches: int) -> tuple[Column, Column]:
    """Optimizer step → (epoch, batch offset); a negative step is an error."""
    s = _c(step)
    checked = F.when(s < 0, F.raise_error(F.lit("step cannot be negative"))).otherwise(s)
    consumed = checked * F.lit(accum)
    return (F.floor(consumed / F.lit(n_batches)).cast("long").alias("epoch"),
            F.pmod(consumed, F.lit(n_batches)).cast("long").alias("batch_offset"))


# P11
def progress_columns(step: Column | str, cfg: TrainConfig) -> list[Column]:
    s = _c(step)
    per = cfg.tokens_per_step
    return [
        (s * F.lit(per)).cast("long").alias("tokens_processed"),
        F.lit(per * cfg.max_steps).cast("long").alias("tokens_planned"),
        (F.lit(100.0) * s / F.lit(cfg.max_steps)).alias("progress_percent"),
    ]


# P12
def format_rate(rate: Column | str, unit: str) -> Column:
    """SI rate text; non-finite or ≤ 0 → "— unit/s".

    Exact half ties may round differently from Python's ``%`` formatting
    (half-up here, half-even of the binary value there).
    """
    r = _c(rate)
    bad = r.isNull() | F.isnan(r) | (r <= 0) | (r == float("inf"))
    return (F.when(bad, F.lit(f"— {unit}/s"))
            .when(r >= 1e9, F.format_string(f"%.2fG {unit}/s", r / 1e9))
            .when(r >= 1e6, F.format_string(f"%.2fM {unit}/s", r / 1e6))
            .when(r >= 1e3, F.format_string(f"%.1fk {unit}/s", r / 1e3))
            .otherwise(F.format_string(f"%.1f {unit}/s", r)))


# P13
def run_name(mode: Column | str, ts: Column | str, base: str) -> Column:
    """Fresh runs get a ``yyyyMMdd-HHmmss-`` prefix; resumed runs keep the base."""
    return F.when(_c(mode) == "fresh",
                  F.concat(F.date_format(_c(ts), "yyyyMMdd-HHmmss"), F.lit("-" + base))
                  ).otherwise(F.lit(base))


# P14
def parse_list(text: Column | str) -> Column:
    """Comma list → trimmed of ASCII white space, ordered, distinct; an empty result is an error."""
    blank = F.lit("\t\n\x0b\x0c\r ")
    parts = F.array_distinct(F.filter(F.transform(F.split(_c(text), ",", -1), lambda x: F.trim(x, blank)),
                                      lambda x: x != ""))
    return F.when(F.size(parts) == 0, F.raise_error(F.lit("the list names nothing"))
                  ).otherwise(parts)


def parse_list_py(value: str) -> list[str]:
    out: list[str] = []
    for part in value.split(","):
        p = part.strip()
        if p and p not in out:
            out.append(p)
    if not out:
        raise ValueError("the list names nothing")
    return out


# P15
ACCURACY_KEYS = ("acc,none", "acc_norm,none", "acc")   # fixed preference order


def select_accuracy(metrics: Column | str) -> Column:
    m = _c(metrics)
    return F.coalesce(*[F.element_at(m, F.lit(k)) for k in ACCURACY_KEYS])


# P16
def normalize_limit(limit: int | None) -> int | None:
    if limit is None or limit == 0:
        return None
    if limit < 0:
        raise ValueError("limit cannot be negative")
    return limit


# P17
def temperature(score: Column | str, t: float) -> Column:
    if t <= 0:
        raise ValueError("temperature must be greater than zero")
    return _c(score) / F.lit(float(t))


# P18
POSITIVE = ("B", "grad_accum_steps", "T", "max_steps", "eval_interval", "eval_batches", "num_processes", "learning_rate")
NOT_NEGATIVE = ("warmup_steps", "min_lr")


def config_faults(cfg: Column | str) -> Column:
    """The fields of a stored configuration (a struct) outside their bounds, in the bounds' order; a
    field that is not there has its default and is none."""
    c = _c(cfg)
    out = [F.when(c[n] <= 0, F.lit(n)) for n in POSITIVE] + [F.when(c[n] < 0, F.lit(n)) for n in NOT_NEGATIVE]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


# G8, G9
def split_sizes(n_tokens: Column | str, seq_len: int, stride: int, ratio: float) -> tuple[Column, Column, Column]:
    """Train windows, dev windows and whether the split is refused, for a corpus of one shard: a gap of
    ⌈T / stride⌉ windows lies between the sides, and neither may be empty."""
    n = F.greatest(F.lit(0), F.floor((_c(n_tokens) - (seq_len + 1)) / stride) + 1).cast("long")
    train = F.floor(n * F.lit(ratio)).cast("long")
    dev = n - F.least(n, train + (seq_len + stride - 1) // stride)
    return train, dev, (train == 0) | (dev == 0)


# P19
def is_eval_step(step: Column | str, interval: int, max_steps: int) -> Column:
    s = _c(step)
    return (F.pmod(s, F.lit(interval)) == 0) | (s == F.lit(max_steps))


# P20
def strip_padding(df: DataFrame, vocab_size: int, cand_col: str = "cand_id") -> DataFrame:
    """Drop candidates of the padded vocabulary tail (ids ≥ vocab_size)."""
    return df.filter(F.col(cand_col) < vocab_size)


def padded_vocab(vocab_size: int, multiple: int = 64) -> int:
    return ((vocab_size + multiple - 1) // multiple) * multiple
