"""Full validation over a logits table, and the summary file."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shardwright.operators.evaluate import cross_entropy, full_validation, sequence_loss
from shardwright.sources.sinks import write_summary


def validate(logits: DataFrame, seq_len: int, cap: float = 0.0, out: str | None = None) -> DataFrame:
    """``(seq_index, logits, target)`` per position → one summary row
    (loss = mean of sequence means, perplexity, sequences, tokens)."""
    summary = full_validation(sequence_loss(cross_entropy(logits, cap=cap)), seq_len)
    if out:
        write_summary(summary, out)
    return summary
